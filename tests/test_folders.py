"""Files in folders by key, written by tasks: what Spark's writers would have written, and nothing partial."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from bomspark.session import bound_listing
from bomspark.sinks.documents import TAG_END, write_documents
from bomspark.sinks.folders import ESCAPED, write_parquet, write_texts

ODD = ["a", "c d=1", "x/y", "100%", "é:*", None, "", "#'\"?\\{[]^", "tab\there", "🙂", "A"]


def held(root):
    """{folder: the bytes of its files one behind the other}"""
    out = {}
    for path in sorted(glob.glob(f"{glob.escape(root)}/**/part-*", recursive=True)):
        folder = os.path.dirname(os.path.relpath(path, root))
        out[folder] = out.get(folder, b"") + open(path, "rb").read()
    return out


def test_folders_and_bytes_equal_those_of_spark(spark, tmp_path):
    rows = [(p, f, "".join(f"{p} {f} {i};" for i in range(n))) for n, p in enumerate(ODD) for f in (1, 2)]
    df = spark.createDataFrame(rows, "project string, file int, value string").repartition(3, "project", "file").sortWithinPartitions("project", "file")
    df = df.withColumn("value", F.concat("value", F.lit(";")))
    write_texts(df, str(tmp_path / "a"), ["project", "file"], end=";")
    df.withColumn("value", F.expr("substring(value, 1, length(value) - 1)")).write.partitionBy("project", "file").option("lineSep", ";").text(str(tmp_path / "b"))
    a, b = held(str(tmp_path / "a")), held(str(tmp_path / "b"))
    # null and '' share a folder, where the order of the two writers may differ
    assert {k: sorted(v.split(b";")) for k, v in a.items()} == {k: sorted(v.split(b";")) for k, v in b.items()} and len(a) == 20
    assert not glob.glob(f"{tmp_path}/a/**/.part*", recursive=True)  # no checksum files: Hadoop's client made no file
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and os.path.exists(tmp_path / "a" / "_SUCCESS")


def test_every_escaped_character(spark, tmp_path):
    df = spark.createDataFrame([(f"a{c}b", "x\n") for c in ESCAPED], "p string, value string").coalesce(1).sortWithinPartitions("p")
    write_texts(df, str(tmp_path / "a"), ["p"])
    df.write.partitionBy("p").text(str(tmp_path / "b"))
    assert held(str(tmp_path / "a")).keys() == held(str(tmp_path / "b")).keys() and len(held(str(tmp_path / "a"))) == len(ESCAPED)


def test_parquet_reads_back_with_sparks_types(spark, tmp_path):
    df = spark.sql("""SELECT id % 3 AS project_id, id AS k, cast(id AS tinyint) AS b, cast(id AS double) / 3 AS d, cast(id AS decimal(20, 3)) AS m,
        if(id % 2 = 0, 'é', NULL) AS s, date'1998-06-01' AS day, timestamp'1998-06-01 09:30:00.123456' AS t, timestamp_ntz'1600-01-01 00:00:00' AS n,
        id > 3 AS yes, cast('x' AS binary) AS raw FROM range(50)""").repartition(2, "project_id").sortWithinPartitions("project_id", "k")
    for writer, name in ((write_parquet, "a"), (lambda d, p, f: d.write.partitionBy(*f).parquet(p), "b")):
        writer(df, str(tmp_path / name), ["project_id"])
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    assert a.schema == b.schema
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 50
    assert not glob.glob(f"{tmp_path}/a/**/.part*", recursive=True)
    listed = spark.sql("SELECT 1 AS project_id, array(1) AS v")  # no plain values: by Spark's writer
    write_parquet(listed, str(tmp_path / "c"), ["project_id"])
    assert spark.read.parquet(str(tmp_path / "c")).first().v == [1]


def test_a_failed_write_leaves_nothing_and_keeps_what_was_there(spark, tmp_path):
    out = str(tmp_path / "d")
    parts = spark.createDataFrame([(i, 0, 0, f"<p{i}>") for i in range(4)], "project_id int, part_no int, chunk_no long, html string")
    write_documents(parts, out, "html", end=TAG_END)
    before = held(out)
    with pytest.raises(Exception, match="does not end"):
        write_documents(parts.withColumn("html", F.lit("no end")), out, "html", end=TAG_END)
    assert held(out) == before and len(before) == 4 and os.listdir(tmp_path) == ["d"]
    write_documents(parts.filter("project_id = 1"), out, "html", end=TAG_END)  # overwrite leaves no other project
    assert held(out) == {"project_id=1": b"<p1>"}
    with pytest.raises(Exception, match="(?i)already.exists"):
        write_documents(parts, out, "html", mode="error", end=TAG_END)
    write_documents(parts, out, "html", mode="append", end=TAG_END)
    assert held(out)["project_id=1"] == b"<p1><p1>" and len(held(out)) == 4


def test_folders_are_listed_by_few_tasks(spark):
    key, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    try:
        for before, after in ((10_000, tasks), (1, 1)):
            spark.conf.set(key, before)
            bound_listing(spark)
            assert int(spark.conf.get(key)) == after
    finally:
        spark.conf.unset(key)
