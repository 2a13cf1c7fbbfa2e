"""Tables written by project: files made by tasks, and one pass over them when they are read back."""

import glob
import os

from pyspark.sql import functions as F

from bomspark.sinks.tables import count_files, read_tables, stored_files, table_digests, write_by_project


def tables(spark):
    rows = spark.range(900).select((F.col("id") % 7).alias("project_id"), "id", F.when(F.col("id") % 5 > 0, F.lit("x")).alias("s"))
    return {"t": (rows, ["id"]), "none": (rows.filter("false"), [])}


def test_files_are_made_by_tasks(spark, tmp_path):
    paths = write_by_project(tables(spark), str(tmp_path / "out"), file_rows=50)
    assert len(glob.glob(f"{paths['t']}/project_id=*/part-*.parquet")) > 7
    assert not glob.glob(f"{tmp_path}/out/**/.part*", recursive=True)  # no checksum files


def test_one_pass_gives_the_same_counts_and_digests(spark, tmp_path):
    made = {"t": tables(spark)["t"]}
    paths = write_by_project(made, str(tmp_path / "out"), file_rows=50)
    read = read_tables(spark, paths) | {"none": read_tables(spark, paths)["t"].filter("false")}
    stored = stored_files(read)
    assert [c for c, _ in stored.dtypes] == ["table_name", "project_id", "file", "rows", "digest"]
    again = table_digests(read, stored)
    assert again.dtypes == table_digests(read).dtypes
    assert sorted(again.collect()) == sorted(table_digests(read).collect()) and {r.rows for r in again.collect()} == {900, 0}
    files = lambda **x: sorted(count_files(paths, spark, read=read, **x).collect())
    assert files(stored=stored) == files()
    for f in glob.glob(f"{tmp_path}/out/t/project_id=*/part-*.parquet"):
        os.remove(f)
    assert again.filter("table_name = 't'").first().rows == 900  # the files are not opened again
