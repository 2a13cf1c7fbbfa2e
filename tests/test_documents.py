"""Documents written as ordered text files."""

import glob
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from bomspark import fixed_values as fv
from bomspark.operators import report
from bomspark.plans import queries
from bomspark.sinks.documents import (B, LINE_END, P, PART_ORDER, REPORT_ORDER, TAG_END, _power, file_digests,
                                      part_digests, read_document, with_line_ends, write_documents)
from bomspark.sinks.landing import TASK_FILES


def test_report_lines_keep_their_order(spark, tmp_path):
    lines = queries.q_report_lines(spark, SF_SMALL)
    out = write_documents(with_line_ends(lines).repartition(7), str(tmp_path / "reports"), "line", REPORT_ORDER)
    rows = lines.collect()
    for project in sorted({r.project_id for r in rows})[:3]:
        mine = [r for r in rows if r.project_id == project]
        # equal order keys (line numbers that occur twice in a file) may swap
        want = sorted(((r.section_no, r.file_id or "", r.line_no), r.line) for r in mine)
        got = read_document(spark, out, project).split("\n")
        assert got.pop() == ""
        assert sorted(got) == sorted(line for _, line in want)
        keys = {}
        for k, line in want:
            keys.setdefault(line, []).append(k)
        last = (-1, "", -1)
        for line in got:
            k = min((k for k in keys[line] if k >= last), default=None)
            assert k is not None
            last = k


def test_pages_equal_the_assembled_ones(spark, tmp_path):
    """Byte for byte, with every line and issue once."""
    parts = queries.q_html_documents(spark, SF_SMALL)
    out = write_documents(parts.repartition(5), str(tmp_path / "pages"), "html", end=TAG_END)
    pages = {r.project_id: r.html for r in report.assemble(parts, "html").collect()}
    kpis = {r.project_id: r for r in queries.q_project_kpis(spark, SF_SMALL).collect()}
    for project in sorted(pages)[:3]:
        page = read_document(spark, out, project)
        assert page == pages[project]
        assert page.count("<div class='item-row'>") == kpis[project].bom_lines
        issues = page.split(fv.PAGE_ISSUES)[1].split("</ul>")[0]
        assert issues.count("<li>") == max(1, kpis[project].issues)


def test_prompts_equal_the_assembled_ones(spark, tmp_path):
    parts = queries.q_project_prompts(spark, SF_SMALL)
    out = write_documents(parts, str(tmp_path / "prompts"), "prompt")
    prompts = {r.project_id: r.prompt for r in report.assemble(parts, "prompt").collect()}
    for project in sorted(prompts)[:3]:
        assert read_document(spark, out, project) == prompts[project]


PIECES = [("b", 1, 0, "x>"), ("a", 0, 0, "<p>é>"), ("a", 1, 1, "\n>>"), ("a", 1, 0, "tail \r\n>"), ("a", 2, 0, ">"), ("c d=1", 0, 0, "🙂>")]


def plain_digest(text, end):
    import hashlib

    pieces = text.split(end)[:-1]
    return (len(pieces), len(text.encode()),
            sum(int(hashlib.md5(p.encode()).hexdigest()[:7], 16) * pow(1_000_003, j, 2**31 - 1) for j, p in enumerate(pieces)) % (2**31 - 1))


def test_digests(spark, tmp_path):
    """Digests of parts, of files and of whole texts agree, also when the order is found by
    ranges; a lost or moved part shows."""
    parts = spark.createDataFrame(PIECES, "project_id string, part_no int, chunk_no long, html string")
    texts = {}
    for p, _, _, t in sorted(PIECES):
        texts[p] = texts.get(p, "") + t
    want = {p: plain_digest(t, TAG_END) for p, t in texts.items()}

    def rows(df):
        return {r.project_id: (r.pieces, r.bytes, r.digest) for r in df.collect()}

    out = write_documents(parts, str(tmp_path / "d"), "html", end=TAG_END)
    for limit in (1_000_000, 0):
        assert rows(part_digests(parts, "html", PART_ORDER, TAG_END, one_task_rows=limit)) == want
        assert rows(file_digests(spark, out, "string", TAG_END, one_task_rows=limit)) == want
    moved = parts.withColumn("chunk_no", 1 - F.col("chunk_no"))
    assert rows(part_digests(moved, "html", PART_ORDER, TAG_END))["a"] != want["a"]
    assert read_document(spark, out, "a") == texts["a"]


def test_digests_of_files_read_in_blocks(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i % 2, i, 0, "".join(rng.choice("abé\n ") for _ in range(rng.randrange(60))) + LINE_END) for i in range(4000)]
    parts = spark.createDataFrame(rows, "project_id int, part_no int, chunk_no long, prompt string")
    out = write_documents(parts.coalesce(1), str(tmp_path / "d"), "prompt")
    want = {p: plain_digest("".join(r[3] for r in rows if r[0] == p), LINE_END) for p in (0, 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        got = {r.project_id: (r.pieces, r.bytes, r.digest) for r in file_digests(spark, out, "int").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_a_part_without_its_end_stops_the_job(spark, tmp_path):
    parts = spark.createDataFrame([("a", 0, 0, "no end")], "project_id string, part_no int, chunk_no long, html string")
    with pytest.raises(Exception, match="does not end"):
        write_documents(parts, str(tmp_path / "d"), "html", end=TAG_END)


def test_powers_of_the_digest(spark):
    n = [0, 1, 255, 256, P - 2, P - 1, P, (1 << 33) - 1, (1 << 48) - 1]
    got = spark.createDataFrame([(x,) for x in n], "n bigint").select("n", F.expr(_power("n")).alias("p")).collect()
    assert {r.n: r.p for r in got} == {x: pow(B, x, P) for x in n}
    assert len(_power("n")) < 20_000 and "aggregate" not in _power("n")


def test_tasks_follow_the_number_of_folders(spark, tmp_path):
    parts = spark.range(3 * TASK_FILES).select(F.col("id").alias("project_id"), F.lit(0).alias("part_no"), F.lit(0).alias("chunk_no"),
                                               F.lit("<p>").alias("html"))
    out = write_documents(parts, str(tmp_path / "pages"), "html", PART_ORDER, end=TAG_END)
    files = glob.glob(f"{out}/project_id=*/part-*")
    assert len(files) == 3 * TASK_FILES
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) == 3  # small files of one task before
