"""One project holding a third of all lines (and of all families).

The driver's BOM is reshaped so that every third supplier's lines belong to
project 0.  The analysis and every report output are computed twice: as
planned (window numbering, one chunk per table) and with the numbering forced
onto the range-sorted path and tiny text chunks; the results must be equal.
"""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from bomspark.operators import report
from bomspark.plans.procurement import analyse_bom
from bomspark.sources.catalogue import catalogue_from_entries
from bomspark.sources.tables import AS_OF, TEST_CATALOGUE, bom_view

AS_OF_TEXT = AS_OF


@pytest.fixture(scope="module")
def hot(spark):
    bom = bom_view(spark, SF_SMALL).withColumn(
        "project_id", F.when(F.col("project_id") % 3 == 0, F.lit(0)).otherwise(F.col("project_id")))
    a = analyse_bom(bom, catalogue_from_entries(spark, TEST_CATALOGUE),
                    project_start="1998-09-01 00:00:00", as_of=AS_OF_TEXT)
    return bom, a


def _parts(df, col):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["project_id"], r["part_no"], r["chunk_no"])):
        out[r["project_id"]] = out.get(r["project_id"], "") + r[col]
    return out


def test_hot_project_really_is_hot(hot):
    bom, a = hot
    lines = bom.groupBy("project_id").count()
    top = lines.orderBy(F.col("count").desc()).first()
    assert top["project_id"] == 0 and top["count"] * 4 > bom.count()
    assert a.group_bound >= a.summary.filter("project_id = 0").count() > 40


def test_reports_equal_on_forced_distributed_path(hot):
    _, a = hot
    lines_w = report.report_lines(a.kpis, a.lead_times, a.delivery, a.spend, a.summary, a.bom_lines, AS_OF_TEXT,
                                  bound=a.group_bound)
    lines_r = report.report_lines(a.kpis, a.lead_times, a.delivery, a.spend, a.summary, a.bom_lines, AS_OF_TEXT,
                                  one_task_rows=0)
    assert lines_w.exceptAll(lines_r).count() == 0 and lines_r.exceptAll(lines_w).count() == 0

    frags_w = report.html_fragments(a.lead_times, a.delivery, a.spend, a.summary, bound=a.group_bound)
    frags_r = report.html_fragments(a.lead_times, a.delivery, a.spend, a.summary, chunk_lines=8,
                                    one_task_rows=0)
    assert frags_r.filter("project_id = 0").agg(F.max("chunk_no")).first()[0] >= 5
    assert (_parts(report.html_documents(a.kpis, frags_r, AS_OF_TEXT), "html")
            == _parts(report.html_documents(a.kpis, frags_w, AS_OF_TEXT), "html"))

    p_w = report.project_prompts(a.kpis, a.summary, a.lead_times, a.delivery, bound=a.group_bound)
    p_r = report.project_prompts(a.kpis, a.summary, a.lead_times, a.delivery, chunk_lines=8, one_task_rows=0)
    assert _parts(p_r, "prompt") == _parts(p_w, "prompt")


def test_hot_project_lines_numbered_densely(hot):
    _, a = hot
    lines = report.report_lines(a.kpis, a.lead_times, a.delivery, a.spend, a.summary, a.bom_lines, AS_OF_TEXT,
                                one_task_rows=0)
    fam = [r["line_no"] for r in lines.filter("project_id = 0 AND section_no = 6").collect()]
    assert sorted(fam) == list(range(len(fam)))   # heading at 0, families 1..n
