"""The project list as the spine: projects whose files yield nothing stay in every output."""

import pytest
from conftest import write_file
from pyspark.sql import functions as F
from test_golden import REVIT_CSV

from bomspark import fixed_values as fv
from bomspark.operators import report
from bomspark.plans.procurement import analyse_bom, analyse_files
from bomspark.sinks.tables import RUN, read_tables, result_tables, write_tables

AS_OF = "2026-02-12 09:00:00"
SCHEMA = ("project_id string, file_id string, line_no bigint, family string, type string, "
          "panel_name string, level string, count bigint")


def documents(a):
    frags = report.html_fragments(a.lead_times, a.delivery, a.spend, a.summary)
    pages = report.html_documents(a.kpis, frags, AS_OF, report.html_cards(a.bom_lines, a.projects))
    prompts = report.project_prompts(a.kpis, a.summary, a.lead_times, a.delivery)
    return ({r.project_id: r.html for r in report.assemble(pages, "html").collect()},
            {r.project_id: r.prompt for r in report.assemble(prompts, "prompt").collect()})


def test_project_without_lines_and_without_issues(spark):
    bom = spark.createDataFrame([("b", "f", 1, "Widget", "W", "P-1", "Level 2", 1)], SCHEMA)
    projects = spark.createDataFrame([("a",), ("b",), ("b",)], "project_id string")
    a = analyse_bom(bom, project_start="2030-06-01", as_of=AS_OF, projects=projects)
    kpis = {r.project_id: tuple(r)[1:] for r in a.kpis.collect()}
    assert kpis == {"a": (0, 0, 0, 0, 0, 0), "b": (1, 1, 0, 1, 1500, 0)}
    assert {r.project_id: r.total_spend_usd for r in a.total_spend.collect()} == {"a": "$0", "b": "$1,500"}
    pages, prompts = documents(a)
    assert set(pages) == set(prompts) == {"a", "b"}
    for p in "ab":
        assert fv.NO_ISSUES_ITEM in pages[p] and pages[p].endswith("</body></html>")
        assert f"({kpis[p][1]} lines)" in pages[p]
    assert pages["a"].count("</tr>\n  </table>") == 3 and "item-row" not in pages["a"]
    assert pages["b"].count("item-row") == 1
    assert prompts["a"].count(fv.NONE_IDENTIFIED + "\n") == 3 and prompts["b"].count(fv.NONE_IDENTIFIED) == 1
    assert prompts["a"].endswith(fv.PROMPT_TASKS)
    lines = report.report_lines(a.kpis, a.lead_times, a.delivery, a.spend, a.summary, a.bom_lines, AS_OF)
    assert lines.filter("project_id = 'a'").filter(F.col("line") == "Total equipment units: 0").count() == 1


def test_empty_bom_with_projects(spark):
    a = analyse_bom(spark.createDataFrame([], SCHEMA), as_of=AS_OF, projects=spark.createDataFrame([("a",)], "project_id string"))
    pages, prompts = documents(a)
    assert list(pages) == list(prompts) == ["a"]


def test_files_that_all_fail_keep_their_project(spark, tmp_path):
    landing = str(tmp_path / "in")
    write_file(landing + "/project=good", "a.csv", REVIT_CSV)
    write_file(landing + "/project=bad", "a.csv", "no,header\n")
    write_file(landing + "/project=empty", "a.csv", "")
    write_file(landing + "/project=hidden", "_a.csv", REVIT_CSV)
    a = analyse_files(spark, landing, as_of=AS_OF)
    kpis = {r.project_id: r.bom_lines for r in a.kpis.collect()}
    assert set(kpis) == {"good", "bad", "empty", "hidden"}
    assert kpis["good"] > 0 and kpis["bad"] == kpis["empty"] == kpis["hidden"] == 0
    assert set(documents(a)[0]) == set(kpis)


def test_instant_is_written_with_the_tables(spark, tmp_path):
    bom = spark.createDataFrame([("b", "f", 1, "Widget", "W", "P-1", "Level 2", 1)], SCHEMA)
    a = analyse_bom(bom)  # as of now
    tables = read_tables(spark, write_tables(result_tables(a), str(tmp_path / "out")))
    run = tables[RUN].collect()
    assert len(run) == 1
    lead = tables["Lead_Time_Estimator"].first()
    assert (run[0].default_start.date() - lead.order_by_date).days == 7 * lead.lead_max_weeks
    assert run[0].default_start.date() - run[0].as_of.date() == __import__("datetime").timedelta(140)


@pytest.mark.parametrize("chunk, ranked", [(1, 0), (3, 0), (2, 10**9), (10_000, 10**9)])
def test_cards_hold_every_line_once(spark, chunk, ranked):
    """One project with most lines in several files; chunks and numbering change nothing."""
    rows = [("hot" if i % 10 < 7 else f"p{i % 3}", f"f{i % 4}", i // 7, f"Fam {i % 5}", "" if i % 4 == 0 else "T", "P", "L", i) for i in range(400)]
    rows += rows[:5]  # repeated lines
    rows += [("clean", None, i, "F", "T", "P", "L", i) for i in range(5)]
    a = analyse_bom(spark.createDataFrame(rows, SCHEMA).repartition(5), as_of=AS_OF)
    cards = report.html_cards(a.bom_lines, None, chunk, one_task_rows=ranked)
    got = {}
    for r in sorted(cards.collect(), key=lambda r: (r.project_id, r.fragment, r.chunk_no)):
        got.setdefault((r.project_id, r.fragment), []).append(r.html)
    for project in ("hot", "p0", "p1", "p2", "clean"):
        mine = sorted((r for r in rows if r[0] == project), key=lambda r: (r[1] or "", r[2], r[3], r[4], r[7]))
        item = [f"Qty: {r[7]}</small>" for r in mine]
        text = "".join(got[project, "item_list"])
        assert sorted(text.count(x) for x in set(item)) == sorted(item.count(x) for x in set(item))
        order = [text.index(x) for x in item]
        files = [r[1] or "" for r in mine]
        first = {f: min(o for o, g in zip(order, files) if g == f) for f in files}
        assert [f for f in sorted(first)] == sorted(first, key=first.get)  # file by file
        assert len(got[project, "item_list"]) == -(-len(mine) // chunk)
        issues = sum(r[4] == "" for r in mine)
        assert "".join(got[project, "issue_list"]).count("<li>") == max(1, issues)
        if not issues:
            assert got[project, "issue_list"] == [fv.NO_ISSUES_ITEM]
