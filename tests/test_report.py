"""Report outputs on a small BOM: ordering of report lines, fallbacks
("None identified.", "No issues found."), HTML escaping, prompt layout."""

import pytest

from bomspark import fixed_values as fv
from bomspark.operators import report
from bomspark.plans.procurement import analyse_bom

SCHEMA = ("project_id string, file_id string, line_no bigint, family string, type string, "
          "panel_name string, level string, count bigint")
ROWS = [
    ("a", "f1", 1, "Dry Type Transformer", "75 kVA", "T-1", "Basement B1", 2),
    ("a", "f1", 2, "Pull Box <x>", "", "PB-1", "Roof", 3),
    ("b", "f2", 1, "Widget", "W", "P-1", "Level 2", 1),
]


AS_OF = "2026-02-12 09:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    bom = spark.createDataFrame(ROWS, SCHEMA)
    a = analyse_bom(bom, project_start="2026-06-01 00:00:00", as_of="2026-02-12 09:00:00")
    return bom, a


def test_report_lines_order(tables):
    _, a = tables
    lines = report.report_lines(a.kpis, a.lead_times, a.delivery, a.spend, a.summary, a.bom_lines,
                                "2026-02-12 09:00:00")
    got = [r["line"] for r in lines.filter("project_id = 'a'")
           .orderBy("section_no", "file_id", "line_no").collect()]
    assert got[:2] == [fv.REPORT_TITLE, "Generated: 2026-02-12 09:00"]
    assert got[2:7] == [fv.REPORT_HEADINGS[1], "Total equipment units: 5", "Order lines (BOM rows): 2",
                        "Data quality issues: 1", "Estimated procurement spend: $37,050 USD"]
    i = got.index(fv.REPORT_HEADINGS[3])
    assert got[i + 2].startswith(fv.STATUS_OVERDUE + " Dry Type Transformer — Lead time: 16–24 wks")
    i = got.index(fv.REPORT_HEADINGS[4])
    assert got[i + 1] == "Phase 1: Basement B1 — 2 units — " + fv.ACTION_MAIN
    assert got[i + 2] == "Phase 2: Roof — 3 units — " + fv.ACTION_ROOF
    i = got.index(fv.REPORT_HEADINGS[5])
    assert got[i + 1] == "Total estimated procurement value: $37,050 USD (indicative)"
    assert got[i + 2] == fv.TIER_MEDIUM + "  Dry Type Transformer: 2 units × $18,000 = $36,000"
    assert got[-1] == "Pull Box <x> | Type:  | Panel: PB-1 | Level: Roof | Qty: 3"


def test_html_items_fallback_and_escape(tables):
    _, a = tables
    items = report.html_items(a.bom_lines)
    issues = {r["project_id"]: r["html"] for r in items.filter("kind = 'issue'").collect()}
    assert issues["b"] == fv.NO_ISSUES_ITEM
    assert issues["a"] == "<li>Pull Box &lt;x&gt; (): Type undefined</li>"
    assert items.filter("kind = 'item'").count() == 3


def test_prompt_sections(tables):
    _, a = tables
    p = {r["project_id"]: r["prompt"] for r in report.assemble(report.project_prompts(
        a.kpis, a.summary, a.lead_times, a.delivery), "prompt").collect()}
    assert "- Total units: 1\n" in p["b"]
    assert "Family | Count\nWidget | 1\n" in p["b"]
    crit_b = p["b"].split(fv.PROMPT_CRITICAL + "\n")[1].split("\n\n")[0]
    crit_a = p["a"].split(fv.PROMPT_CRITICAL + "\n")[1].split("\n\n")[0]
    assert crit_a.startswith("Family | Lead Time Max (wks) | Order By Date\nDry Type Transformer | 24 | 2025-12-15")
    assert crit_b in (fv.NONE_IDENTIFIED, "Family | Lead Time Max (wks) | Order By Date\nWidget | 12 | 2026-03-09")
    assert p["a"].endswith(fv.PROMPT_TASKS)


def test_html_document(tables):
    _, a = tables
    frags = report.html_fragments(a.lead_times, a.delivery, a.spend, a.summary)
    parts = report.html_documents(a.kpis, frags, "2026-02-12 09:00:00")
    docs = {r["project_id"]: r["html"] for r in report.assemble(parts, "html").collect()}
    d = docs["a"]
    assert d.startswith("<!DOCTYPE html>") and d.endswith("</body></html>")
    assert "<h2>$37k</h2>" in d
    assert "<li><strong>Pull Box &lt;x&gt;</strong>: 3 units</li>" in d
    assert d.index("Dry Type Transformer</td>") < d.index("Pull Box &lt;x&gt;</td>")


def _parts_text(df, col):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["project_id"], r["part_no"], r["chunk_no"])):
        out[r["project_id"]] = out.get(r["project_id"], "") + r[col]
    return out


def test_chunked_parts_equal_whole_text(tables):
    """Small chunks and the distributed numbering give the same documents,
    prompts and report lines as one chunk per table and a window."""
    _, a = tables
    args = (a.lead_times, a.delivery, a.spend, a.summary)
    whole = report.html_fragments(*args)
    split = report.html_fragments(*args, chunk_lines=1, one_task_rows=0)
    assert split.filter("project_id = 'a' AND fragment = 'lead_rows'").count() == 2
    docs = _parts_text(report.html_documents(a.kpis, whole, AS_OF), "html")
    assert _parts_text(report.html_documents(a.kpis, split, AS_OF), "html") == docs
    pw = report.project_prompts(a.kpis, a.summary, a.lead_times, a.delivery)
    ps = report.project_prompts(a.kpis, a.summary, a.lead_times, a.delivery, chunk_lines=1, one_task_rows=0)
    assert _parts_text(ps, "prompt") == _parts_text(pw, "prompt")
    lw = report.report_lines(a.kpis, a.lead_times, a.delivery, a.spend, a.summary, a.bom_lines, AS_OF)
    ls = report.report_lines(a.kpis, a.lead_times, a.delivery, a.spend, a.summary, a.bom_lines, AS_OF,
                             one_task_rows=0)
    assert sorted(map(str, lw.collect())) == sorted(map(str, ls.collect()))
