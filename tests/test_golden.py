"""Golden files: two hand-checked schedules (one per layout) read from disk
through the whole chain, compared with outputs derived by hand."""

import datetime as dt

import pytest
from conftest import write_file

from bomspark import fixed_values as fv
from bomspark.plans.procurement import analyse_files

REVIT_CSV = """Electrical Equipment Schedule,,,,
Family,Type,Panel Name,Level,Count
Panelboard 208V,,,,3
Panelboard 208V,125 A,LP-1,Level 1,1
Panelboard 208V,225 A,,Level 2,2
Dry Type Transformer,75 kVA,T-1,Basement B1,2
Dry Type Transformer,N/A,T-2,Roof,1
Heat Pump Fan,,HP,,4
PV Inverter,10 kW,INV-1,Roof,"1,000"
Pull Box,12x12,PB-1,B2,2.7
Grand total: 12,,,,
"""

GURTZ_CSV = """,,,PANELBOARD SCHEDULE,,
Level,Location,Mains,Panel Name,Bus,Type
Level 1,Elec Rm,MLO,LP-1,100,NQ
,,,,,
Level,Location,Mains,Panel Name,Bus,Type
Level 2,Elec Rm,MCB,LP-2,225,
,Closet,MCB,LP-3,225,NF
Parking P1,Yard,MCB,MDP,800,I-Line
"""

START = "2026-06-01 00:00:00"
AS_OF = "2026-02-12 09:00:00"


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("golden")
    write_file(str(root / "project=rv"), "schedule.csv", REVIT_CSV)
    write_file(str(root / "project=gz"), "panels.csv", GURTZ_CSV)
    write_file(str(root / "project=bad"), "notes.csv", "just,some\ntext,here\n")
    return analyse_files(spark, str(root), project_start=START, as_of=AS_OF)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bom_lines(analysis):
    got = rows(analysis.bom_lines, "project_id", "family", "type", "panel_name", "level", "count", "issues")
    assert got == sorted([
        ("rv", "Panelboard 208V", "125 A", "LP-1", "Level 1", 1, ""),
        ("rv", "Panelboard 208V", "225 A", "", "Level 2", 2, "Panel not assigned"),
        ("rv", "Dry Type Transformer", "75 kVA", "T-1", "Basement B1", 2, ""),
        ("rv", "Dry Type Transformer", "", "T-2", "Roof", 1, "Type undefined"),
        ("rv", "Heat Pump Fan", "", "HP", "", 4, "Type undefined; Level missing"),
        ("rv", "Pull Box", "12x12", "PB-1", "B2", 2, ""),
        ("gz", "Panelboard", "NQ", "LP-1", "Level 1", 1, ""),
        ("gz", "Panelboard", "", "LP-2", "Level 2", 1, "Type undefined"),
        ("gz", "Panelboard", "NF", "LP-3", "", 1, "Level missing"),
        ("gz", "Panelboard", "I-Line", "MDP", "Parking P1", 1, ""),
    ])
    layouts = rows(analysis.bom_lines.select("project_id", "layout").distinct(), "project_id", "layout")
    assert layouts == [("gz", "gurtz"), ("rv", "revit")]


def test_summary(analysis):
    assert rows(analysis.summary, "project_id", "family", "count") == sorted([
        ("rv", "Heat Pump Fan", 4), ("rv", "Dry Type Transformer", 3), ("rv", "Panelboard 208V", 3),
        ("rv", "Pull Box", 2), ("gz", "Level 1", 1), ("gz", "Level 2", 1), ("gz", "Parking P1", 1),
    ])


def test_lead_times(analysis):
    got = rows(analysis.lead_times, "project_id", "family", "lead_min_weeks", "lead_max_weeks",
               "order_by_date", "days_until_deadline", "status")
    d = dt.date
    w = ("gz", 6, 12, d(2026, 3, 9), 24, fv.STATUS_WARNING)
    assert got == sorted([
        ("rv", "Dry Type Transformer", 16, 24, d(2025, 12, 15), -60, fv.STATUS_OVERDUE),
        ("rv", "Panelboard 208V", 8, 14, d(2026, 2, 23), 10, fv.STATUS_CRITICAL),
        ("rv", "Heat Pump Fan", 6, 12, d(2026, 3, 9), 24, fv.STATUS_WARNING),
        ("rv", "Pull Box", 2, 4, d(2026, 5, 4), 80, fv.STATUS_OK),
        (w[0], "Level 1", *w[1:]), (w[0], "Level 2", *w[1:]), (w[0], "Parking P1", *w[1:]),
    ])
    crit = rows(analysis.critical_items, "project_id", "family")
    assert crit == [("rv", "Dry Type Transformer"), ("rv", "Panelboard 208V")]


def test_delivery(analysis):
    got = rows(analysis.delivery, "project_id", "delivery_phase", "level", "total_units", "recommended_action")
    std, main, roof = fv.ACTION_STANDARD, fv.ACTION_MAIN, fv.ACTION_ROOF
    assert got == sorted([
        ("rv", 1, "B2", 2, std), ("rv", 2, "Basement B1", 2, main), ("rv", 3, "Level 1", 1, std),
        ("rv", 4, "Level 2", 2, std), ("rv", 5, "", 4, std), ("rv", 6, "Roof", 1, roof),
        ("gz", 1, "Parking P1", 1, main), ("gz", 2, "Level 1", 1, std), ("gz", 3, "Level 2", 1, std),
        ("gz", 4, "", 1, std),
    ])


def test_spend(analysis):
    got = rows(analysis.spend, "project_id", "family", "count", "unit_cost", "estimated_total", "spend_tier")
    assert got == sorted([
        ("rv", "Dry Type Transformer", 3, 18000, 54000, fv.TIER_MEDIUM),
        ("rv", "Heat Pump Fan", 4, 3200, 12800, fv.TIER_LOW),
        ("rv", "Panelboard 208V", 3, 3500, 10500, fv.TIER_LOW),
        ("rv", "Pull Box", 2, 350, 700, fv.TIER_LOW),
        ("gz", "Level 1", 1, 1500, 1500, fv.TIER_LOW),
        ("gz", "Level 2", 1, 1500, 1500, fv.TIER_LOW),
        ("gz", "Parking P1", 1, 1500, 1500, fv.TIER_LOW),
    ])
    totals = rows(analysis.total_spend, "project_id", "total_spend", "total_spend_usd", "total_spend_k")
    # the project whose file fails stays, with nothing spent
    assert totals == [("bad", 0, "$0", "0k"), ("gz", 4500, "$4,500", "4k"), ("rv", 78000, "$78,000", "78k")]


def test_kpis(analysis):
    got = rows(analysis.kpis, "project_id", "total_units", "bom_lines", "issues", "families",
               "total_spend", "critical_items")
    # the project whose file fails stays, with zeros
    assert got == [("bad", 0, 0, 0, 0, 0, 0), ("gz", 4, 4, 2, 3, 4500, 0), ("rv", 12, 6, 3, 4, 78000, 2)]


def test_rejects(analysis):
    got = rows(analysis.rejects, "project_id", "reason")
    assert got == [("bad", fv.REJECT_NO_FAMILY)]


def test_project_spread_over_files(spark, tmp_path):
    """A project's schedules may span several files (and layouts): per-file
    steps stay per file, per-project tables add them up."""
    write_file(str(tmp_path / "project=p"), "a.csv", REVIT_CSV)
    write_file(str(tmp_path / "project=p"), "b.csv", REVIT_CSV.replace("Pull Box,12x12,PB-1,B2,2.7", "Pull Box,12x12,PB-2,B2,5"))
    a = analyse_files(spark, str(tmp_path), project_start=START, as_of=AS_OF, persist_rollup=False)
    k = a.kpis.collect()
    assert [(r["project_id"], r["total_units"], r["bom_lines"], r["issues"], r["families"]) for r in k] == \
        [("p", 27, 12, 6, 4)]
    summ = {r["family"]: r["count"] for r in a.summary.collect()}
    assert summ == {"Heat Pump Fan": 8, "Dry Type Transformer": 6, "Panelboard 208V": 6, "Pull Box": 7}
    assert a.bom_lines.select("file_id").distinct().count() == 2


def test_gurtz_summary_by_family_option(spark, tmp_path):
    """Q1 parameter: gurtz lines summarised by family ("Panelboard"), so they
    get the panelboard lead time and cost instead of the default."""
    write_file(str(tmp_path / "project=gz"), "panels.csv", GURTZ_CSV)
    a = analyse_files(spark, str(tmp_path), project_start=START, as_of=AS_OF, gurtz_key="family",
                      persist_rollup=False)
    assert rows(a.summary, "family", "count") == [("Panelboard", 4)]
    assert rows(a.spend, "family", "unit_cost", "estimated_total") == [("Panelboard", 3500, 14000)]
    assert rows(a.lead_times, "lead_min_weeks", "lead_max_weeks") == [(8, 14)]


def test_user_catalogue_from_csv(spark, tmp_path):
    from bomspark.sources.catalogue import read_catalogue
    cat_csv = "priority,keyword,min_weeks,max_weeks,unit_cost\n1,pump fan,1,2,10\n2,box,3,4,20\n"
    write_file(str(tmp_path / "cat"), "c.csv", cat_csv)
    write_file(str(tmp_path / "files" / "project=rv"), "a.csv", REVIT_CSV)
    cat = read_catalogue(spark, str(tmp_path / "cat"), "csv")
    a = analyse_files(spark, str(tmp_path / "files"), catalogue=cat, project_start=START, as_of=AS_OF,
                      persist_rollup=False)
    got = {r["family"]: (r["unit_cost"], r["estimated_total"]) for r in a.spend.collect()}
    assert got == {"Heat Pump Fan": (10, 40), "Pull Box": (20, 40), "Dry Type Transformer": (1500, 4500),
                   "Panelboard 208V": (1500, 4500)}
