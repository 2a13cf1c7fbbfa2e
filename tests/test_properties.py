"""Property tests: invariants that must hold for any BOM."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bomspark.plans.procurement import analyse_bom

FAMILIES = ["Panelboard 208V", "Heat Pump Fan", "Pull Box", "Dry Type Transformer", "Widget", "UPS Unit"]
LEVELS = ["", "B2", "Basement B1", "Level 1", "Level 10", "Roof", "Mezzanine", "Parking P1", "Level 3"]
SCHEMA = "project_id string, family string, type string, panel_name string, level string, count bigint"

line = st.tuples(
    st.sampled_from(["p1", "p2", "p3"]), st.sampled_from(FAMILIES), st.sampled_from(["", "T1", "T2"]),
    st.sampled_from(["", "LP-1", "LP-2"]), st.sampled_from(LEVELS), st.integers(min_value=-5, max_value=60))
boms = st.lists(line, min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _analyse(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return analyse_bom(df, project_start="2026-06-01 00:00:00", as_of="2026-02-12 09:00:00")


def _set(df):
    return sorted(tuple(r) for r in df.collect())


@SETTINGS
@given(rows=boms)
def test_totals_are_consistent(spark, rows):
    a = _analyse(spark, rows)
    units = {r["project_id"]: r["count"] for r in a.summary.groupBy("project_id").agg(F.sum("count").alias("count")).collect()}
    k = {r["project_id"]: r for r in a.kpis.collect()}
    spend = {r["project_id"]: r["total_spend"] for r in a.total_spend.collect()}
    spend_rows = {r["project_id"]: r["s"] for r in a.spend.groupBy("project_id").agg(F.sum("estimated_total").alias("s")).collect()}
    for p, kp in k.items():
        assert kp["total_units"] == units[p]                      # revit: summary covers every unit
        assert kp["total_spend"] == spend[p] == spend_rows[p]     # spend rows add up to the total
        assert kp["bom_lines"] == sum(1 for r in rows if r[0] == p)
        assert kp["families"] == len({r[1] for r in rows if r[0] == p})


@SETTINGS
@given(rows=boms)
def test_phases_are_dense(spark, rows):
    a = _analyse(spark, rows)
    by_p = {}
    for r in a.delivery.collect():
        by_p.setdefault(r["project_id"], []).append(r["delivery_phase"])
    for p, phases in by_p.items():
        assert sorted(phases) == list(range(1, len({r[4] for r in rows if r[0] == p}) + 1))


@SETTINGS
@given(rows=boms)
def test_independent_of_partitioning_and_order(spark, rows):
    a1, a2 = _analyse(spark, rows, 1), _analyse(spark, list(reversed(rows)), 5)
    for name in ["summary", "lead_times", "delivery", "spend", "kpis"]:
        assert _set(getattr(a1, name)) == _set(getattr(a2, name)), name


@SETTINGS
@given(rows=boms)
def test_projects_are_independent(spark, rows):
    whole = _analyse(spark, rows)
    for p in {r[0] for r in rows}:
        alone = _analyse(spark, [r for r in rows if r[0] == p])
        for name in ["summary", "delivery", "spend", "kpis"]:
            got = [t for t in _set(getattr(whole, name)) if p in t]
            assert got == _set(getattr(alone, name)), (p, name)
