"""Aggregations: summary by family / level (G1, G2, C6), project totals
(G4, G6) and the per-project KPI row (G5, G7, G8).

Every aggregate is a hash aggregate with a map-side partial step, so a project
holding a third of all lines is pre-combined inside each scan task before
anything is shuffled; what crosses the network is one row per
(task, project, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark.fixed_values import LAYOUT_GURTZ
from bomspark.functions.planning import days_until, is_critical, lead_status, order_by_ts
from bomspark.functions.text import strip
from bomspark.operators.lookup import enrich, enrich_by_name
from bomspark.operators.quality import with_issues
from bomspark.operators.timing import as_of_col, with_project_start


def _is_gurtz(bom: DataFrame) -> Column:
    if "layout" in bom.columns:
        return F.coalesce(F.col("layout") == LAYOUT_GURTZ, F.lit(False))
    return F.lit(False)


def summary_key(bom: DataFrame, gurtz_key: str = "level") -> tuple[Column, Column]:
    """(key, keep): the summary groups gurtz lines by level (blank levels
    dropped) and every other line by family."""
    g = _is_gurtz(bom)
    if gurtz_key == "family":
        return F.col("family"), F.lit(True)
    key = F.when(g, F.col("level")).otherwise(F.col("family"))
    keep = ~(g & (strip(F.col("level")) == ""))
    return key, keep


def summarise(bom: DataFrame, gurtz_key: str = "level") -> DataFrame:
    """project_id, family, count — "family" holds the level for gurtz lines."""
    key, keep = summary_key(bom, gurtz_key)
    return (bom.filter(keep)
            .groupBy(F.col("project_id"), key.alias("family"))
            .agg(F.sum("count").cast("bigint").alias("count")))


def summarise_by_level(bom: DataFrame) -> DataFrame:
    """Units per non-blank level (the gurtz summary applied to any BOM)."""
    return (bom.filter(strip(F.col("level")) != "")
            .groupBy("project_id", "level")
            .agg(F.sum("count").cast("bigint").alias("count")))


def project_totals(bom: DataFrame) -> DataFrame:
    """project_id, total_units, bom_lines, issues."""
    b = with_issues(bom)
    return b.groupBy("project_id").agg(
        F.sum("count").cast("bigint").alias("total_units"),
        F.count(F.lit(1)).alias("bom_lines"),
        F.count_if(F.col("issues") != "").alias("issues"),
    )


def line_rollup(bom: DataFrame, gurtz_key: str = "level") -> DataFrame:
    """One pass over the lines at (project, summary key, kept, level) grain:
    units, lines, issue_lines.  Summary, level totals, project totals and
    KPIs are all re-aggregations of this (much smaller) table, so the lines
    are scanned and shuffled once (map-side combined)."""
    b = with_issues(bom)
    key, keep = summary_key(b, gurtz_key)
    return (b.select(F.col("project_id"), key.alias("family"), keep.alias("kept"), F.col("level"),
                     F.col("count"), (F.col("issues") != "").cast("int").alias("has_issue"))
            .groupBy("project_id", "family", "kept", "level")
            .agg(F.sum("count").cast("bigint").alias("units"),
                 F.count(F.lit(1)).alias("lines"),
                 F.sum("has_issue").cast("bigint").alias("issue_lines")))


def project_rows_bound(rollup: DataFrame) -> int:
    """Rollup rows of the largest project.  The rollup's grain is (project,
    key, kept, level), so this bounds the per-project rows of the summary,
    lead, spend and delivery tables and of every fragment built from them;
    one small job over the (written) rollup."""
    from bomspark.operators.ranking import largest_group
    return largest_group(rollup, ["project_id"])


def summary_from_rollup(rollup: DataFrame) -> DataFrame:
    return (rollup.filter("kept").groupBy("project_id", "family")
            .agg(F.sum("units").cast("bigint").alias("count")))


def level_totals_from_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("project_id", "level").agg(F.sum("units").cast("bigint").alias("total_units"))


def totals_from_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("project_id").agg(
        F.sum("units").cast("bigint").alias("total_units"),
        F.sum("lines").cast("bigint").alias("bom_lines"),
        F.sum("issue_lines").cast("bigint").alias("issues"))


def kpis_from(totals: DataFrame, enriched: DataFrame, project_start, as_of=None,
              projects: DataFrame | None = None) -> DataFrame:
    """totals: project_id, total_units, bom_lines, issues; enriched: the
    summary with its lookup.  Both sides are one row per project after their
    own aggregates, already partitioned by project_id.  ``projects``: the project list; a
    project of it without any line gets a row of zeros, so every table, prompt and
    page built on the KPI rows holds it."""
    if projects is not None:
        totals = projects.select("project_id").distinct().join(totals, "project_id", "left").select(
            "project_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_units", "bom_lines", "issues")])
    e = with_project_start(enriched, project_start, as_of)
    deadline = order_by_ts(F.col("project_start"), F.col("lead_max_weeks"))
    critical = is_critical(lead_status(days_until(deadline, as_of_col(as_of))))
    fam = e.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("families"),
        F.sum(F.col("unit_cost") * F.col("count")).cast("bigint").alias("total_spend"),
        F.count_if(critical).alias("critical_items"))
    return totals.join(fam, "project_id", "left").select(
        "project_id", "total_units", "bom_lines", "issues",
        F.coalesce("families", F.lit(0)).cast("bigint").alias("families"),
        F.coalesce("total_spend", F.lit(0)).cast("bigint").alias("total_spend"),
        F.coalesce("critical_items", F.lit(0)).cast("bigint").alias("critical_items"))


def project_kpis(bom: DataFrame, catalogue: DataFrame, project_start, as_of=None,
                 gurtz_key: str = "level", profile=None, persist_rollup: bool = False) -> DataFrame:
    """One row per project: total_units, bom_lines, issues, families,
    total_spend, critical_items.  With persist_rollup the line rollup is
    written once to the shared folder, so the lines are scanned once (the
    summary and totals branches otherwise each scan them)."""
    r = line_rollup(bom, gurtz_key)
    if persist_rollup:
        from bomspark.session import materialise
        r = materialise(r, "rollup")
        # names from the written rollup: the lookup runs once per distinct name
        enriched = enrich_by_name(summary_from_rollup(r), r.filter("kept"), catalogue, "family", profile)
    else:
        enriched = enrich(summary_from_rollup(r), catalogue, "family", profile)
    return kpis_from(totals_from_rollup(r), enriched, project_start, as_of)
