"""Planning tables: lead times (S7-S10, O2), critical items (C7, G7),
delivery sequence (G3, S4-S6, S14, W1, O3) and spend (S11-S13, S15, G5, O4).

All of them run on aggregated rows (one per project and family / level);
none touches the line grain except the level aggregate of the delivery
sequence, which combines map-side like every other aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomspark.functions.planning import (days_until, is_critical, lead_status, level_sort_key,
                                         order_by_ts, recommended_action, spend_tier)
from bomspark.functions.text import money, thousands
from bomspark.operators.ranking import row_number_in_group
from bomspark.operators.timing import as_of_col, with_project_start


def lead_times(enriched: DataFrame, project_start, as_of=None) -> DataFrame:
    """enriched: project_id, family, count + lookup columns."""
    e = with_project_start(enriched, project_start, as_of)
    deadline = order_by_ts(F.col("project_start"), F.col("lead_max_weeks"))
    days = days_until(deadline, as_of_col(as_of))
    return e.select(
        "project_id", "family", "count", "lead_min_weeks", "lead_max_weeks",
        deadline.cast("date").alias("order_by_date"),
        days.alias("days_until_deadline"),
        lead_status(days).alias("status"),
    )


def critical_items(lead: DataFrame) -> DataFrame:
    return lead.filter(is_critical(F.col("status")))


def critical_count(lead: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Per project count of OVERDUE/CRITICAL lead rows (0 when none)."""
    counts = lead.groupBy("project_id").agg(F.count_if(is_critical(F.col("status"))).alias("critical_items"))
    if projects is None:
        return counts
    return (projects.select("project_id").join(counts, "project_id", "left")
            .select("project_id", F.coalesce("critical_items", F.lit(0)).cast("bigint").alias("critical_items")))


def level_totals(bom: DataFrame) -> DataFrame:
    return bom.groupBy("project_id", "level").agg(F.sum("count").cast("bigint").alias("total_units"))


def delivery_sequence(bom: DataFrame, totals: DataFrame | None = None,
                      bound: int | None = None) -> DataFrame:
    """Phase 1..n per project: basement first, floors by number, roof last;
    ties broken by level text.  Numbered on one row per (project, level),
    never on the lines, by ``row_number_in_group`` (a window when the
    largest project's level count is checked to fit one task, a range sort
    beyond).  ``totals`` (project_id, level, total_units) may be given
    precomputed, e.g. from a line rollup; ``bound``: known largest level
    count per project."""
    totals = (totals if totals is not None else level_totals(bom)).withColumn(
        "_sort", level_sort_key(F.col("level")))
    ranked = row_number_in_group(totals, ["project_id"], ["_sort", "level"], "_phase", bound)
    return ranked.select(
        "project_id",
        F.col("_phase").cast("int").alias("delivery_phase"),
        "level", "total_units",
        recommended_action(F.col("level")).alias("recommended_action"),
    )


def spend_estimation(enriched: DataFrame) -> DataFrame:
    total = (F.col("unit_cost") * F.col("count")).cast("bigint")
    return enriched.select(
        "project_id", "family", "count", "unit_cost",
        total.alias("estimated_total"),
        spend_tier(total).alias("spend_tier"),
    )


def spend_formatted(spend: DataFrame) -> DataFrame:
    return spend.select(
        "project_id", "family", "count", "spend_tier",
        money(F.col("unit_cost")).alias("unit_cost_usd"),
        money(F.col("estimated_total")).alias("estimated_total_usd"),
    )


def total_spend(enriched: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """project_id, total_spend, total_spend_usd, total_spend_k (0 for a project of
    ``projects`` without any line)."""
    t = enriched.groupBy("project_id").agg(
        F.sum((F.col("unit_cost") * F.col("count"))).cast("bigint").alias("total_spend"))
    if projects is not None:
        t = projects.select("project_id").distinct().join(t, "project_id", "left").select(
            "project_id", F.coalesce("total_spend", F.lit(0)).cast("bigint").alias("total_spend"))
    return t.select("project_id", "total_spend",
                    money(F.col("total_spend")).alias("total_spend_usd"),
                    thousands(F.col("total_spend")).alias("total_spend_k"))
