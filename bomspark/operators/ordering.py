"""Report orderings (O1, O2, O4) for sinks and previews.

Ties are broken by name so the order is total (the original used an
unstable sort).  These are global sorts — use them only where the order is
the product (writing a report table), on aggregated tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_summary(summary: DataFrame) -> DataFrame:
    """O1: per project, units descending."""
    return summary.orderBy("project_id", F.col("count").desc(), "family")


def order_lead_times(lead: DataFrame) -> DataFrame:
    """O2: per project, most urgent first."""
    return lead.orderBy("project_id", "days_until_deadline", "family")


def order_delivery(delivery: DataFrame) -> DataFrame:
    """O3: per project, by phase."""
    return delivery.orderBy("project_id", "delivery_phase")


def order_spend(spend: DataFrame) -> DataFrame:
    """Per project, largest estimated total first."""
    return spend.orderBy("project_id", F.col("estimated_total").desc(), "family")
