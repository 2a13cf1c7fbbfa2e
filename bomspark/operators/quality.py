"""Data-quality audit (P6) and issue log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark import fixed_values as fv
from bomspark.functions.text import strip


def issues_expr(type_: Column, panel: Column, level: Column, stripped: bool = False) -> Column:
    """'Type undefined; Panel not assigned; Level missing' subset, '' if none.
    ``stripped``: the cells are known to be clean, so they are only compared."""
    def blank(c: Column) -> Column:
        return c == "" if stripped else strip(F.coalesce(c, F.lit(""))) == ""
    return F.concat_ws(
        fv.ISSUE_SEPARATOR,
        F.when(blank(type_), F.lit(fv.ISSUE_TYPE)),
        F.when(blank(panel), F.lit(fv.ISSUE_PANEL)),
        F.when(blank(level), F.lit(fv.ISSUE_LEVEL)),
    )


def with_issues(bom: DataFrame, stripped: bool = False) -> DataFrame:
    if "issues" in bom.columns:
        return bom
    return bom.withColumn("issues", issues_expr(F.col("type"), F.col("panel_name"), F.col("level"), stripped))


def issue_log(bom: DataFrame) -> DataFrame:
    return with_issues(bom).filter(F.col("issues") != "")
