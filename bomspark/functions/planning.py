"""Column -> Column planning rules: level sort key, delivery action,
order-by date, days until deadline, lead status, spend tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomspark import fixed_values as fv

_LONG_MAX = 9223372036854775807
_DAY_MICROS = 86_400_000_000


def _contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def level_sort_key(level: Column) -> Column:
    """0 basement-ish, 99 roof-ish, else the first digit run, else 50."""
    lvl = F.lower(level)
    digits = F.regexp_extract(lvl, "([0-9]+)", 1)
    return (
        F.when(_contains_any(lvl, fv.SORT_BASEMENT_WORDS), F.lit(fv.SORT_BASEMENT).cast("bigint"))
        .when(_contains_any(lvl, fv.SORT_ROOF_WORDS), F.lit(fv.SORT_ROOF).cast("bigint"))
        .when(digits == "", F.lit(fv.SORT_NO_NUMBER).cast("bigint"))
        .otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(_LONG_MAX)))
    )


def recommended_action(level: Column) -> Column:
    lvl = F.lower(level)
    return (
        F.when(_contains_any(lvl, fv.ACTION_MAIN_WORDS), F.lit(fv.ACTION_MAIN))
        .when(_contains_any(lvl, fv.ACTION_ROOF_WORDS), F.lit(fv.ACTION_ROOF))
        .otherwise(F.lit(fv.ACTION_STANDARD))
    )


def order_by_ts(project_start: Column, max_weeks: Column) -> Column:
    """project_start - max_weeks weeks (timestamp_ntz stays timestamp_ntz)."""
    return project_start - F.make_dt_interval(days=(max_weeks * 7).cast("int"))


def days_until(deadline: Column, as_of: Column) -> Column:
    """Whole days from as_of to deadline, floored (a deadline later today is 0,
    earlier today is -1)."""
    micros = F.timestamp_diff("MICROSECOND", as_of, deadline)
    return F.floor(micros / F.lit(_DAY_MICROS)).cast("bigint")


def lead_status(days: Column) -> Column:
    return (
        F.when(days < 0, F.lit(fv.STATUS_OVERDUE))
        .when(days < fv.CRITICAL_DAYS, F.lit(fv.STATUS_CRITICAL))
        .when(days < fv.WARNING_DAYS, F.lit(fv.STATUS_WARNING))
        .when(days.isNotNull(), F.lit(fv.STATUS_OK))  # unknown days have no status
    )


def is_critical(status: Column) -> Column:
    return F.coalesce(status.rlike(fv.CRITICAL_PATTERN), F.lit(False))


def spend_tier(total: Column) -> Column:
    return (
        F.when(total > fv.TIER_HIGH_ABOVE, F.lit(fv.TIER_HIGH))
        .when(total > fv.TIER_MEDIUM_ABOVE, F.lit(fv.TIER_MEDIUM))
        .otherwise(F.lit(fv.TIER_LOW))
    )
