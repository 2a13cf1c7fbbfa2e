"""Run parameters: the as-of instant and each project's start."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark.fixed_values import DEFAULT_START_WEEKS_AHEAD


def as_of_col(as_of=None) -> Column:
    """A timestamp_ntz column: None -> the session's local time (once per query)."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(as_of, dt.date):
        as_of = as_of.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def default_project_start(as_of=None) -> Column:
    """Midnight of (as_of + 20 weeks), as timestamp_ntz."""
    t = as_of_col(as_of) + F.make_dt_interval(days=F.lit(7 * DEFAULT_START_WEEKS_AHEAD))
    return t.cast("date").cast("timestamp_ntz")


def fixed_as_of(spark, as_of=None):
    """``as_of``, or the session's local time now as a literal: one instant for
    all tables of a run, which are evaluated in jobs of their own."""
    return spark.range(1).select(F.localtimestamp()).first()[0] if as_of is None else as_of


def run_info(spark, as_of):
    """One row: as_of, the instant all tables of a run are made for, and default_start, the
    start of projects that have none.  ``as_of`` must be fixed (``fixed_as_of``)."""
    return spark.range(1).select(as_of_col(as_of).alias("as_of"), default_project_start(as_of).alias("default_start"))


def with_project_start(df: DataFrame, project_start, as_of=None) -> DataFrame:
    """project_start is a Column (per-row expression, e.g. of project_id),
    a DataFrame(project_id, project_start) joined on project_id, or None
    for the default start, 20 weeks after ``as_of``.  A project without a start
    (not in the table, or null) gets the default; of several rows of a project
    the earliest counts."""
    default = default_project_start(as_of)
    if isinstance(project_start, DataFrame):
        ps = project_start.groupBy("project_id").agg(
            F.min(F.col("project_start").cast("timestamp_ntz")).alias("project_start"))
        return df.join(ps, "project_id", "left").withColumn("project_start", F.coalesce("project_start", default))
    if project_start is None:
        return df.withColumn("project_start", default)
    if not isinstance(project_start, Column):
        project_start = as_of_col(project_start)
    return df.withColumn("project_start", F.coalesce(project_start.cast("timestamp_ntz"), default))
