"""Row numbers within a group (W1 and the report orderings) that never gather
a group into one task unless its size has been checked.

``row_number_in_group`` first measures the largest group (one aggregate with
a map-side partial step; only a single number reaches the driver).  When every
group fits one task (``ONE_TASK_ROWS``) it is a plain
``row_number() OVER (PARTITION BY keys ORDER BY order)``.  Beyond that bound
the rows are numbered by a range-partitioned sort instead, so a project
holding a third of all rows is spread over many tasks:

1. ``orderBy(keys, order)`` range-partitions on the full sort key, so a hot
   group is split across partitions in order;
2. each row records its partition and its position inside the sorted
   partition; this table is written once to the shared folder (the positions
   are then fixed, and a lost executor re-reads the files);
3. per (partition, group): the first position and the row count — at most
   partitions + groups rows;
4. a window over that small table (at most one row per partition for a hot
   group) gives the rows of the group that sit in earlier partitions;
5. join back on (partition, group): row number = position - first position
   + rows before + 1.

The order must be total within a group (callers break ties by name), so the
numbering is deterministic either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest group numbered by a single window task.
ONE_TASK_ROWS = 1_000_000


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group of ``df`` by ``keys`` (0 when empty)."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return int(top or 0)


def row_number_in_group(df: DataFrame, keys: list[str], order: list, name: str,
                        bound: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """df + ``name`` (bigint, 1..n within each group of ``keys`` in ``order``).

    bound: a known upper bound of the group size (skips the measuring job);
    a wrong bound only changes the strategy, never the numbers.  Without
    one, df is written once to the shared folder and both the measuring and
    the numbering read that copy (df is never computed twice)."""
    if bound is None:
        from bomspark.session import materialise
        df = materialise(df, "to_rank")
        bound = largest_group(df, keys)
    if bound <= one_task_rows:
        w = Window.partitionBy(*keys).orderBy(*[_c(o) for o in order])
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    return _row_number_by_range(df, keys, order, name)


def sum_before_in_group(df: DataFrame, keys: list[str], order: list, sums: dict[str, str],
                        bound: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """df + a column for each entry of ``sums`` (column -> new name): the sum of the
    column over the rows of the group that come before the row in ``order`` (total within a
    group), as bigint; 0 for the first.  Bounds as in ``row_number_in_group``: beyond
    them the sums are made inside range-sorted partitions, and a table of one row per
    (partition, group) carries what lies before a partition."""
    if bound is None:
        from bomspark.session import materialise
        df = materialise(df, "to_sum")
        bound = largest_group(df, keys)

    def before(c: str, w) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")

    if bound <= one_task_rows:
        w = Window.partitionBy(*keys).orderBy(*[_c(o) for o in order])
        return df.withColumns({name: before(c, w) for c, name in sums.items()})
    from bomspark.session import materialise
    placed = materialise(
        df.orderBy(*[F.col(k) for k in keys], *[_c(o) for o in order])
          .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos")),
        "summed")
    inside = Window.partitionBy("_part", *keys).orderBy("_pos")
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part")
    offsets = totals.select(F.col("_part").alias("_opart"), *[F.col(k).alias(f"_o_{k}") for k in keys],
                            *[before(c, earlier).alias(f"_b_{name}") for c, name in sums.items()])
    cond = [placed["_part"] == offsets["_opart"]] + [placed[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys]
    placed = placed.withColumns({f"_i_{name}": before(c, inside) for c, name in sums.items()})
    return placed.join(offsets, cond).select(
        *df.columns, *[(F.col(f"_i_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums.values()])


def _row_number_by_range(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    from bomspark.session import materialise
    cols = df.columns
    placed = materialise(
        df.orderBy(*[F.col(k) for k in keys], *[_c(o) for o in order])
          .select("*", F.spark_partition_id().alias("_part"),
                  F.monotonically_increasing_id().alias("_pos")),
        "ranked")
    starts = placed.groupBy("_part", *keys).agg(F.min("_pos").alias("_lo"),
                                                F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")
                               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = starts.select(F.col("_part").alias("_opart"), *[F.col(k).alias(f"_o_{k}") for k in keys],
                            "_lo", F.coalesce(earlier, F.lit(0)).alias("_before"))
    cond = [placed["_part"] == offsets["_opart"]] + [placed[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys]
    return placed.join(offsets, cond).select(
        *cols, (F.col("_pos") - F.col("_lo") + F.col("_before") + 1).cast("bigint").alias(name))
