"""Row numbers within groups: the window path and the range-sorted path
(used beyond the one-task bound) agree, also when one group holds most rows
and is spread over several partitions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bomspark.operators.ranking import largest_group, row_number_in_group, sum_before_in_group


def _skewed(spark, n):
    return spark.range(0, n, numPartitions=4).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 13).cast("string")).alias("g"),
        (F.col("id") * 7919 % 20011).alias("k"), F.col("id"))


def test_largest_group(spark):
    assert largest_group(_skewed(spark, 1000), ["g"]) == 700
    assert largest_group(spark.range(0).select(F.col("id").alias("g")), ["g"]) == 0


def test_range_path_matches_window_on_hot_group(spark):
    df = _skewed(spark, 20000)
    order = [F.col("k").desc(), "id"]
    a = row_number_in_group(df, ["g"], order, "rn", one_task_rows=10**9)
    b = row_number_in_group(df, ["g"], order, "rn", one_task_rows=0)
    assert b.count() == 20000
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    hot = b.filter("g = 'hot'").agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(hot) == (1, 14000, 14000)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-5, 5)), min_size=0, max_size=40))
def test_range_path_brute_force(spark, rows):
    data = [(g, k, i) for i, (g, k) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, k int, i int")
    got = {r["i"]: r["rn"] for r in row_number_in_group(df, ["g"], ["k", "i"], "rn", one_task_rows=0).collect()}
    want = {}
    for g in {g for g, _, _ in data}:
        members = sorted((k, i) for gg, k, i in data if gg == g)
        for n, (_, i) in enumerate(members, 1):
            want[i] = n
    assert got == want


def test_delivery_phases_same_beyond_bound(spark):
    from conftest import SF_SMALL

    from bomspark.operators.planning import delivery_sequence
    from bomspark.sources.tables import bom_view
    bom = bom_view(spark, SF_SMALL)
    window = delivery_sequence(bom)
    ranged = delivery_sequence(bom, bound=10**7)   # above ONE_TASK_ROWS: range-sorted numbering
    assert window.count() == ranged.count() > 0
    assert window.exceptAll(ranged).count() == 0


def test_sums_before_match_on_hot_group_and_brute_force(spark):
    df = _skewed(spark, 3000).withColumn("v", F.col("id") % 17)
    order = ["k", "id"]
    a = sum_before_in_group(df, ["g"], order, {"v": "s", "id": "t"}, one_task_rows=10**9)
    b = sum_before_in_group(df, ["g"], order, {"v": "s", "id": "t"}, one_task_rows=0)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect())) and a.columns == b.columns == [*df.columns, "s", "t"]
    sums = {}
    for g, k, i, v, s, t in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        assert (s, t) == sums.get(g, (0, 0))
        sums[g] = (s + v, t + i)
