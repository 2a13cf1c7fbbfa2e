"""The seed index finds the same keywords as the exact substrings and a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from bomspark.operators import lookup

SCHEMA = "priority int, keyword string, min_weeks int, max_weeks int, unit_cost long"


def entries(seed, n, shortest, unique):
    rng = random.Random(seed)
    words = list({"".join(rng.choice("abé ") for _ in range(rng.randrange(shortest, 14))) for _ in range(n)})
    rng.shuffle(words)
    return [(i if unique else i // 5, w, i, i + 1, i * 10) for i, w in enumerate(words)]


@pytest.mark.parametrize("shortest, unique", [(1, True), (3, False), (0, True), (0, False)])
def test_seeds_equal_substrings_and_a_plain_search(spark, monkeypatch, shortest, unique):
    monkeypatch.setattr(lookup, "INLINE_MAX_ROWS", 0)
    rng = random.Random(shortest)
    cat = entries(7, 150, shortest, unique)
    names = ["".join(rng.choice("ABÉ a") for _ in range(rng.randrange(0, 30))) for _ in range(120)] + [None, "", "a", None, "zzz"]
    df = spark.createDataFrame([(n,) for n in names], "family string")
    catalogue = spark.createDataFrame(cat, SCHEMA)

    def run(limit):
        monkeypatch.setattr(lookup, "MAX_LENGTHS", limit)
        rows = lookup.match_keywords(df, catalogue).collect()
        assert len(rows) == len(set(names))
        return {r.family: tuple(r)[1:] for r in rows}

    want = {}
    for n in set(names):
        hit = min(((p, w, lo, hi, usd) for p, w, lo, hi, usd in cat if n is not None and w in n.lower()), default=None)
        want[n] = hit[1:] if hit else lookup.DEFAULT_LEAD
    assert run(0) == want and run(10**9) == want
    rows = lookup.enrich(df, catalogue).count()
    assert rows == len(names)


def test_one_candidate_per_position(spark, monkeypatch):
    """Many keyword lengths do not multiply the candidates of a name."""
    monkeypatch.setattr(lookup, "INLINE_MAX_ROWS", 0)
    cat = spark.createDataFrame([(i, "x" * (i + 4), 1, 2, 3) for i in range(40)], SCHEMA)
    df = spark.createDataFrame([("y" * 50 + "xxxx",)], "family string")
    plan = lookup.match_keywords(df, cat)._jdf.queryExecution().toString()
    assert "explode" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert lookup.match_keywords(df, cat).first().keyword == "xxxx"
