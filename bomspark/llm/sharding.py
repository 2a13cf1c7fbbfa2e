"""Shards by a hierarchical weighted hash tree.

A tree has regions, racks in regions, shards in racks, and a weight for every
shard; a rack or region weighs what its shards weigh together.  A row descends
the tree: at each level every child draws ``-ln(u) / weight`` with u a hash of
(key, child), and the smallest draw wins.  A child therefore gets its share of
weight, and its draw depends on nothing but the key, its own name and its own
weight: when the weights of one subtree change, rows move into or out of that
subtree only, never between two unchanged children of a node.

``default_tree(n)``: the first eight shards fill two regions of two racks of two;
every later shard opens a region of its own.  Growing from n >= 8 to n + 1
shards thus changes no weight below an existing region, and rows move only into
the new shard.

u is made of the md5 of key and child name.  Equal draws, which hashes of 48 bits hardly
have, go to the smaller name.  Null keys are one key value like any other.  Rows with
equal keys meet in one shard.  The result has no row for an empty input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark.operators.ranking import largest_group, row_number_in_group

SLOT_ROWS = 1_000_000  # a shard of more rows is numbered by more than one task


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def default_tree(n: int) -> list[Shard]:
    def place(s: int) -> Shard:
        if s < 8:
            return Shard(f"r{s // 4}", f"r{s // 4}.k{s // 2 % 2}", s)
        return Shard(f"r{s - 6}", f"r{s - 6}.k0", s)

    return [place(s) for s in range(n)]


def _winner(key: list[Column], weights: dict[str, float]) -> Column:
    """The name of the child with the smallest draw."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    named = [F.coalesce(k.cast("string"), F.lit("null")) for k in key]

    def u(name: str) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", *named, F.lit(name))), 1, 12)
        return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))

    draws = F.array(*[F.struct((-F.log(u(name)) / F.lit(w)).alias("draw"), F.lit(name).alias("name"))
                      for name, w in weights.items()])
    return F.array_min(draws)["name"]


def _choose(key: list[Column], shards: list[Shard], parent: Column | None, of, name) -> Column:
    """For each node ``of`` that the parent column may name: the winner among
    its children ``name``."""
    groups: dict[str, dict[str, float]] = {}
    for s in shards:
        kids = groups.setdefault(of(s), {})
        kids[name(s)] = kids.get(name(s), 0.0) + s.weight
    if parent is None:
        return _winner(key, next(iter(groups.values())))
    chosen = None
    for node, kids in groups.items():
        hit = parent == F.lit(node)
        chosen = F.when(hit, _winner(key, kids)) if chosen is None else chosen.when(hit, _winner(key, kids))
    return chosen


def place(df: DataFrame, keys: list[str], tree: list[Shard], shard: str = "shard",
          region: str = "region", rack: str = "rack") -> DataFrame:
    """Add the region, rack and shard of every row; same-named columns are replaced."""
    shards = [s for s in tree if s.weight > 0]
    if not shards:
        raise ValueError("a tree needs a shard of positive weight")
    key = [F.col(f"`{k}`") for k in keys]
    # draws of different levels use different names, so they are independent
    df = df.withColumn(region, _choose(key, shards, None, lambda s: "", lambda s: s.region))
    df = df.withColumn(rack, _choose(key, shards, F.col(region), lambda s: s.region, lambda s: s.rack))
    return df.withColumn(shard, _choose(key, shards, F.col(rack), lambda s: s.rack,
                                        lambda s: str(s.shard)).cast("int"))


def number_slots(placed: DataFrame, shard: str = "shard", slot: str = "slot", order: list[str] | None = None) -> DataFrame:
    """Add a number per row, gapless from 0 within each shard, in ``order`` (default: all
    columns); rows equal there in any order.

    ``placed`` must be a written table.  A shard of up to SLOT_ROWS rows is numbered by a
    window; larger ones by a range sort over many tasks, in which equal rows spread, too, by
    their place in the table, so no task sees a whole shard."""
    at = "__slot_at"
    order = order or [c for c in placed.columns if c != shard]
    numbered = row_number_in_group(
        placed.withColumn(at, F.monotonically_increasing_id()), [shard], [F.col(f"`{c}`") for c in order] + [F.col(at)], slot,
        largest_group(placed, [shard]), SLOT_ROWS)
    return numbered.withColumn(slot, F.col(slot) - 1).drop(at)
