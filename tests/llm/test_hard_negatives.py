"""Hard negatives and their search against brute force."""

import random

import numpy as np
import pytest

from bomspark.llm import hard_negatives as H
from bomspark.llm import queries as Q

SCHEMA = "vec_id long, label int, v array<bigint>"


def brute(rows, anchors, k=5):
    rows = [r for r in rows if None not in r and None not in r[2]]
    asks = {(a, b, tuple(v)) for a, b, v in anchors if None not in (a, b, v) and None not in v}
    out = []
    for a, label, v in asks:
        scored = [(-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:k]:
            fits = sorted(s[:2] for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out += [(a, pid, n + 1, nid, -p, -s) for n, (s, nid) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, anchors):
    df = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(anchors, SCHEMA))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def clustered(seed, n, dim=6, spread=12, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 61, (8, dim))
    return [(i, int(rng.integers(labels)), (centres[rng.integers(8)] + rng.integers(-spread, spread + 1, dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("cell, block, pack", [(1_024, 4_096, 512), (40, 64, 4), (20, 16, 512)])
def test_equals_brute_force(spark, monkeypatch, cell, block, pack):
    monkeypatch.setattr(H, "CELL_ROWS", cell)
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "PACK_ROWS", pack)
    monkeypatch.setattr(H, "RUN_BLOCKS", 2)
    rows = clustered(1, 600)
    rows += [(700 + i, i % 2, rows[0][2]) for i in range(150)]          # a hot vector
    rows += [(900, i % 3, rows[i][2]) for i in range(40)] * 2           # a hot id, repeated rows
    rows += [(950 + i, 1, [0] * 6) for i in range(3)] + [(960, 0, [1, 2]), (961, 0, [3, 1]), (962, 1, [3, 1]), (963, 1, []), (964, 1, [])]
    rows += [(None, 1, [1] * 6), (970, None, [1] * 6), (971, 1, None), (972, 1, [None] * 6)]
    anchors = [r for r in rows if r[0] is not None and (r[0] % 23 == 0 or r[0] in (900, 950, 960, 963, 970, 971, 972))]
    got = run(spark, rows, anchors + anchors[:3])
    assert got == brute(rows, anchors) and len(got) > 100


def test_products_beyond_floating_point(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.randrange(-2_000_000_000, 2_000_000_000) for _ in range(2)]) for i in range(60)]
    assert run(spark, rows, rows[:10]) == brute(rows, rows[:10])
    run(spark, [(i, i % 2, [1 << 62, -(1 << 63)]) for i in range(9)], [(0, 0, [1 << 62, -(1 << 63)])])


def test_empty_tables(spark):
    rows = clustered(2, 30)
    assert run(spark, [], rows) == [] and run(spark, rows, []) == [] and run(spark, [(1, None, [1])], [(1, 1, None)]) == []
    assert run(spark, [(1, 1, [3])], [(1, 1, [3])]) == []


def test_tree_covers_its_rows():
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.integers(-50, 50, (300, 5)), np.tile(rng.integers(-50, 50, (1, 5)), (100, 1)),
                        rng.integers(0, 3, (200, 5)) + 20])
    labels = np.concatenate([np.zeros(400, np.int64), rng.integers(0, 3, 200)])
    most = float(np.sqrt((v * v).sum(1)).max())
    points = H.augmented(v, most)
    assert np.allclose((points ** 2).sum(1), most * most)
    order, nodes = H.build_tree(points, labels)
    assert sorted(order.tolist()) == list(range(600))
    points, labels = points[order], labels[order]
    leaves = np.zeros(600, int)
    for i, n in enumerate(nodes):
        far = np.sqrt(((points[n["start"]:n["stop"]] - points[n["center"]]) ** 2).sum(1))
        assert far.max() <= n["radius"] + 1e-9
        assert bool(n["pure"]) == (len(set(labels[n["start"]:n["stop"]])) == 1)
        if n["leaf"]:
            leaves[n["start"]:n["stop"]] += 1
            assert n["next"] == i + 1
    assert (leaves == 1).all()
    q = rng.integers(-60, 60, 5).astype(float)
    products = points[:, :5] @ q
    lower, upper = H.bounds(float(q @ q), products[nodes["center"]], nodes["radius"], most)
    for n, lo, hi in zip(nodes, lower, upper):
        assert lo <= products[n["start"]:n["stop"]].min() and products[n["start"]:n["stop"]].max() <= hi


def test_descent_skips_nodes_outside_the_window():
    """On clustered rows a search reads few of them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    centres = 200 * centres / np.sqrt((centres ** 2).sum(1))[:, None]
    v = (centres[np.arange(4000) % 40] + rng.normal(size=(4000, 8)) * 4).round().astype(np.int64)
    most = float(np.sqrt((v * v).sum(1)).max())
    order, nodes = H.build_tree(H.augmented(v, most), np.arange(4000) % 40 % 2)
    values = v[order].astype(float)
    q = v[7].astype(float)
    lower, upper = H.bounds(float(q @ q), values[nodes["center"]] @ q, nodes["radius"], most)
    read, best = [], []

    def verify(i):
        a, b = nodes[i]["start"], nodes[i]["stop"]
        read.append(b - a)
        return values[a:b] @ q, order[a:b]

    H.descend(nodes.tolist(), lower.tolist(), upper.tolist(), H.LOWEST, H.HIGHEST, 0, False, 5, best, verify)
    scores = [(-int(v[i] @ v[7]), int(i)) for i in range(4000) if i % 2]
    assert best == sorted(scores)[:5] and sum(read) < 1000


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(0, [0.5, -0.25], 1), (100, [0.25, 0.25], 1), (1, None, 1), (2, [None, 1.0], 1), (None, [1.0, 1.0], 1), (3, [], 1),
            (4, [1.0], 2), (5, [float("nan"), 1.0], 2), (6, [0.5, -0.25], None), (7, [0.5, -0.25], 0), (8, [0.5, -0.24], 2)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, v string, rank int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in Q.op13_hard_negatives(spark, str(tmp_path)).collect()]
    assert got == [(100, 7, 1, 0, 4096, 4096)]
    assert Q.op13_hard_negatives(spark, str(tmp_path)).columns[0] == "anchor_id"


def test_no_vectors_are_broadcast(spark, monkeypatch):
    """Anchors routed to many cells were taken for as small as the table of anchors, and broadcast."""
    import re

    plans, searched = [], H._searched
    monkeypatch.setattr(H, "CELL_ROWS", 10)

    def seen(*args):
        found = searched(*args)
        plans.append(found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted"))
        return found

    monkeypatch.setattr(H, "_searched", seen)
    rows = clustered(5, 300)
    assert run(spark, rows, rows[:20]) == brute(rows, rows[:20])
    assert len(plans) == 4
    sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", "\n".join(plans))
    assert not [x for x in sent if re.search(r"\b(v|vectors)#", x)], sent
