"""Hard-negative mining by exact inner-product search in cover trees.

For each anchor the ``positives`` rows of its own label with the largest inner product are
found, and for each of them the first rows of other labels whose score lies in a
window: low * positive <= 100 * score <= high * positive.  Both are one search: rows
in the order (score falling, id rising) inside score windows, on one side of the label.

Norm augmentation.  A candidate x gets the coordinate sqrt(M^2 - |x|^2), M being the
largest norm, and a query q gets 0.  All candidates then have norm M, and with D the
distance of q from a node's centre c and r the node's covering radius, every x under
the node has
    (|q|^2 + M^2 - (D + r)^2) / 2  <=  q.x  <=  (|q|^2 + M^2 - max(0, D - r)^2) / 2.

The tree has two parts.

* Top: at most PIVOTS centres, a farthest-first net of a sample of SAMPLE rows (a
  documented bound; every row is indexed).  A row belongs to the cell of its nearest
  centre; a cell's radius is measured over all its rows.  Vectors of a dimension
  that the sample lacks form a cell without bounds.  Cells are dealt into blocks of at most
  BLOCK_ROWS rows by a hash of the row's place, so neither equal vectors nor equal
  ids nor a cell with a third of all rows make a large block.
* Blocks: one cover tree each, built where the block is packed.  A node's rows within
  radius / BASE of its centre form its own child; the farthest row left becomes the
  next centre, and so on (at most MAX_CHILDREN).  Children of fewer than MIN_CHILD
  rows, and rows left over, become one leaf around the parent's centre.  Radii are
  measured, so they are never larger than the level's.  Of copies (equal vector and
  label) only the first k + 1 ids, k rows each, can be among the first k of any query, so a
  block keeps no more of them.

Search.  The anchors of each needed cell are dealt into packs of about PACK_ROWS, and a
pack meets RUN_BLOCKS blocks of the cell in one task.  Descent is best first: nodes wait in a
heap by upper bound; nodes outside a window, nodes whose rows all lie on the wrong side of
the label, and nodes that cannot reach the k-th best are skipped; leaves are
verified by exact products.  An anchor first searches the cell it is nearest to; what it
finds raises its windows' lower ends, and only cells whose bounds still meet a window
are searched after that, so most blocks are never sent to most anchors.

Bounds are widened by SLACK against rounding; candidates equal to the k-th best stay, for
ties.  Products beyond the exact range of floating point are made with Python's integers,
and the block is then read as one leaf; beyond 64 bits a product counts as the nearest
64-bit number.

Defined cases.  Rows with a null id, label or vector, or a null component take no part.
Vectors of different dimension are not compared.  Rows that repeat an id are separate
candidates; an anchor never meets a row of its own id.  Anchors equal in id, label and
vector count once.  Fewer candidates than asked for: all of them.  Empty tables, or no
anchor, give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomspark.session import materialise, ship_package

PIVOTS = 128
SAMPLE = 1_024
CELL_ROWS = 1_024  # cells are no more than rows / CELL_ROWS
BLOCK_ROWS = 4_096
FILL = 0.9  # share of BLOCK_ROWS that rows are dealt for: a hash deals unevenly
PACK_ROWS = 2_048
RUN_BLOCKS = 8
ROUTE_ROWS = 1_024  # anchors a routing task takes
BASE = 1.3
LEAF = 32
MIN_CHILD = 8
MAX_CHILDREN = 64
SLACK = 1e-6
MAX_EXACT = float(1 << 53)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

NODE = [("center", "<i4"), ("start", "<i4"), ("stop", "<i4"), ("next", "<i4"), ("leaf", "<i4"), ("pure", "<i4"),
        ("radius", "<f8"), ("label", "<i8")]
BLOCK = ("dim int, cell int, part bigint, n int, width int, radius double, longest double, ids binary, labels binary, "
         "vectors binary, nodes binary")


# -- one block -------------------------------------------------------------------------

def augmented(vectors, most: float):
    """Rows with the coordinate that makes every norm ``most``."""
    import numpy as np

    v = np.asarray(vectors, np.float64)
    last = np.sqrt(np.maximum(0.0, most * most - (v * v).sum(1)))
    return np.concatenate([v, last[:, None]], axis=1)


def build_tree(points, labels):
    """(order, nodes): the rows in tree order, and the nodes before their children, each
    with its centre (a place in that order), its rows [start, stop), the node behind
    its subtree, the measured covering radius, and the label all its rows share."""
    import numpy as np

    order: list[int] = []
    nodes: list[list] = []

    def add(center: int, rows, radius: float, leaf: bool) -> int:
        pure = len(np.unique(labels[rows])) == 1
        nodes.append([center, len(order), len(order) + len(rows), 0, int(leaf), int(pure), radius,
                      int(labels[rows[0]]) if pure else 0])
        return len(nodes) - 1

    def grow(center: int, rows, far) -> None:
        radius = float(far.max(initial=0.0))
        if len(rows) <= LEAF or radius == 0.0:
            at = add(center, rows, radius, True)
            order.extend(rows.tolist())
            nodes[at][3] = len(nodes)
            return
        at = add(center, rows, radius, False)
        limit = radius / BASE
        children, loose = [], []
        c, inside, gone = center, rows[far <= limit], far[far <= limit]
        left, away = rows[far > limit], far[far > limit]
        while True:
            if len(inside) >= MIN_CHILD:
                children.append((c, inside, gone))
            else:
                loose.append(inside)
            if not len(left) or len(children) + len(loose) >= MAX_CHILDREN:
                break
            c = int(left[np.argmax(away)])
            d = np.sqrt(((points[left] - points[c]) ** 2).sum(1))
            near = d <= limit
            inside, gone = left[near], d[near]
            left, away = left[~near], away[~near]
        for child in children:
            grow(*child)
        rest = np.concatenate([*loose, left])
        if len(rest):
            spread = np.sqrt(((points[rest] - points[center]) ** 2).sum(1)).max()
            leaf = add(center, rest, float(spread), True)
            order.extend(rest.tolist())
            nodes[leaf][3] = len(nodes)
        nodes[at][3] = len(nodes)

    rows = np.arange(len(points))
    first = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    grow(first, rows, np.sqrt(((points - points[first]) ** 2).sum(1)))
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    for n in nodes:
        n[0] = int(place[n[0]])
    return np.array(order), np.array([tuple(n) for n in nodes], NODE)


def bounds(square, center_products, radius, most: float):
    """(lower, upper) of the inner products under nodes, from |q|^2 and q.c."""
    import numpy as np

    both = square + most * most
    distance = np.sqrt(np.maximum(0.0, both - 2.0 * center_products))
    slack = SLACK * both + 1e-9
    return ((both - (distance + radius) ** 2) / 2 - slack,
            (both - np.maximum(0.0, distance - radius) ** 2) / 2 + slack)


def keep_best(best: list, scores, ids, k: int) -> None:
    """Merge candidates into ``best``: sorted (-score, id), at most k."""
    best += [(-int(s), int(i)) for s, i in zip(scores, ids)]
    best.sort()
    del best[k:]


def descend(nodes: list, lower: list, upper: list, low: int, high: int, label: int, same: bool, k: int,
            best: list, verify) -> None:
    """Bring ``best`` up to date with the rows of one tree that have a score in [low, high]
    and the wanted label; ``verify(node)`` gives the exact (scores, ids) of a leaf."""

    def useful(i: int) -> bool:
        n = nodes[i]
        return not (upper[i] < low or lower[i] > high or (n[5] and (n[7] == label) != same))

    heap = [(-upper[0], 0)] if nodes and useful(0) else []
    while heap:
        u, i = heapq.heappop(heap)
        floor = -best[-1][0] if len(best) == k else low
        if -u < floor:
            return  # no node left can reach the k-th best
        n = nodes[i]
        if n[4]:
            scores, ids = verify(i)
            fits = (scores >= max(low, floor)) & (scores <= high)
            keep_best(best, scores[fits].tolist(), ids[fits].tolist(), k)
            continue
        child = i + 1
        while child < n[3]:
            if upper[child] >= floor and useful(child):
                heapq.heappush(heap, (-upper[child], child))
            child = nodes[child][3]


class Block:
    """One packed block, unpacked for searching."""

    def __init__(self, row: dict, most: float):
        import numpy as np

        n = row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.whole = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(n, row["dim"])
        self.values = self.whole.astype(np.float64)
        self.largest = float(np.abs(self.values).max(initial=0.0))
        self.table = np.frombuffer(row["nodes"], NODE)
        self.nodes = self.table.tolist()
        self.most = most

    def search(self, asks: list, same: bool, k: int, state: dict) -> None:
        """``asks``: (ask, id, label, vector, windows (number, low, high))."""
        import numpy as np

        q = np.array([a[3] for a in asks], np.float64).reshape(len(asks), self.values.shape[1])
        products = q @ self.values[self.table["center"]].T
        for j, (ask, own, label, vector, windows) in enumerate(asks):
            side = ((self.labels == label) == same) & (self.ids != own)
            bests = [(low, high, state.setdefault((ask, w), [])) for w, low, high in windows]
            if self.largest * np.abs(q[j]).max(initial=0.0) * max(1, q.shape[1]) >= MAX_EXACT:
                at = np.flatnonzero(side)
                whole = [(max(LOWEST, min(HIGHEST, sum(int(a) * int(b) for a, b in zip(vector, self.whole[i])))),
                          int(self.ids[i])) for i in at]
                for low, high, best in bests:
                    fits = [x for x in whole if low <= x[0] <= high]
                    keep_best(best, [x[0] for x in fits], [x[1] for x in fits], k)
                continue
            lower, upper = bounds(float(q[j] @ q[j]), products[j], self.table["radius"], self.most)
            lower, upper = lower.tolist(), upper.tolist()
            seen: dict[int, tuple] = {}

            def verify(i: int):
                if i not in seen:
                    a, b = self.nodes[i][1], self.nodes[i][2]
                    ok = side[a:b]
                    seen[i] = ((self.values[a:b] @ q[j])[ok], self.ids[a:b][ok])
                return seen[i]

            for low, high, best in bests:
                descend(self.nodes, lower, upper, low, high, label, same, k, best, verify)


def _packer(most: float, k: int):
    """Rows (dim, cell, part, far, id, label, v) in that order of groups -> blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def finish(key, rows):
            dim, cell, part = key
            ids, labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            v = np.array([r[2] for r in rows], np.int64).reshape(len(rows), dim)
            order, nodes = build_tree(augmented(v, most), labels)
            largest = int(max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))))
            width = 2 if largest < 1 << 15 else 4 if largest < 1 << 31 else 8
            norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            one = lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_pydict({
                "dim": one(dim, pa.int32()), "cell": one(cell, pa.int32()), "part": one(part, pa.int64()),
                "n": one(len(rows), pa.int32()), "width": one(width, pa.int32()),
                "radius": one(max(r[3] for r in rows), pa.float64()), "longest": one(float(norms.max()), pa.float64()),
                "ids": one(ids[order].tobytes(), pa.binary()), "labels": one(labels[order].tobytes(), pa.binary()),
                "vectors": one(v[order].astype(f"<i{width}").tobytes(), pa.binary()),
                "nodes": one(nodes.tobytes(), pa.binary())})

        key, rows, copies = None, [], {}
        for batch in batches:
            for at in range(0, len(batch), 512):
                piece = batch.slice(at, 512)
                for dim, cell, part, far, i, label, v in zip(*(piece.column(c).to_pylist() for c in (
                        "dim", "cell", "part", "far", "id", "label", "v"))):
                    if key != (dim, cell, part) or len(rows) == BLOCK_ROWS:
                        if rows:
                            yield finish(key, rows)
                        key, rows, copies = (dim, cell, part), [], {}
                    # ids rise within a group: [ids so far, last id, its rows so far]
                    met = copies.setdefault((label, tuple(v)), [0, None, 0])
                    if met[1] != i:
                        met[0], met[1], met[2] = met[0] + 1, i, 0
                    met[2] += 1
                    if met[0] <= k + 1 and met[2] <= k:
                        rows.append((i, label, v, far))
        if rows:
            yield finish(key, rows)

    return run


# -- the index -------------------------------------------------------------------------

class Index:
    """Blocks with their trees (a written table), and the top of the tree."""

    def __init__(self, blocks: DataFrame, pivots: list, radius: dict, longest: dict, most: float):
        self.blocks, self.pivots, self.radius, self.longest, self.most = blocks, pivots, radius, longest, most


def choose_pivots(sample: list, count: int, most: float) -> list:
    """Farthest-first net of at most ``count`` of the sampled vectors, over all dimensions:
    the next centre is the vector farthest from the centres of its dimension."""
    import numpy as np

    points = [augmented([v], most)[0] for v in sample]
    away = [most * 4.0] * len(points)  # farther than any two can be
    chosen: list[int] = []
    while len(chosen) < min(count, len(points)):
        i = max(range(len(points)), key=lambda j: away[j])
        if away[i] <= 0.0:
            break
        chosen.append(i)
        for j, p in enumerate(points):
            if len(p) == len(points[i]):
                away[j] = min(away[j], float(np.sqrt(((p - points[i]) ** 2).sum())))
    return [sample[i] for i in chosen]


def _by_dimension(pivots: list) -> dict:
    """Dimension -> (cells, centres)."""
    import numpy as np

    found: dict = {}
    for cell, v in enumerate(pivots):
        found.setdefault(len(v), ([], []))
        found[len(v)][0].append(cell)
        found[len(v)][1].append(v)
    return {d: (np.array(cells), np.array(vs, np.float64).reshape(len(vs), d)) for d, (cells, vs) in found.items()}


def _assigned(rows: DataFrame, pivots: list, most: float) -> DataFrame:
    """rows + cell (of the nearest centre; -1 without one) and far, its distance."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centres = {d: (cells, augmented(vs, most)) for d, (cells, vs) in _by_dimension(shared.value).items()}
        for batch in batches:
            for at in range(0, len(batch), 512):
                piece = batch.slice(at, 512)
                cell, far = np.full(len(piece), -1, np.int32), np.zeros(len(piece))
                vectors = piece.column("v").to_pylist()
                for d in {len(v) for v in vectors} & centres.keys():
                    mine = np.array([i for i, v in enumerate(vectors) if len(v) == d])
                    points = augmented(np.array([vectors[i] for i in mine], np.float64).reshape(len(mine), d), most)
                    cells, at_centres = centres[d]
                    away = np.stack([((points - c) ** 2).sum(1) for c in at_centres], axis=1)
                    near = away.argmin(1)
                    cell[mine], far[mine] = cells[near], np.sqrt(away[np.arange(len(mine)), near])
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("id", "label", "v", "dim")), pa.array(cell), pa.array(far)],
                    names=["id", "label", "v", "dim", "cell", "far"])

    return rows.select("id", "label", "v", "dim").mapInArrow(
        run, "id bigint, label bigint, v array<bigint>, dim int, cell int, far double")


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _usable(df: DataFrame) -> DataFrame:
    return (df.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
            .select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
                    F.col("v").cast("array<bigint>").alias("v"), F.size("v").alias("dim")))


def build_index(rows: DataFrame, k: int) -> Index:
    """Index of (id, label, v, dim) rows for searches of at most ``k`` results."""
    n, most = rows.agg(F.count(F.lit(1)), F.max(_norm(F.col("v")))).first()
    most = (most or 0.0) * (1 + 1e-12)
    sample = [r.v for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()]
    pivots = choose_pivots(sample, max(1, min(PIVOTS, n // CELL_ROWS)), most)
    placed = materialise(_assigned(rows, pivots, most), "negatives-cells")
    fill = max(1, int(BLOCK_ROWS * FILL))
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / fill).cast("bigint").alias("parts"))
    dealt = placed.withColumn("place", F.xxhash64("id", F.monotonically_increasing_id())).join(parts, ["dim", "cell"])
    dealt = dealt.select("dim", "cell", F.pmod("place", "parts").alias("part"), "far", "id", "label", "v")
    blocks = (dealt.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "id")
              .mapInArrow(_packer(most, k), BLOCK))
    blocks = materialise(blocks, "negatives-blocks")
    ends = (blocks.filter("cell >= 0").groupBy("cell")
            .agg(F.max("radius").alias("radius"), F.max("longest").alias("longest")).collect())  # at most PIVOTS
    return Index(blocks, pivots, {r.cell: r.radius for r in ends}, {r.cell: r.longest for r in ends}, most)


# -- searching -------------------------------------------------------------------------

def _routed(asks: DataFrame, index: Index, home: bool, tasks: int) -> DataFrame:
    """(ask, dim, cell): the cells each ask has to search: with ``home`` the nearest, else the others whose
    bounds meet a window.  Up to PIVOTS rows an ask, so they carry no vectors, and are written:
    their size is known then, where Spark would guess it from that of the asks."""
    top = asks.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.longest))  # PIVOTS vectors
    most = index.most

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pivots, radius, longest = top.value
        centres = _by_dimension(pivots)

        def cells_of(v, windows):
            cells, at_centres = centres.get(len(v), (np.array([], np.int64), None))
            held = np.array([c in radius for c in cells.tolist()], bool)
            if not held.any():
                return [-1] if home else []
            q = np.array(v, np.float64)
            products = at_centres @ q
            square = float(q @ q)
            nearest = int(cells[np.argmax(np.where(held, products, -np.inf))])
            if home:
                return [nearest]
            away = np.array([radius.get(c, 0.0) for c in cells.tolist()])
            lower, upper = bounds(square, products, away, most)
            reach = square ** 0.5 * np.array([longest.get(c, 0.0) for c in cells.tolist()]) * (1 + SLACK) + 1e-9
            upper = np.minimum(upper, reach)
            fits = np.zeros(len(cells), bool)
            for w in windows:
                fits |= (upper >= w["low"]) & (lower <= w["high"])
            return [c for c in cells[fits & held].tolist() if c != nearest]

        for batch in batches:
            for at in range(0, len(batch), 128):
                piece = batch.slice(at, 128)
                found = [cells_of(v, w) for v, w in zip(piece.column("v").to_pylist(), piece.column("windows").to_pylist())]
                took = pa.array([i for i, cells in enumerate(found) for _ in cells], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("ask").take(took), piece.column("dim").take(took),
                     pa.array([c for cells in found for c in cells], pa.int32())], names=["ask", "dim", "cell"])

    # by number: adaptive execution would join them to one task, as they have few bytes
    dealt = asks.select("ask", "dim", "v", "windows").repartition(tasks, "ask")
    return materialise(dealt.mapInArrow(run, "ask bigint, dim int, cell int"), "negatives-routes")


def _searched(asks: DataFrame, routes: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(ask, window, score, found): at most k rows a window and run of blocks."""
    most = index.most

    def run(left, right):
        import pyarrow as pa

        state: dict = {}
        if len(left) and len(right):
            batch = [(r["ask"], r["id"], r["label"], r["v"], [(w["window"], w["low"], w["high"]) for w in r["windows"]])
                     for r in left.select(["ask", "id", "label", "v", "windows"]).to_pylist()]
            right = right.sort_by("part")
            for at in range(len(right)):
                Block(right.slice(at, 1).to_pylist()[0], most).search(batch, same, k, state)
        out = [(ask, w, -s, i) for (ask, w), best in state.items() for s, i in best]
        cols = list(zip(*out)) if out else [(), (), (), ()]
        return pa.Table.from_pydict({
            "ask": pa.array(cols[0], pa.int64()), "window": pa.array(cols[1], pa.int32()),
            "score": pa.array(cols[2], pa.int64()),
            "found": pa.array(cols[3], pa.int64())})

    keys = ["dim", "cell", "pack", "run"]
    asked = routes.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / PACK_ROWS).cast("bigint").alias("packs"))
    held = index.blocks.groupBy("dim", "cell").agg((F.expr(f"max(part) div {RUN_BLOCKS}") + 1).alias("runs"))
    met = asked.join(held, ["dim", "cell"])
    count = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    # Who meets whom is dealt as narrow rows; vectors join last, by a merge: in files they take a fraction
    # of their memory, so Spark would take sides for small that no broadcast can hold.
    place = ["dim", "cell", "part"]
    left = (routes.join(met, ["dim", "cell"]).withColumn("pack", F.pmod(F.xxhash64("ask"), F.col("packs")))
            .withColumn("run", F.explode(count("runs"))).select(*keys, "ask")
            .join(asks.select("ask", "id", "label", "v", "windows").hint("merge"), "ask")
            .select(*keys, "ask", "id", "label", "v", "windows"))
    right = (index.blocks.select(*place).distinct().join(met, ["dim", "cell"])
             .withColumn("run", F.expr(f"part div {RUN_BLOCKS}")).withColumn("pack", F.explode(count("packs"))).select(*keys, "part")
             .join(index.blocks.select(*place, "n", "width", "ids", "labels", "vectors", "nodes").hint("merge"), place)
             .select(*keys, "part", "n", "width", "ids", "labels", "vectors", "nodes"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        run, "ask bigint, window int, score bigint, found bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window, with their rank from 1: at most k rows a run meet."""
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(asks: DataFrame, windows: DataFrame, index: Index, same: bool, k: int, tasks: int = 1) -> DataFrame:
    """(ask, window, rank, score, found): the first k rows of each window (ask, window, low,
    high), scores in [low, high], with the ask's own label (``same``) or another.  ``tasks``: how many
    tasks route the asks."""

    def searched(w: DataFrame, home: bool) -> DataFrame:
        gathered = w.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct(
            F.col("window").cast("int").alias("window"), "low", "high"))).alias("windows"))
        met = asks.hint("merge").join(gathered, "ask")
        return _searched(met, _routed(met, index, home, tasks), index, same, k)

    near = materialise(_first(searched(windows, True), k), "negatives-near")
    reached = (near.groupBy("ask", "window").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least"))
               .filter(F.col("c") == k).select("ask", "window", "least"))
    raised = (windows.join(reached, ["ask", "window"], "left")
              .select("ask", "window", F.greatest("low", "least").alias("low"), "high"))
    more = searched(raised, False)
    return materialise(_first(near.select("ask", "window", "score", "found").union(more), k), "negatives-found")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  ``rows``
    and ``anchors``: vec_id, label, v (array of whole numbers); the window of a positive is
    low * its score <= 100 * score <= high * its score."""
    ship_package(rows.sparkSession)
    index = build_index(materialise(_usable(rows), "negatives-rows"), max(positives, negatives))
    asks = _usable(anchors).dropDuplicates(["id", "label", "v"])
    asks = materialise(asks.withColumn("ask", F.monotonically_increasing_id()), "negatives-asks")
    tasks = max(1, -(-asks.count() // ROUTE_ROWS))
    all_scores = asks.select("ask", F.lit(0).alias("window"), F.lit(LOWEST).cast("bigint").alias("low"),
                             F.lit(HIGHEST).cast("bigint").alias("high"))
    found = search(asks, all_scores, index, True, positives, tasks).select(
        "ask", F.col("rank").alias("window"), F.col("score").alias("positive_score"), F.col("found").alias("positive_id"))
    exact = F.col("positive_score").cast("decimal(20,0)")
    windows = (found.select("ask", "window", F.ceil(F.lit(low) * exact / 100).cast("bigint").alias("low"),
                            F.floor(F.lit(high) * exact / 100).cast("bigint").alias("high")).filter("low <= high"))
    negative = search(asks, windows, index, False, negatives, tasks)
    return (negative.join(found, ["ask", "window"]).join(asks.select("ask", F.col("id").alias("anchor_id")), "ask")
            .select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
