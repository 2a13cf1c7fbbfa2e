"""Exact top-k inner products by norm-bucketed retrieval.

Vectors of whole numbers are grouped by length (norm) into buckets of at most
BUCKET_ROWS, packed one bucket to a row, however many rows share a length or an id.
Queries are packed in blocks of about QUERY_ROWS.  A task takes one query block and one run of RUN_BUCKETS buckets,
longest first, and keeps for every query the k best so far; theta is the k-th best
product.  For a bucket whose longest vector has length l, a candidate can only
reach theta if its cosine with the query is at least t = theta / (|q| l), the local
threshold:

* t > 1: no vector of the bucket can, so the bucket is skipped (length pruning of
  the whole bucket, and as buckets get shorter, of the rest of the run);
* t >= COORD_FROM: coordinate pruning.  On the FOCUS largest coordinates of the
  query, a unit vector with cosine >= t must lie in
  q_f t +- sqrt((1 - t^2)(1 - q_f^2)); candidates outside are dropped;
* else: length pruning.  Candidates shorter than theta / |q| are dropped.

What is left is verified by exact products.  Bounds are widened by SLACK, so
rounding cannot drop a candidate, and candidates equal to theta stay, for ties.
Runs are independent tasks; their k best per query are merged by a window over at
most k rows per run.

Every query meets every bucket that may hold one of its k best, in blocks, as the task is
exact search for a stated query set.  First all blocks search the FIRST longest
buckets; the k-th best product of a query over its norm is the length a better candidate needs, and
a block is then joined only with buckets whose longest vector has the least length that
some query of the block needs.  Vectors travel in the narrowest whole numbers that hold a pack.

Ties go to the smaller id.  Vectors that are null, or hold null or non-finite
components, take no part; vectors of different dimension are not compared.  Rows
that repeat an id are separate candidates; a query never meets a row of its own id.
Queries that repeat (equal id and vector) count once.  Without vectors or queries the result
is empty.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomspark.session import materialise, ship_package

BUCKET_ROWS = 4_096
FILL = 0.9  # share of BUCKET_ROWS that rows are dealt for: a hash deals unevenly
QUERY_ROWS = 512
RUN_BUCKETS = 8
FIRST = 2
FOCUS = 5
COORD_FROM = 0.35
SLACK = 1e-9
MAX_EXACT = float(1 << 53)

PACK = "dim int, part bigint, n int, longest double, width int, ids binary, vectors binary"


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null unless all are finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")))


def _packed(rows: DataFrame, part: Column, order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows (id, v, norm) packed to one row per (dimension, part), in the given order.
    A part of more than ``limit`` rows becomes several packs."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        group, key = [], None

        def flush():
            ids = np.array([g[0] for g in group], np.int64)
            vectors = np.array([g[1] for g in group], np.int64).reshape(len(group), key[0])
            largest = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
            width = 2 if largest < 1 << 15 else 4 if largest < 1 << 31 else 8
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int64()),
                "n": pa.array([len(group)], pa.int32()), "longest": pa.array([max(g[2] for g in group)], pa.float64()),
                "width": pa.array([width], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                "vectors": pa.array([vectors.astype(f"<i{width}").tobytes()], pa.binary())})

        for batch in batches:
            for dim, p, i, v, norm in zip(*(batch.column(c).to_pylist() for c in ("dim", "part", "id", "v", "norm"))):
                if key != (dim, p) or len(group) == limit:
                    if group:
                        yield flush()
                    group, key = [], (dim, p)
                group.append((i, v, norm))
        if group:
            yield flush()

    return (rows.withColumn("part", part).select("dim", "part", "id", "v", "norm")
            .repartition("dim", "part").sortWithinPartitions("dim", "part", *order)
            .mapInArrow(pack, PACK))


def _norm_part(rows: DataFrame, n: int) -> Column:
    """Bucket of a row of a written table by its norm, longest first.  Bands lie between
    bounds at approximate quantiles; each is counted and dealt into as many buckets as
    its rows need, by a hash of the id and the row's place, so neither equal norms nor
    equal ids make a large bucket."""
    if n <= BUCKET_ROWS:
        return F.lit(0).cast("bigint")
    fill = max(1, int(BUCKET_ROWS * FILL))
    buckets = -(-n // fill)
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(rows.agg(F.percentile_approx("norm", cuts, 20 * buckets)).first()[0]), reverse=True)
    step = max(1, int(len(bounds) ** 0.5))
    block = F.greatest(F.size(F.filter(F.lit(bounds[::step]), lambda b: b >= F.col("norm"))) - 1, F.lit(0))
    inside = F.slice(F.lit(bounds), block * step + 1, step)
    band = block * step + F.size(F.filter(inside, lambda b: b >= F.col("norm")))
    held = {r.band: r["count"] for r in rows.groupBy(band.alias("band")).count().collect()}  # one row per bound
    parts = [max(1, -(-held.get(i, 0) // fill)) for i in range(len(bounds) + 1)]
    before = [0, *accumulate(parts)][:-1]
    place = F.xxhash64("id", F.monotonically_increasing_id())
    return (F.get(F.lit(before), band) + F.pmod(place, F.get(F.lit(parts), band))).cast("bigint")


def search_bucket(query, ids, vectors, norms, q_norm: float, longest: float, best: list, k: int, own: int) -> None:
    """Bring ``best`` (sorted (-score, id) pairs, at most k) up to date with one
    bucket, sorted by falling norm.  ``vectors`` are float64 and exact."""
    import numpy as np

    rows = np.arange(len(ids))
    if len(best) == k and q_norm > 0:
        theta = -best[-1][0]
        if theta > 0:
            need = theta / q_norm * (1 - SLACK)
            if longest < need:
                return
            local = min(1.0, need / longest)
            if local >= COORD_FROM:
                unit = query / q_norm
                keep = norms >= need
                for f in np.argsort(-np.abs(unit))[:FOCUS]:
                    wide = ((1 - local * local) * max(0.0, 1 - unit[f] ** 2)) ** 0.5 + SLACK
                    side = vectors[:, f]
                    keep &= (side >= (unit[f] * local - wide) * norms) if unit[f] >= 0 else (
                        side <= (unit[f] * local + wide) * norms)
                rows = np.flatnonzero(keep)
            else:
                rows = rows[:int(np.searchsorted(-norms, -need, "right"))]
        elif theta == 0 and longest == 0:
            pass  # zero vectors tie with theta
    if len(rows) == 0:
        return
    scores = vectors[rows] @ query
    cand = ids[rows]
    other = cand != own  # any number of rows may have the query's id
    scores, cand = scores[other], cand[other]
    if len(best) == k:
        close = scores >= -best[-1][0]
        scores, cand = scores[close], cand[close]
    elif len(scores) > 4 * k:
        close = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, cand = scores[close], cand[close]
    best += [(-int(s), int(i)) for s, i in zip(scores.tolist(), cand.tolist())]
    best.sort()
    del best[k:]


def _exact_products(query, vectors):
    """Products as Python integers, for components too large for floating point."""
    return [sum(int(a) * int(b) for a, b in zip(query, v)) for v in vectors]


def _search(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def unpack(ids, vectors, n, dim, width):
            return np.frombuffer(ids, np.int64), np.frombuffer(vectors, f"<i{width}").reshape(n, dim)

        state: dict = {}
        key = None

        def flush():
            out = [(q, key[2], -s, i) for (_, q), best in state.items() for s, i in best]
            cols = list(zip(*out)) if out else [(), (), (), ()]
            return pa.RecordBatch.from_pydict({
                "query_id": pa.array(cols[0], pa.int64()), "run": pa.array(cols[1], pa.int64()),
                "score": pa.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in cols[2]], pa.int64()),
                "id": pa.array(cols[3], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["dim"], r["q_part"], r["run"])
                if now != key:
                    if key is not None:
                        yield flush()
                    key, state = now, {}
                    q_ids, q_rows = unpack(r["q_ids"], r["q_vectors"], r["q_n"], r["dim"], r["q_width"])
                    q_float = q_rows.astype(np.float64)
                    q_norms = np.sqrt((q_float * q_float).sum(1))
                    q_most = np.abs(q_float).max(initial=0.0)
                ids, rows = unpack(r["ids"], r["vectors"], r["n"], r["dim"], r["width"])
                values = rows.astype(np.float64)
                exact = q_most * np.abs(values).max(initial=0.0) * max(1, r["dim"]) < MAX_EXACT
                norms = np.sqrt((values * values).sum(1))
                for j, q in enumerate(q_ids.tolist()):
                    best = state.setdefault((j, q), [])
                    if exact:
                        search_bucket(q_float[j], ids, values, norms, q_norms[j], norms[0], best, k, q)
                    else:
                        scores = _exact_products(q_rows[j], rows)
                        best += [(-s, i) for s, i in zip(scores, ids.tolist()) if i != q]
                        best.sort()
                        del best[k:]
        if key is not None:
            yield flush()

    return run


def top_products(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "v") -> DataFrame:
    """The k largest inner products of each query with all vectors but those of its
    own id: query_id, rank (from 1), id, score.  ``vector`` holds array<bigint>."""
    ship_package(vectors.sparkSession)

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        return (df.filter(v.isNotNull() & F.col(id_col).isNotNull())
                .select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.size(v).alias("dim"),
                        F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")))

    rows, asked = prepared(vectors), prepared(queries).dropDuplicates(["id", "v"])
    rows = materialise(rows, "topk-rows")  # a row's place must not change
    n = rows.count()
    buckets = materialise(_packed(rows, _norm_part(rows, n), [F.desc("norm"), F.col("id")], BUCKET_ROWS), "topk-buckets")
    q_parts = max(1, -(-asked.count() // QUERY_ROWS))
    # queries differ in id or vector, so this hash deals them evenly
    q_part = F.pmod(F.xxhash64("id", "v"), F.lit(q_parts))
    blocks = materialise(_packed(asked, q_part, [F.col("id")]), "topk-queries").select(
        "dim", F.col("part").alias("q_part"), F.col("n").alias("q_n"), F.col("width").alias("q_width"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    buckets = buckets.withColumn("run", F.col("part").cast("bigint") % F.lit(max(1, -(-n // (BUCKET_ROWS * RUN_BUCKETS)))))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def best_of(sent: DataFrame) -> DataFrame:
        """The k best of each query among the buckets sent to its block."""
        pairs = (sent.join(blocks, ["dim", "q_part"]).repartition("dim", "q_part", "run")
                 .sortWithinPartitions("dim", "q_part", "run", F.desc("longest"), "part"))
        found = pairs.mapInArrow(_search(k), "query_id bigint, run bigint, score bigint, id bigint")
        return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_parts - 1).cast("bigint")))
    first = materialise(best_of(buckets.filter(F.col("part") < FIRST).withColumn("q_part", every)), "topk-first")
    # the length that a better candidate needs; 0 where it is not known (ids of several vectors, too)
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    once = asked.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    need = F.when((F.col("score") > 0) & (F.col("norm") > 0) & (F.col("times") == 1), F.col("score") / F.col("norm")).otherwise(0.0)
    needs = (asked.select("id", "norm", "dim", q_part.alias("q_part")).join(kth, "id", "left").join(once, "id")
             .groupBy("dim", "q_part").agg(F.min(need).alias("need")))
    wanted = (buckets.filter(F.col("part") >= FIRST).select("dim", "part", "longest").join(needs, "dim")
              .filter(F.col("longest") >= F.col("need") * (1 - SLACK)).select("dim", "part", "q_part")
              .distinct())  # a part may be several packs
    more = best_of(buckets.join(wanted, ["dim", "part"]))
    both = first.drop("rank").unionByName(more.drop("rank"))
    return (both.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
