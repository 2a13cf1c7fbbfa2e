"""Near-duplicate documents: an exact Jaccard self-join of word n-gram sets.

Two sets link if 100 * |A n B| >= percent * |A u B|.  The steps:

1. Sets.  Each document becomes the sorted array of its distinct shingle hashes
   (64 bits); equal sets share an id made from the array and are one node.
2. Order.  Shingles that many sets hold are put last: each task counts its own
   shingles and passes on those it met TASK_TIMES times or more; the HOT_SHINGLES most
   frequent overall are ranked after all others.  Any order is right, so this list may
   be bounded; it keeps frequent passages from making candidates.
3. Candidates.  In that order two linked sets share one of their first shingles: one
   of the first n - ceil(t n) + 1 of the larger and of the first
   n - ceil(2 t n / (1 + t)) + 1 of the smaller.  Only shingles that two different
   sets put forward go on.
4. Tiles.  The sets of one shingle, cut into size bands (a set can link only within
   its band and the next), are tiles.  A tile of more than TILE_ROWS rows is split into
   blocks and its block pairs become tiles of their own, so no task holds a whole hot
   group.  Each pair of a tile whose sizes fit is bounded from above by bitmap
   signatures: each set flips one bit per shingle in a bitmap of at least one bit a
   shingle (folded to the shorter of two), and with d differing bits
   |A n B| <= (|A| + |B| - d) / 2.  Rows of larger tiles bring their bitmaps along; a
   tile of at most SMALL_TILE rows names its pairs, which meet their bitmaps once
   each, as one pair often shares many shingles and most tiles have no pair at all.
5. Verification.  Pairs that pass are intersected exactly, on the sorted arrays of
   the documents concerned.
6. Components by alternating large-star and small-star steps.

A group of G near copies has G * G / 2 linked pairs, but a component needs few of
them.  A tile with more than FEW_PAIRS passing pairs a row hands on the most alike pair
that joins two of its parts, and the next, until it is connected (a spanning
forest), and the pairs it kept back are remembered by the shingle.  After the
components of the first pass those tiles are run again, and every passing pair
between different components is verified.  So no link between components is lost.

Null or empty text, or text without words: an empty set, which links with nothing.
Fewer words than the shingle length: the whole sequence is one shingle.  Null ids
take no part in links; repeated rows are copies.  Long texts give large sets, which tasks
take one at a time.  Empty tables give empty tables.  Hashes of 64 bits stand for
shingles and sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark.llm.common import by_parts, each, released, slices
from bomspark.session import bound_batches, materialise, ship_package

WORDS, PERCENT = 5, 80
TASK_TIMES, HOT_SHINGLES = 8, 100_000
COUNT_BUFFER = 500_000
TILE_ROWS = 2_048
SMALL_TILE = 32
FEW_PAIRS = 4
CACHE_WORDS = 100_000
SEEN_SETS = 200_000


class _WordHashes(dict):
    """64-bit hash of a word; remembers CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHashes()


def _tidy(run):
    """``run`` that leaves neither word hashes nor freed memory in its worker."""
    return released(run, _Hashes())


class _Hashes:
    """The word hashes of the worker that runs the task (pickled by name, so never copied)."""

    def clear(self):
        _HASHES.clear()


def shingles_of(text: str | None, words: int):
    """Sorted distinct shingle hashes (uint64) of one text.  Words are runs without
    ASCII white space, A-Z in lower case (``bytes`` methods do just that)."""
    import numpy as np

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ h[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def set_id(shingles) -> int:
    """Signed 64-bit id of a set (0 for the empty set)."""
    import xxhash

    if len(shingles) == 0:
        return 0
    h = xxhash.xxh3_64_intdigest(shingles.tobytes()) or 1
    return h - (1 << 64) if h >> 63 else h


def signature(shingles) -> bytes:
    """Parity bitmap with a power of two of bits, at least one a shingle."""
    import numpy as np

    bits = max(64, 1 << int(len(shingles) - 1).bit_length())
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """(as the larger, as the smaller) set of a pair."""
    return (n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1)


class _Seen(set):
    def fresh(self, x: int) -> bool:
        if x in self:
            return False
        if len(self) >= SEEN_SETS:
            self.clear()
        self.add(x)
        return True


def _signed(shingles):
    import numpy as np

    return shingles.view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """One pass over the texts: a row (doc_id, sid, n, bits) per document, and rows
    (shingle, times) of the shingles a task met often, copies within a task once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(ids, sids, sizes, bits, shingle, times):
            size = max(len(sids), len(shingle))
            null = lambda kind: pa.nulls(size, kind)
            mine = len(sids) > 0
            return pa.RecordBatch.from_pydict({
                "doc_id": ids if mine else null(pa.int64()),
                "sid": pa.array(sids, pa.int64()) if mine else null(pa.int64()),
                "n": pa.array(sizes, pa.int64()) if mine else null(pa.int64()),
                "bits": pa.array(bits, pa.binary()) if mine else null(pa.binary()),
                "shingle": null(pa.int64()) if mine else pa.array(shingle, pa.int64()),
                "times": null(pa.int64()) if mine else pa.array(times, pa.int64())})

        def often(parts):
            values, times = np.unique(np.concatenate(parts), return_counts=True)
            keep = times >= TASK_TIMES
            return rows(None, [], [], [], _signed(values[keep]), times[keep])

        seen, parts, held = _Seen(), [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            sids, sizes, bits = [], [], []
            for text in each(batch.column("text")):
                s = shingles_of(text, words)
                sids.append(set_id(s))
                sizes.append(len(s))
                bits.append(signature(s) if len(s) else None)
                if len(s) and seen.fresh(sids[-1]):
                    parts.append(s)
                    held += len(s)
                    if held >= COUNT_BUFFER:
                        yield often(parts)
                        parts, held = [], 0
            yield rows(batch.column("doc_id"), sids, sizes, bits, [], [])
        if parts:
            yield often(parts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _tidy(run), "doc_id bigint, sid bigint, n bigint, bits binary, shingle bigint, times bigint")


def _entries(docs: DataFrame, words: int, percent: int, hot) -> DataFrame:
    """(shingle, sid, n, small) of the shingles each set puts forward; ``small``: also
    as the smaller set of a pair.  A task leaves out sets it has just met."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        values, ranks = hot.value  # ascending shingles, and their place among the frequent
        seen = _Seen()
        for batch in (part for whole in batches for part in slices(whole)):
            keys, sids, sizes, small = [], [], [], []
            for text in each(batch.column("text")):
                s = shingles_of(text, words)
                n = len(s)
                if n == 0:
                    continue
                sid = set_id(s)
                if not seen.fresh(sid):
                    continue
                first, as_small = prefix_lengths(n, percent)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    common = values[at] == s
                    chosen = s[~common][:first]
                    if len(chosen) < first:
                        late = s[common][np.argsort(ranks[at[common]], kind="stable")]
                        chosen = np.concatenate([chosen, late[:first - len(chosen)]])
                else:
                    chosen = s[:first]
                keys.append(_signed(chosen))
                sids.append(np.full(first, sid, np.int64))
                sizes.append(np.full(first, n, np.int64))
                small.append(np.arange(first) < as_small)
            if keys:
                yield pa.RecordBatch.from_pydict({
                    "shingle": pa.array(np.concatenate(keys)), "sid": pa.array(np.concatenate(sids)),
                    "n": pa.array(np.concatenate(sizes)), "small": pa.array(np.concatenate(small))})

    return docs.select("text").mapInArrow(_tidy(run), "shingle bigint, sid bigint, n bigint, small boolean")


def _arrays(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, shingles) for the ids of ``wanted`` (doc_id), each read once."""

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole, 16)):  # whole sets go out
            got = [shingles_of(t, words) for t in each(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({
                "sid": pa.array([set_id(g) for g in got], pa.int64()),
                "shingles": pa.array([g.tobytes() for g in got], pa.binary())})

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id")
            .select("text").mapInArrow(_tidy(run), "sid bigint, shingles binary").dropDuplicates(["sid"]))


def _differing(a, b):
    """Differing bits between rows of two bitmap matrices (64-bit words), after
    folding the wider to the narrower."""
    import numpy as np

    while a.shape[1] > b.shape[1]:
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    while b.shape[1] > a.shape[1]:
        half = b.shape[1] // 2
        b = b[:, :half] ^ b[:, half:]
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _fold(value: int, width: int, to: int) -> int:
    """A bitmap of ``width`` bits as one of ``to`` bits."""
    while width > to:
        width //= 2
        value = (value ^ (value >> width)) & ((1 << width) - 1)
    return value


def differing_bits(small: bytes, large: bytes) -> int:
    """Differing bits of two bitmaps, the wider folded to the narrower."""
    if len(small) > len(large):
        small, large = large, small
    return (_fold(int.from_bytes(large, "little"), 8 * len(large), 8 * len(small))
            ^ int.from_bytes(small, "little")).bit_count()


def _may_link(a: int, b: int, differing: int, percent: int) -> bool:
    most = (a + b - differing) // 2  # upper bound of the overlap
    return 100 * most >= percent * (a + b - most)


def passing_pairs(tile: list, split: bool, percent: int) -> list[tuple[int, int, int]]:
    """Pairs (i, j, differing bits) of one tile that sizes and signatures allow.

    ``tile``: rows (sid, n, small, comp, bits, mine, block).  A pair needs different
    sets and components, a row of the tile's own band, the shingle put forward by
    the smaller set as such, and in a split tile different blocks."""

    def joins(x, y) -> bool:  # x is not larger than y
        return (x[0] != y[0] and x[3] != y[3] and (x[5] or y[5]) and (x[2] or (x[1] == y[1] and y[2]))
                and not (split and x[6] == y[6]))

    order = sorted(range(len(tile)), key=lambda i: (tile[i][1], tile[i][0]))
    out = []
    if len(tile) <= SMALL_TILE or tile[0][4] is None:
        for p, i in enumerate(order):
            for j in order[p + 1:]:
                x, y = tile[i], tile[j]
                if 100 * x[1] < percent * y[1]:
                    break  # the rest are larger still
                if joins(x, y):
                    d = 0 if x[4] is None else differing_bits(x[4], y[4])
                    if d == 0 or _may_link(x[1], y[1], d, percent):
                        out.append((i, j, d))
        return out
    import numpy as np

    sids, sizes, small, comps, mine, blocks = (np.array([tile[i][c] for i in order]) for c in (0, 1, 2, 3, 5, 6))
    words = [np.frombuffer(tile[i][4], np.uint64) for i in order]
    widths = np.array([len(w) for w in words])
    same_width = {int(w): np.stack([x for x in words if len(x) == w]) for w in np.unique(widths)}
    place = np.zeros(len(order), np.int64)  # row within its width's matrix
    for w in same_width:
        place[widths == w] = np.arange((widths == w).sum())
    last = np.searchsorted(sizes, 100 * sizes // percent, "right")
    for x in range(len(order)):
        ys = np.arange(x + 1, last[x])
        ok = ((sids[ys] != sids[x]) & (comps[ys] != comps[x]) & (mine[ys] | mine[x])
              & (small[x] | ((sizes[ys] == sizes[x]) & small[ys])))
        if split:
            ok &= blocks[ys] != blocks[x]
        ys = ys[ok]
        for w in np.unique(widths[ys]):
            at = ys[widths[ys] == w]
            d = _differing(words[x][None, :], same_width[int(w)][place[at]])
            total = sizes[x] + sizes[at]
            most = (total - d) // 2
            good = 100 * most >= percent * (total - most)
            out += [(order[x], order[int(y)], int(e)) for y, e in zip(at[good], d[good])]
    return out


def _forest(pairs, n: int):
    """The most alike pairs that connect what ``pairs`` connects."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, j, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            kept.append((i, j, d))
    return kept


def _tile_rows(shared: DataFrame, bits: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame:
    """Rows of ``shared`` (shingle, sid, n, small, rows) dealt to their tiles.  Bands
    are powers of four; a set near the end of its band also visits the next.  The
    rows of larger tiles get their bitmaps."""
    large = shared.filter(F.col("rows") > SMALL_TILE).join(bits.select("sid", "bits"), "sid")
    rows = large
    if comps is None:
        rows = large.unionByName(shared.filter(F.col("rows") <= SMALL_TILE).withColumn("bits", F.lit(None).cast("binary")))
        rows = rows.withColumn("comp", F.col("sid"))
    else:  # only larger tiles keep pairs back
        rows = rows.join(comps.withColumnRenamed("root", "comp"), "sid", "left").withColumn(
            "comp", F.coalesce("comp", "sid"))
    rows = rows.withColumn("blocks", F.ceil(F.col("rows") / TILE_ROWS).cast("bigint"))
    rows = rows.withColumn("own", F.expr("(length(bin(n)) - 1) div 2"))
    visits = F.expr(f"100 * n div {percent} + 1 >= shiftleft(1L, cast(2 * (own + 1) as int))")  # one early is harmless
    rows = rows.withColumn("band", F.explode(
        F.when(visits, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.select("shingle", "band", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"),
                       "sid", "n", "small", "comp", "bits", (F.col("own") == F.col("band")).alias("mine"), "block")


def _passing(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b, bounded, shingle): the pairs that pass in their tiles, a < b; ``bounded``
    if their signatures were compared.  A row with a shingle and no pair marks a
    shingle with a tile that kept pairs back (only unless ``every``)."""

    def run(batches):
        import pyarrow as pa

        def finish(key, tile, out):
            if len(tile) < 2:
                return
            tile = list(tile.values())
            bounded = tile[0][4] is not None
            pairs = passing_pairs(tile, key[2] != key[3], percent)
            if bounded and not every and len(pairs) > FEW_PAIRS * len(tile):
                pairs = _forest(pairs, len(tile))
                out.append((None, None, None, key[0]))
            out += [(*sorted((tile[i][0], tile[j][0])), bounded, None) for i, j, _ in pairs]

        def emit(out):
            a, b, bounded, shingle = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                                               "bounded": pa.array(bounded, pa.bool_()),
                                               "shingle": pa.array(shingle, pa.int64())})

        tile, key, out = {}, None, []  # rows by set: copies from other tasks fall together
        for batch in (part for whole in batches for part in slices(whole)):
            for row in zip(*(batch.column(c).to_pylist() for c in (
                    "shingle", "band", "b0", "b1", "sid", "n", "small", "comp", "bits", "mine", "block"))):
                if key != row[:4]:
                    finish(key, tile, out)
                    tile, key = {}, row[:4]
                    if len(out) > 10_000:
                        yield emit(out)
                        out = []
                tile[row[4]] = row[4:]
        finish(key, tile, out)
        yield emit(out)

    return (rows.repartition("shingle", "band", "b0", "b1").sortWithinPartitions("shingle", "band", "b0", "b1")
            .mapInArrow(_tidy(run), "a bigint, b bigint, bounded boolean, shingle bigint"))


def _bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures allow."""

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            a, b = [], []
            for x, y, nx, ny, bx, by in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "ba", "bb"))):
                if _may_link(nx, ny, differing_bits(bx, by), percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    left = bits.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = bits.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_tidy(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets really link, by exact intersection."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for x, y, sx, sy in zip(*(batch.column(c) for c in ("a", "b", "sa", "sb"))):  # sets stay in Arrow's memory
                left, right = np.frombuffer(sx.as_buffer(), np.uint64), np.frombuffer(sy.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = materialise(sids.join(reps, "sid").select(F.col("rep").alias("doc_id")).distinct(), "jaccard-wanted")
    arrays = materialise(_arrays(docs, wanted, words), "jaccard-arrays")
    left = arrays.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = arrays.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    return materialise(pairs.join(left, "a").join(right, "b").mapInArrow(_tidy(run), "a bigint, b bigint"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """(sid, root) for every node of the edges (a, b): root is the smallest node
    reachable.  Alternates large-star and small-star until every node hangs on one
    node that hangs on none; each round is written to the shared folder."""

    def done(e: DataFrame) -> bool:
        ends = (e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
                .union(e.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")))
        return ends.filter("up > 1 OR up + down > 1").isEmpty()

    e = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                    "components")
    while not done(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        e = materialise(small, "components")
    return (e.select(F.col("u").alias("sid"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("sid"), F.col("v").alias("root"))).distinct())


def set_ids(text: Column, words: int = WORDS) -> Column:
    """The id of a text's set, as in ``document_sets``."""

    def ids(texts):
        import pyarrow as pa

        return pa.array([set_id(shingles_of(t, words)) for t in texts.to_pylist()], pa.int64())

    return by_parts(ids, "bigint", text)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text);
    component_id is the smallest doc_id reachable by links (null for a null id)."""
    return document_sets(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def document_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``near_duplicates`` with sid, the id of the row's set, and root, the
    id of its component.  A component_id may stand for several components if a doc_id
    repeats with different texts; a root stands for one."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    first = materialise(_sets(docs, words), "jaccard-sets")
    members = first.filter("n IS NOT NULL").select("doc_id", "sid", "n")
    hot_rows = (first.filter("times IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times"))
                .orderBy(F.desc("times"), "shingle").limit(HOT_SHINGLES).collect())  # bounded by HOT_SHINGLES
    hot = spark.sparkContext.broadcast(_hot_table([(r.shingle, r.times) for r in hot_rows]))

    usable = docs.filter(F.col("doc_id").isNotNull())
    reps = (members.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep")))
    bits = first.filter("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    entries = _entries(usable, words, percent, hot)
    entries = materialise(entries, "jaccard-entries")
    hot.destroy()
    met = (entries.groupBy("shingle").agg(F.min("sid").alias("x"), F.max("sid").alias("y"), F.count(F.lit(1)).alias("rows"))
           .filter("x != y").select("shingle", "rows"))
    shared = materialise(entries.join(met, "shingle"), "jaccard-shared")

    passed = materialise(_passing(_tile_rows(shared, bits, None, percent), percent, every=False), "jaccard-passed")
    named = materialise(passed.filter("NOT bounded").select("a", "b").distinct(), "jaccard-named")
    pairs = materialise(passed.filter("bounded").select("a", "b").union(_bounded(named, bits, percent)).distinct(),
                        "jaccard-pairs")
    links = _verified(pairs, usable, reps, words, percent)
    comps = components(links)
    kept_back = passed.filter("shingle IS NOT NULL").select("shingle").distinct()
    if not kept_back.isEmpty():
        again = _tile_rows(shared.join(kept_back, "shingle", "left_semi"), bits, comps, percent)
        more = _passing(again, percent, every=True).select("a", "b").distinct()
        more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "jaccard-pairs")
        comps = components(links.union(_verified(more, usable, reps, words, percent)))
    smallest = comps.join(reps, "sid").groupBy("root").agg(F.min("rep").alias("least"))
    labels = (reps.join(comps, "sid", "left").join(smallest, "root", "left")
              .select("sid", F.coalesce("least", "rep").alias("component"), F.coalesce("root", "sid").alias("root")))
    return (members.join(labels, "sid", "left")
            .select("doc_id", "sid", "root", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component")))
                    .otherwise(F.col("doc_id")).alias("component_id")))


def _hot_table(rows: list[tuple[int, int]]):
    """(ascending shingles, place of each by rising frequency)."""
    import numpy as np

    values = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    times = np.array([r[1] for r in rows], np.int64)
    order = np.lexsort((values, times))
    ranks = np.empty(len(rows), np.int64)
    ranks[order] = np.arange(len(rows))
    up = np.argsort(values)
    return values[up], ranks[up]
