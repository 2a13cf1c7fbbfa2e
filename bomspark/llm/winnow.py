"""Document fingerprints by winnowing.

Every run of K characters gets a rolling hash; in every window of W successive
hashes the smallest is chosen, the rightmost of equal ones, and kept with its
position.  Two texts that share a passage of W + K - 1 characters or more
therefore share a fingerprint at the same place of that passage; positions let a
match be located.  A text of fewer than K characters is one gram as a whole; one
with fewer than W grams is one window; the empty text has no fingerprint.

Hashes have HASH_BITS bits.  Texts are processed in blocks of BLOCK characters that
overlap by W + K - 2, so a long text needs bounded memory and gives the same result.

Likeness of two fingerprints is 2 |A n B| / (|A| + |B|) over their hash sets: 1 for
two empty ones, 0 if only one is empty.

Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomspark.llm.common import by_parts
from bomspark.session import ship_package

K, W = 12, 24
HASH_BITS = 40
BLOCK = 1 << 20
RANGE_ROWS, MAX_RANGES = 2_000, 20_000
TIE_BITS = 32
SPAN_TYPE = "array<struct<hash:bigint,pos:bigint>>"
LOWEST = -(1 << 63)


def _grams(codes, k: int):
    """Polynomial hash of every run of k codes, finished by a mix; uint64."""
    import numpy as np

    base = np.uint64(0x9E3779B97F4A7C15)
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    out, done, need = None, 0, k
    size, power = 1, base  # h covers `size` codes, power = base ** size
    while need:
        if need & 1:
            if out is None:
                out, done = h, size
            else:
                n = len(codes) - done - size + 1
                out = out[:n] * power + h[done:done + n]
                done += size
        need >>= 1
        if need:
            n = len(codes) - 2 * size + 1
            h = h[:n] * power + h[size:size + n]
            size, power = 2 * size, power * power
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def fingerprint_text(text: str, k: int = K, w: int = W, block: int = BLOCK):
    """(hashes, positions) of one text, ordered by position."""
    import numpy as np

    n = len(text)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = min(k, n)
    w = min(w, n - k + 1)
    low = np.uint64(64 - HASH_BITS)
    mask = np.uint64((1 << (64 - HASH_BITS)) - 1)
    hashes, places = [], []
    with np.errstate(over="ignore"):
        for at in range(0, n - k - w + 2, block):
            codes = np.frombuffer(text[at:at + block + k + w - 2].encode("utf-32-le", "surrogatepass"), np.uint32)
            h = _grams(codes, k) >> low
            # hash above, reversed position below: the smallest is the rightmost of equal hashes
            key = (h << low) | (mask - np.arange(len(h), dtype=np.uint64))
            size, best = 1, key
            while size < w:  # smallest of each window by doubling
                step = min(size, w - size)
                best = np.minimum(best[:len(best) - step], best[step:])
                size += step
            pos = (mask - (best & mask)).astype(np.int64)
            pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
            hashes.append(h[pos].astype(np.int64))
            places.append(pos + at)
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    fresh = np.concatenate([[True], places[1:] != places[:-1]])  # blocks may choose one place twice
    return hashes[fresh], places[fresh]


def _span_array(rows):
    """Fingerprints as one Arrow array of SPAN_TYPE."""
    import numpy as np
    import pyarrow as pa

    none = [np.empty(0, np.int64)]
    values = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([r[i] for r in rows] or none)) for i in (0, 1)], ["hash", "pos"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(h) for h, _ in rows], dtype=np.int32)), values)


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, w: int = W) -> DataFrame:
    """Add ``out``: the fingerprint as array<struct<hash, pos>>; a column of that name
    is replaced."""
    ship_package(df.sparkSession)
    return df.withColumn(out, by_parts(
        lambda texts: _span_array([fingerprint_text(t or "", k, w) for t in texts.to_pylist()]), SPAN_TYPE, F.col(text)))


def pack(text: Column) -> Column:
    """A text (null: empty) as compressed bytes, to be shuffled at half the size."""

    def packed(texts):
        import pyarrow as pa

        codec = pa.Codec("zstd")
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
        return pa.array([len(r).to_bytes(8, "little") + codec.compress(r, asbytes=True) for r in raw], pa.binary())

    return by_parts(packed, "binary", text)


def unpack_text(packed: bytes) -> str:
    import pyarrow as pa

    size = int.from_bytes(packed[:8], "little")
    return pa.Codec("zstd").decompress(packed[8:], size, asbytes=True).decode("utf-8", "surrogatepass") if size else ""


def edited_text(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the start
    of another, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COMPARED = (f"struct<n_chars:bigint,edited_sha256:string,own:{SPAN_TYPE},edited:{SPAN_TYPE},"
            "near_edited:double,near_next:double>")


def compare_edited(text: Column, following: Column, k: int = K, w: int = W) -> Column:
    """COMPARED of two packed texts: length, digest of the edited text, the
    fingerprints of the text and the edited text, and the likeness of the text's to the
    edited text's and to the other text's.  As rows come in order, the other text is
    mostly the next row's, whose fingerprint is kept."""

    def compared(texts, others):
        import hashlib

        import pyarrow as pa

        known: dict[bytes, tuple] = {}

        def prints(packed, text):
            if packed not in known:
                known[packed] = fingerprint_text(text, k, w)
            return known[packed]

        sizes, digests, own, edited, near_edited, near_next = [], [], [], [], [], []
        for a, b in zip(texts.to_pylist(), others.to_pylist()):
            text, other = unpack_text(a), unpack_text(b)
            changed = edited_text(text, other)
            sizes.append(len(text))
            digests.append(hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest())
            own.append(prints(a, text))
            edited.append(fingerprint_text(changed, k, w))
            near_edited.append(likeness(own[-1][0], edited[-1][0]))
            near_next.append(likeness(own[-1][0], prints(b, other)[0]))
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), _span_array(own), _span_array(edited),
             pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())],
            ["n_chars", "edited_sha256", "own", "edited", "near_edited", "near_next"])

    return by_parts(compared, COMPARED, text, following)


def likeness(a, b) -> float:
    """Likeness of two fingerprints' hashes."""
    import numpy as np

    x, y = np.unique(a), np.unique(b)
    both = len(x) + len(y)
    return 2.0 * len(np.intersect1d(x, y, assume_unique=True)) / both if both else 1.0


def with_next(df: DataFrame, order: str, tie: str, value: str, out: str = "next") -> DataFrame:
    """Add the ``value`` of the next row in ascending ``order``, the first row's for
    the last.  Null order comes first; equal ones are ordered by ``tie``, a hash in
    [0, 2^TIE_BITS); a single row follows itself.

    No task sees all rows: rows are dealt to ranges of the order value at
    approximate quantiles (RANGE_ROWS rows each, at most MAX_RANGES ranges, whose
    bounds the driver holds), and the first row of each range is also sent to the
    range before it, where it stands last.  An order value that is several quantiles at
    once (a hot id, or all null ids) is cut into as many slices by ``tie``.  Rows equal in
    every column, more of them than a range should hold, travel as one row with their
    number: each but the last is followed by its equal.  The window over a range sorts and
    spills, so ranges beyond MAX_RANGES * RANGE_ROWS rows grow in time, not in memory."""
    spark = df.sparkSession
    key, pid, tail, times = "__next_key", "__next_range", "__next_tail", "__next_times"
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn(key, F.coalesce(F.col(order).cast("bigint"), F.lit(LOWEST)))
    ids = rows.select(key, F.col(tie).alias("__next_tie"))
    n = ids.count()
    if n == 0:
        return df.withColumn(out, F.col(value))
    ranges = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
    cuts = [i / ranges for i in range(1, ranges)]
    quantiles = ids.agg(F.percentile_approx(key, cuts, 10 * ranges)).first()[0] if cuts else []
    bounds = sorted(set(quantiles))
    slices = [1] + [quantiles.count(b) if len(bounds) < len(quantiles) else 1 for b in bounds]  # by range

    def range_of(x: Column, t: Column) -> Column:
        """The number of bounds at or below x, looked up in two steps, then its slice: values
        behind a bound that is cut come after all of its slices."""
        if not bounds:
            return F.lit(0).cast("bigint")
        step = max(1, int(len(bounds) ** 0.5))
        coarse = F.lit(bounds[::step])
        block = F.greatest(F.size(F.filter(coarse, lambda b: b <= x)) - 1, F.lit(0))
        inside = F.slice(F.lit(bounds), block * step + 1, step)
        at = block * step + F.size(F.filter(inside, lambda b: b <= x))
        if max(slices) == 1:
            return at.cast("bigint")
        m = F.get(F.lit(slices), at).cast("bigint")
        own = (at > 0) & (x == F.get(F.lit(bounds), F.greatest(at - 1, F.lit(0))))
        return at * (MAX_RANGES + 1) + F.when(m == 1, 0).when(own, F.shiftright(t * m, TIE_BITS)).otherwise(m)

    # at most MAX_RANGES pairs hold that many rows each
    many = [tuple(r) for r in ids.groupBy(key, "__next_tie").count().filter(
        F.col("count") > max(RANGE_ROWS, n // MAX_RANGES)).select(key, "__next_tie").collect()] if max(slices) > 1 else []
    rows = rows.withColumn(times, F.lit(1).cast("bigint"))
    if many:
        pairs = F.broadcast(spark.createDataFrame(many, "__m_key bigint, __m_tie bigint"))
        met = (F.col(key) == F.col("__m_key")) & (F.col(tie) == F.col("__m_tie"))
        packed = rows.join(pairs, met, "left_semi").groupBy(*columns, key).agg(F.sum(times).alias(times))
        rows = rows.join(pairs, met, "left_anti").unionByName(packed)
    rows = rows.withColumn(pid, range_of(F.col(key), F.col(tie)))
    firsts = (ids.withColumn(pid, range_of(F.col(key), F.col("__next_tie"))).groupBy(pid)
              .agg(F.min(F.struct(key, "__next_tie")).alias("f")).select(pid, "f.*").collect())  # one row a range or slice
    firsts = sorted(tuple(r) for r in firsts)
    before = [(firsts[i][1], firsts[i][2], firsts[i - 1][0]) for i in range(len(firsts))]
    heads = spark.createDataFrame(before, "__h_key bigint, __h_tie bigint, __next_to bigint")
    rows = rows.join(F.broadcast(heads), (F.col(key) == F.col("__h_key")) & (F.col(tie) == F.col("__h_tie")), "left")
    rows = rows.withColumn("__next_at", F.explode(F.filter(
        F.array(F.struct(F.col(pid).alias("p"), F.lit(False).alias("t")),
                F.struct(F.col("__next_to").alias("p"), F.lit(True).alias("t"))), lambda a: a["p"].isNotNull())))
    rows = rows.withColumns({pid: F.col("__next_at.p"), tail: F.col("__next_at.t")})
    # the tails of the last range are the first rows of all: they come after its own
    follows = Window.partitionBy(pid).orderBy(tail, key, tie)
    found = rows.withColumn("__next_value", F.lead(value).over(follows)).filter(~F.col(tail))
    if many:
        found = found.withColumn("__next_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).withColumn(
            "__next_value", F.when(F.col("__next_i") < F.col(times), F.col(value)).otherwise(F.col("__next_value")))
    return found.withColumn(out, F.col("__next_value")).select(*[c for c, name in zip(columns, df.columns) if name != out], out)
