"""Grouping of spelling variants by reduced-alphabet generation.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point.  Near words are found without comparing all words:

1. Every letter is hashed to one of SYMBOLS symbols (code point modulo SYMBOLS), so a word
   becomes a reduced word, and near words become reduced words at most one edit apart.
   A reduced word is one number: its symbols as digits behind a leading one.
2. Each distinct reduced word generates its full one-edit neighbourhood over the few
   symbols (itself, every deletion, replacement and insertion: about 2 * SYMBOLS numbers a
   letter).  The relation is symmetric, so of a pair the larger number alone hands on
   the smaller.
3. The neighbourhoods are joined with the reduced vocabulary, which holds each reduced
   word once, so no key of this join is hot.
4. The words behind the two reduced words of a match are compared as they are
   (``levenshtein``, ended beyond one edit).

Words behind one reduced word.  Two reduced words whose words would make more than
HEAVY_PAIRS comparisons are not expanded.  Their words, and words of LONG_CHARS or
more code points, whose reduced words would not fit a number, go through the same generation
with the finest alphabet, each letter its own symbol; there a word's deletions are
enough, as 64-bit hashes: words that share the deletion at one place differ by a
replacement there, and a deletion that is itself a word is an insertion.  Such a
group holds at most one word for each letter of the alphabet, and a word of k
letters makes 2 k rows of 20 bytes, so neither hot reduced words nor very long words make
all pairs of a group.  The original strings are verified on this path, too.

A word's form is its near word of largest n (ties: the smallest in code-point order), if
that n is at least ``ratio`` times the word's own; the root is reached by following forms to
the last.  n grows along a chain, so there is no cycle, and chains double their step a
round (a bigint allows 19 forms at ratio 10: five rounds).

Defined cases.  Null words are no words.  Repeated (word, n) rows must be summed before
(``vocabulary`` does).  Words without a near word have n_near 0 and null form; an empty
vocabulary gives an empty result.  Any characters may occur in words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomspark.llm.common import slices
from bomspark.session import materialise, ship_package

SYMBOLS = 8
BITS = 3  # of a symbol
HEAVY_PAIRS = 10_000
LONG_CHARS = 20  # one letter more still fits 64 bits
RATIO = 10


def vocabulary(words: DataFrame, word: str = "word", min_chars: int = 1, min_count: int = 1) -> DataFrame:
    """(word, n): the distinct words with their number of rows, counted in the tasks
    first, so a word that fills a third of all rows is no hot key."""
    return (words.filter(F.length(word) >= min_chars).groupBy(F.col(word).alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def reduced(word: str) -> int:
    """The word's symbols as digits behind a leading one."""
    code = 1
    for c in word:
        code = code << BITS | ord(c) % SYMBOLS
    return code


def neighbourhoods(codes, length: int):
    """For reduced words (uint64) of ``length`` symbols, one row each: itself, its deletions,
    replacements and insertions (with repeats)."""
    import numpy as np

    codes = np.asarray(codes, np.uint64)
    symbols = np.arange(SYMBOLS, dtype=np.uint64)

    def up(x, places: int):
        return x << np.uint64(BITS * places)

    def down(x, places: int):
        return x >> np.uint64(BITS * places)

    found = [codes[:, None]]
    for i in range(length + 1):  # places from the last symbol
        low = codes & (up(np.uint64(1), i) - np.uint64(1))
        found.append((up(down(codes, i), i + 1) | low)[:, None] | up(symbols, i))
        if i < length:
            found.append((up(down(codes, i + 1), i) | low)[:, None])
            found.append((up(down(codes, i + 1), i + 1) | low)[:, None] | up(symbols, i))
    return np.concatenate(found, axis=1)


def _reduced(words: DataFrame) -> DataFrame:
    """(word, r) of words of at most LONG_CHARS code points."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 4096):
                word = part.column("word")
                yield pa.RecordBatch.from_arrays(
                    [word, pa.array([signed(reduced(w)) for w in word.to_pylist()], pa.int64())], names=["word", "r"])

    return words.select("word").filter(F.length("word") <= LONG_CHARS).mapInArrow(run, "word string, r bigint")


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def _neighbours(counted: DataFrame) -> DataFrame:
    """(r1, c1, r2): the neighbourhood of each reduced word (r, c) as far as it is not larger."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2048):
                r = part.column("r").to_numpy(zero_copy_only=False).view(np.uint64)
                c = part.column("c").to_numpy(zero_copy_only=False)
                size = np.array([(int(x).bit_length() - 1) // BITS for x in r])
                for length in np.unique(size):
                    mine = size == length
                    near = np.sort(neighbourhoods(r[mine], int(length)), axis=1)
                    fresh = np.ones(near.shape, bool)
                    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
                    at, column = np.nonzero(fresh & (near <= r[mine][:, None]))
                    yield pa.RecordBatch.from_pydict({
                        "r1": pa.array(r[mine][at].view(np.int64)), "c1": pa.array(c[mine][at]),
                        "r2": pa.array(near[at, column].view(np.int64))})

    return counted.mapInArrow(run, "r1 bigint, c1 bigint, r2 bigint")


def deletion_hashes(word: str):
    """(hash of the word, hashes of the word without each of its letters), uint64, in
    time linear in the word: sums of letter values times powers of an odd base, of which
    the part behind the gap moves down by one power."""
    import numpy as np

    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        values = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(29)
        values *= np.uint64(0x94D049BB133111EB)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(codes) - 1), base, np.uint64)]))[:len(codes)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers, dtype=np.uint64)])
        behind = (sums[-1] - sums[1:]) * np.uint64(inverse)
        return sums[-1], sums[:-1] + behind


def _deletions(words: DataFrame) -> DataFrame:
    """(key, whole, id): for each word its own hash (``whole``) and the hashes of its
    deletions, once with the place for replacements (whole null) and once without for
    insertions (whole false); id is the word's 64-bit hash."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def emit(keys, kinds, ids):
            return pa.RecordBatch.from_pydict({
                "key": pa.array(np.concatenate(keys).view(np.int64)), "kind": pa.array(np.concatenate(kinds)),
                "id": pa.array(np.concatenate(ids))})

        keys, kinds, ids, held = [], [], [], 0
        for batch in batches:
            for word, i in zip(batch.column("word"), batch.column("id")):
                own, gone = deletion_hashes(word.as_py())
                with np.errstate(over="ignore"):
                    at = (gone ^ np.arange(1, len(gone) + 1, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                each = np.unique(gone)
                keys += [np.array([own], np.uint64), each, at]
                kinds += [np.zeros(1, np.int32), np.full(len(each), 1, np.int32), np.full(len(at), 2, np.int32)]
                n = 1 + len(each) + len(at)
                ids.append(np.full(n, i.as_py(), np.int64))
                held += n
                if held >= 100_000:
                    yield emit(keys, kinds, ids)
                    keys, kinds, ids, held = [], [], [], 0
        if held:
            yield emit(keys, kinds, ids)

    return words.select("word", "id").mapInArrow(run, "key bigint, kind int, id bigint")


def _fine_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: near pairs among ``words``, by the finest alphabet."""
    named = words.select("word", F.xxhash64("word").alias("id"))
    rows = materialise(_deletions(named), "spelling-deletions")
    replaced = rows.filter("kind = 2").select("key", "id")
    swaps = replaced.join(replaced.withColumnRenamed("id", "other"), "key").filter("id < other").select("id", "other")
    whole = rows.filter("kind = 0").select("key", "id")
    grown = rows.filter("kind = 1").select("key", F.col("id").alias("other"))
    pairs = swaps.union(whole.join(grown, "key").select("id", "other")).distinct()
    left = named.select(F.col("word").alias("x"), "id")
    right = named.select(F.col("word").alias("y"), F.col("id").alias("other"))
    return (pairs.join(left, "id").join(right, "other").filter(F.levenshtein("x", "y", 1) == 1)
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b in code-point order: every pair of near words of ``words`` (word),
    once; ``words`` is a written table of distinct words."""
    ship_package(words.sparkSession)
    short = materialise(_reduced(words), "spelling-reduced")
    counted = short.groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    met = (_neighbours(counted).join(counted.select(F.col("r").alias("r2"), F.col("c").alias("c2")), "r2")
           .filter("r1 != r2 OR c1 > 1"))
    met = materialise(met.select("r1", "r2", (F.col("c1") * F.col("c2") > HEAVY_PAIRS).alias("heavy")), "spelling-met")
    light = (met.filter("NOT heavy")
             .join(short.select(F.col("r").alias("r1"), F.col("word").alias("x")), "r1")
             .join(short.select(F.col("r").alias("r2"), F.col("word").alias("y")), "r2")
             .filter((F.col("r1") != F.col("r2")) | (F.col("x") < F.col("y")))
             .filter(F.levenshtein("x", "y", 1) == 1)
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    heavy = met.filter("heavy").select(F.explode(F.array("r1", "r2")).alias("r")).distinct()
    fine = (short.join(heavy, "r", "left_semi").select("word")
            .union(words.filter(F.length("word") >= LONG_CHARS).select("word")).distinct())
    return light.union(_fine_pairs(fine)).distinct()


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n)."""
    words = materialise(words.select("word", F.col("n").cast("bigint").alias("n")).filter("word IS NOT NULL"), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    best = (both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                 F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return found.join(_roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form."""
    hops = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(hops.join(on, "root", "left"), "spelling-roots")
        hops = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.filter("further IS NOT NULL").isEmpty():
            return hops
