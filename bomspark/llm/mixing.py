"""Mixing sources to target weights by Pareto order sampling.

1. Targets.  Sources share ``share`` times all words by weight; a target stops at
   ``cap`` times its source's words and the excess is reshared by weight until
   none is above.  Equivalently there is one level L with target = min(cap * words,
   L * weight); the sources in the order of cap * words / weight give L from
   running sums.
2. Whole copies.  With r = target / words, every document of the source certainly
   gets floor(r) copies.
3. Inclusion.  The words left, B = target - floor(r) * words, are drawn without
   replacement.  A document's inclusion probability is p = min(1, c * g), where
   g = 1 + floor(log2(words)) prefers longer documents mildly, and c makes the
   expected words equal B.  Those with p = 1 are certain too.
4. Pareto order.  With u a hash of (seed, doc_id, text, number among equal rows), rows are
   ranked by [u / (1 - u)] / [p / (1 - p)], and taken in that order as long as the words
   taken come nearer to the words still to draw.  So the drawn sample has a fixed
   size, counted in words, and probabilities proportional to g.

The cut in the order is found without sorting or gathering a source: the rank is
mapped to a whole number of RANK_BITS bits, and LEVELS rounds of RADIX-way
histograms (partial sums per source and digit) narrow the cut down to one value.
Every table except the documents' (id, source, words, rank) has at most RADIX
rows per source.

Null source: a source of its own, last in order.  Null or empty text: no words;
such documents are never taken beyond their whole copies, which have no words.  Long
texts are only counted and hashed where they are.  Every row has a draw of its own: rows of
one doc_id (or of none) differ by their text, and rows equal in id, source and text
are numbered, so neither a repeated nor a null id makes many rows rise or fall together.
Of rows that differ in other columns only, any may get any of their numbers.  Reruns take
the same number of each.  Ties in the order (equal ranks) are taken together.  An
empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomspark.llm.common import WORD
from bomspark.operators.ranking import row_number_in_group
from bomspark.session import materialise

WEIGHTS = (5, 2, 1)   # by order of the source, repeating
SHARE = 1.5           # words of the mix, as a part of all words
CAP = 2.0             # most copies of a source
SEED = 17
RANK_BITS, DIGIT_BITS = 40, 10
LEVELS, RADIX = RANK_BITS // DIGIT_BITS, 1 << DIGIT_BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A non-null form that sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(src, words, weight, target) from (src, size): one row per source.  The
    windows below run over sources, not documents."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("words"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(listed, F.pmod(F.row_number().over(Window.orderBy("src")) - 1,
                                                        F.lit(len(weights)))))
    room = F.col("words") * F.lit(cap)
    by_room = Window.orderBy(room / F.col("weight"), "src")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = (per.withColumn("total", F.sum("words").over(everything) * F.lit(share))
           .withColumn("full", F.coalesce(F.sum(room).over(earlier), F.lit(0.0)))
           .withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
           # the level if this source is the first that stays below its cap
           .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
           .withColumn("fits", F.col("level") * F.col("weight") <= room))
    level = F.min(F.when(F.col("fits"), F.struct(room / F.col("weight"), "src", "level"))).over(everything)["level"]
    return per.select("src", "words", "weight", F.when(level.isNull(), room).otherwise(
        F.least(room, level * F.col("weight"))).alias("target"))


def _classes(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, cls, copies, p): whole copies and inclusion probability per source
    and length class (at most 64 classes a source)."""
    per = (docs.filter("size > 0").groupBy("src", "cls").agg(F.sum("size").alias("words_cls"))
           .join(targets, "src"))
    ratio = F.col("target") / F.col("words")
    per = per.withColumn("copies", F.floor(ratio)).withColumn(
        "left", F.col("target") - F.col("copies") * F.col("words"))
    longest_first = Window.partitionBy("src").orderBy(F.desc("cls"))
    pull = F.col("words_cls") * (F.col("cls") + 1)
    per = (per.withColumn("sure", F.coalesce(F.sum("words_cls").over(
               longest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("pull", F.sum(pull).over(longest_first.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("c", (F.col("left") - F.col("sure")) / F.col("pull"))
           .withColumn("fits", F.col("c") * (F.col("cls") + 1) <= 1))
    c = F.max(F.when(F.col("fits"), F.struct("cls", "c"))).over(Window.partitionBy("src"))["c"]
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c * (F.col("cls") + 1), F.lit(1.0))))
    return per.select("src", "cls", "copies", "left", "words_cls", p.alias("p"))


def _rank(u: Column, p: Column) -> Column:
    """The Pareto rank as a whole number: q / (1 + q) in RANK_BITS bits."""
    q = (u / (1 - u)) * F.try_divide(1 - p, p)
    return F.least(F.floor(q / (1 + q) * F.lit(float(1 << RANK_BITS))), F.lit((1 << RANK_BITS) - 1))


def _cuts(drawn: DataFrame, budget: DataFrame) -> DataFrame:
    """(src, last): the largest rank taken, per source; ``drawn`` has (src, size,
    rank), ``budget`` (src, want) the words to draw."""
    state = budget.select("src", "want", F.lit(0).cast("bigint").alias("prefix"),
                          F.lit(0).cast("bigint").alias("base"))
    for level in range(LEVELS):
        shift = RANK_BITS - DIGIT_BITS * (level + 1)
        digit = F.shiftright("rank", shift)
        rows = (drawn.join(state, "src")
                .filter(F.shiftright("rank", shift + DIGIT_BITS) == F.col("prefix"))
                .groupBy("src", "want", "base", digit.alias("digit")).agg(F.sum("size").alias("n")))
        upto = F.sum("n").over(Window.partitionBy("src").orderBy("digit")) + F.col("base")
        rows = rows.withColumn("upto", upto)
        last = level == LEVELS - 1
        # the first digit that reaches the words wanted, else the last there is
        reached = F.col("upto") >= F.col("want")
        state = rows.groupBy("src", "want").agg(
            F.min(F.when(reached, F.struct("digit", "upto", "n"))).alias("hit"),
            F.max(F.struct("digit", "upto", "n")).alias("end"))
        cut = F.coalesce(F.col("hit"), F.col("end"))
        if not last:
            state = state.select("src", "want", cut["digit"].alias("prefix"), (cut["upto"] - cut["n"]).alias("base"))
        else:
            over, under = cut["upto"] - F.col("want"), F.col("want") - (cut["upto"] - cut["n"])
            state = state.select("src", F.when(over <= under, cut["digit"]).otherwise(cut["digit"] - 1).alias("last"))
    return state


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``__mix``: struct<src, size, cls, u> to the rows of (doc_id, text, source).  ``docs``
    must be a table as it is read (its rows are named by their place in it)."""
    keyed = (docs.withColumn("__mix_at", F.monotonically_increasing_id())
             .withColumn("__mix_src", source_key(F.col("source")))
             .withColumn("__mix_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
             .withColumn("__mix_text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
             .withColumn("__mix_size", word_count(F.col("text"))))
    return _with_draws(keyed, _numbers(keyed), seed)


def measure_keys(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, __mix) for every row of (doc_id, text, source), reading the texts once."""
    keys = materialise(docs.select(
        "doc_id", source_key(F.col("source")).alias("__mix_src"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__mix_id"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__mix_text"),
        word_count(F.col("text")).alias("__mix_size")), "mix-keys").withColumn("__mix_at", F.monotonically_increasing_id())
    return _with_draws(keys, _numbers(keys), seed)


SAME = ["__mix_id", "__mix_src", "__mix_text"]


def _numbers(keyed: DataFrame) -> DataFrame:
    """(__mix_row, __mix_k): the numbers of rows that are equal in id, source and text, by their place;
    rows that are alone are left out.  A group that fills a third of the table is
    numbered over many tasks."""
    small = materialise(keyed.select("__mix_at", *SAME), "mix-places")
    again = small.groupBy(*SAME).agg(F.count(F.lit(1)).alias("__mix_n")).filter("__mix_n > 1").select(*SAME)
    numbered = row_number_in_group(small.join(again, SAME, "left_semi"), SAME, ["__mix_at"], "__mix_k")
    return materialise(numbered.select(F.col("__mix_at").alias("__mix_row"), "__mix_k"), "mix-numbers")


def _with_draws(keyed: DataFrame, numbers: DataFrame, seed: int) -> DataFrame:
    k = F.coalesce("__mix_k", F.lit(1)).cast("string")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "__mix_id", "__mix_text", k)), 1, 12), 16, 10)
    u = (u.cast("double") + 0.5) / F.lit(float(1 << 48))
    size = F.col("__mix_size")
    cls = F.when(size > 0, F.floor(F.log2(size))).otherwise(0).cast("int")
    rows = keyed.join(numbers, F.col("__mix_at") == F.col("__mix_row"), "left")
    return rows.withColumn("__mix", F.struct(F.col("__mix_src").alias("src"), size.alias("size"), cls.alias("cls"),
                                             u.alias("u"))).drop("__mix_at", "__mix_row", "__mix_k", "__mix_size", *SAME)


def plan(measured: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix as a table (src, cls, words, target, copies, p, last): at most 64 rows
    a source.  ``measured`` is read several times, so it should be a written table
    of little more than ``__mix``."""
    sizes = measured.select("__mix.*")
    targets = materialise(source_targets(sizes.select("src", "size"), weights, share, cap), "mix-targets")
    classes = materialise(_classes(sizes, targets), "mix-classes")
    drawn = sizes.join(classes.select("src", "cls", "p"), ["src", "cls"]).filter("size > 0 AND p > 0 AND p < 1").select(
        "src", "size", _rank(F.col("u"), F.col("p")).alias("rank"))
    certain = F.sum(F.when(F.col("p") >= 1, F.col("words_cls")).otherwise(0))
    budget = classes.filter("p > 0").groupBy("src").agg((F.max("left") - certain).alias("want"))
    cuts = _cuts(drawn, budget)
    return materialise(
        targets.select("src", "words", "target").join(cuts, "src", "left")
        .join(classes.select("src", "cls", "copies", "p"), "src", "left")
        .withColumn("cls", F.coalesce("cls", F.lit(0))), "mix-plan")


def decide(measured: DataFrame, made: DataFrame, out: str = "mix") -> DataFrame:
    """Replace ``__mix`` by ``out``: struct<size, source_size, target, p, copies>, the
    decision on every row.  Documents are joined with the plan only, which is small
    however large they are."""
    columns = [c for c in measured.columns if c not in ("__mix", out)]
    m = F.col("__mix")
    # every source keeps a row for documents of no words, which no class has
    whole = made.groupBy("src").agg(F.first("words").alias("words"), F.first("target").alias("target"),
                                    F.first("last").alias("last"))
    rows = (measured.join(whole.withColumnsRenamed({c: f"__s_{c}" for c in whole.columns}), m["src"] == F.col("__s_src"))
            .join(made.select(*[F.col(c).alias(f"__c_{c}") for c in ("src", "cls", "copies", "p")]),
                  (m["src"] == F.col("__c_src")) & (m["cls"] == F.col("__c_cls")), "left"))
    size, p = m["size"], F.col("__c_p")
    extra = (F.when((size == 0) | p.isNull() | (p <= 0), 0).when(p >= 1, 1)
             .otherwise((_rank(m["u"], p) <= F.coalesce(F.col("__s_last"), F.lit(-1))).cast("int")))
    copies = F.coalesce(F.col("__c_copies"), F.floor(F.try_divide("__s_target", "__s_words")), F.lit(0)) + extra
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.struct(
        size.alias("size"), F.col("__s_words").alias("source_size"), F.col("__s_target").alias("target"),
        F.coalesce(p, F.lit(0.0)).alias("p"), copies.cast("bigint").alias("copies")).alias(out))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED,
        out: str = "mix") -> DataFrame:
    """Add the decision ``out`` to every row of (doc_id, text, source, ...), a table as it is read.
    The words of the texts are counted twice, so that texts need no shuffle (but for rows with an
    equal twin, which meet their numbers); a caller that needs no text can take
    ``measure_keys``, write that, and ``plan`` and ``decide`` on it."""
    measured = measure(docs, seed)
    small = materialise(measured.select("__mix"), "mix-sizes")
    return decide(measured, plan(small, weights, share, cap), out)
