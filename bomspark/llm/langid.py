"""Language identification by rank-order n-gram profiles.

Learning: the n-grams (one to three letters, words padded by ``_``) of the training
texts of a language are counted; its profile is the PROFILE most frequent, in order
of count, then n-gram.  The fit uses about TRAIN_DOCS rows a language, chosen by a
hash of id and text; rows equal in both count once.  Every language is learned: the
profiles are a written table, and documents are compared with LANG_GROUP languages at a
time, so neither the driver nor a worker holds more, however many there are.

Prediction: a document's own PROFILE most frequent n-grams, over its whole text, are
ranked the same way.  The out-of-place distance to a language is the sum over them
of |rank in the document - rank in the profile|, or PROFILE where the profile lacks
the n-gram.  The nearest language is predicted (ties: the first by name).  The score
is 1 - distance / (greatest possible distance).  N-grams that few profiles hold are
looked up in one sorted table of (n-gram, language, rank).

Null text and text without a letter give ``und`` with score 0, and so does every
text if nothing could be learned.  Null lang is not learned from.  Repeated rows get
equal results, and empty tables empty ones.

N-grams are counted with sorted arrays, a text in blocks of BLOCK_CHARS, so memory
follows the number of different n-grams.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomspark.llm.common import by_parts, unit_hash
from bomspark.operators.ranking import row_number_in_group
from bomspark.session import materialise, ship_package

PROFILE = 400
TRAIN_DOCS = 2_000
LANG_GROUP = 5_000
BLOCK_CHARS = 1 << 20
EDGE, MASK = ord("_"), (1 << 21) - 1
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters.  The pattern also takes a few signs that count as numbers
    but not as digits (such as a raised 2); words with those are cut at them."""
    words = LETTERS.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]


def _blocks(text: str):
    """The text in parts of about BLOCK_CHARS that end between words."""
    at = 0
    while at < len(text):
        stop = at + BLOCK_CHARS
        while stop < len(text) and text[stop].isalpha():
            stop += 1
        yield text[at:stop]
        at = stop


def _merge(keys, counts):
    """Equal keys added up; ascending."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_grams(texts):
    """(n-grams, counts) of some texts together.  An n-gram is a number of 21 bits
    a letter, first letter highest, so numbers sort like the n-grams themselves.
    Both arrays are empty if there is no letter."""
    import numpy as np

    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for text in texts:
        for part in _blocks(text.lower()):
            words = words_of(part)
            if not words:
                continue
            line = f"_{'_'.join(words)}_"
            c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            edge = c == EDGE
            one, two = c << 42, (c[:-1] << 42) | (c[1:] << 21)
            three = (two[:-1] | c[2:])[~edge[1:-1]]  # not across words
            found = np.sort(np.concatenate([one[~edge], two, three]))
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            times = np.diff(np.concatenate([first, [len(found)]]))
            found = found[first]
            if len(keys):
                found, times = _merge(np.concatenate([keys, found]), np.concatenate([counts, times]))
            keys, counts = found, times
    return keys, counts


def gram_text(key: int) -> str:
    return "".join(chr(c) for c in (key >> 42, key >> 21 & MASK, key & MASK) if c)


def _gram_key(gram: str) -> int:
    a, b, c = (ord(x) for x in gram.ljust(3, "\0"))
    return a << 42 | b << 21 | c


def top_grams(keys, counts, most: int):
    """The ``most`` most frequent n-grams, by falling count, then n-gram."""
    import numpy as np

    if len(keys) > most:  # drop what cannot be in, before ordering
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:most]]


def _count_batches(batches):
    """N-gram counts per language of one task."""
    import numpy as np
    import pyarrow as pa

    found: dict[str, tuple] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text or "")
        for lang, texts in by_lang.items():
            keys, counts = count_grams([" ".join(texts)])
            if lang in found and len(keys):
                keys, counts = _merge(np.concatenate([found[lang][0], keys]), np.concatenate([found[lang][1], counts]))
            found[lang] = (keys, counts) if len(keys) else found.get(lang, (keys, counts))
    for lang, (keys, counts) in found.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()),
                                          "gram": pa.array(keys), "times": pa.array(counts.astype(np.int64))})


class Profiles:
    """Learned profiles: a written table (lang, gram, rank, part) of ``parts`` groups of languages."""

    def __init__(self, table: DataFrame, parts: int):
        self.table, self.parts = table, parts

    def part(self, i: int) -> dict[str, list[str]]:
        """The profiles of one group: at most LANG_GROUP lists of n-grams."""
        found: dict[str, list[str]] = {}
        rows = self.table.filter(F.col("part") == i).select("lang", "gram", "rank").collect()
        for r in sorted(rows, key=lambda r: (r.lang, r.rank)):
            found.setdefault(r.lang, []).append(gram_text(r.gram))
        return found


def fit(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text",
        train_docs: int = TRAIN_DOCS, profile: int = PROFILE) -> Profiles:
    """Learn a profile of ``profile`` n-grams for every value of ``lang``."""
    ship_package(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = materialise(rows.groupBy("lang").count(), "language-counts")
    chance = F.lit(float(train_docs)) / F.col("count")
    chosen = (rows.withColumn("hash", F.xxhash64("text")).join(counts, "lang")
              .filter(unit_hash(F.col("key"), F.col("hash"), F.lit("lang")) < chance)
              .groupBy("lang", "key", "hash").agg(F.first("text").alias("text")))
    counted = (chosen.select("lang", "text").mapInArrow(_count_batches, "lang string, gram bigint, times bigint")
               .groupBy("lang", "gram").agg(F.sum("times").alias("times")))
    best = (counted.withColumn("rank", F.row_number().over(
                Window.partitionBy("lang").orderBy(F.desc("times"), "gram")))
            .filter(F.col("rank") <= profile))
    best = materialise(best.select("lang", "gram", "rank"), "language-grams")
    langs = row_number_in_group(best.select("lang").distinct().withColumn("all", F.lit(0)), ["all"], ["lang"], "n")
    langs = langs.select("lang", F.expr(f"(n - 1) div {LANG_GROUP}").alias("part"))
    table = materialise(best.join(langs, "lang"), "language-profiles")
    return Profiles(table, (table.agg(F.max("part")).first()[0] or 0) + 1)


class Ranker:
    """Distances of texts to the profiles."""

    def __init__(self, profiles: dict[str, list[str]], profile: int = PROFILE):
        import numpy as np

        self.langs, self.profile = sorted(profiles), profile
        entries = sorted((_gram_key(gram), i, rank) for i, lang in enumerate(self.langs)
                         for rank, gram in enumerate(profiles[lang]))
        table = np.array(entries, np.int64).reshape(len(entries), 3)
        self.keys, first = np.unique(table[:, 0], return_index=True)
        self.first = np.append(first, len(entries))
        self.lang, self.rank = table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

    def predict(self, text: str) -> tuple[str, float]:
        import numpy as np

        keys, counts = count_grams([text])
        if len(keys) == 0 or not self.langs:
            return UNKNOWN, 0.0
        own = top_grams(keys, counts, self.profile)
        apart = np.full(len(self.langs), self.profile * len(own), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            place = np.flatnonzero(self.keys[at] == own)
            at = at[place]
            size = self.first[at + 1] - self.first[at]
            # the entries of all n-grams met, one after the other
            entry = np.arange(size.sum()) + np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            nearer = self.profile - np.abs(self.rank[entry] - np.repeat(place, size))
            apart -= np.bincount(self.lang[entry], nearer, len(self.langs)).astype(np.int64)
        best = int(np.argmin(apart))
        return self.langs[best], float(1.0 - apart[best] / (self.profile * len(own)))


RANKERS = 4  # models a worker keeps; more groups of languages than that are loaded again and again
_RANKERS: dict[str, Ranker] = {}  # of this worker process, by model


def _nearest(spark, profiles: dict[str, list[str]], text: Column) -> Column:
    """struct<lang, score> of a text among the given languages."""
    shared = spark.sparkContext.broadcast(profiles)
    name = uuid.uuid4().hex

    def langs_of(texts):
        import pyarrow as pa

        ranker = _RANKERS.get(name)
        if ranker is None:
            if len(_RANKERS) >= RANKERS:
                _RANKERS.clear()
            ranker = _RANKERS[name] = Ranker(shared.value)
        got = [ranker.predict(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()),
                                           pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return by_parts(langs_of, "struct<lang:string,score:double>", text)


def predict(df: DataFrame, profiles: Profiles | dict[str, list[str]], text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct<lang, score>.  A column of that name is replaced.  Each group of
    languages names its nearest, and the nearest of these is predicted."""
    spark = df.sparkSession
    ship_package(spark)
    parts = [profiles] if isinstance(profiles, dict) else (profiles.part(i) for i in range(profiles.parts))
    best = [_nearest(spark, part, F.col(text)) for part in parts]
    if len(best) == 1:
        return df.withColumn(out, best[0])
    names = [f"__language_{i}" for i in range(len(best))]
    nearest = F.array_min(F.array(*[F.struct((-F.col(n)["score"]).alias("far"), F.col(n)["lang"].alias("lang")) for n in names]))
    return (df.withColumns(dict(zip(names, best)))
            .withColumn(out, F.struct(nearest["lang"].alias("lang"), (-nearest["far"]).alias("score"))).drop(*names))
