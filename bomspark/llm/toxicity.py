"""Toxicity by maximum-scoring segments.

Learning.  From at most MAX_TRAIN labelled rows (the bound of the fit; chosen by a
hash of the id), the documents of each class that hold a word are counted.  A
word's score is its log-odds between toxic and other documents with an informative
Dirichlet prior (PRIOR pseudo-documents spread like the word's share of all
training documents).  Words whose log-odds are not Z_MIN standard errors from zero
score nothing; the MODEL_WORDS words of the largest z are kept.

Scanning.  Every word costs DRIFT, so the expected score of a word is negative, and
the linear-time scan for all maximal scoring segments (Ruzzo and Tompa) yields
disjoint passages that no neighbour improves.  Words of no score only add drift, so
the scan visits the scored words alone.

Calibration.  The best segment of n random words exceeds s with probability
1 - exp(-K n exp(-L s)) (extreme values).  L solves sum p(w) exp(L score(w)) = 1 for
the words of non-toxic documents; K is the maximum likelihood estimate from the best
segments of the non-toxic training documents.  A segment is significant if its
expected number of equals, E = K n exp(-L s), is below E_MAX.  A document's evidence is
the sum of -ln(E / E_MAX) over its significant segments, where repeats of a word within
a segment are damped (and no segment counts less than 0).  A one-variable logistic fit on
the training documents turns ln(1 + evidence) into the score.

Only the text enters a score.  Words are runs of letters, lower case.  Null text
counts as empty; a text without scored words has evidence 0 and the score learned
for that.  If the labels lack a class, every score is the class's share (0.5
without labels).  Labels that are null or neither 0 nor 1 are not used; of several
labels of one document the larger counts.  Repeated rows get equal results, empty tables
give empty tables.

The fit is bounded by two parameters: about MAX_TRAIN labelled rows, also where ids repeat (of
more rows a sample by id and text is taken, equal rows once), and the MODEL_WORDS words of
the largest |z| (equal ones by word).  Scoring covers all rows and whole texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomspark.llm.common import by_parts, each, released, slices, unit_hash
from bomspark.session import bound_batches, materialise, ship_package

MAX_TRAIN = 20_000
MODEL_WORDS = 50_000
PRIOR = 200.0
Z_MIN = 2.6
DRIFT = 0.05
E_MAX = 0.1
BLOCK_CHARS = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")

RESULT = ("struct<score:double,evidence:double,"
          "segments:array<struct<start:bigint,end:bigint,score:double,evalue:double>>>")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    gumbel_l: float = 1.0
    gumbel_k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0

    def probability(self, evidence: float) -> float:
        z = self.intercept + self.slope * math.log1p(evidence)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _blocks(text: str):
    """(offset, lower-case part) of a text in blocks that end between words, with
    one character for each of the text's."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow in lower case; those stay as they are
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at = 0
    while at < len(lower):
        stop = at + BLOCK_CHARS
        while stop < len(lower) and lower[stop].isalpha():
            stop += 1
        yield at, lower[at:stop]
        at = stop


class Scored:
    """The scored words of one text: word, place among all words, score, and the sums
    of the scores before each.  With ``damp`` the k-th occurrence of a word in the text
    counts 1 / k**2 of its score; the query scans without."""

    def __init__(self, text: str, words: dict[str, float], damp: bool = True):
        self.words: list[str] = []
        self.places: list[int] = []
        self.scores: list[float] = []
        self.before: list[float] = []
        self.n = 0
        get, total, seen = words.get, 0.0, {}
        for _, part in _blocks(text):
            tokens = LETTERS.findall(part)
            for i, s in enumerate(map(get, tokens)):
                if s is not None:
                    word = tokens[i]
                    if damp:
                        k = seen[word] = seen.get(word, 0) + 1
                        s /= k * k
                    self.words.append(word)
                    self.places.append(self.n + i)
                    self.scores.append(s)
                    self.before.append(total)
                    total += s
            self.n += len(tokens)


def maximal_segments(found: Scored, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last), indices into the
    scored words; every word of the text costs ``drift``.

    Keeps a stack of candidate segments with the running total before (low) and
    after (high) each; a new positive word joins the nearest candidate that starts
    lower, if that one also ends lower; otherwise it stands alone.  Each candidate
    points to the nearest one that starts lower, so no candidate is passed twice."""
    stack: list[tuple[float, float, int, int, int]] = []  # low, high, first, last, nearest lower start
    for i, score in enumerate(found.scores):
        if score <= drift:
            continue
        low = found.before[i] - drift * found.places[i]
        high, first = low + score - drift, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, first, i, j))
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, first, last) for low, high, first, last, _ in stack]


def damped(found: Scored, segment: tuple[float, int, int]) -> float:
    """A segment's score when the k-th occurrence of a word in it counts 1 / k**2, at
    most its own score: the log-odds are learned from documents, not from repeats."""
    score, first, last = segment
    seen: dict[str, int] = {}
    less = 0.0
    for i in range(first, last + 1):
        k = seen[found.words[i]] = seen.get(found.words[i], 0) + 1
        less += found.scores[i] * (1 - 1 / (k * k))
    return score - max(0.0, less)


def _offsets(text: str, places: set[int]) -> dict[int, tuple[int, int]]:
    """Start and end of the words with the given numbers."""
    found, n = {}, 0
    for at, part in _blocks(text):
        for m in LETTERS.finditer(part):
            if n in places:
                found[n] = (at + m.start(), at + m.end())
            n += 1
    return found


def evidence_of(text: str, model: Model):
    """(evidence, significant segments as (start, end, score, E))."""
    found = Scored(text, model.words, damp=False)
    evidence, kept = 0.0, []
    for score, first, last in maximal_segments(found):
        log_e = math.log(model.gumbel_k * found.n) - model.gumbel_l * score
        if log_e < math.log(E_MAX):
            counted = damped(found, (score, first, last))
            evidence += max(0.0, math.log(E_MAX) - log_e - model.gumbel_l * (score - counted))
            kept.append((found.places[first], found.places[last], score, math.exp(log_e)))
    if kept:
        at = _offsets(text, {p for k in kept for p in k[:2]})
        kept = [(at[a][0], at[b][1], s, e) for a, b, s, e in kept]
    return evidence, kept


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of about ``limit`` labelled rows at most.  Ids are chosen from the
    labels alone; their number is bounded, so they are broadcast.  If many rows share
    those ids, a hash of id and text chooses again, and equal rows count once."""
    usable = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = usable.count()
    if n > limit:
        usable = usable.filter(unit_hash(F.col("doc_id"), F.lit("train")) < limit / n)
    usable = materialise(usable, "toxicity-labels")
    found = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    rows = docs.select("doc_id").join(F.broadcast(usable), "doc_id").count()
    if rows > 2 * limit:
        found = (found.withColumn("hash", F.xxhash64("text"))
                 .filter(unit_hash(F.col("doc_id"), F.col("hash"), F.lit("row")) < limit / rows)
                 .groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")))
    return found.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), "toxic")


def _count_words(batches):
    """Documents per word and class of one task."""
    import pyarrow as pa

    counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
    docs = [0, 0]
    for batch in batches:
        for text, toxic in zip(each(batch.column("text")), each(batch.column("toxic"))):
            docs[toxic] += 1
            into = counts[toxic]
            for w in set(LETTERS.findall(text.lower())):
                into[w] = into.get(w, 0) + 1
    words = [""] + list(counts[0].keys() | counts[1].keys())  # "" carries the number of documents
    yield pa.RecordBatch.from_pydict({
        "word": words,
        "other": pa.array([docs[0]] + [counts[0].get(w, 0) for w in words[1:]], pa.int64()),
        "toxic": pa.array([docs[1]] + [counts[1].get(w, 0) for w in words[1:]], pa.int64())})


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic fit on (x, others, toxic) groups, by
    Newton steps; a small penalty keeps separable data finite."""
    a, b, ridge = 0.0, 0.0, 0.02
    for _ in range(60):
        ga, gb, haa, hab, hbb = 0.0, -ridge * b, 1e-9, 0.0, ridge
        for x, others, toxic in points:
            p = 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * x))))
            n = others + toxic
            r, v = toxic - n * p, n * p * (1 - p)
            ga, gb = ga + r, gb + r * x
            haa, hab, hbb = haa + v, hab + v * x, hbb + v * x * x
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + scale * da, b + scale * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    """Learn a model; the driver holds the word table (at most MODEL_WORDS) and
    small summaries, never texts."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    train = training_rows(docs, labels, limit)
    counts = (train.mapInArrow(released(_count_words), "word string, other bigint, toxic bigint")
              .groupBy("word").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")))
    counts = materialise(counts, "toxicity-words")
    total = counts.filter("word = ''").first()
    if total is None or total.other == 0 or total.toxic == 0:
        share = 0.5 if total is None or total.other + total.toxic == 0 else total.toxic / (total.other + total.toxic)
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(intercept=math.log(share / (1 - share)))
    n_toxic, n_other = float(total.toxic), float(total.other)
    # one document more that has the word and one that has not: no share is 0 or 1
    a = F.lit(PRIOR) * (F.col("other") + F.col("toxic") + 1) / F.lit(n_toxic + n_other + 2)
    t, o = F.col("toxic") + a, F.col("other") + a
    odds = (F.log(t / (F.lit(n_toxic + PRIOR) - t)) - F.log(o / (F.lit(n_other + PRIOR) - o)))
    scored = (counts.filter("word != ''")
              .withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / t + 1 / o))
              .filter(F.abs("z") >= Z_MIN)
              .withColumn("p", o / F.lit(n_other + PRIOR)))
    rows = scored.orderBy(F.desc(F.abs("z")), "word").limit(MODEL_WORDS).select("word", "odds", "p").collect()
    model = Model(words={r.word: r.odds for r in rows})
    _calibrate(model, [(r.odds - DRIFT, r.p) for r in rows], train)
    return model


def _calibrate(model: Model, scores: list[tuple[float, float]], train: DataFrame) -> None:
    """Set the extreme-value constants and the logistic fit from the segments of
    the training documents, which are scanned once."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(model.words)

    def segments(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            plain, counted, n = [], [], []
            for text in each(batch.column("text")):  # the words of one text at a time
                found = Scored(text, shared.value, damp=False)
                cut = maximal_segments(found)
                plain.append([s for s, _, _ in cut])
                counted.append([damped(found, s) for s in cut])
                n.append(found.n)
            yield pa.RecordBatch.from_pydict({
                "segments": pa.array(plain, pa.list_(pa.float64())), "damped": pa.array(counted, pa.list_(pa.float64())),
                "n": pa.array(n, pa.int64()), "toxic": batch.column("toxic").cast(pa.int32())})

    seen = materialise(train.mapInArrow(released(segments), "segments array<double>, damped array<double>, n bigint, toxic int"), "toxicity-fit")
    shared.destroy()
    clean = seen.filter("toxic = 0")
    docs, mean = clean.agg(F.count(F.lit(1)), F.avg("n")).first()
    # p is the share of documents with the word: one occurrence in a mean document
    per_word = [(s, p / max(1.0, mean)) for s, p in scores]
    rest = max(0.0, 1.0 - sum(p for _, p in per_word))

    def excess(rate: float) -> float:
        return rest * math.exp(-rate * DRIFT) + sum(p * math.exp(min(500.0, rate * s)) for s, p in per_word) - 1.0

    high = 1e-3
    while excess(high) < 0 and high < 50:
        high *= 2
    low = high / 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    model.gumbel_l = high
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    spread = clean.agg(F.sum(F.greatest(F.col("n"), F.lit(1)) * F.exp(-F.lit(high) * best))).first()[0]
    model.gumbel_k = max(1e-12, docs / spread) if spread else 1.0
    gain = (F.lit(math.log(E_MAX)) - F.log(F.lit(model.gumbel_k) * F.greatest(F.col("n"), F.lit(1))))
    counted = F.zip_with("segments", "damped", lambda s, d: F.when(gain + F.lit(high) * s > 0, d))
    evidence = F.aggregate(F.filter(counted, lambda d: d.isNotNull()), F.lit(0.0),
                           lambda acc, d: acc + F.greatest(F.lit(0.0), gain + F.lit(high) * d))
    # on a grid of ln(1 + evidence), so the fit sees a bounded table
    points = (seen.groupBy(F.round(F.log1p(evidence), 2).alias("x"))
              .agg(F.sum((F.col("toxic") == 0).cast("int")).alias("o"), F.sum("toxic").alias("t")).collect())
    model.intercept, model.slope = _logistic([(float(p.x), int(p.o), int(p.t)) for p in points])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: struct<score, evidence, segments>, segments being the
    significant passages (code points, end exclusive) with their score and E.  A
    column of that name is replaced."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scores_of(texts):
        import pyarrow as pa

        m = shared.value
        rows = []
        for t in texts.to_pylist():
            evidence, kept = evidence_of(t or "", m)
            rows.append({"score": m.probability(evidence), "evidence": evidence, "segments": [
                {"start": a, "end": b, "score": s, "evalue": e} for a, b, s, e in kept]})
        part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())])
        return pa.array(rows, pa.struct([("score", pa.float64()), ("evidence", pa.float64()),
                                         ("segments", pa.list_(part))]))

    return df.withColumn(out, by_parts(scores_of, RESULT, F.col(text)))
