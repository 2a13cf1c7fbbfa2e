"""Workers keep nothing of a task that has ended."""

import pytest
from pyspark.sql import functions as F

from bomspark.llm import bpe, jaccard_join, queries, toxicity
from bomspark.llm.common import released
from bomspark.session import BATCH_BYTES, bound_batches


def test_caches_are_cleared_when_a_task_ends():
    cache = {1: 2}
    run = released(lambda batches: (cache.setdefault(b, b) for b in batches), cache)
    assert list(run([3, 4])) == [3, 4] and cache == {}

    def broken(batches):
        cache[5] = 5
        yield next(batches)
        raise ValueError

    with pytest.raises(ValueError):
        list(released(broken, cache)(iter([1])))
    assert cache == {}


def test_word_hashes_do_not_outlive_their_task():
    jaccard_join.shingles_of("some words of one text here", 5)
    assert jaccard_join._HASHES
    assert list(jaccard_join._tidy(lambda batches: iter(batches))([])) == [] and not jaccard_join._HASHES


def test_words_of_an_encoder_do_not_outlive_their_task(spark):
    rows = spark.createDataFrame([(i, f"Some words, of text{i} here") for i in range(40)], "doc_id bigint, text string").coalesce(1)
    assert bpe.encode(rows, queries.TOKENIZER).filter("size(ids) = 0").count() == 0

    def remembered(batches):
        import pyarrow as pa

        from bomspark.llm import bpe  # the worker's own module

        list(batches)
        coders = [t for t in bpe._TABLES.values() if isinstance(t, bpe.Encoder)]
        kept = sum(len(known) + len(known.old) for c in coders for known in (c.words_known, c.runs_known))
        yield pa.RecordBatch.from_pydict({"coders": pa.array([len(coders)], pa.int64()),
                                          "kept": pa.array([kept + sum(len(c.table) for c in coders)], pa.int64())})

    # more tasks than idle workers, so the one that encoded is among them
    found = spark.range(0, 64, 1, 64).mapInArrow(remembered, "coders bigint, kept bigint").collect()
    assert sum(r.coders for r in found) > 0 and sum(r.kept for r in found) == 0


def test_an_encoder_forgets_texts_and_encodes_as_before():
    with open(queries.TOKENIZER, "rb") as f:
        coder = bpe.Encoder(f.read())
    text = "Some words, qwzxkvjq of one text here"  # the long word takes several tokens
    first = coder.encode(text)
    assert coder.words_known and coder.runs_known and coder.table
    coder.words_known.old = dict(coder.words_known)
    coder.forget()
    assert not (coder.words_known or coder.words_known.old or coder.runs_known or coder.table)
    assert coder.encode(text) == first


def test_round_trip_is_encode_then_decode_in_one_worker(spark):
    rows = spark.createDataFrame([(1, "Some words, of one text"), (2, ""), (3, None), (4, "  \x1f "), (4, "naïve ΣΑΣ 東京 🙂 " * 300),
                                  (4, "Some words, of one text")], "doc_id bigint, text string").coalesce(1)
    plain = bpe.decode(bpe.encode(rows, queries.TOKENIZER), queries.TOKENIZER)
    both = bpe.round_trip(rows, queries.TOKENIZER)
    assert both.schema == plain.schema and both.collect() == plain.collect()
    digests = queries.token_digests(rows)
    plan = digests._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 1
    assert [r.n_tokens for r in digests.collect()] == [len(r.ids) for r in plain.collect()]
    # columns of those names are replaced in their places
    again = bpe.round_trip(plain.withColumn("ids", F.lit("x")), queries.TOKENIZER)
    assert again.columns == plain.columns and again.collect() == plain.collect()
    assert bpe.round_trip(rows.limit(0), queries.TOKENIZER).collect() == []


BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("operator", [
    lambda rows: bpe.round_trip(rows, queries.TOKENIZER),
    lambda rows: bpe.decode(bpe.encode(rows, queries.TOKENIZER), queries.TOKENIZER),
    lambda rows: jaccard_join.near_duplicates(rows),
    lambda rows: toxicity.fit(rows, rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))),
    lambda rows: toxicity.score(rows, toxicity.Model()),
])
def test_batches_of_whole_texts_are_small(spark, operator):
    session = spark.newSession()
    session.conf.set(BOUND, "64MB")
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: i + F.col("id")))
    rows = session.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), long.alias("text"))
    operator(rows.limit(3))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    found = rows.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < 2 * BATCH_BYTES


@pytest.mark.parametrize("given, held", [("64MB", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES)), (str(BATCH_BYTES + 1), str(BATCH_BYTES)),
                                         ("4m", "4m"), ("100k", "100k"), ("2048", "2048")])
def test_a_lower_bound_of_the_session_stays(spark, given, held):
    session = spark.newSession()
    session.conf.set(BOUND, given)
    bound_batches(session)
    assert session.conf.get(BOUND) == held
