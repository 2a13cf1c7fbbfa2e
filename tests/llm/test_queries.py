"""The registered queries and the pipeline on odd and empty tables, and against
their SQL where there is some."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from bomspark.llm import mixing, winnow
from bomspark.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, ids string, size string, "
          "shard string, pii string, mix string, comp string, label string")


def odd_rows():
    extra = ("x",) * 8
    long = ("A quick note to bob@example.com about 10.0.0.1 and card 4111 1111 1111 1111. " * 400
            + "z" * 30_000 + " password=hunter22222 ")
    rows = [(1, "plain words here and there again and more", "en", "a", 41), (2, None, None, None, None), (3, "", "en", None, 0),
            (4, long, "en", "a", len(long)), (5, "plain words here and there again and more", "fr", "b", 41),
            (None, "plain words here and there again and more", "en", "a", 41), (None, None, None, None, None),
            (6, " \t\n ", "en", "b", 4), (7, "123 456 !!!", "en", "b", 11), (8, "Ünïcode 😀 straße <|endoftext|>", "de", "c", 30),
            (9, "repeated row", "en", "c", 12), (9, "repeated row", "en", "c", 12), (9, "another text of the id", "en", "c", 22)]
    return [r + extra for r in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 0), (8, None, None), (None, 1, 1), (99, 1, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, [0.5, -0.25], 1), (50, [0.25, 0.25], 1), (1, None, 1), (2, [None, 1.0], 1), (None, [1.0, 1.0], 1),
                           (3, [], 1), (100, [], 1), (4, [1.0], 2), (5, [float("nan"), 1.0], 2), (6, [0.5, -0.25], None)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").filter("false").write.parquet(f"{d}/{t}.parquet")
    return d


DOC_QUERIES = [n for n in Q.queries() if not n.startswith(("op10", "op12", "op13"))]  # these have no doc_id


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_one_row_per_document(spark, odd, empty, name):
    rows = Q.queries()[name](spark, odd).collect()
    ids = sorted((r.doc_id for r in rows), key=str)
    assert ids == sorted((r[0] for r in odd_rows()), key=str)
    none = Q.queries()[name](spark, empty)
    assert none.count() == 0
    assert none.columns == Q.queries()[name](spark, odd).columns


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id not in (None, 9)}


def test_op1_folds_and_bounds(spark, odd):
    for r in Q.op1_toxicity(spark, odd).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = Q.op1_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_op2_unknown_and_held_out_accuracy(spark, odd):
    got = by_id(Q.op2_language(spark, odd).collect())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 6, 7))
    assert all(got[i].lang_pred in ("en", "de", "fr") for i in (1, 4, 5, 8))
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = Q.op2_language(spark, sf).filter("held_out").join(lang, "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99


def test_op3_digests(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.TOKENIZER)
    lib.no_truncation()
    lib.no_padding()
    got = by_id(Q.op3_bpe(spark, odd).collect())
    for r in odd_rows():
        if r[0] in got:
            ids = lib.encode(r[1] or "", add_special_tokens=False).ids
            assert got[r[0]].n_tokens == len(ids)
            assert got[r[0]].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            text = lib.decode(ids, skip_special_tokens=False)
            assert got[r[0]].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op4_sizes_and_repeated_ids(spark, odd):
    rows = Q.op4_mixing(spark, odd).collect()
    got = by_id(rows)
    assert got[2].size == got[3].size == got[6].size == 0 and got[2].taken == 0
    assert got[2].source_size == 0 and got[2].target == 0.0
    assert all(r.taken <= 2 * r.size for r in rows)
    assert len([r for r in rows if r.doc_id == 9 and r.size == 2]) == 2  # each with a draw of its own


@pytest.mark.parametrize("hot, text", [(7, "text of row {}"), (None, "text of row {}"), (7, "one text for all rows")])
def test_op4_hot_ids_come_near_the_target(spark, tmp_path, hot, text):
    """Most rows of a source under one id, or none, also with equal texts: within a document of the target."""
    rows = [(hot if i < 3900 else i, " ".join([text.format(i)] * (1 + i % 3)), "a") for i in range(4000)]
    rows += [(10_000 + i, "other words " * 5, "b") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op4_mixing(spark, str(tmp_path)).groupBy("target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= r.most for r in got)
    again = Q.op4_mixing(spark, str(tmp_path))
    first = sorted(map(str, Q.op4_mixing(spark, str(tmp_path)).collect()))
    assert sorted(map(str, again.collect())) == first


def test_op5_and_op6_spans(spark, odd):
    got = by_id(Q.op5_pii(spark, odd).collect())
    assert (got[4].n_email, got[4].n_ip, got[4].n_card, got[4].n_phone) == (400, 400, 400, 0)
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    got = by_id(Q.op6_secrets(spark, odd).collect())
    assert got[4].n_assign == 1 and got[4].spans.startswith("assign:")


def test_op7_shards(spark, odd):
    rows = Q.op7_sharding(spark, odd).collect()
    for r in rows:
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8) and r.law == "key"
    got = by_id(rows)
    assert got[2].size == 1 and got[2].text_crc32 == 0
    assert got[8].size == len(odd_rows()[9][1].encode()) + 1
    assert got[8].text_crc32 == zlib.crc32(odd_rows()[9][1].encode())
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_op8_edits(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in Q.op8_winnowing(spark, SF).collect()}
    prints = {}
    for i, d in enumerate(docs):
        follows = docs[(i + 1) % len(docs)].text
        half = len(d.text) // 2
        edited = d.text[:len(d.text) - half] + follows[:half]
        r = got[d.doc_id]
        assert r.n_chars == len(d.text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(d.text, r.fingerprint) == r.fingerprint
        own, changed, other = ({int(h) for h in winnow.fingerprint_text(t)[0]} for t in (d.text, edited, follows))
        for near, b in ((r.near_edited, changed), (r.near_next, other)):
            assert near == (2 * len(own & b) / (len(own) + len(b)) if own or b else 1.0)
    long = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.35 > 0.15 > sum(r.near_next for r in long) / len(long)


def test_op9_odd_rows(spark, odd):
    rows = Q.op9_jaccard(spark, odd).collect()
    got = by_id(rows)
    assert got[1].component_id == got[5].component_id == 1
    assert got[2] == (2, 0, 2) and got[3] == (3, 0, 3) and got[6] == (6, 0, 6)
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id == 9} == {9}


def test_op10_odd_rows(spark, odd, empty):
    got = [tuple(r) for r in Q.op10_topk(spark, odd).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 128 * 128 + 64 * 64), (0, 2, 50, 128 * 64 - 64 * 64), (50, 1, 0, 4096), (50, 2, 6, 4096),
                   (100, 1, 3, 0)]
    assert Q.op10_topk(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.queries()[name](spark, SF)
    res = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, res.fetchall())) == sorted(key(r) for r in df.select(*names).collect())


# ---- pipeline

def test_stages_keep_columns_and_clean_documents(spark, odd, empty):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == columns, name
        assert corpus_pipeline.bpe_stage(spark, docs, folder).columns[:3] == ["doc_id", "source", "n_tokens"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]


def test_near_duplicate_stage_keeps_one_of_each_group(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 9]
    assert sum(r.doc_id is None for r in kept) == 2


def test_near_duplicate_stage_looks_at_the_text_of_a_repeated_id(spark, odd):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(3, a), (7, a), (7, b), (7, b), (11, c), (11, d), (12, c), (13, d), (14, a), (14, a), (15, ""), (15, a), (16, None),
            (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, odd).collect()]
    assert sorted(r for r in kept if r[0] is not None) == [(3, a), (7, b), (11, c), (11, d), (15, ""), (16, None)]
    assert (None, a) in kept and len(kept) == 7


def test_near_duplicate_stage_keeps_unrelated_texts_of_a_hot_id(spark, odd):
    """One id with a third of all rows: every unrelated text stays once."""
    texts = [" ".join(f"{i}w{k}" for k in range(12)) for i in range(60)]
    rows = [(5, t) for t in texts] + [(5, t) for t in texts[:30]] + [(100 + i, t + " tail") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, odd).collect()]
    assert sorted(kept) == sorted((5, t) for t in texts)


def test_pii_stage_masks_and_counts(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = corpus_pipeline.pii_stage(spark, docs, odd).collect()
    for r in rows:
        assert (r.text is None and r.n_chars is None) or len(r.text) == r.n_chars
    long = next(r for r in rows if r.doc_id == 4)
    assert "bob@" not in long.text and long.text.count("[EMAIL]") == 400 and long.text.count("[CARD]") == 400


def test_mixing_stage_repeats_documents(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mix(
        docs.select("doc_id", "text", "source")).select("doc_id", "mix.copies").collect()}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mixing_stage(spark, docs, SF).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_pipeline_runs_and_is_registered(spark, odd):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0
    assert os.path.exists(f"{SF}/documents.parquet")
    assert rows.filter(F.size("ids") != F.col("n_tokens")).count() == 0
