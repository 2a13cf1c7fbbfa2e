"""The registered queries of this subpackage: each applies one operator to its
whole table and derives the agreed columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.llm import (bpe, hard_negatives, jaccard_join, langid, licenses, mixing, pii, secret_scan, sharding, spelling,
                          topk, toxicity, winnow)
from bomspark.llm.common import doc_crc, table, text_or_empty
from bomspark.session import materialise, ship_package

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SECRET_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = 8


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _n(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def learned_toxicity(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Learned from the rows of ``docs`` that are not held out."""
    learn = F.pmod(doc_crc(), F.lit(5)) != 0
    return toxicity.fit(docs.filter(learn), table(spark, sf_dir, "labels", "doc_id", "toxic").filter(learn))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    scored = toxicity.score(docs, learned_toxicity(spark, sf_dir, docs))
    return scored.select(
        "doc_id", (F.pmod(doc_crc(), F.lit(5)) == 0).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.transform("toxicity.segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("passages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.pmod(doc_crc(), F.lit(4)) == 2
    profiles = langid.fit(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"))


def token_digests(docs: DataFrame) -> DataFrame:
    """``docs`` with ids, decoded and the columns op3 returns."""
    coded = bpe.round_trip(docs, TOKENIZER)  # encode and decode, by one worker a task
    return coded.withColumns({
        "n_tokens": F.size("ids").cast("bigint"),
        "ids_sha256": sha256(F.array_join(F.col("ids").cast("array<string>"), " ")),
        "decoded_sha256": sha256(F.col("decoded"))})


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialise(mixing.measure_keys(_documents(spark, sf_dir, "doc_id", "text", "source")), "mix-sizes")
    mixed = mixing.decide(measured, mixing.plan(measured))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target",
                        (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "pii")
    return found.select("doc_id", *[_n(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                        sha256(span_list(_of_kinds(F.col("pii"), pii.BASE_KINDS))).alias("base_sha256"),
                        span_list(F.col("pii")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir, "doc_id", "text"), SECRET_RANKS,
                                     public_tokenizers.PATTERN).select("doc_id", "secrets")
    return found.select("doc_id", *[_n(F.col("secrets"), k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
                        sha256(span_list(_of_kinds(F.col("secrets"), secret_scan.BASE_KINDS))).alias("base_sha256"),
                        span_list(F.col("secrets")).alias("spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    sized = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"),
                        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    placed = sharding.place(sized, ["doc_id"], sharding.default_tree(SHARDS))
    grown = sharding.place(placed, ["doc_id"], sharding.default_tree(SHARDS + 1), "grown_shard",
                           "grown_region", "grown_rack")
    kept = materialise(grown.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "region", "rack"), "shards")
    return sharding.number_slots(kept, order=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def _fingerprint_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda p: F.concat(
        F.lower(F.hex(p["hash"])), F.lit(":"), p["pos"].cast("string"))), ",")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = _documents(spark, sf_dir, "doc_id", "text")
    # texts go to their id range once, compressed
    packed = docs.select("doc_id", F.crc32(text_or_empty().cast("binary")).alias("crc"), winnow.pack(F.col("text")).alias("packed"))
    pairs = winnow.with_next(packed, "doc_id", "crc", "packed")
    found = pairs.select("doc_id", winnow.compare_edited(F.col("packed"), F.col("next")).alias("c"))
    return found.select(
        "doc_id", "c.n_chars", "c.edited_sha256",
        _fingerprint_text(F.col("c.own")).alias("fingerprint"),
        _fingerprint_text(F.col("c.edited")).alias("edited_fingerprint"),
        "c.near_edited", "c.near_next")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), words=4, percent=85)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        "vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    return topk.top_products(rows, rows.filter("vec_id % 50 = 0"), k=5).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "licences")
    base = F.filter("licences.places", lambda p: p["label"].isin(*licenses.BASE))
    words = F.transform(base, lambda p: p["word"])
    return found.select(
        "doc_id", "licences.n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("licences.labels", ",").alias("labels"), F.col("licences.score").alias("score"),
        F.transform("licences.tags", lambda t: t["expression"]).alias("expressions"),
        F.col("licences.restriction").alias("restriction"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIANT_CHARS, VARIANT_COUNT = 7, 2


def op12_words(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of all texts that may become words of enough letters,
    A-Z in lower case, one letter deleted where the hash of id and run says so."""
    # a shorter run stays shorter, so the length may stand in the pattern
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(rf"[A-Za-z\u00C0-\u00FF]{{{VARIANT_CHARS},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    runs = runs.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    return runs.withColumn("h", h).select(F.when(
        F.col("h") % 31 == 0, F.expr("concat(left(run, cast(h % length(run) as int)), substr(run, cast(h % length(run) as int) + 2))"))
        .otherwise(F.col("run")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = op12_words(_documents(spark, sf_dir, "doc_id", "text"))
    return spelling.group_variants(spelling.vocabulary(words, min_chars=VARIANT_CHARS, min_count=VARIANT_COUNT))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        topk.whole_numbers(F.col("embedding")).alias("v"))
    return hard_negatives.hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_language, op3_bpe, op4_mixing, op5_pii, op6_secrets,
                                    op7_sharding, op8_winnowing, op9_jaccard, op10_topk, op11_licenses,
                                    op12_spelling, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    from bomspark.llm.oracle import SQL

    return dict(SQL)
