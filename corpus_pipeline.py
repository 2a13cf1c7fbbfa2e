"""Cleaning a corpus for training: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet under the session's shared folder and reads back for the next stage.  All but
the last return the columns of the documents they got.

1. toxicity: documents scored 0.5 or more go.
2. near_duplicates: of each group of near copies (five words, Jaccard 0.8) one row
   stays, that of the smallest doc_id; of rows of one doc_id with equal sets the first in
   the order of text, then of the other columns as JSON.  Each row is judged by its own
   text, so rows that repeat a doc_id with unrelated texts all stay.  Documents without
   words or without a doc_id have no copies and stay.
3. pii: confirmed personal data are replaced by ``[KIND]``; ``n_chars`` follows.
4. mixing: each document is repeated as often as the mix takes it (0 to 2 times).
5. bpe: token ids of each text with the digests of ids and decoded text.

Empty input gives empty output of the same columns.  Extra columns are carried
through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.llm import jaccard_join, mixing, pii, queries, toxicity
from bomspark.llm.common import table
from bomspark.session import materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.learned_toxicity(spark, sf_dir, docs)
    scored = toxicity.score(docs, model, out="__toxicity")
    return scored.filter(F.col("__toxicity.score") < 0.5).select(*_names(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.document_sets(docs.select("doc_id", "text")).filter("doc_id IS NOT NULL").select("doc_id", "sid", "root")
    found = materialise(found, "pipeline-groups")
    first = (found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "sid")).alias("f"))
             .select("f.*"))  # the id and set that stay of each group
    first = materialise(first, "pipeline-first")
    rows = found.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("__many"), F.max("root").isNotNull().alias("__words"))
    # an id of one row is judged by its id alone, one of several rows by each row's set
    judged = rows.join(first.select("doc_id").withColumn("__stays", F.lit(True)).distinct(), "doc_id", "left")
    judged = materialise(judged.filter("__many OR (__words AND __stays IS NULL)").select("doc_id", "__many"), "pipeline-judged")
    left = docs.join(judged, "doc_id", "left").filter("__many IS NULL OR __many")
    if judged.filter("__many").isEmpty():
        return left.select(*_names(docs))
    own = left.filter("__many").withColumn("__own", jaccard_join.set_ids(F.col("text")))
    stay = own.join(first.withColumnsRenamed({"doc_id": "__id", "sid": "__sid"}),
                    (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__sid")), "left_semi")
    order = F.struct("text", F.to_json(F.struct(*_names(docs))))
    stay = stay.groupBy("doc_id", "__own").agg(F.min_by(F.struct(*_names(docs)), order).alias("__row")).select("__row.*")
    wordless = own.filter(F.col("__own") == 0)
    return (left.filter("__many IS NULL").select(*_names(docs)).unionByName(stay.select(*_names(docs)))
            .unionByName(wordless.select(*_names(docs))))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask_pii(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*_names(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, out="__decision")
    copies = F.col("__decision.copies").cast("int")
    return (mixed.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
            .select(*_names(docs)))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.token_digests(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


def _names(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage),
          ("mixing", mixing_stage), ("bpe", bpe_stage)]

# Learned scores and tokenizer files cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
