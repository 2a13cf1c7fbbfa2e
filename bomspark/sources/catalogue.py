"""Lead-time catalogue source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bomspark.fixed_values import LEAD_TIME_CATALOGUE

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("min_weeks", T.IntegerType(), False),
    T.StructField("max_weeks", T.IntegerType(), False),
    T.StructField("unit_cost", T.LongType(), False),
])


def catalogue_from_entries(spark: SparkSession, entries) -> DataFrame:
    """entries: ordered (keyword, min_weeks, max_weeks, unit_cost); order = priority."""
    rows = [(i + 1, k, int(lo), int(hi), int(cost)) for i, (k, lo, hi, cost) in enumerate(entries)]
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)


def default_catalogue(spark: SparkSession) -> DataFrame:
    return catalogue_from_entries(spark, LEAD_TIME_CATALOGUE)


def read_catalogue(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A user catalogue with columns priority, keyword, min_weeks, max_weeks, unit_cost."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").schema(CATALOGUE_SCHEMA)
    df = reader.load(path)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in CATALOGUE_SCHEMA.fields])
