"""Result tables written by project: few files, all rows, rows in order."""

import glob

from pyspark.sql import functions as F

from bomspark.sinks.tables import count_files, deal_by_project, read_tables, write_by_project, write_tables


def skewed(spark):
    return spark.range(0, 6000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 40).cast("string"))).alias("project_id"),
        (F.col("id") * 7919 % 6007).alias("k"), F.col("id"))


def test_files_are_bounded_by_projects_and_rows(spark, tmp_path):
    df = skewed(spark)
    paths = write_by_project({"t": (df, ["k"])}, str(tmp_path / "out"), file_rows=500)
    projects = df.select("project_id").distinct().count()
    files = count_files(paths, spark).first().files
    assert projects < files <= projects + 6000 / 500
    hot = glob.glob(f"{paths['t']}/project_id=hot/*.parquet")
    assert 2 <= len(hot) <= 4  # 2000 rows in files of about 500
    back = read_tables(spark, paths)["t"].select(*df.columns)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    for f in hot:
        k = [r.k for r in spark.read.parquet(f).collect()]
        assert k == sorted(k)


def test_partitioned_result_tables(spark, tmp_path):
    run = spark.range(1).select(F.lit("x").alias("as_of"))
    paths = write_tables({"t": skewed(spark), "Run": run}, str(tmp_path / "out"), partition_by_project=True)
    assert read_tables(spark, paths)["t"].count() == 6000 and read_tables(spark, paths)["Run"].count() == 1
    assert count_files({"t": paths["t"]}, spark).first().files == skewed(spark).select("project_id").distinct().count()
    assert write_by_project({"none": (skewed(spark).filter("false"), [])}, str(tmp_path / "empty"))


def test_tasks_follow_the_files_not_the_rows_of_a_file(spark):
    df = spark.range(6000).select((F.col("id") % 400).alias("project_id"), F.col("id").alias("k"))
    dealt = deal_by_project(df, ["k"], file_rows=10)
    held = dealt.withColumn("task", F.spark_partition_id()).groupBy("project_id").agg(F.count_distinct("task").alias("files"), F.count(F.lit(1)).alias("n"))
    assert dealt.rdd.getNumPartitions() == 8  # 800 files; 600 tasks before
    assert held.filter("files > 2 OR n != 15").isEmpty()
