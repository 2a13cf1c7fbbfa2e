"""Result tables to storage.

The six named tables of a run are written with the DataFrameWriter, one
folder each.  Writes go through Spark's commit protocol, so a failed or
retried task never leaves partial output, and rerunning a run with
mode="overwrite" is idempotent.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.operators.ordering import order_delivery, order_lead_times, order_spend, order_summary
from bomspark.session import bound_listing, materialise
from bomspark.sinks.folders import write_parquet
from bomspark.sinks.landing import TASK_FILES

TABLE_NAMES = ["Clean_BOM", "Summary_by_Family", "Data_Quality_Log", "Lead_Time_Estimator",
               "Delivery_Sequence", "Spend_Estimation"]
REJECTS = "Rejected_Files"
RUN = "Run"
# Rows of a file of a table written by project.
FILE_ROWS = 1_000_000


def result_tables(analysis) -> dict[str, DataFrame]:
    """The six tables of an ``Analysis`` under their report names, and the rejected
    files if it started from files.  The four
    aggregated ones are in report order (a global sort over aggregated rows);
    the two line tables are only clustered by project inside each file
    (sortWithinPartitions, no global sort of the lines), so a reader of one
    project touches few row groups."""
    tables = {
        "Clean_BOM": analysis.bom_lines.drop("issues").sortWithinPartitions("project_id"),
        "Summary_by_Family": order_summary(analysis.summary),
        "Data_Quality_Log": analysis.issues.sortWithinPartitions("project_id"),
        "Lead_Time_Estimator": order_lead_times(analysis.lead_times),
        "Delivery_Sequence": order_delivery(analysis.delivery),
        "Spend_Estimation": order_spend(analysis.spend),
    }
    if analysis.rejects is not None:
        tables[REJECTS] = analysis.rejects
    if analysis.run is not None:
        tables[RUN] = analysis.run
    return tables


def clustered_tables(analysis) -> dict[str, tuple[DataFrame, list]]:
    """The tables that are written by project, with the order of the rows of a project."""
    position = "line_no" if "line_no" in analysis.bom_lines.columns else "row_idx"
    file_order = [c for c in ("file_id", position) if c in analysis.bom_lines.columns]
    return {
        "Clean_BOM": (analysis.bom_lines.drop("issues"), file_order),
        "Summary_by_Family": (analysis.summary, [F.col("count").desc(), F.col("family")]),
        "Data_Quality_Log": (analysis.issues, file_order),
        "Lead_Time_Estimator": (analysis.lead_times, ["days_until_deadline", "family"]),
        "Delivery_Sequence": (analysis.delivery, ["delivery_phase"]),
        "Spend_Estimation": (analysis.spend, [F.col("estimated_total").desc(), F.col("family")]),
    }


def deal_by_project(df: DataFrame, order: list, file_rows: int = FILE_ROWS) -> DataFrame:
    """``df`` dealt to tasks for writing by project, in ``order`` within a project.

    The rows of each project are counted first.  A project of up to ``file_rows`` rows goes to one
    task, a larger one in as many pieces as it needs, by a hash of the row, each to another task.
    There are tasks for the rows (``FILE_ROWS`` each), for the files (``TASK_FILES`` each) and
    for the pieces of the largest project, however small ``file_rows`` is; small projects share one."""
    sizes = materialise(df.groupBy("project_id").agg(F.count(F.lit(1)).alias("_rows")), "project-sizes")
    cut = F.ceil(F.col("_rows") / file_rows).cast("bigint")
    total, files, most = sizes.agg(F.sum("_rows"), F.sum(cut), F.max(cut)).first()
    tasks = max(1, -(-(total or 0) // max(file_rows, FILE_ROWS)), -(-(files or 0) // TASK_FILES), most or 0)
    pieces = sizes.filter(F.col("_rows") > file_rows).select("project_id", cut.alias("_pieces"))  # at most total / file_rows rows
    dealt = df.join(pieces, "project_id", "left").withColumn(
        "_piece", F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(*df.columns), F.col("_pieces"))).otherwise(F.lit(0)))
    task = F.pmod(F.pmod(F.xxhash64("project_id"), F.lit(tasks)) + F.col("_piece"), F.lit(tasks)).cast("int")
    return dealt.repartitionById(tasks, task).sortWithinPartitions("project_id", *order).select(*df.columns)


def write_by_project(tables: dict[str, tuple[DataFrame, list]], out_dir: str, fmt: str = "parquet",
                     mode: str = "overwrite", file_rows: int = FILE_ROWS) -> dict[str, str]:
    """Write each table (rows, order within a project) to out_dir/<name> with a folder per
    project; name -> path.  Rows are dealt by ``deal_by_project``, so a table has at most one
    file a project and one more for every ``file_rows`` rows, where writing straight from
    the producing tasks would open up to tasks x projects files.  Inside a file rows are in
    the order given."""
    paths = {}
    for name, (df, order) in tables.items():
        path = os.path.join(out_dir, name)
        dealt = deal_by_project(df, order, file_rows)
        if fmt == "parquet":
            write_parquet(dealt, path, ["project_id"], mode)
        else:
            w = dealt.write.mode(mode).format(fmt).partitionBy("project_id")
            if fmt == "csv":
                w = w.option("header", "true")
            w.save(path)
        paths[name] = path
    return paths


def stored_files(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, project_id, file, rows, digest: a row for each data file of tables as ``read_tables`` returned
    them (and project, if they have projects), from one pass over each that is written.  ``count_files`` and
    ``table_digests`` sum it up, where each would open every file again."""
    out = None
    for name, df in tables.items():
        project = F.col("project_id").cast("string") if "project_id" in df.columns else F.lit(None).cast("string")
        one = (df.groupBy(project.alias("project_id"), F.col("_metadata.file_path").alias("file"))
               .agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_number(df)).alias("digest"))
               .select(F.lit(name).alias("table_name"), "project_id", "file", "rows", "digest"))
        out = one if out is None else out.unionByName(one)
    return materialise(out, "stored-files")


def count_files(paths: dict[str, str], spark: SparkSession, fmt: str = "parquet",
                read: dict[str, DataFrame] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """table_name, files: the data files of written tables that hold rows.  ``read``: the tables
    as ``read_tables`` returned them, whose folders then are not listed again; ``stored``: their
    ``stored_files``, so that they are not opened again either."""
    out = None
    for name, df in (read or read_tables(spark, paths, fmt)).items():
        file = df.select(F.col("_metadata.file_path").alias("f")) if stored is None else (
            stored.filter(F.col("table_name") == name).select(F.col("file").alias("f")))
        one = (file.distinct()
               .agg(F.count(F.lit(1)).alias("files")).select(F.lit(name).alias("table_name"), "files"))
        out = one if out is None else out.unionByName(one)
    return out


def write_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
                 partition_by_project: bool = False, mode: str = "overwrite") -> dict[str, str]:
    """Write each table to out_dir/<name>; returns name -> path.  With
    partition_by_project each project gets its own folder, its rows dealt as in
    ``write_by_project``; a table without projects is written as it is."""
    paths = {}
    if partition_by_project:
        by_project = {n: (df, []) for n, df in tables.items() if "project_id" in df.columns}
        paths = write_by_project(by_project, out_dir, fmt, mode)
        tables = {n: df for n, df in tables.items() if n not in paths}
    for name, df in tables.items():
        path = os.path.join(out_dir, name)
        w = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        w.save(path)
        paths[name] = path
    return paths


def read_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    bound_listing(spark)
    return {name: spark.read.format(fmt).load(p) for name, p in paths.items()}


def _row_number(df: DataFrame) -> Column:
    """The number of a row: 40 bits of the md5 of all its columns by name."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in sorted(df.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *values)), 1, 10), 16, 10).cast("decimal(38,0)")


def table_digests(tables: dict[str, DataFrame], stored: DataFrame | None = None) -> DataFrame:
    """table_name, rows, digest — one row per table; the digest is a sum of row
    hashes over all columns by name, so it does not depend on row order.  ``stored``: the
    ``stored_files`` of the tables, which are summed then."""
    parts = []
    for name, df in tables.items():
        if stored is None:
            held, rows, digest = df, F.count(F.lit(1)), F.sum(_row_number(df))
        else:
            held, rows, digest = stored.filter(F.col("table_name") == name), F.coalesce(F.sum("rows"), F.lit(0)), F.sum("digest")
        parts.append(held.agg(rows.alias("rows"), F.coalesce(digest, F.lit(0)).cast("string").alias("digest"))
                     .select(F.lit(name).alias("table_name"), "rows", "digest"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
