"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Session settings this library is tuned for.  Nothing here is required for
# correctness; they are the knobs a cluster deployment should review.
RECOMMENDED_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The CSV reader receives whole files per Arrow row: bound each input
    # batch by bytes, not only by row count.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # Schedule files are many and small; pack them into fewer read tasks.
    "spark.sql.files.openCostInBytes": str(1 << 20),
}


# Row groups of intermediate tables.
ROW_GROUP_BYTES = 32 << 20

# Arrow batches to Python workers, where rows hold whole texts or sets.
BATCH_BYTES = 4 << 20


def get_session(master: str | None = None, app_name: str = "bomspark",
                shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The location is read from the session (``spark.checkpoint.dir`` or the
    SparkContext checkpoint dir).  Only a local-mode session without one gets a
    directory of our own, as in tests.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="bomspark-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return os.path.join(base, (name or "out") + "-" + uuid.uuid4().hex[:12])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so a worker
    must be able to import the package from whatever folder it runs in.  The
    archive is written to the driver's own temporary folder and served from
    there by Spark (``addPyFile``)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="bomspark-ship-"), "bomspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("bomspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches to Python workers take at most BATCH_BYTES (and one row), unless the session
    has a lower bound already.

    Each running task holds its batch in Arrow's buffers, in the buffer of the socket and in the
    worker, all of which double as they grow; with Spark's own bound (64 MB) they can outgrow what an
    executor has beside its heap.  Batches may be cut anywhere, so results stay the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(setting: str) -> int:
    """A size as Spark settings give it: 4194304, 64MB, 64m."""
    number, unit = re.fullmatch(r"([0-9]+)\s*([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]):
    """The session with these settings for a while; what is lazy must run meanwhile."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bound_listing(spark: SparkSession) -> None:
    """Let folders be listed by a few tasks for each core, unless the session asks for fewer already.  Spark makes a
    task for every folder, up to 10 000, and a task costs far more than the listing of a folder that holds
    a file or two.  The setting stays on the session, as streams list when they run; it changes no result."""
    key, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(key)) > tasks:
        spark.conf.set(key, str(tasks))


def materialise(df, name: str):
    """Write df as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor later re-reads the written files
    instead of recomputing everything upstream.  Row groups are smaller than
    Parquet's default, as every running task holds one in memory."""
    out = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(out)
    return df.sparkSession.read.parquet(out)
