"""Session construction and lineage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "oddsforge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("ODDSFORGE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only on ``local[...]`` masters (tests) is a private scratch folder made where the
    setting is absent; on a cluster that folder would be another one on every
    executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="oddsforge-ckpt-")
    sc.setCheckpointDir(configured)
    path = sc._jsc.sc().getCheckpointDir().get()
    _delete_on_exit(spark, path)
    return path


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove ``path`` when the application ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


#: Has a query remove its shuffle files at its end. Otherwise they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_go(spark: SparkSession):
    """Inside it the shuffle files of every action go at its end. For plans that no later action runs again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a parquet table in the shared checkpoint folder.

    The plan runs once (an un-persisted ``checkpoint()`` would run it twice:
    once for the action, once for the write), the result survives executor
    loss, and later scans of it get column pruning and filter pushdown (and, with
    ``partition_by``, read only the folders that a filter leaves). The
    folder is this application's own and goes when the application ends.
    The shuffle files of the write go at its end: nobody reads them again, the table stands for them.
    Never a local checkpoint.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    with shuffle_files_go(spark):
        df.write.mode("overwrite").parquet(path, partitionBy=partition_by, compression="zstd")
    out = spark.read.parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut_lineage` before the application ends. Only for those that no plan reads any more: what is
    built on one has been written itself."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path is not None:
            where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def cached_blocks_go(spark: SparkSession):
    """Unpersists at its end what was persisted inside it (a fit keeps its factors), and has the driver collect its garbage: that
    is when Spark deletes the shuffle files of an RDD that nobody holds. For blocks whose results are written."""
    sc = spark.sparkContext
    before = set(sc._jsc.getPersistentRDDs().keySet())
    try:
        yield
    finally:
        for k, rdd in dict(sc._jsc.getPersistentRDDs()).items():
            if k not in before:
                rdd.unpersist()
        gc.collect()
        sc._jvm.System.gc()
