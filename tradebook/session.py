"""Session settings the jobs expect, and the shared folder they cut lineage in."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# with little data every core should still get a share of it
LOCAL = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}


def local_session(cores: int | str = 8, partitions: int = 8, name: str = "tradebook", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in {
        **SETTINGS,
        **LOCAL,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **extra,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Rows over all cores when a scan gives fewer than ``per_core`` partitions for each; else as it is.

    For work that costs far more per row than moving the row does.  A table of
    many files or splits is never shuffled by this, nor is what a shuffle has
    spread already.  A file is cut at even places, but its rows stand in a few
    groups, so splits as many as the cores may still leave most of them idle:
    ``per_core`` above 1 is for narrow rows that become wide ones later.
    """
    if df.isStreaming or not df.inputFiles():
        return df
    plan = df._jdf.queryExecution()
    # a plan with a shuffle is run stage by stage: asking it for its partitions would run it
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if plan.toRdd().getNumPartitions() < wanted else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the one the session names in spark.checkpoint.dir.  Only a
    local session without that setting gets a scratch folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tradebook-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a query made and run inside as soon as it has ended.

    Otherwise they stay until the driver next collects garbage, and a job of hundreds of small shuffles fills the disk
    with them.  For jobs that store what they read again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    import uuid

    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tradebook-scratch-")
    # a path without scheme means the cluster's default file system, also to those who open files without Spark
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: packed by columns, and Spark knows its true size."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
