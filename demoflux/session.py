"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FORCE_SPLIT = "spark.sql.adaptive.forceOptimizeSkewedJoin"

_LOCAL_FOLDER = None


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; a cluster passes its own session."""
    session = (
        SparkSession.builder.master(master)
        .appName("demoflux")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def split_hot_keys(spark: SparkSession) -> None:
    """Let adaptive execution split a hot join key even where the rows are then grouped by that key.

    By default Spark keeps such a join whole, to save the extra shuffle before the grouping; one
    task would then read all rows of the key. The extra shuffle follows a partial aggregation and
    is only made where a skewed partition is found.
    """
    for name in ("spark.sql.adaptive.skewJoin.enabled", FORCE_SPLIT):
        if spark.conf.get(name, "false") != "true" and spark.conf.isModifiable(name):
            spark.conf.set(name, "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A machine-local folder is used only when nothing is set and Spark runs inside
    this one process.
    """
    global _LOCAL_FOLDER
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _LOCAL_FOLDER is None:
        _LOCAL_FOLDER = tempfile.TemporaryDirectory(prefix="demoflux-")
    return _LOCAL_FOLDER.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once, so several passes can read them.

    A written table survives lost executors, and its known size lets Spark choose joins well.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
