"""Session set-up and the shared folder that written intermediates live in."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(name: str = "lociframe", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.useIdInClassName", "false")  # equal stages share compiled code
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path that every executor can reach.

    Below the folder in ``spark.checkpoint.dir``; where that is unset, below
    the session's warehouse, which is shared as well.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Cuts the lineage: later steps read files that outlive a lost executor, and
    what the rows hold is fixed from here on.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.written_path = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Remove the files of frames that ``written`` gave; for intermediates that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.written_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that no frame refers to any more.

    Its cleaner follows the driver's garbage collection, which may be long in
    coming; a job of many written steps asks for it between them.
    """
    for _ in range(2):  # what the first round frees on this side, the second one finds on the other
        gc.collect()
        spark._jvm.System.gc()
