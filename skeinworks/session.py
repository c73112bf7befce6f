"""Session helpers shared by all operators: tables, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the count is always taken first.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skeinworks")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as it lies on disk; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of this machine only in local mode without it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        made = tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    All executors share that folder, so the result survives the loss of any of
    them. Only where the setting is absent (tests) is a local folder made.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more (a loop's earlier rounds).

    Others go when the session's cleaner finds them unused
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    for df in frames:
        place = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if place.isDefined():
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place.get())
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if a count proves it small; else leave it to a shuffle join.

    ``df`` should be cheap to count (checkpointed or a dimension table).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
