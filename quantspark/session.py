"""Session defaults for local runs and the durable-staging helper."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "quantspark", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, a temporary folder of this process
    serves; it goes when the process ends. A cluster without the setting fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="quantspark-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def staging_folder(spark: SparkSession) -> str:
    """The shared folder of this run, for files that several steps read."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it from there.

    Used after a pre-aggregation whose result feeds several branches, so the
    raw table is scanned once and a lost executor re-reads a small file.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
