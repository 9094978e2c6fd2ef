"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # call sites for error messages cost more than building the plan itself
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "perilscope", master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution on; ``extra`` uses ``__`` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors reach, as ``spark.checkpoint.dir`` names it.

    Without that setting, a session whose executor is the driver itself gets a temporary
    folder, which goes when the process ends; any other gets none.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and re.fullmatch(r"local(\[.*\])?", sc.master):
        folder = tempfile.mkdtemp(prefix="perilscope-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if folder is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, for frames that several later jobs read.

    A checkpoint in the shared folder, so that a lost executor costs nothing. Spark removes
    its files once the frame is no longer used, with the setting that ``session`` makes. A
    cluster that names no such folder is an error.
    """
    if shared_dir(df.sparkSession) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, as Parquet in a folder of its own, and read back: for many rows that
    several later jobs read, each some of the columns. Takes a fraction of a checkpoint's bytes."""
    base = run_folder(df.sparkSession, name)
    df.write.parquet(base)
    return df.sparkSession.read.schema(df.schema).parquet(base)


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, in the shared folder, for files a run writes."""
    folder = shared_dir(spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
