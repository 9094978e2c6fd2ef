"""Write result frames under one run folder and read them back."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table of published runs below a base folder.
RUNS = "published_runs"
RUN_SCHEMA = "run_id string, name string, path string, fmt string, at bigint"


def run_name(tag: str = "", at: datetime | None = None) -> str:
    """A run id from a tag and the time."""
    stamp = (at or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{tag}_{stamp}" if tag else stamp


def run_path(base: str, name: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/{name}/run_id={run_id}"


def write_outputs(
    frames: Mapping[str, DataFrame | None],
    base: str,
    run_id: str,
    fmt: str = "parquet",
    skip_empty: Sequence[str] = ("unmapped", "joined"),
) -> dict[str, str]:
    """Write each frame to ``base/name/run_id=...``; returns the paths written.

    Absent frames are left out, and those of ``skip_empty`` when they have no rows. Files
    are written by the tasks in parallel; nothing passes through the driver.
    """
    paths = {}
    for name, df in frames.items():
        if df is None or (name in skip_empty and df.isEmpty()):
            continue
        paths[name] = run_path(base, name, run_id)
        _save(df.write.mode("overwrite"), paths[name], fmt)
    return paths


def publish_outputs(
    frames: Mapping[str, DataFrame | None],
    base: str,
    run_id: str,
    fmt: str = "parquet",
    skip_empty: Sequence[str] = ("unmapped", "joined"),
) -> dict[str, str]:
    """``write_outputs`` as a whole: a run is there with all its frames, or not at all.

    Each call writes to folders of its own. Only when all frames are written are they listed,
    by one file of a few rows that is added to the table of runs; until then, and for ever if a
    frame fails, ``read_output`` finds the run published before under that id. Frames that the
    new run leaves out are no longer part of it. What no list names any more can be deleted.
    """
    attempt = uuid.uuid4().hex
    spark = next((df.sparkSession for df in frames.values() if df is not None), None)
    if spark is None:
        return {}
    paths = {}
    for name, df in frames.items():
        if df is None or (name in skip_empty and df.isEmpty()):
            continue
        paths[name] = f"{run_path(base, name, run_id)}/attempt={attempt}"
        _save(df.write, paths[name], fmt)
    # the row without a name stands for the run itself, which may have no frames
    rows = [(run_id, name, path, fmt, time.time_ns()) for name, path in [("", ""), *paths.items()]]
    listed = spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1)
    listed.write.mode("append").parquet(f"{base.rstrip('/')}/{RUNS}")
    return paths


def _save(writer, path: str, fmt: str) -> None:
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def published(spark: SparkSession, base: str, run_id: str) -> dict[str, str] | None:
    """The paths of the frames of the run last published under an id; None without any."""
    try:
        runs = spark.read.schema(RUN_SCHEMA).parquet(f"{base.rstrip('/')}/{RUNS}")
    except AnalysisException:
        return None
    own = runs.where(F.col("run_id") == run_id)
    begin = own.where("name = ''").agg(F.max("at")).first()[0]
    if begin is None:
        return None
    attempt = own.where(F.col("at") >= begin).where("name <> ''").collect()
    return {r["name"]: r["path"] for r in attempt}


def read_output(
    spark: SparkSession, base: str, name: str, run_id: str, fmt: str = "parquet", schema=None
) -> DataFrame:
    """A frame of the run last published under ``run_id``, or else written there."""
    paths = published(spark, base, run_id)
    if paths is not None and name not in paths:
        raise ValueError(f"run {run_id!r} has no frame {name!r}")
    path = run_path(base, name, run_id) if paths is None else paths[name]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)
