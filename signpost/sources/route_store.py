"""Route tables on disk, as snapshots behind a pointer.

    <path>/snapshots/<write>/*.parquet
    <path>/current.json                  which snapshot is the table now

A write makes a new snapshot and then moves the pointer in one step. Who loaded the
table before, a batch or a stream, goes on with the snapshot it loaded; a write that was
broken off leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from signpost.sources import files


def _pointer(path: str) -> str:
    return f"{path.rstrip('/')}/current.json"


def _snapshots(path: str) -> str:
    return f"{path.rstrip('/')}/snapshots"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the snapshot that is the table now."""
    text = files.read_text(spark, _pointer(path))
    return None if text is None else json.loads(text)["snapshot"]


def versions(spark: SparkSession, path: str) -> list[str]:
    """All snapshots there are, newest first, also such as were never pointed at."""
    return files.names(spark, _snapshots(path))


def save_routes(routes: DataFrame, path: str, overwrite: bool = True) -> str:
    """Write a route table as the new current snapshot, whose name is returned.

    Without ``overwrite`` an existing table is an error.
    """
    spark = routes.sparkSession
    if not overwrite and current_version(spark, path) is not None:
        raise ValueError(f"a route table already exists under {path}")
    name = uuid.uuid4().hex
    routes.write.parquet(f"{_snapshots(path)}/{name}")
    files.write_text(spark, _pointer(path), json.dumps({"snapshot": name}))
    return name


def load_routes(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """The current route table, or a named snapshot; None if there is none or it has no route."""
    name = version or current_version(spark, path)
    if name is None or not files.exists(spark, f"{_snapshots(path)}/{name}"):
        return None
    routes = spark.read.parquet(f"{_snapshots(path)}/{name}")
    return None if routes.isEmpty() else routes


def remove_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all snapshots but the current one and the ``keep`` newest; nobody may still read them."""
    current, gone = current_version(spark, path), []
    for name in versions(spark, path)[keep:]:
        if name != current:
            files.remove(spark, f"{_snapshots(path)}/{name}")
            gone.append(name)
    return gone
