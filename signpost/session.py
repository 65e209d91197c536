"""Session helpers: a local session for tests and bench, and the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from signpost.sources import files

_OWNER: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and bench runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("signpost")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: executors
    of a cluster could not read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="signpost-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder that owns the tables written inside the ``with`` and is removed at its end.

    Results that are read later must be written elsewhere before; those of an inner
    ``with`` go with the inner one. Without an owner tables stay until someone
    removes ``signpost`` in the shared folder.
    """
    folder = f"{shared_folder(spark)}/signpost/scratch-{uuid.uuid4().hex}"
    outer = _OWNER.set(folder)
    try:
        yield folder
    finally:
        _OWNER.reset(outer)
        files.remove(spark, folder)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst the true size
    on disk, so a join against the result is broadcast only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise. The table belongs to the
    ``scratch`` around it, if there is one.
    """
    owner = _OWNER.get() or f"{shared_folder(df.sparkSession)}/signpost"
    path = f"{owner}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, max_bytes: int = 256 << 20) -> DataFrame:
    """Use every core for a small scan that has fewer partitions than there are cores.

    Only a table of at most ``max_bytes`` by Catalyst's estimate is moved; a larger
    one keeps the partitions of its scan, whatever the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > max_bytes or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
