"""Runs on disk: report rows as CSV, metrics and run info as JSON, each write in a folder of its own.

    <base>/classifications/run_id=<id>/<write>/*.csv
    <base>/metrics/run_id=<id>/<write>/*.json          (category, metric, value)
    <base>/run_info/run_id=<id>/<write>/*.json
    <base>/manifests/<id>.json                         which of these make up the run

The manifest is put in place last, in one step, and readers go by it alone. A run that
was broken off has none and is seen by nobody; one that is written again stays as it was
until its new manifest replaces the old one, and readers that began before go on with the
files they began with. ``remove_leftovers`` deletes what no manifest names.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.operators.runs import run_id
from signpost.sources import files

_METRICS = "category string, metric string, value double"
_INFO = (
    "timestamp timestamp, classifier_config string, pipeline_config string, "
    "files_generated map<string,string>, facts map<string,double>"
)
_ROWS = (
    "batch_id string, article_id bigint, prediction string, true_label string, "
    "correct boolean, batch_status string, article_text_preview string"
)
PARTS = ("classifications", "metrics", "run_info")


def new_run_id(spark: SparkSession) -> str:
    return spark.range(1).select(run_id(F.current_timestamp())).first()[0]


def _folder(base: str, part: str, run: str) -> str:
    return f"{base.rstrip('/')}/{part}/run_id={run}"


def _new_folder(base: str, part: str, run: str) -> str:
    return f"{_folder(base, part, run)}/{uuid.uuid4().hex}"


def save_classifications(rows: DataFrame, base: str, run: str) -> str:
    """Write report rows; the folder. They count once the run is committed."""
    folder = _new_folder(base, "classifications", run)
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return folder


def save_metrics(metrics: DataFrame, base: str, run: str) -> str:
    """Write metrics; the folder. They count once the run is committed."""
    folder = _new_folder(base, "metrics", run)
    metrics.select("category", "metric", "value").write.option("ignoreNullFields", False).json(folder)
    return folder


def save_run_info(
    spark: SparkSession,
    base: str,
    run: str,
    classifier_config: dict | None = None,
    pipeline_config: dict | None = None,
    facts: dict[str, float] | None = None,
    written: dict[str, str] | None = None,
) -> str:
    """Write what is needed to repeat a run, then commit the run; the manifest's path.

    ``written`` names the folders of the other parts; without it each part's newest one
    is taken. ``facts`` are numbers measured in the run.
    """
    parts = dict(written) if written is not None else _newest_parts(spark, base, run)
    folder = _new_folder(base, "run_info", run)
    parts["run_info"] = folder
    numbers = [F.lit(x) for k, v in (facts or {}).items() for x in (k, float(v))]
    spark.range(1).select(
        F.current_timestamp().alias("timestamp"),
        F.lit(json.dumps(classifier_config or {})).alias("classifier_config"),
        F.lit(json.dumps(pipeline_config or {})).alias("pipeline_config"),
        F.create_map(*[F.lit(x) for item in parts.items() for x in item]).alias("files_generated"),
        (F.create_map(*numbers) if numbers else F.lit(None).cast("map<string,double>")).alias("facts"),
    ).write.json(folder)
    return commit(spark, base, run, parts)


def _newest_parts(spark: SparkSession, base: str, run: str) -> dict[str, str]:
    found = {p: files.names(spark, _folder(base, p, run)) for p in PARTS if p != "run_info"}
    return {p: f"{_folder(base, p, run)}/{names[0]}" for p, names in found.items() if names}


def _manifests(base: str) -> str:
    return f"{base.rstrip('/')}/manifests"


def commit(spark: SparkSession, base: str, run: str, parts: dict[str, str]) -> str:
    """Make a run visible, with exactly these folders."""
    now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds")
    path = f"{_manifests(base)}/{run}.json"
    files.write_text(spark, path, json.dumps({"run_id": run, "committed_at": now, "parts": parts}))
    return path


def manifest(spark: SparkSession, base: str, run: str) -> dict | None:
    """The manifest of a committed run."""
    text = files.read_text(spark, f"{_manifests(base)}/{run}.json")
    return None if text is None else json.loads(text)


def committed(spark: SparkSession, base: str) -> DataFrame | None:
    """(run_id, committed_at, parts) of all committed runs, or None if there is none."""
    if not files.names(spark, _manifests(base)):
        return None
    schema = "run_id string, committed_at timestamp, parts map<string,string>"
    return spark.read.schema(schema).json(_manifests(base))


def remove_leftovers(spark: SparkSession, base: str) -> list[str]:
    """Delete folders that no manifest names: broken runs, replaced writes. No run may be under way."""
    root, gone = base.rstrip("/"), []
    for part in PARTS:
        for name in files.names(spark, f"{root}/{part}"):
            kept = (manifest(spark, base, name.removeprefix("run_id=")) or {}).get("parts", {}).get(part)
            for write in files.names(spark, f"{root}/{part}/{name}"):
                folder = f"{root}/{part}/{name}/{write}"
                if folder != kept:
                    files.remove(spark, folder)
                    gone.append(folder)
    return gone


def _read(spark: SparkSession, base: str, part: str, run: str, schema: str) -> DataFrame | None:
    folder = (manifest(spark, base, run) or {}).get("parts", {}).get(part)
    if folder is None:
        return None
    rows = spark.read.schema(schema).options(header=True, escape='"')
    kind = "csv" if part == "classifications" else "json"
    return rows.format(kind).load(folder).withColumn("run_id", F.lit(run))


def read_metrics(spark: SparkSession, base: str, run: str) -> DataFrame | None:
    """Metrics of a run, or None if it has none."""
    metrics = _read(spark, base, "metrics", run, _METRICS)
    return None if metrics is None or metrics.isEmpty() else metrics


def read_classifications(spark: SparkSession, base: str, run: str) -> DataFrame | None:
    return _read(spark, base, "classifications", run, _ROWS)


def read_run_info(spark: SparkSession, base: str, run: str) -> DataFrame | None:
    return _read(spark, base, "run_info", run, _INFO)


def run_summary(spark: SparkSession, base: str, run: str) -> dict | None:
    """Info and metrics of a run as tables and whether it has report rows; None if unknown."""
    if manifest(spark, base, run) is None:
        return None
    rows = read_classifications(spark, base, run)
    return {
        "run_info": read_run_info(spark, base, run),
        "metrics": read_metrics(spark, base, run),
        "has_classifications": rows is not None and not rows.isEmpty(),
    }


def stored_runs(spark: SparkSession, bases: dict[str, str]) -> DataFrame:
    """Committed runs under each base folder: (result_type, run_id, modified_at).

    ``bases`` maps a result type to its folder; a missing folder has no runs.
    The time is that of the commit.
    """
    found = spark.createDataFrame([], "result_type string, run_id string, modified_at timestamp")
    for result_type, base in bases.items():
        runs = committed(spark, base)
        if runs is not None:
            found = found.unionByName(
                runs.select(
                    F.lit(result_type).alias("result_type"),
                    "run_id",
                    F.col("committed_at").alias("modified_at"),
                )
            )
    return found


def save_comparison(
    comparison: DataFrame, baseline: DataFrame, semantic: DataFrame, base: str, run: str
) -> None:
    """A comparison with the metrics of both runs it compared."""
    folder = f"{base.rstrip('/')}/%s/run_id={run}"
    # an infinite ratio has no JSON number: written as text
    text = [F.col(c).cast("string").alias(c) for c in comparison.columns]
    comparison.select(*text).write.mode("overwrite").json(folder % "comparison")
    both = baseline.select(F.lit("baseline").alias("side"), "metric", "value").unionByName(
        semantic.select(F.lit("semantic").alias("side"), "metric", "value")
    )
    both.write.mode("overwrite").json(folder % "compared_metrics")
