"""All stored runs as one table, by a data source that opens only the runs asked for.

    read_catalogue(spark, {"baseline": base_a, "semantic": base_b})
        .filter("result_type = 'semantic' AND run_id = '2024-..'")

One partition per committed run. Filters on ``result_type`` and ``run_id`` are taken over
by the source, so runs they leave out are neither listed as partitions nor opened.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

NAME = "signpost_runs"
SCHEMA = (
    "result_type string, run_id string, committed_at timestamp, has_classifications boolean, "
    "category string, metric string, value double"
)


def catalogue_source(name: str, columns: str) -> type[DataSource]:
    """The source's class, made here so that it travels to the workers by value."""
    import datetime as dt
    import json

    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

    def opened(path: str):
        local = path.removeprefix("file:")
        return fs.FileSystem.from_uri(f"/{local.lstrip('/')}" if local != path or path.startswith("/") else path)

    def listed(path: str) -> list[str]:
        system, at = opened(path)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")

    def text(path: str) -> str:
        system, at = opened(path)
        with system.open_input_stream(at) as stream:
            return stream.read().decode()

    class Run(InputPartition):
        def __init__(self, result_type: str, base: str, run: str) -> None:
            self.result_type, self.base, self.run = result_type, base, run

    class Reader(DataSourceReader):
        def __init__(self, bases: dict[str, str]) -> None:
            self.bases = bases
            self.wanted: dict[str, set] = {}

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute in (("result_type",), ("run_id",)):
                    values = {f.value}
                elif isinstance(f, In) and f.attribute in (("result_type",), ("run_id",)):
                    values = set(f.value)
                else:
                    yield f
                    continue
                (column,) = f.attribute
                self.wanted[column] = self.wanted.get(column, values) & values

        def takes(self, column: str, value: str) -> bool:
            return column not in self.wanted or value in self.wanted[column]

        def partitions(self):
            return [
                Run(result_type, base, name.removesuffix(".json"))
                for result_type, base in self.bases.items()
                if self.takes("result_type", result_type)
                for name in listed(f"{base}/manifests")
                if self.takes("run_id", name.removesuffix(".json"))
            ]

        def read(self, part):
            manifest = json.loads(text(f"{part.base}/manifests/{part.run}.json"))
            at = dt.datetime.fromisoformat(manifest["committed_at"])
            parts = manifest["parts"]
            head = (part.result_type, part.run, at, "classifications" in parts)
            rows = 0
            for name in listed(parts["metrics"]) if "metrics" in parts else []:
                for line in text(f"{parts['metrics']}/{name}").splitlines():
                    found = json.loads(line)
                    rows += 1
                    yield (*head, found["category"], found["metric"], found["value"])
            if not rows:
                yield (*head, None, None, None)

    class Catalogue(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema):
            return Reader(json.loads(self.options["bases"]))

    return Catalogue


def read_catalogue(spark: SparkSession, bases: dict[str, str]) -> DataFrame:
    """A row per metric of every committed run; a run without metrics has one row with nulls.

    ``bases`` maps a result type to its folder. Needs Spark's pushdown for Python sources,
    which is switched on for the session here.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(catalogue_source(NAME, SCHEMA))
    folders = {k: v.rstrip("/") for k, v in bases.items()}
    return spark.read.format(NAME).option("bases", json.dumps(folders)).load()
