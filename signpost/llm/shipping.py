"""The package's code for Python workers that can't import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship_code(spark: SparkSession) -> None:
    """Give the workers this package, once per application.

    Workers import functions by name. Where the package is not installed on them it
    travels as a small archive with Spark's own file service.
    """
    context = spark.sparkContext
    name = "signpost_code.zip"
    if any(file.endswith(name) for file in context.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="signpost-code-")) / name
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_ROOT.rglob("*.py")):
            out.write(file, Path(_ROOT.name) / file.relative_to(_ROOT))
    context.addPyFile(str(archive))
