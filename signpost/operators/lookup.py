"""Fetch few rows of a large table by id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FILES = 10_000


def rows_by_id(
    source: DataFrame, ids: DataFrame, id_col: str, max_files: int = MAX_FILES
) -> DataFrame:
    """Rows of ``source`` joined with ``ids``, a written table with unique ids.

    If ``source`` reads files, a pass over the id column
    alone finds the files they lie in, and only those files are read: a sample of
    hundreds of rows then reads hundreds of files of a table that has a million.
    More than
    ``max_files`` files are read by the plain join.
    """
    try:
        path = F.col("_metadata.file_path")
        located = source.select(id_col, path.alias("_file"))
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        return source.join(ids, id_col)  # not a file scan
    found = located.join(ids.select(id_col), id_col, "left_semi").select("_file").distinct()
    files = [r["_file"] for r in found.limit(max_files + 1).collect()]
    if not 0 < len(files) <= max_files:
        return source.join(ids, id_col)
    return source.filter(path.isin(files)).join(ids, id_col)
