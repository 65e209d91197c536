"""Small files on any file system that Spark reads; the driver alone uses this."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, newest first (then by name); a missing folder has none."""
    if not exists(spark, folder):
        return []
    found = _system(spark, folder).listStatus(_path(spark, folder))
    order = sorted((-f.getModificationTime(), f.getPath().getName()) for f in found)
    return [name for _, name in order]


def read_text(spark: SparkSession, path: str) -> str | None:
    """What a small file holds; None if there is none."""
    if not exists(spark, path):
        return None
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place at once: readers see the old one or the new one, never a part."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, name = path.rsplit("/", 1)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    stream = _system(spark, path).create(_path(spark, aside), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    over = getattr(hadoop, "Options$Rename").OVERWRITE
    how = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = over
    uri = _system(spark, path).getUri()
    hadoop.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(
        _path(spark, aside), _path(spark, path), how
    )


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)
