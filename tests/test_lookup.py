import glob
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from signpost.operators import lookup as lu
from signpost.session import materialize


@pytest.fixture()
def table(spark, tmp_path):
    # a folder with a blank: paths are escaped in the metadata column
    path = str(tmp_path / "many files")
    df = spark.range(0, 1000, 1, 20).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")
    )
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_only_files_with_a_wanted_row_are_read(spark, table, tmp_path):
    ids = materialize(
        spark.createDataFrame(
            [(3, "a"), (4, "b"), (777, "c"), (5000, "d")], "doc_id bigint, tag string"
        )
    )
    holding = {
        unquote(r[0]).removeprefix("file://").removeprefix("file:")
        for r in table.filter("doc_id in (3, 4, 777)").select("_metadata.file_path").collect()
    }
    got = lu.rows_by_id(table.select("doc_id", "text"), ids, "doc_id")
    spoiled = [f for f in glob.glob(str(tmp_path / "many files" / "*.parquet")) if f not in holding]
    assert (len(holding), len(spoiled)) == (2, 18)
    for f in spoiled:
        open(f, "w").close()
    assert sorted(map(tuple, got.collect())) == [
        (3, "t3", "a"), (4, "t4", "b"), (777, "t777", "c"),
    ]


@pytest.mark.parametrize("limit", [10_000, 2])
def test_other_sources_and_many_ids_join_plainly(spark, table, monkeypatch, limit):
    monkeypatch.setattr(lu, "MAX_FILES", limit)
    ids = materialize(spark.range(10).withColumnRenamed("id", "doc_id"))
    for source in (table, table.groupBy("doc_id").agg(F.max("text").alias("text"))):
        got = lu.rows_by_id(source.select("doc_id", "text"), ids, "doc_id").collect()
        assert sorted(map(tuple, got)) == [(i, f"t{i}") for i in range(10)]


def test_no_ids(spark, table):
    ids = materialize(spark.range(0).withColumnRenamed("id", "doc_id"))
    assert lu.rows_by_id(table, ids, "doc_id").count() == 0
