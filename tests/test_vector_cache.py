"""A model is asked for every text once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from signpost.sources import vector_cache as vc


def counting(folder):
    """Writes one file per text it embeds; a text "break" ends its task if the marker is there."""

    def factory():
        import os
        import time
        import uuid

        def embed(texts):
            for t in texts:
                if t == "break" and os.path.exists(os.path.join(folder, "broken")):
                    time.sleep(4)
                    raise SystemExit("lost")
                open(os.path.join(folder, f"text-{len(t)}-{uuid.uuid4().hex}"), "w").close()
            return np.array([[1.0, len(t)] for t in texts])

        return embed

    return factory


@pytest.fixture
def calls(tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    return folder


def made(folder):
    return len([f for f in os.listdir(folder) if f.startswith("text-")])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("_digest_of", F.lit(1))


def test_copies_once_and_reruns_never(spark, tmp_path, calls):
    path = str(tmp_path / "cache")
    df = frame(spark, ["a", "bb", "a", None, "", "ccc"] * 30)
    rows = vc.embed_cached(df, counting(calls), path, "m").collect()
    assert made(calls) == 4 and len(rows) == 180
    for r in rows:
        n = len(r["text"] or "")
        assert r["vec"] == pytest.approx([1 / (1 + n * n) ** 0.5, n / (1 + n * n) ** 0.5])
    again = vc.embed_cached(df.limit(50), counting(calls), path, "m")
    assert again.count() == 50 and made(calls) == 4
    assert vc.embed_cached(frame(spark, ["a", "new"]), counting(calls), path, "m").count() == 2
    assert made(calls) == 5
    # another model has vectors of its own
    assert vc.embed_cached(frame(spark, ["a"]), counting(calls), path, "other").count() == 1 and made(calls) == 6
    assert vc.cached_vectors(spark, path, "m").count() == 5
    with pytest.raises(ValueError):
        vc.cached_vectors(spark, path, "a/b")


def test_a_broken_job_keeps_what_it_paid_for(spark, tmp_path, calls):
    path, marker = str(tmp_path / "cache"), os.path.join(calls, "broken")
    open(marker, "w").close()
    df = frame(spark, ["x" * (10 + n) for n in range(12)] + ["break"])
    with pytest.raises(Exception):
        vc.embed_cached(df, counting(calls), path, "m", partitions=8)
    kept = vc.cached_vectors(spark, path, "m").count()
    assert kept > 0
    os.remove(marker)
    before = made(calls)
    assert vc.embed_cached(df, counting(calls), path, "m").filter("vec IS NOT NULL").count() == 13
    assert made(calls) == before + 13 - kept


def test_two_writers_of_one_text(spark, tmp_path, calls):
    path, df = str(tmp_path / "cache"), frame(spark, ["a", "b"])
    vc.add_missing(df, counting(calls), path, "m")
    spark.read.parquet(f"{path}/model=m").write.mode("append").parquet(f"{path}/model=m")
    assert vc.embed_cached(df, counting(calls), path, "m").count() == 2


def test_an_empty_table(spark, tmp_path, calls):
    assert vc.embed_cached(frame(spark, ["a"]).limit(0), counting(calls), str(tmp_path / "c"), "m").count() == 0
