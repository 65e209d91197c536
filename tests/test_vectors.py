import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signpost.functions import vectors as vx
from signpost.operators.embed import embed, embed_hashed, embed_with, vector_rows


def terms(text, dims):
    return Counter(
        int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dims for w in text.lower().split()
    )


TEXTS = ["", "  ", "one", "one two ONE", "ä ö Ä " * 30, "the quick brown fox " * 7]


@pytest.mark.parametrize("dims", [1, 7, 256])
def test_hashed_terms_and_unit_vector(spark, dims):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = df.select(
        "id",
        vx.hashed_terms(F.col("text"), dims).alias("n"),
        vx.hashed_vector(F.col("text"), dims).alias("v"),
    ).collect()
    for r in rows:
        want = terms(TEXTS[r["id"]], dims)
        assert {e["dim"]: e["n"] for e in r["n"]} == dict(want)
        norm = math.sqrt(sum(c * c for c in want.values()))
        assert {e["dim"]: pytest.approx(e["val"]) for e in r["v"]} == {
            d: c / norm for d, c in want.items()
        }


def test_null_text_has_no_vector(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    assert {r["id"]: r["vec"] for r in embed_hashed(df).collect()} == {1: None, 2: []}


def test_vector_rows(spark):
    df = embed_hashed(spark.createDataFrame([(1, "a b a")], "doc_id bigint, text string"))
    rows = vector_rows(df).collect()
    assert math.isclose(sum(r["v"] ** 2 for r in rows), 1.0)


def test_dense_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(vx.unit_dense(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    dot = df.select(vx.dense_dot(F.col("v"), F.col("v"))).collect()
    assert [r[0] for r in dot] == [25.0, 0.0]


def test_confidence_is_clamped(spark):
    df = spark.createDataFrame([(0.25,), (1.5,), (-2e-16,)], "d double")
    got = [r[0] for r in df.select(vx.confidence(F.round("d", 9))).collect()]
    assert got == [0.75, 0.0, 1.0]


def test_plugged_in_embedder(spark):
    def factory():
        import numpy

        return lambda texts: numpy.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r["vec"] for r in embed_with(df, factory).collect()}
    assert np.allclose(got[1], np.array([3, 1]) / math.sqrt(10))
    assert got[2] == got[3] == [0.0, 1.0]


def test_unknown_embedder_is_an_error(spark):
    with pytest.raises(ValueError):
        embed(spark.range(1), "no such embedder")
