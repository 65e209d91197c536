import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signpost.operators import articles as ar
from signpost.operators import ranking as rk
from tests.conftest import plan_of


def order(i, seed=42):
    return (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i)


@pytest.fixture(scope="module")
def rows(spark):
    # one class holds two thirds of the rows, one has a single row, one is null
    def label(i):
        if i == 7:
            return "lone"
        if i % 50 == 3:
            return None
        return "hot" if i % 3 else ("Mid" if i % 2 else "mid")

    return [(i, label(i)) for i in range(3000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, lang string").repartition(6)


def test_sample_per_class_matches_brute_force(table, rows):
    got = defaultdict(list)
    for r in ar.sample_per_class(table, 20).collect():
        got[r["lang"]].append((r["rank"], r["doc_id"]))
    groups = defaultdict(list)
    for i, label in rows:
        if label is not None:
            groups[label.lower()].append(i)
    assert set(got) == set(groups)
    for label, ids in groups.items():
        want = sorted(ids, key=order)[:20]
        assert sorted(got[label]) == list(enumerate(want, 1))


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
@pytest.mark.parametrize("prefix_len", [1, 4])
def test_split_matches_brute_force(table, rows, share, prefix_len):
    got = {
        r["doc_id"]: r["f"]
        for r in rk.with_share_flag(
            table,
            rk.share_cuts(table, "lang", "doc_id", share, 42, prefix_len),
            "lang",
            "doc_id",
            42,
            "f",
        ).collect()
    }
    groups = defaultdict(list)
    for i, label in rows:
        groups[label].append(i)
    assert len(got) == len(rows)
    for ids in groups.values():
        first = set(sorted(ids, key=order)[: math.ceil(share * len(ids))])
        assert {i for i in ids if got[i]} == first


def test_split_parts_are_disjoint_and_complete(table, rows):
    split = ar.stratified_split(table).collect()
    assert sorted(r["doc_id"] for r in split) == [i for i, _ in rows]
    assert set(Counter(r["split"] for r in split)) == {"train", "validation"}


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_global_index_matches_one_window(spark, partitions):
    ids = [i * i % 7919 + 10_000 * i for i in range(1000)]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id bigint, t string").repartition(5)
    got = {
        r["doc_id"]: r["idx"] for r in rk.global_index(df, "doc_id", partitions=partitions).collect()
    }
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_fixed_batches(spark):
    got = ar.fixed_batches(spark.range(25).withColumnRenamed("id", "doc_id"), 10).collect()
    assert Counter(r["batch_id"] for r in got) == {0: 10, 1: 10, 2: 5}
    assert len({r["request_id"] for r in got}) == 3
    assert all(len(r["request_id"]) == 8 for r in got)
    assert ar.fixed_batches(spark.range(0).withColumnRenamed("id", "doc_id"), 10).count() == 0


def test_dedupe_keeps_the_smallest_id_of_exact_texts(spark):
    df = spark.createDataFrame(
        [(5, "a"), (2, "a"), (3, "a "), (9, None), (4, None), (6, "A")],
        "doc_id bigint, text string",
    )
    assert sorted(r["doc_id"] for r in ar.dedupe_text(df).collect()) == [2, 3, 4, 6]


def test_dedupe_with_a_hot_text(spark):
    df = spark.range(2000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"),
    )
    kept = {r["doc_id"] for r in ar.dedupe_text(df).collect()}
    assert kept == {i for i in range(2000) if i % 3 or i == 0}


def test_labeled_articles(spark):
    articles = spark.createDataFrame(
        [(1, " a\n"), (2, "b")], "article_id bigint, text string"
    )
    labels = spark.createDataFrame([(1, "x")], "article_id bigint, label string")
    got = {r["article_id"]: (r["text"], r["label"]) for r in
           ar.labeled_articles(articles, labels).collect()}
    assert got == {1: ("a", "x"), 2: ("b", None)}
    raw = ar.labeled_articles(articles, labels, strip=False).collect()
    assert {r["text"] for r in raw} == {" a\n", "b"}


def test_arguments_are_checked(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"))
    with pytest.raises(ValueError):
        ar.fixed_batches(df, 0)
    with pytest.raises(ValueError):
        ar.sample_per_class(df, 0)
    with pytest.raises(ValueError):
        ar.stratified_split(df, validation_share=1.5)


@pytest.mark.parametrize("n", [1001, 5000])
def test_a_large_sample_moves_no_more_than_itself(spark, n):
    """Beyond what Spark's window limit prunes, rows of a class are chosen before they are moved."""
    rows = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("lang")
    )
    got = ar.sample_per_class(rows, n)
    order = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(60_000)}
    for lang, keep in (("big", lambda i: i % 10 < 9), ("small", lambda i: i % 10 == 9)):
        want = sorted((i for i in order if keep(i)), key=lambda i: (order[i], i))[:n]
        mine = {r["rank"]: r["doc_id"] for r in got.filter(F.col("lang") == lang).collect()}
        assert mine == dict(enumerate(want, 1))
    # the plan that moves rows to rank them filters by the cut first, below every exchange
    plan = plan_of(got)
    below = plan[plan.rindex("Exchange") :]
    assert "_cut_h" in below and "Filter" in below
    assert rows.count() == 60_000
