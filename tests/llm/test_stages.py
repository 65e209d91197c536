"""Stages of the corpus pipeline in Spark, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from signpost.llm import mixing, pii, simhash

SCHEMA = "doc_id bigint, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, words, places):
    out = list(words)
    for at in places:
        out[at] = f"v{rng.randrange(10**9)}"
    return out


def brute_groups(rows, similarity=0.8, width=5):
    """Smallest id of every row's group, by all pairs of whole sets."""
    sets = [np.unique(simhash.shingle_hashes(t or "", width)) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            met = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            whole = len(sets[i]) + len(sets[j]) - met
            if whole == 0 or met / whole >= similarity:
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(rows))]


def spark_groups(spark, rows, **how):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows), **how).collect()}
    return [got[i] for i, _ in rows]


@pytest.mark.parametrize("variants", [12, 250])
def test_variants_of_one_text_are_one_group(spark, variants):
    # 0.88 like the original, 0.78 like each other: below and above the crowd limit
    rng = random.Random(4)
    words = prose(rng, 500)
    rows = [(1000, " ".join(words))]
    spots = range(5, 495, 5)
    rows += [(i, " ".join(changed(rng, words, rng.sample(spots, 6)))) for i in range(variants)]
    rows += [(2000 + i, " ".join(prose(rng, 300))) for i in range(20)]
    want = brute_groups(rows)
    assert want[:variants] == [0] * variants
    assert spark_groups(spark, rows) == want


@pytest.mark.parametrize("block,shingles", [(8, 1 << 20), (256, 900), (256, 1 << 20)])
def test_blocks_connect_what_all_pairs_connect(spark, block, shingles):
    # no hub joins these: three roots under one crowded key, and blocks smaller than it
    rng = random.Random(5)
    words = prose(rng, 200)
    texts = [" ".join(changed(rng, words, rng.sample(range(5, 195, 5), rng.randrange(1, 9)))) for _ in range(70)]
    texts += [" ".join(prose(rng, rng.randrange(3, 60))) for _ in range(5)]
    parts = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    made = [
        (77, i, i if i % 3 else 0, [77] + [1000 * k + i for k in range(1, simhash.BANDS)], len(p), simhash.least_of(p).tolist())
        for i, p in enumerate(parts)
    ]
    kinds = "_key bigint, _set bigint, _root bigint, _bands array<bigint>, _n int, _sketch array<int>"
    wholes = spark.createDataFrame([(i, p.view(np.int64).tolist()) for i, p in enumerate(parts)], "_set bigint, _whole array<bigint>")
    meetings = simhash.in_blocks(spark.createDataFrame(made, kinds), block, shingles)
    assert meetings.filter("_own <> _lo AND _own <> _hi").count() == 0
    for similarity in (0.6, 0.8):
        still = simhash.still_open(meetings, similarity)
        links = simhash.links_in_blocks(still, wholes, similarity).collect()
        like = simhash.likeness_of_sets(parts, parts)
        alone = simhash.likeness_of_sets(parts, list(parts))
        for i in range(75):
            for j in range(75):
                met = len(np.intersect1d(parts[i], parts[j]))
                assert alone[i, j] == met / (len(parts[i]) + len(parts[j]) - met)
                assert i == j or like[i, j] == alone[i, j]
        assert all(alone[r["a"], r["b"]] >= similarity for r in links)

        def groups(pairs):
            up = [r[2] for r in made]
            for a, b in pairs:
                up = [up[a] if x == up[b] else x for x in up]
            return [up.index(x) for x in up]

        want = groups([(i, j) for i in range(75) for j in range(75) if alone[i, j] >= similarity])
        assert groups([(r["a"], r["b"]) for r in links]) == want
        # a forest per meeting, of its roots
        n = meetings.groupBy("_lo", "_hi").count().count()
        assert len(links) <= n * (min(2 * block, 75) - 1)


def test_links_are_decided_on_whole_sets(spark):
    # each pair truly just above or just below 0.8, where sketches of 128 often err
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = prose(rng, 1000)
        other = changed(rng, words, rng.sample(range(5, 995, 5), 20 if i % 2 else 25))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = brute_groups(rows)
    assert want == [i - i % 2 if i // 2 % 2 else i for i in range(120)]
    assert spark_groups(spark, rows) == want
    rng = random.Random(5)
    words = prose(rng, 400)
    rows = [(i, " ".join(changed(rng, words, rng.sample(range(5, 395, 5), 5)))) for i in range(70)]
    assert spark_groups(spark, rows, crowd=4) == brute_groups(rows)


def test_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(7)
    base = [" ".join(prose(rng, 60)) for _ in range(8)]
    near = base[0] + " tail"
    rows = [
        (5, base[1]), (5, base[2]),  # one id, two groups
        (None, base[3]), (None, base[4]), (None, base[4]),  # groups without ids
        (1, base[0]), (2, near), (2, base[5]), (9, base[5]),  # 2 is a copy here and the smallest there
        (None, base[6]), (7, base[6]), (8, base[7]), (8, base[7]),
        (None, None), (3, ""),
    ]
    got = simhash.one_per_group(frame(spark, rows)).collect()
    want = [(5, base[1]), (5, base[2]), (None, base[3]), (None, base[4]), (1, base[0]), (2, base[5]), (7, base[6]), (8, base[7]), (3, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_mixed_documents_meet_targets_with_long_documents(spark):
    rng = random.Random(8)
    sizes = {"a": [9000, 7000, 5000, 40], "b": [300] * 30, "c": [20_000], None: [0, 50, 60]}
    rows = [(i, "  ".join(prose(rng, n)) + "\n", s) for i, (s, n) in enumerate((s, n) for s, x in sizes.items() for n in x)]
    rows += [(1, rows[0][1], "a"), (None, rows[0][1], "a"), (None, rows[0][1], "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    target = {r["_source"]: r["target"] for r in mixing.source_targets(mixing.sized(df)).collect()}
    given = {}
    texts = {(i, t) for i, t, _ in rows}
    cut = {}
    for r in mixing.mixed_documents(df).collect():
        given[r["source"]] = given.get(r["source"], 0) + len(r["text"].split())
        if (r["doc_id"], r["text"]) not in texts:
            cut[r["source"]] = cut.get(r["source"], 0) + 1
            assert any(i == r["doc_id"] and t.startswith(r["text"]) for i, t in texts)
    assert all(abs(given[s] - target[s]) <= 1 for s in target)
    assert all(n == 1 for n in cut.values())


def test_overlapping_kinds_are_masked_whole(spark):
    texts = {
        "10.0.0.0 4111 1111 1111 1111": "[IP][CARD]",
        "pay 4111111111111111@pay.com now": "pay [EMAIL] now",
        "10.0.0.1@example.com": "[EMAIL]",
        "plain 10.0.0.1, a@b.cd": "plain [IP], [EMAIL]",
    }
    rows = pii.sanitised(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == list(texts.values())


def test_telling_terms_far_off_and_short(spark):
    filler = " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    texts = [f"Dear Bob 李雷 of Zorblax, {filler} {i} {filler} mail ann@corp.example.com or Bob again" for i in range(3)]
    texts += [f"{filler} number {i} mail or again of dear" for i in range(40)] + ["Bob is elsewhere in another text"]
    rows = pii.sanitised(frame(spark, list(enumerate(texts))), min_letters=1).orderBy("doc_id").collect()
    for r in rows[:3]:
        assert not {"bob", "李雷", "zorblax"} & set(r["text"].lower().replace(",", " ").split())
        assert filler in r["text"] and "[EMAIL]" in r["text"]
    assert [r["text"] for r in rows[3:]] == texts[3:]


def test_the_pipeline_mixes_by_drawn_blocks(spark):
    rng = random.Random(3)
    sizes = {"a": [900, 70, 500, 40] * 5, "b": [30] * 30, "c": [2000, 1], None: [0, 50, 60]}
    rows = [(i, "  " + " \n".join(prose(rng, n)) + "\n", s) for i, (s, n) in enumerate((s, n) for s, x in sizes.items() for n in x)]
    rows += [(900, None, "a"), (901, "", "b"), (None, "no id at all", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_words(df).collect()}
    text = {i: t for i, t, _ in rows}
    given, whole, cut = {}, 0, 0
    for r in cp.mixed(spark, df, "").collect():
        given[r["doc_id"]] = given.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert r["text"] is None or r["text"] in text[r["doc_id"]]
        whole += r["text"] == text[r["doc_id"]]
        cut += r["text"] != text[r["doc_id"]]
    assert {i: n for i, n in given.items() if n} == {i: n for i, n in taken.items() if n}
    assert {900, 901} <= set(given) and whole and cut
    assert mixing.drawn_documents(df.limit(0)).count() == 0


def test_what_is_drawn_of_a_text(spark):
    df = spark.createDataFrame([(" a  b c\td e ",)], "t string")
    parts = F.array(*[F.struct(F.lit(a).alias("_from"), F.lit(n).alias("_n"), F.lit(k).alias("_times")) for a, n, k in [(0, 2, 1), (2, 1, 2), (4, 1, 1)]])
    assert df.select(mixing.drawn_texts(F.col("t"), parts)).first()[0] == [" a  b c", "e ", "c"]
