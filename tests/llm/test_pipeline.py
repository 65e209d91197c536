"""The stages toxicity and tokens, and the pipeline as a whole."""

import base64
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from signpost.session import shared_folder
from signpost.sources import files
from tests.llm import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose of three sources with copies, near copies, insults, personal data, nulls and clashing columns."""
    rng = random.Random(21)
    letters = "abcdefghilmnorstu"

    def prose(n):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)]

    rows, labels = [], []
    for i in range(360):
        words = prose(rng.randrange(40, 120))
        if i % 3 == 0:
            words[rng.randrange(40)] = words[rng.randrange(40)] = "awfulword"
        labels.append((i, int(i % 3 == 0)))
        rows.append((i, " ".join(words), f"s{i % 2}"))
    clean = [r for r in rows if r[0] % 3]
    rows += [(1000 + k, clean[k][1], "s0") for k in range(20)]  # copies
    rows += [(2000 + k, clean[k][1] + " tail", "s1") for k in range(20, 40)]  # near copies
    rows += [(3000, "write to ann@corp.example.com or 10.0.0.1 " + " ".join(prose(30)), "s0")]
    rows += [(4000, None, "s0"), (4001, "", "s1"), (None, " ".join(prose(50)), "s1"), (4002, " ".join(prose(50)), None)]
    kinds = "doc_id bigint, text string, source string, score string, doc string, __toxicity string, ids string, _set string"
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_toxic_documents_go_and_all_columns_stay(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.without_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all((r["score"], r["doc"], r["__toxicity"]) == ("a", "b", "c") for r in got)
    texts = {r["text"] for r in got}
    clean = [t for _, t, _ in rows if "awfulword" not in (t or "")]
    assert sum("awfulword" in (t or "") for t in texts) <= 2
    assert len([t for t in clean if t not in texts]) <= 2
    assert None in texts and "" in texts
    assert cp.without_toxic(spark, docs.limit(0), folder).count() == 0


def test_tokens_of_a_stage(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in cp.tokenised(spark, docs, folder).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), brute.sha(t or "")))
    assert got == sorted(want, key=repr)


def test_the_pipeline_as_a_whole(spark, corpus):
    folder, rows = corpus
    shared = f"{shared_folder(spark)}/signpost"
    before = set(files.names(spark, shared))
    out = cp.run(spark, folder)
    left = set(files.names(spark, shared)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-")  # the stages' own tables are gone
    stages = {name: spark.read.parquet(f"{shared}/{next(iter(left))}/{name}") for name, _ in cp.STAGES}
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "tokens"]
    names = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert all(stages[s].columns == names for s in list(stages)[:-1])
    one = [r["text"] for r in stages["near_duplicates"].collect()]
    assert len(one) == len(set(one))
    ids = {r["doc_id"] for r in stages["near_duplicates"].select("doc_id").collect()}
    kept = {r["doc_id"] for r in stages["toxicity"].select("doc_id").collect()}
    clean = [r[0] for r in rows[:360] if r[0] % 3]
    for k in range(20):
        assert 1000 + k not in ids or clean[k] not in kept
    for k in range(20, 40):
        assert 2000 + k not in ids or clean[k] not in kept
    masked = stages["personal_data"].filter("doc_id = 3000").first()["text"]
    assert masked.startswith("write to [EMAIL] or [IP]")
    assert stages["personal_data"].count() == len(one)
    assert out.count() == stages["mixing"].count() == stages["tokens"].count()
    words = stages["mixing"].select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert words > 0 and out.filter("decoded_sha256 IS NULL").count() == 0
