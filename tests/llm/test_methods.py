"""The methods inside the tasks, against plain versions; no session needed."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard

from signpost.llm import bpe, simhash
from signpost.llm import suffix_dedup as sd
from tests.llm import brute


def test_ids_are_tiktokens():
    own = bpe.Tokenizer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "'", "'s", "'re", "'ll", "d", "É", "日", "1", "²", "!", "\n", "\t", " ", "\x1c", "\x85", "😀", "\0", "!'"]
    texts = ["", " ", "a" * 5000, "=" * 300 + " '" * 50]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_close_fingerprints_share_a_key():
    rng = random.Random(2)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        one, two = simhash.keys_of(np.array([a, b], np.uint64))
        assert len(one) <= 18 and set(one.tolist()) & set(two.tolist())


def removed(docs, crowd):
    items = list(docs.items())
    kinds = {"id": pa.int64(), "tie": pa.int64(), "t": pa.binary()}
    batches = [
        pa.RecordBatch.from_pylist([{"id": i, "tie": 0, "t": t} for i, t in items[k : k + 12]], pa.schema(kinds))
        for k in range(0, len(items), 12)
    ]
    found = {}
    for batch in sd.repeated_grams(iter(list(sd.gram_runs(iter(batches))))):
        for row in batch.to_pylist():
            found.setdefault(row["id"], []).append(row["body"])
    pack = zstandard.ZstdCompressor().compress
    rows = [{"id": i, "tie": 0, "z": pack(t), "bodies": found[i]} for i, t in items if i in found]
    joined = [pa.RecordBatch.from_pylist(rows[k : k + 12]) for k in range(0, len(rows), 12)]
    out = [r for b in sd.repeats(sd.suffix_runs(iter(joined)), crowd) for r in b.to_pylist()]
    first = {}
    for r in out:
        if r["g"] is not None:
            key, at = (r["g"], r["w"]), (r["id"], r["s"])
            first[key] = min(first.get(key, at), at)
    gone = {i: [False] * len(t) for i, t in items}
    for r in out:
        if r["g"] is None or (r["id"], r["s"]) > first[(r["g"], r["w"])]:
            gone[r["id"]][r["s"] : r["e"]] = [True] * (r["e"] - r["s"])
    return gone


def test_removed_bytes_are_those_of_brute_force():
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()

    for _ in range(4):
        shared = [text(rng.randint(90, 400)) for _ in range(4)]
        docs = {
            3 * i: b"".join(rng.choice([text(rng.randint(0, 150)), rng.choice(shared)[rng.randint(0, 60) :]]) for _ in range(5))
            for i in range(30)
        }
        docs |= {200: b"=" * 500, 201: b"ab" * 300, 202: docs[3], 203: b"", 204: b"=" * 120}
        for crowd in (20_000, 2):
            assert removed(docs, crowd) == brute.unique_bytes(docs)
