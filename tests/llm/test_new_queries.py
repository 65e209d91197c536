"""op11 to op13 against the libraries and brute force, on whole small tables and odd rows."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from signpost.llm import alignment, periodic, transducer
from signpost.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES, looped

ODD = [
    None, "", " ", "a", "a" * 5000, "don't we'll 'r 're", "  two  blanks \n\n", "<|endoftext|>x<|end",
    "日本語 naïve ΑΒΓ 😀", "▁ <0x41> <s>", "a b " * 200, "\u0000​\t", "-" * 900 + " " * 700 + "7" * 600,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, a repeated and a null id, columns with the operators' own names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a b a b a b a b"), (5, "other")]
    names = ["ids", "n_tokens", "decoded", "runs", "groups", "pairs", "times", "_id", "_text", "_row", "count_sum"]
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], f"doc_id bigint, text string, {', '.join(n + ' string' for n in names)}")
    return df, rows


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_row(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


# ---- 12 -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def merges():
    return transducer.Merges(transducer.read_model(BYTE_BPE))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_tokens_do_not_depend_on_the_parts(merges, library):
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "'", "'s", "'r", "e", "l", "\n", "1", "!", "é", "日", "<|endoftext|>", "<|end", "|>",
            " ", " guaranteeing", "x" * 700, "-" * 900, " " * 800, "ab" * 3000]
    encoder = transducer.Encoder(merges)
    for _ in range(300):
        text, out, at = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))), [], 0
        while at < len(text):
            n = rng.choice([1, 2, 3, 7, 300, 5000])
            out += encoder.feed(text[at : at + n])
            at += n
        assert out + encoder.close() == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_cut_as_in_the_library(merges, library):
    encoder = transducer.Encoder(merges)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 2000):
        text = "a".join(points[lo : lo + 2000])
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_the_lookahead_suffices(merges):
    """Whatever follows, tokens that end before the lookahead stay."""
    rng, words = random.Random(2), [merges.tokens[i] for i in range(256, 20000, 7)]
    for _ in range(200):
        data = b"".join(rng.choice(words) for _ in range(120)).replace(b" ", b"")
        more = b"".join(rng.choice(words) for _ in range(5)).replace(b" ", b"")
        ends = [np.cumsum([len(merges.tokens[t]) for t in merges.merge(d)]) for d in (data, data + more)]
        known = len(data) - merges.lookahead
        assert [e for e in ends[0] if e <= known] == [e for e in ends[1] if e <= known]


def test_state_stays_bounded(merges):
    encoder = transducer.Encoder(merges)
    for _ in range(200):
        encoder.feed("ab" * 1000)
        assert len(encoder.merger.rest) < transducer.MERGE_BYTES + merges.lookahead and len(encoder.tail) <= transducer.LONG
    encoder.close()


def test_lookahead_of_a_small_list():
    spec = {
        "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False},
        "model": {"vocab": {c: i for i, c in enumerate(transducer.byte_letters())} | {"ab": 256, "cd": 257, "bc": 258, "abcd": 259},
                  "merges": [["a", "b"], ["c", "d"], ["b", "c"], ["ab", "cd"]]},
    }
    small = transducer.Merges(json.dumps(spec).encode())
    # a d takes the c from (b, c), so b is in doubt, and (ab, cd) needs the chain ab + c
    assert small.lookahead == 3
    assert [small.tokens[t] for t in small.merge(b"abcdbcd")] == [b"abcd", b"b", b"cd"]
    spec["model"]["merges"] = [["ab", "cd"], ["a", "b"], ["c", "d"]]
    with pytest.raises(ValueError):
        transducer.Merges(json.dumps(spec).encode())


def test_broken_sequences_decode_as_in_the_library(merges, library):
    rng, decoder = random.Random(3), transducer.Decoder(merges)
    for _ in range(500):
        ids = [rng.randrange(256) if rng.random() < 0.7 else rng.randrange(50257) for _ in range(20)]
        at = rng.randrange(20)
        got = decoder.feed(ids[:at]) + decoder.feed(ids[at:]) + decoder.close()
        assert got == library.decode(ids, skip_special_tokens=False)


def _op12(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_op12_on_a_whole_table(spark, sf, library):
    got = QUERIES["op12_transducer"](spark, sf).collect()
    want = [(r.doc_id, *_op12(library, r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_encode_and_decode_odd_rows(spark, odd, library):
    df, rows = odd
    model = transducer.read_model(BYTE_BPE)
    coded = transducer.encode(df, model, with_decoded=True)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in coded.collect()), key=repr) == want
    back = transducer.decode(coded.drop("decoded"), model).collect()
    assert by_row(back, "doc_id", "decoded") == sorted(((i, t or "") for i, t in rows), key=repr)
    assert transducer.encode(df.limit(0), model).count() == 0


# ---- 13 -----------------------------------------------------------------------------


def brute_runs(w, min_length=6, min_exponent=4):
    """Runs by trying every period."""
    out, n = [], len(w)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q))
            if length >= max(min_length, min_exponent * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out)


def test_runs_against_every_period():
    rng = random.Random(5)
    for _ in range(2500):
        n, letters = rng.randrange(0, 70), rng.choice([1, 2, 3, 5])
        w = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.6 and n > 8:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, times in ((6, 4), (2, 2), (4, 3)):
            assert [tuple(x) for x in periodic.word_runs(w, least, times).tolist()] == brute_runs(w, least, times)


def test_runs_without_the_cut_into_stretches():
    rng = random.Random(6)
    for _ in range(300):
        w = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 60))] * rng.randrange(1, 6))
        assert [tuple(x) for x in periodic.runs_of(w, 2, 2).tolist()] == brute_runs(w.tolist(), 2, 2)


def test_stretches_end_in_a_bounded_number_of_rounds(monkeypatch):
    monkeypatch.setattr(periodic, "ROUNDS", 1)
    rng = random.Random(7)
    for _ in range(200):
        w = [b"%d" % rng.randrange(4) for _ in range(60)]
        assert [tuple(x) for x in periodic.word_runs(w, 2, 2).tolist()] == brute_runs(w, 2, 2)


def test_common_prefixes_of_all_suffixes():
    rng = random.Random(8)
    for n in (1, 2, 40, 400):
        w = [1 + rng.randrange(2) for _ in range(n)]
        tour = periodic.Tour(w)
        a, b = np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]).T
        for i, j, got in zip(a.tolist(), b.tolist(), tour.common(a, b).tolist()):
            k = 0
            while max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            assert got == k
            if n == 400 and i > 20:
                break


def brute_collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def _op13(doc, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    w = [x.decode() for x in w]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(w, runs)))


def test_op13_on_a_table(spark, tmp_path, sf):
    """Whole texts up to 1,500 words, by every period; odd rows with ids that turn some of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text.split()) <= 1500]
    turned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = short + [(turned[k], t) for k, t in enumerate(ODD)] + [(None, "a a a a a a"), (turned[0], None), (turned[3], "x y z " * 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_runs"](spark, str(tmp_path)).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert by_row(got, *names) == sorted((_op13(*r) for r in rows), key=repr)
    assert sum(r.n_runs for r in got) > 20


def test_runs_of_odd_rows(spark, odd):
    df, rows = odd
    got = periodic.periodic_runs(df).collect()
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = brute_runs(w)
        want.append((i, len(w), runs, brute_collapsed(w, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert looped(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, min_exponent=1)


# ---- 11 -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PIECE_BPE)
    letters = transducer.byte_letters()
    bytes_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), bytes_a.__getitem__, b.encode, bytes_b


def brute_groups(coders, text):
    """Groups as (A ids, B ids) by the set of common ends."""
    encode_a, bytes_a, encode_b, bytes_b = coders
    if not text:
        return []
    sides, whole = [], (" " + text).encode()
    for ids, of in ((encode_a(text), bytes_a), (encode_b(text), bytes_b)):
        if b"".join(map(of, ids)) != whole:
            return []
        sides.append(list(zip(ids, np.cumsum([len(of(i)) for i in ids]).tolist())))
    cuts = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
    out, before = [], 0
    for cut in cuts:
        out.append(tuple([i for i, e in side if before < e <= cut] for side in sides))
        before = cut
    return out


def brute_alignment(coders, rows):
    docs = [(i, brute_groups(coders, t)) for i, t in rows]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in docs]
    held, top = Counter(p for pairs in linked for p in pairs), defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (i, groups), pairs in zip(docs, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in pairs.items()),
            sha(text) if text else "",
        ))
    return sorted(out, key=repr)


OP11 = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op11_on_a_whole_table(spark, sf, coders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert by_row(QUERIES["op11_alignment"](spark, sf).collect(), *OP11) == brute_alignment(coders, rows)


@pytest.mark.parametrize("many", [0, 3, 40, 100_000])
def test_counts_are_the_same_on_both_ways(spark, odd, coders, many):
    """All pairs by shuffle, some, all by broadcast."""
    df, rows = odd
    models = transducer.read_model(BYTE_BPE), transducer.read_model(PIECE_BPE)
    groups = alignment.aligned(df, *models)
    got = alignment.with_counts(groups, many)
    rows_got = [{**r.asDict(), "groups_sha256": sha(r.groups) if r.groups else ""} for r in got.collect()]
    assert by_row(rows_got, *OP11) == brute_alignment(coders, rows)


def test_wide_groups_give_the_same_pairs(monkeypatch, coders):
    own = alignment.Aligner(transducer.read_model(BYTE_BPE), transducer.read_model(PIECE_BPE))
    texts = [t or "" for t in ODD]
    plain = own.align(texts)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    assert {k: v.to_pylist() for k, v in own.align(texts).items()} == {k: v.to_pylist() for k, v in plain.items()}


@pytest.mark.parametrize("work", [1, 2, 7, 256])
def test_pieces_of_any_size_give_the_same_groups(work):
    rng = random.Random(work)
    for _ in range(200):
        n = rng.randrange(1, 60)
        a, b = [np.array(sorted(set(rng.choices(range(1, n + 1), k=rng.randrange(1, n + 1))) | {n})) for _ in range(2)]
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        want = [[sum(lo < e <= hi for e in x.tolist()) for lo, hi in zip([0, *cuts], cuts)] for x in (a, b)]
        assert [x.tolist() for x in alignment.groups_of(a, b, work)] == want
        i, j = alignment.split_points(a, b, work)
        assert set((np.diff(i) + np.diff(j)).tolist()[:-1]) <= {work}


def test_empty_table(spark, odd):
    models = transducer.read_model(BYTE_BPE), transducer.read_model(PIECE_BPE)
    assert alignment.with_counts(alignment.aligned(odd[0].limit(0), *models)).count() == 0


def test_the_model_files_are_where_the_package_says():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
