"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

Both tokenizers cut the same bytes; a group reaches from one place where a token of A
and a token of B both end to the next. The token ends of a batch of documents form two
sorted lists, whose merging is a path through a grid. Diagonals of the grid at equal
distances cut the path: a binary search on each finds where the path crosses it, so the
pieces between are independent and hold the same number of steps whatever the lengths
of the documents. All pieces are merged side by side and emit the overlaps (A token, B
token) they pass; where consecutive overlaps differ in both tokens a group ends, and
comparing the last overlap of a piece with the first of the next one stitches groups
that cross pieces.

A pair of ids is linked in a document once for every two occurrences in one group. How
many documents hold a pair is counted over the corpus and brought back to the documents:
the pairs of most documents, at most ``MANY`` of them, by a broadcast table, so that no
row of theirs moves; each of the others has at most 2 / MANY of all rows, so the join
that shuffles them has no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.shipping import ship_code
from signpost.llm.slices import lists_of, slices
from signpost.llm.transducer import Merges
from signpost.llm.worker import held
from signpost.session import materialize

# Fixed value: what a byte-level vocabulary cuts texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORK = 256  # steps of one piece
SLICE_BYTES = 1 << 20
MANY = 100_000  # pairs whose counts are broadcast
WIDE_GROUP = 1 << 16  # links of a group from which equal ids are put together first


class Coder:
    """A tokenizer as a function from texts to ids, with the bytes of its tokens."""

    def __init__(self, encode, tokens: list[bytes]) -> None:
        self.encode = encode
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens one behind another."""
        lengths = self.lengths[ids]
        total = np.cumsum(lengths)
        n = int(total[-1]) if len(total) else 0
        return self.bytes[np.repeat(self.offsets[ids] - (total - lengths), lengths) + np.arange(n)]


def byte_level(model: bytes) -> Coder:
    """A byte-level BPE file (JSON); a blank is put before every text, special tokens are plain text.

    The file's merges are applied by a rank merger: the same result if tokens are numbered in the order
    of their merges and every token's own bytes merge to it. Both are checked.
    """
    merges = Merges(model)
    own = {i: token for i, token in merges.tokens.items() if i not in merges.special.values()}
    if merges.made != sorted(merges.made) or any(merges.merge(token) != [i] for i, token in own.items()):
        raise ValueError("tokens must be numbered in the order of their merges and merge to themselves")
    ranks = {token: i for i, token in own.items()}
    coder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [own.get(i, b"") for i in range(merges.width)]
    return Coder(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], tokens)


def byte_piece(pieces, i: int) -> bytes:
    """The bytes of a piece: the sign for a blank as a blank, <0xHH> as the byte."""
    piece = pieces.id_to_piece(i)
    return bytes([int(piece[3:-1], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()


def sentence_pieces(model: bytes) -> Coder:
    """A sentence-piece file, which puts a blank before every text itself."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    tokens = [byte_piece(pieces, i) for i in range(pieces.vocab_size())]
    return Coder(partial(pieces.encode, num_threads=1), tokens)


def split_points(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted lists crosses every ``work``-th diagonal, both ends included.

    A binary search on each diagonal, on all at once; of equal values that of ``a`` comes first.
    """
    diagonal = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    lo, hi = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.flatnonzero(open_)
        first = a[mid[at]] <= b[diagonal[at] - 1 - mid[at]]
        lo[at] = np.where(first, mid[at] + 1, lo[at])
        hi[at] = np.where(first, hi[at], mid[at])
    return lo, diagonal - lo


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens that share a byte, in order; ``a``, ``b``: the tokens' ends, the last ones equal."""
    i, j = split_points(a, b, work)
    stop = i[1:] + j[1:]
    i, j = i[:-1].copy(), j[:-1].copy()
    # one row per step and one column per piece
    seen = np.zeros((2, work, len(i)), np.int64)
    real = np.zeros((work, len(i)), bool)
    starts_a, starts_b = np.append(0, a), np.append(0, b)
    ends_a, ends_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    for step in range(work):
        x, y = ends_a[i], ends_b[j]
        seen[0, step], seen[1, step] = i, j
        live = i + j < stop
        real[step] = live & (np.maximum(starts_a[i], starts_b[j]) < np.minimum(x, y)) & (i < len(a)) & (j < len(b))
        go = x <= y
        i += live & go
        j += live & ~go
    kept = real.T
    return seen[0].T[kept], seen[1].T[kept]


def groups_of(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group."""
    at_a, at_b = overlaps(a, b, work)
    # a group goes on while one of the two tokens does, also from piece to piece
    fresh = np.append(True, (np.diff(at_a) != 0) & (np.diff(at_b) != 0)) if len(at_a) else np.empty(0, bool)
    first = np.flatnonzero(fresh)
    return (np.diff(np.append(at_a[first], len(a))), np.diff(np.append(at_b[first], len(b))))


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each size, one behind another."""
    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    return np.repeat(first - (total - sizes), sizes) + np.arange(n)


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted ``keys`` and where each begins."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[new], new


def linked_pairs(
    a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, doc: np.ndarray, ids: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document its distinct linked pairs (A id in the upper, B id in the lower 32 bits) and how often.

    ``a``, ``b``: ids; ``in_a``, ``in_b``: tokens of each group; ``doc``: document of each
    group; ``ids``: how many ids A and B have.
    """
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    wide = in_a * in_b > WIDE_GROUP
    some = np.flatnonzero(~wide)
    # each A token of a group once for every B token of it
    left = ranges(first_a[some], in_a[some])
    group = np.repeat(some, in_a[some])
    times = in_b[group]
    head = (doc[group] * ids[0] + a[left]) * ids[1]
    keys = np.repeat(head, times) + b[ranges(first_b[group], times)]
    keys.sort()
    total = len(keys)
    keys, new = run_lengths(keys)
    counts = np.diff(np.append(new, total))
    if wide.any():
        more, often = [keys], [counts]
        for g in np.flatnonzero(wide).tolist():
            x, n = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            more.append((((doc[g] * ids[0] + x) * ids[1])[:, None] + y[None, :]).ravel())
            often.append((n[:, None] * m[None, :]).ravel())
        keys, counts = np.concatenate(more), np.concatenate(often)
        order = np.argsort(keys)
        keys, new = run_lengths(keys[order])
        counts = np.add.reduceat(counts[order], new)
    upper, lower = np.divmod(keys, ids[1])
    docs, upper = np.divmod(upper, ids[0])
    return docs, upper << 32 | lower, counts


def written(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as ASCII, ``a1,a2|b1;``, and the length of each; behind the ``last`` group of a document no ``;``."""
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    # tokens in the order of the text: of every group those of A, then those of B
    n = len(a) + len(b)
    place_a = np.arange(len(a)) + np.repeat(first_b, in_a)
    place_b = np.arange(len(b)) + np.repeat(first_a + in_a, in_b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[first_a + in_a - 1]] = ord("|")
    mark[place_b[first_b + in_b - 1]] = ord(";")
    digits = np.ones(n, np.int64)
    for k in range(1, len(str(int(ids.max(initial=0))))):
        digits += ids >= 10**k
    size = digits + 1
    closing = place_b[(first_b + in_b - 1)[last]]
    size[closing] -= 1
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if n else 0, np.uint8)
    with_mark = np.ones(n, bool)
    with_mark[closing] = False
    out[end[with_mark] - 1] = mark[with_mark]
    at, left = end - size + digits - 1, ids.copy()
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[at[has] - k] = 48 + left[has] % 10
        left //= 10
    return out, np.add.reduceat(size, np.cumsum(in_a + in_b) - in_a - in_b) if len(in_a) else np.empty(0, np.int64)


class Aligner:
    """Two coders and the alignment of their tokens over many texts."""

    def __init__(self, model_a: bytes, model_b: bytes) -> None:
        self.a, self.b = byte_level(model_a), sentence_pieces(model_b)

    def align(self, texts: list[str]) -> dict[str, pa.Array]:
        """The columns of ``aligned`` but the id, a row per text."""
        n = len(texts)
        want = [(" " + t).encode() if t else b"" for t in texts]
        sizes = np.array([len(w) for w in want], np.int64)
        coded = []
        good = sizes > 0
        for coder in (self.a, self.b):
            lists = coder.encode(texts)
            counts = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
            total = np.concatenate([[0], np.cumsum(coder.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            good &= np.diff(total) == sizes
            coded.append((ids, counts))
        for coder, (ids, counts) in zip((self.a, self.b), coded, strict=True):
            got = coder.joined(ids[np.repeat(good, counts)]).tobytes()
            kept = np.flatnonzero(good)
            ends = np.cumsum(sizes[kept]).tolist()
            for row, end in zip(kept.tolist(), ends, strict=True):
                good[row] = got[end - len(want[row]) : end] == want[row]
            good[sizes == 0] = False
        (a, n_a), (b, n_b) = [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in coded]
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        in_a, in_b = groups_of(ends_a, ends_b)
        # a document begins and ends with a group
        closing = np.searchsorted(np.cumsum(in_a), np.cumsum(n_a)[good])
        n_groups = np.zeros(n, np.int64)
        n_groups[good] = np.diff(np.append(-1, closing))
        doc = np.repeat(np.arange(n), n_groups)
        docs, pairs, times = linked_pairs(a, b, in_a, in_b, doc, (len(self.a.lengths), len(self.b.lengths)))
        text, lengths = written(a, b, in_a, in_b, closing)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, doc, in_a * in_b)
        per_text = np.zeros(n, np.int64)
        np.add.at(per_text, doc, lengths)
        offsets = np.append(0, np.cumsum(per_text)).astype(np.int32)
        rows = np.bincount(docs, minlength=n)
        return {
            "n_a": pa.array(n_a),
            "n_b": pa.array(n_b),
            "n_groups": pa.array(n_groups),
            "n_links": pa.array(n_links),
            "groups": pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text)),
            "pairs": lists_of(pa.array(pairs), rows),
            "times": lists_of(pa.array(times), rows),
        }


def aligner(model_a: bytes, model_b: bytes) -> Aligner:
    key = hashlib.sha256(model_a).hexdigest() + hashlib.sha256(model_b).hexdigest()
    return held("aligner" + key, lambda: Aligner(model_a, model_b))


def aligned(
    df: DataFrame, model_a: bytes, model_b: bytes, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` has the ids of each group in order, ``a1,a2|b1;a3|b2``; ``pairs`` the distinct
    linked pairs (A id in the upper 32 bits) and ``times`` how often each is linked. Null
    and empty texts, and texts whose tokens don't give back a blank and the text, have no
    tokens: zeros, an empty string, empty arrays. Every row stands for itself; an empty
    table gives an empty one; other columns are not looked at. One pass over the scan, no
    shuffle; the models (a few MB) are broadcast. In a group of many tokens equal ids are put
    together before they are paired.
    """
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model_a, model_b))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                columns = {id_col: part.column(0)} | own.align([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
        "pairs array<bigint>, times array<bigint>",
    )


def id_a(pair: Column) -> Column:
    return F.shiftright(pair, 32)


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair``, ``docs`` (rows that hold it), ``best`` (no pair of its A id has more): a row per distinct pair.

    ``links``: ``_row``, ``pair``, one row for each. Counts fold in the tasks before they move; the
    best count per A id is a row per id of the vocabulary.
    """
    counts = materialize(links.groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    tops = counts.groupBy(id_a(F.col("pair")).alias("_a")).agg(F.max("docs").alias("_top"))
    best = counts.withColumn("_a", id_a(F.col("pair"))).join(tops, "_a")
    return materialize(best.select("pair", "docs", (F.col("docs") == F.col("_top")).alias("best")))


def with_counts(pairs: DataFrame, many: int = MANY) -> DataFrame:
    """``pairs`` (``pairs``, ``times`` and other columns) with n_best and count_sum in their place.

    ``count_sum`` adds over a row's links the number of rows that hold the link's pair,
    ``n_best`` counts the links whose pair no other of the same A id outnumbers. The
    table is written once. ``many`` bounds the broadcast table, never the result.
    """
    table = materialize(pairs.withColumn("_row", F.monotonically_increasing_id()))
    zipped = F.explode(F.arrays_zip("pairs", "times")).alias("x")
    links = table.select("_row", zipped).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = pair_counts(links)
    # the least power of two from which at most ``many`` pairs remain: at most 64 rows on the driver
    power = F.floor(F.log2("docs"))
    sizes = counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("p")).collect()
    cut, held_pairs = None, 0
    for row in sizes:
        held_pairs += row["n"]
        if held_pairs > many:
            break
        cut = row["p"]
    often = F.lit(False) if cut is None else power >= cut
    sums = [F.sum(F.col("n") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")]
    met = links.join(F.broadcast(counts.filter(often)), "pair", "left")
    near = met.filter(F.col("docs").isNotNull()).groupBy("_row").agg(*sums)
    rest = met.filter(F.col("docs").isNull()).select("_row", "pair", "n")
    far = rest.join(counts.filter(~often).hint("shuffle_merge"), "pair").groupBy("_row").agg(*sums)
    both = near.union(far).groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("bigint")
    return (
        table.drop("pairs", "times")
        .join(both, "_row", "left")
        .drop("_row")
        .withColumn("count_sum", F.coalesce("count_sum", zero))
        .withColumn("n_best", F.coalesce("n_best", zero))
    )
