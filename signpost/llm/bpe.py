r"""Byte-level BPE encoding and decoding.

The texts of a slice are laid out as one array of code points and cut into pieces
without a regular expression. Every code point has a class; a class is a function on
the cutter's few states; functions compose associatively and generate a small closed
set, so the state before every code point comes from a blocked prefix scan over
their numbers. Pieces are made distinct, only those not met before are merged by
rank, and the ids of a text are gathered from the cache. The bytes of all tokens lie
in one array with their offsets, so decoding is one gather.

The pieces are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.shipping import ship_code
from signpost.llm.worker import held

# Code point classes; the last three stand for an apostrophe before one of SUFFIXES
# (one letter, two letters) and for the end of a text.
LETTER, NUMBER, OTHER, BLANK, SPACE, TICK_ONE, TICK_TWO, END = range(8)
# White space of \s outside the Unicode categories Z*.
CONTROL_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
# What makes a piece of its own behind an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

# States of the cutter: in a run of letters, numbers or others; behind a blank or
# other white space; one or two letters before a suffix ends; at the start of a piece.
IN_LETTER, IN_NUMBER, IN_OTHER, AT_BLANK, AT_SPACE, ONE_LEFT, TWO_LEFT, FRESH = range(8)

LANE = 256
SLICE_CHARS = 1 << 20
CACHE_PIECES = 120_000
NEVER = 1 << 40


def class_table() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LNZ":
            out[cp] = {"L": LETTER, "N": NUMBER, "Z": SPACE}[kind]
    out[list(CONTROL_SPACE)] = SPACE
    out[0x20] = BLANK
    return out


def step(kind: int, state: int) -> int:
    """The state behind a code point of this class."""
    if state == TWO_LEFT and kind != END:
        return ONE_LEFT
    if state == ONE_LEFT or kind == END:
        return FRESH
    if kind in (TICK_ONE, TICK_TWO):
        if state in (IN_OTHER, AT_BLANK):
            return IN_OTHER  # part of a run of others, or of one that a blank opens
        return ONE_LEFT if kind == TICK_ONE else TWO_LEFT
    return (IN_LETTER, IN_NUMBER, IN_OTHER, AT_BLANK, AT_SPACE)[kind]


def closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that strings of classes are: number per class, compositions, values."""
    found = [tuple(step(k, s) for s in range(8)) for k in range(8)]
    first = list(found)
    numbers = {f: i for i, f in enumerate(dict.fromkeys(found))}
    queue = list(numbers)
    for f in queue:
        for g in first:
            h = tuple(g[x] for x in f)
            if h not in numbers:
                numbers[h] = len(numbers)
                queue.append(h)
    compose = np.array(
        [[numbers[tuple(g[x] for x in f)] for g in queue] for f in queue], dtype=np.uint16
    )
    return np.array([numbers[f] for f in first], dtype=np.uint16), compose, np.array(queue, dtype=np.uint8)


class Cutter:
    """Finds where pieces begin in the code points of many texts."""

    def __init__(self) -> None:
        self.classes = class_table()
        self.number, compose, self.values = closure()
        self.width = len(compose)
        self.compose = compose.ravel()

    def kinds(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kinds = self.classes[cps]
        kinds[ends] = END
        ticks = np.flatnonzero(cps == 0x27)
        if len(ticks):
            padded = np.concatenate([cps, np.zeros(2, cps.dtype)])
            for suffix in SUFFIXES:
                hit = padded[ticks + 1] == ord(suffix[0])
                if len(suffix) == 2:
                    hit &= padded[ticks + 2] == ord(suffix[1])
                kinds[ticks[hit]] = TICK_ONE if len(suffix) == 1 else TICK_TWO
        return kinds

    def states(self, kinds: np.ndarray) -> np.ndarray:
        """The state before every code point: a scan in lanes, then over the lanes' totals."""
        n = len(kinds)
        lanes = -(-n // LANE)
        padded = np.full(lanes * LANE, END, np.uint8)
        padded[:n] = kinds
        scan = np.ascontiguousarray(self.number[padded].reshape(lanes, LANE).T)
        wide = np.empty(lanes, np.int32)
        for j in range(1, LANE):
            np.multiply(scan[j - 1], self.width, out=wide, dtype=np.int32)
            wide += scan[j]
            np.take(self.compose, wide, out=scan[j])
        entry, state, values = np.empty(lanes, np.uint8), FRESH, self.values.tolist()
        for k, total in enumerate(scan[-1].tolist()):
            entry[k] = state
            state = values[total][state]
        after = self.values.ravel()[scan.astype(np.int32) * 8 + entry].T.reshape(-1)
        before = np.empty(n, np.uint8)
        before[0] = FRESH
        before[1:] = after[: n - 1]
        return before

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Where pieces begin; the END behind each text begins one of its own."""
        before = self.states(kinds)
        white = (kinds == BLANK) | (kinds == SPACE)
        behind_white = (before == AT_BLANK) | (before == AT_SPACE)
        solid_next = np.zeros(len(kinds), bool)
        solid_next[:-1] = ~white[1:] & (kinds[1:] != END)
        run = np.where(kinds >= TICK_ONE, np.uint8(IN_OTHER), kinds)
        fresh = (before == FRESH) | (before == AT_SPACE) | ((before <= IN_OTHER) & (before != run))
        return np.where(white, ~behind_white | solid_next, fresh) | (kinds == END)


class Tokenizer:
    """A vocabulary of ranked byte strings with its cache of merged pieces."""

    def __init__(self, rank_file: bytes) -> None:
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.cutter = Cutter()
        self.cache: dict[bytes, tuple[int, ...]] = {}
        # every way to put a token together from two, by (left id, right id)
        joins = [
            (left << 32 | right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None
            and (right := self.ranks.get(token[i:])) is not None
        ]
        table = np.array(sorted(joins), dtype=np.int64).reshape(-1, 2)
        self.join_keys, self.join_ranks = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids put together, NEVER if it is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.join_ranks[at], NEVER)

    def merge_many(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """``merge`` for pieces of 2 to ``width`` bytes at once: a row per piece, one join per row and turn."""
        rows = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, rows)
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        ids = self.byte_ids[grid]
        column = np.arange(width)
        pair = np.full((rows, width), NEVER, np.int64)
        pair[:, :-1] = self.joined(ids[:, :-1], ids[:, 1:])
        pair[column[None, :] >= length[:, None] - 1] = NEVER
        open_rows = np.arange(rows)
        while len(open_rows):
            best = pair[open_rows].argmin(axis=1)
            rank = pair[open_rows, best]
            live = rank < NEVER
            open_rows, best, rank = open_rows[live], best[live], rank[live]
            if not len(open_rows):
                break
            # close the gap behind the joined pair
            source = np.minimum(column[None, :] + (column[None, :] > best[:, None]), width - 1)
            ids[open_rows] = np.take_along_axis(ids[open_rows], source, 1)
            pair[open_rows] = np.take_along_axis(pair[open_rows], source, 1)
            length[open_rows] -= 1
            ids[open_rows, best] = rank
            last = best >= length[open_rows] - 1
            after = self.joined(rank, ids[open_rows, np.minimum(best + 1, width - 1)])
            pair[open_rows, best] = np.where(last, NEVER, after)
            some = best > 0
            r, b = open_rows[some], best[some]
            pair[r, b - 1] = self.joined(ids[r, b - 1], rank[some])
            pair[open_rows, np.maximum(length[open_rows] - 1, 0)] = NEVER
        return [tuple(row[:n]) for row, n in zip(ids.tolist(), length.tolist(), strict=True)]

    def learn(self, pieces: list[bytes]) -> None:
        """Put new pieces into the cache: short ones together, by width."""
        by_width: dict[int, list[bytes]] = {8: [], 16: [], 32: []}
        for piece in pieces:
            n = len(piece)
            whole = self.ranks.get(piece)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif n > 32:
                self.cache[piece] = self.merge(piece)
            else:
                by_width[8 if n <= 8 else 16 if n <= 16 else 32].append(piece)
        for width, some in by_width.items():
            if some:
                self.cache.update(zip(some, self.merge_many(some, width), strict=True))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the neighbours of lowest rank are joined, leftmost first, till none joins."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        if n > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        none = 1 << 60
        pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(n - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap of neighbours over linked places, for pieces of any length."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n

        def rank(i: int) -> int | None:
            j = right[i]
            return ranks.get(piece[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or right[i] >= n or end[right[i]] != stop:
                continue
            j = right[i]
            alive[j] = False
            end[i], right[i] = end[j], right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[right[k]]))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (uint32); nothing longer than a slice is laid out at once."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        todo: list[tuple[int, str]] = []
        chars = 0
        for i, text in enumerate(texts):
            for segment in segments(text):
                todo.append((i, segment))
                chars += len(segment)
                if chars >= SLICE_CHARS:
                    self._encode_slice(todo, parts)
                    todo, chars = [], 0
        self._encode_slice(todo, parts)
        empty = np.empty(0, np.uint32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in parts]

    def _encode_slice(self, todo: list[tuple[int, str]], parts: list[list[np.ndarray]]) -> None:
        if not todo:
            return
        # each text ends in a zero that stands for its end
        joined = "\0".join(s for _, s in todo) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = joined.encode()
        ends = np.cumsum([len(s) + 1 for _, s in todo]) - 1
        kinds = self.cutter.kinds(cps, ends)
        starts = np.flatnonzero(self.cutter.starts(kinds))
        if len(data) == len(cps):
            at = starts
        else:
            width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
            at = (np.cumsum(width) - width)[starts]
        offsets = np.append(at, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        cache, known = self.cache, pieces.dictionary.to_pylist()
        if len(cache) > CACHE_PIECES:
            cache.clear()
        self.learn([p for p in known if p not in cache])
        merged = [cache[p] for p in known]
        which = pieces.indices.to_numpy()
        is_end = np.zeros(len(cps), bool)
        is_end[ends] = True
        closing = is_end[starts]
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.uint32, int(lengths.sum()))
        first = np.cumsum(lengths) - lengths
        n = np.where(closing, 0, lengths[which])
        total = np.cumsum(n)
        place = np.repeat(first[which] - (total - n), n) + np.arange(int(total[-1]))
        ids = flat[place]
        begin = 0
        for (i, _), end in zip(todo, total[closing].tolist(), strict=True):
            parts[i].append(ids[begin:end])
            begin = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the vocabulary by their offsets."""
        lengths = self.lengths[ids]
        total = np.cumsum(lengths)
        if not len(total):
            return b""
        place = np.repeat(self.offsets[ids] - (total - lengths), lengths) + np.arange(int(total[-1]))
        return self.bytes[place].tobytes()


def segments(text: str) -> Iterator[str]:
    """A text in parts of about a slice, cut where white space begins: a piece begins there too."""
    start = 0
    while len(text) - start > 2 * SLICE_CHARS:
        cut = start + SLICE_CHARS
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def tokenizer(rank_file: bytes) -> Tokenizer:
    """One tokenizer per vocabulary and worker, so that its cache outlives a task."""
    return held("bpe" + hashlib.sha256(rank_file).hexdigest(), lambda: Tokenizer(rank_file))


def read_ranks(path: str) -> bytes:
    """A rank file (base64 token and rank per line), read where the driver runs."""
    with open(path, "rb") as file:
        return file.read()


def encode(
    df: DataFrame,
    rank_file: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_decoded: bool = False,
) -> DataFrame:
    """Per row: id, ids (binary: little-endian unsigned 32-bit numbers), n_tokens.

    Null texts count as empty and have no tokens. Every row is encoded by itself, so
    repeated rows and ids stay as they are; other columns are not looked at. No
    shuffle: one pass over the scan. The vocabulary (under 1 MB) is broadcast.
    ``with_decoded`` adds ``decoded``, the bytes the ids decode to, as ``decode``
    would, in the same worker: a second one per task would hold the vocabulary again.
    """
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(rank_file)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = own.encode([t or "" for t in part.column(1).to_pylist()])
                columns = {
                    id_col: part.column(0),
                    "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                }
                if with_decoded:
                    columns["decoded"] = pa.array([own.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = rows.schema["_id"].dataType.simpleString()
    more = ", decoded binary" if with_decoded else ""
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens bigint{more}")


def decode(df: DataFrame, rank_file: bytes, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids in ``ids_col``; null ids give null."""
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                packed = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                out = [None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in packed]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, decoded binary")
