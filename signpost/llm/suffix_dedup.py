"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier in the
corpus. Sorting the suffixes of every byte would move a hundred times the text, so
suffixes are sorted at anchors: a gram of ``GRAM`` bytes is an anchor if its hash is
the least among the grams of some string of ``WIDTH`` bytes. Equal strings have equal
anchors, so every repeat shows at the anchors it holds, and some 3 % of places are
anchors. Three passes, each over narrow rows:

1. Anchors whose gram occurs once are dropped. Tasks send sorted, packed runs of
   gram hashes; a gram met twice in a batch is known to repeat at once, and only a
   mark of it is sent on, so copies are folded before they travel.
2. The suffix at an anchor (``WIDTH`` bytes, then the bytes before it, reversed)
   is sorted in runs that are exchanged front-coded: each suffix as the length of
   its common prefix with the one before, and the rest. Equal suffixes of a run are
   folded to the earliest.
3. Runs are merged by a loser tree that keeps with every waiting suffix its common
   prefix with the last one put out, compares numbers where they differ, and bytes
   only beyond what is known to be common. Equal suffixes come out side by side: all
   but the earliest are repeats as a whole. Suffixes of one gram with different
   surroundings are compared by the strings of ``WIDTH`` bytes they hold; a gram with
   very many of them hands these strings to a keyed minimum over the cluster.

A document's ranges meet its text in a join. Texts cross the shuffle compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from signpost.llm.shipping import ship_code
from signpost.llm.slices import slices
from signpost.llm.worker import give_back
from signpost.session import materialize

WIDTH = 100
GRAM = 32
SPAN = WIDTH - GRAM  # bytes before an anchor that strings over it can begin
PARTS_PER_TASK = 8  # parts of the hash range for every shuffle partition
SLICE = 1 << 20
BATCH_BYTES = 4 << 20  # of texts whose anchors a task holds at once
ZIPPED_BYTES = 1 << 20  # of compressed texts whose suffixes a task holds at once
CROWD = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_OTHER_BASE = 0xD6E8FEB86659FD93 | 1
LAST_ID = 2**63 - 1


# ---- hashes of all strings of one length ---------------------------------------


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 12)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(step, dtype=np.uint64))
        _POWERS[base] = (out[0], out[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of every string of ``width`` bytes in ``data``, never 0 nor the largest."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(base, n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])
    return np.clip(h, np.uint64(1), np.uint64(2**64 - 2))


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of texts laid end to end (``ends`` exclusive)."""
    n = len(data)
    if n < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = gram_hashes(data, GRAM)
    # strings that cross the end of a text don't count
    crossing = np.zeros(n + 1, bool)
    for k in range(1, WIDTH):
        at = ends - k
        crossing[at[at >= 0]] = True
    least = sliding(grams, SPAN + 1, True)
    least = np.where(crossing[: len(least)], np.uint64(0), least)
    padded = np.concatenate([np.zeros(SPAN, np.uint64), least, np.zeros(SPAN, np.uint64)])
    most = sliding(padded, SPAN + 1, False)[: len(grams)]
    at = np.flatnonzero(most == grams)
    return at, grams[at]


def laid_out(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: bytes, ends of the parts, their text's number, their start in it.

    A text longer than a slice goes in parts that overlap by ``WIDTH - 1`` bytes.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def slice_of(parts: list[tuple[int, int, bytes]]):
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        ends = np.cumsum([len(p[2]) for p in parts])
        return data, ends, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for i, value in enumerate(texts):
        text = value.as_py()
        if len(text) < WIDTH:
            continue
        for lo in range(0, len(text), SLICE):
            if lo and len(text) - lo < WIDTH:
                break
            part = text[lo : lo + SLICE + WIDTH - 1]
            parts.append((i, lo, part))
            size += len(part)
            if size >= SLICE:
                yield slice_of(parts)
                parts, size = [], 0
    if parts:
        yield slice_of(parts)


def anchors_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in the text, gram hash) of all anchors."""
    found = []
    for data, ends, number, start in laid_out(texts):
        at, grams = anchors(data, ends)
        part = np.searchsorted(ends, at, side="right")
        begin = np.concatenate([[0], ends[:-1]])[part]
        found.append((number[part], start[part] + at - begin, grams))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# ---- packed arrays ---------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, or of several, as compressed bytes."""
    body = b"".join(
        struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)) + a.tobytes() for a in arrays
    )
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(body):
        kind, n = struct.unpack_from("<2sI", body, at)
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(body, dtype, n, at + 6))
        at += 6 + n * dtype.itemsize
    return out


def grouped(ids: np.ndarray, ties: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """``(id, tie, columns...)`` per text, rows in order of id and tie."""
    if not len(ids):
        return
    order = np.lexsort((ties, ids))
    ids, ties, columns = ids[order], ties[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])]))
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
        yield int(ids[lo]), int(ties[lo]), *[c[lo:hi] for c in columns]


def record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


# ---- pass 1: anchors whose gram repeats -------------------------------------------

_RUN = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("body", pa.binary())])
_FOUND = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("body", pa.binary())])


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches by the bytes of a column, a longer value alone."""
    for batch in batches:
        yield from slices(batch, column, size)
        give_back()


def gram_runs(batches: Iterator[pa.RecordBatch], bits: int = 8) -> Iterator[pa.RecordBatch]:
    """Per batch of texts and part of the hash range: the sorted grams met once (kind 0,
    with a mark for those met twice); per text: its grams met twice (kind 1)."""
    for batch in sliced(batches, 2, BATCH_BYTES):
        ids, ties, texts = (batch.column(i) for i in range(3))
        ids, ties = ids.to_numpy(), ties.to_numpy()
        which, place, grams = anchors_of(texts)
        if not len(grams):
            continue
        order = np.argsort(grams, kind="stable")
        which, place, grams = which[order], place[order], grams[order]
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        number = np.cumsum(new) - 1
        twice = (np.bincount(number) > 1)[number]
        rows = []
        if twice.any():
            w = which[twice]
            for i, tie, place_of, gram_of in grouped(ids[w], ties[w], place[twice], grams[twice]):
                rows.append((i % (1 << bits), 1, i, tie, pack(place_of, gram_of)))
        # a mark stands for all places of a gram met twice
        sent = new
        place = np.where(twice, -1, place)
        part = (grams >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.searchsorted(part, np.arange((1 << bits) + 1)).tolist()
        for p, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            own = np.arange(lo, hi)[sent[lo:hi]]
            if len(own):
                w = which[own]
                rows.append((p, 0, 0, 0, pack(grams[own], place[own], ids[w], ties[w])))
        yield record(_RUN, rows)


def repeated_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of grams that repeat, per text, from all runs of the partition's parts.

    Runs stay packed until the turn of their part.
    """
    runs: dict[int, list[bytes]] = {}
    for batch in batches:
        known = []
        for row in batch.to_pylist():
            if row["kind"]:
                known.append((row["id"], row["tie"], row["body"]))
            else:
                runs.setdefault(row["part"], []).append(row["body"])
        if known:
            yield record(_FOUND, known)
    for part in list(runs):
        opened = [unpack(body) for body in runs.pop(part)]
        grams, place, ids, ties = (np.concatenate(c) for c in zip(*opened, strict=True))
        del opened
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        same = grams[1:] == grams[:-1]
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keep = order[again & (place[order] >= 0)]
        hashes = np.empty(len(order), np.uint64)
        hashes[order] = grams
        rows = [
            (i, tie, pack(p, g))
            for i, tie, p, g in grouped(ids[keep], ties[keep], place[keep], hashes[keep])
        ]
        if rows:
            yield record(_FOUND, rows)
        give_back()


# ---- pass 2: sorted, front-coded runs of suffixes ----------------------------------

_SORTED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("body", pa.binary())])
END = b"\xff"  # no byte of UTF-8; closes a side that the text's end cuts short


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, at least ``known``."""
    n = min(len(a), len(b))
    diff = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (diff.bit_length() + 7) // 8 if diff else n


def suffix_key(text: bytes, place: int, gram: int) -> tuple[bytes, int, int]:
    """What is sorted at an anchor, with the bytes it has behind and before the place."""
    right = text[place : place + WIDTH]
    left = text[max(0, place - SPAN) : place][::-1]
    key = gram.to_bytes(8, "big") + right
    if len(right) < WIDTH:
        key += END
    key += left
    if len(left) < SPAN:
        key += END
    return key, len(right), len(left)


def front_coded(entries: list[tuple]) -> bytes:
    """A sorted run of (key, right, left, id, tie, place): common prefixes and rests."""
    lcps, rests, before = [], [], b""
    for entry in entries:
        key = entry[0]
        lcp = common(key, before)
        lcps.append(lcp)
        rests.append(key[lcp:])
        before = key
    _, right, left, ids, ties, place = zip(*entries, strict=True)
    return pack(
        np.array(lcps, "<u2"),
        np.array([len(r) for r in rests], "<u2"),
        np.frombuffer(b"".join(rests), "<u1"),
        np.array(right, "<u1"),
        np.array(left, "<u1"),
        np.array(ids, "<i8"),
        np.array(ties, "<i8"),
        np.array(place, "<i8"),
    )


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the one before, key, (right, left, id, tie, place)) of a run."""
    lcps, lengths, rests, *columns = unpack(blob)
    rests, at, key = rests.tobytes(), 0, b""
    refs = zip(*[c.tolist() for c in columns], strict=True)
    for lcp, n, ref in zip(lcps.tolist(), lengths.tolist(), refs, strict=True):
        key = key[:lcp] + rests[at : at + n]
        at += n
        yield lcp, key, ref


def whole(ref: tuple) -> tuple[int, int, int, int]:
    """(id, tie, start, end) of the range that all strings at an anchor cover."""
    right, left, i, tie, place = ref
    return i, tie, place - left, place + right


def suffix_runs(batches: Iterator[pa.RecordBatch], bits: int = 8) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated grams to runs per part (kind 0) and ranges that the
    batch itself shows to be repeats (kind 1)."""
    unzip = zstandard.ZstdDecompressor()
    for batch in sliced(batches, 2, ZIPPED_BYTES):
        entries = []
        for row in batch.to_pylist():
            text = unzip.decompress(row["z"])
            seen = set()
            for blob in row["bodies"]:
                places, grams = unpack(blob)
                for place, gram in zip(places.tolist(), grams.tolist(), strict=True):
                    if place in seen:
                        continue
                    seen.add(place)
                    key, right, left = suffix_key(text, place, gram)
                    entries.append((key, right, left, row["id"], row["tie"], place))
        entries.sort(key=lambda x: (x[0], x[3], x[4], x[5]))
        rows, run, part = [], [], -1
        for entry in entries:
            if run and entry[0] == run[-1][0]:
                if entry[3:] != run[-1][3:]:
                    rows.append((entry[3] % (1 << bits), 1, *whole(entry[1:]), None))
                continue
            if (p := int.from_bytes(entry[0][:2], "big") >> (16 - bits)) != part:
                if run:
                    rows.append((part, 0, 0, 0, 0, 0, front_coded(run)))
                part, run = p, []
            run.append(entry)
        if run:
            rows.append((part, 0, 0, 0, 0, 0, front_coded(run)))
        if rows:
            yield record(_SORTED, rows)


# ---- pass 3: merge by loser trees ---------------------------------------------------


def merge_runs(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Sorted runs to one, each entry with its common prefix with the entry before.

    A waiting head carries its common prefix with the last entry put out. Of two heads
    the longer prefix is the smaller key, and the loser's prefix with the winner is
    the one it has; only equal prefixes need bytes, from there on. A loser's number
    is then its prefix with the winner, which is what the next round asks for.
    """
    size = 1
    while size < len(runs):
        size *= 2
    keys: list[bytes | None] = [None] * size
    refs: list[tuple] = [()] * size
    lcps = [0] * size

    def pull(i: int) -> None:
        if i < len(runs) and (entry := next(runs[i], None)) is not None:
            lcps[i], keys[i], refs[i] = entry
        else:
            keys[i] = None

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's number becomes its prefix with the winner."""
        a, b = keys[i], keys[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if lcps[i] != lcps[j]:
            return (i, j) if lcps[i] > lcps[j] else (j, i)
        known = common(a, b, lcps[i])
        win, lose = (i, j) if a[known:] <= b[known:] else (j, i)
        lcps[lose] = known
        return win, lose

    for i in range(size):
        pull(i)
    if size == 1:
        while keys[0] is not None:
            yield lcps[0], keys[0], refs[0]
            pull(0)
        return
    losers, winners = [0] * size, [0] * size + list(range(size))
    for i in range(size):
        lcps[i] = 0  # no entry is out yet
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while keys[best] is not None:
        yield lcps[best], keys[best], refs[best]
        pull(best)
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


_OUT = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("g", pa.int64()), ("w", pa.int64())])


def surroundings(members: list[tuple[int, bytes, tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around each anchor ``[member, SPAN + WIDTH]``, and how many are real on either side."""
    rows = []
    for _, key, (right, left, *_) in members:
        at = 8 + right + (right < WIDTH)
        rows.append(key[at : at + left][::-1].rjust(SPAN, END) + key[8 : 8 + right].ljust(WIDTH, END))
    around = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), SPAN + WIDTH)
    return around, np.array([m[2][0] for m in members]), np.array([m[2][1] for m in members])


def string_hashes(around: np.ndarray, right: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each start before the anchor: who holds a whole string there, and its hash."""
    up, down = powers(_OTHER_BASE, SPAN + WIDTH + 1)
    sums = np.zeros((len(around), SPAN + WIDTH + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((around.astype(np.uint64) + np.uint64(1)) * up[None, :-1], axis=1, out=sums[:, 1:])
        for o in range(SPAN + 1):
            who = np.flatnonzero((left >= SPAN - o) & (right >= WIDTH - SPAN + o))
            if len(who):
                yield o, who, mixed((sums[who, o + WIDTH] - sums[who, o]) * down[o])


def shared_strings(members: list[tuple[int, bytes, tuple]]) -> list[tuple]:
    """Ranges of members (group, key, reference) whose strings an earlier member holds too."""
    around, right, left = surroundings(members)
    group = np.array([m[0] for m in members])
    order = np.array([m[2][2:] for m in members])
    rank = np.empty(len(members), np.int64)
    by = np.lexsort((order[:, 2], order[:, 1], order[:, 0]))
    step = np.concatenate([[False], (order[by][1:] != order[by][:-1]).any(axis=1)])
    rank[by] = np.cumsum(step)
    low, high = np.full(len(members), SPAN + 1), np.full(len(members), -1)
    for o, who, hashes in string_hashes(around, right, left):
        at = np.lexsort((rank[who], hashes, group[who]))
        g, h, r = group[who][at], hashes[at], rank[who][at]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
        first = r[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        late = who[at[r > first]]
        low[late] = np.minimum(low[late], o)
        high[late] = np.maximum(high[late], o)
    out = []
    for m in np.flatnonzero(high >= 0).tolist():
        _, _, i, tie, place = members[m][2]
        # strings of one anchor overlap, so what they cover is one range
        out.append((i, tie, place - SPAN + int(low[m]), place - SPAN + int(high[m]) + WIDTH, None, None))
    return out


def string_rows(members: list[tuple[int, bytes, tuple]]) -> Iterator[pa.RecordBatch]:
    """Every string of every member as a row, for a minimum over the cluster."""
    around, right, left = surroundings(members)
    ids, ties, places = (np.array([m[2][k] for m in members], np.int64) for k in (2, 3, 4))
    gram = np.array([int.from_bytes(m[1][:8], "big", signed=True) for m in members], np.int64)
    for o, who, hashes in string_hashes(around, right, left):
        start = places[who] - SPAN + o
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (ids[who], ties[who], start, start + WIDTH, gram[who], hashes.view(np.int64))],
            schema=_OUT,
        )


def repeats(batches: Iterator[pa.RecordBatch], crowd: int = CROWD) -> Iterator[pa.RecordBatch]:
    """Ranges of repeats from all runs of the partition; strings of crowded grams (g, w set)."""
    runs: dict[int, list[bytes]] = {}
    for batch in batches:
        known = []
        for row in batch.to_pylist():
            if row["kind"]:
                known.append((row["id"], row["tie"], row["s"], row["e"], None, None))
            else:
                runs.setdefault(row["part"], []).append(row["body"])
        if known:
            yield record(_OUT, known)
    for part in sorted(runs):
        members: list[tuple[int, bytes, tuple]] = []  # of the gram under way
        waiting: list[tuple[int, bytes, tuple]] = []  # of grams with several members
        found: list[tuple] = []
        group, crowded = 0, False
        for lcp, key, ref in merge_runs([decoded(b) for b in runs.pop(part)]):
            if members and lcp == len(key) == len(members[-1][1]):
                last = members[-1][2]
                if ref[2:] != last[2:]:
                    early, late = (ref, last) if ref[2:] < last[2:] else (last, ref)
                    members[-1] = (group, key, early)
                    found.append((*whole(late), None, None))
            elif members and lcp >= 8 + GRAM:
                members.append((group, key, ref))
                if len(members) > crowd:
                    # all but the last, which equal suffixes may still follow
                    yield from string_rows(members[:-1])
                    members, crowded = members[-1:], True
            else:
                if crowded:
                    yield from string_rows(members)
                elif len(members) > 1:
                    waiting += members
                group, crowded = group + 1, False
                members = [(group, key, ref)]
                if len(waiting) >= 4096:
                    found += shared_strings(waiting)
                    waiting = []
            if len(found) >= 20_000:
                yield record(_OUT, found)
                found = []
        if crowded:
            yield from string_rows(members)
        elif len(members) > 1:
            waiting += members
        if waiting:
            found += shared_strings(waiting)
        if found:
            yield record(_OUT, found)
        give_back()


# ---- the operator -------------------------------------------------------------------

_RANGES = "array<struct<s:bigint,e:bigint>>"


def cut(text: bytes, ranges: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text without the ranges, and the ranges joined where they touch."""
    spans: list[list[int]] = []
    for r in sorted((x["s"], x["e"]) for x in ranges):
        if spans and r[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], r[1])
        else:
            spans.append(list(r))
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept), [(s, e) for s, e in spans]


def repeated_ranges(df: DataFrame, id_col: str, text_col: str, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Texts (``_id``, ``id``, ``tie``, compressed ``z``) and their ranges (``id``, ``tie``, ``s``, ``e``)."""
    ship_code(df.sparkSession)
    # rows that share an id are told apart by their text; equal rows are one text
    ids = df.select(F.col(id_col).alias("id"))
    shared = ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("id"),
        (F.xxhash64(text) if shared else F.lit(0).cast("bigint")).alias("tie"),
        text.alias("t"),
    )

    @pandas_udf("binary")
    def zipped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=3)
        for texts in batches:
            yield pd.Series([packer.compress(t) for t in texts])

    # parts follow the shuffle, so that a task's share stays in its memory at any size
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, max(8, (PARTS_PER_TASK * tasks - 1).bit_length()))
    texts = rows.select("_id", "id", "tie", zipped("t").alias("z"))
    grams = rows.select("id", "tie", "t").mapInArrow(partial(gram_runs, bits=bits), "part int, kind int, id bigint, tie bigint, body binary")
    found = materialize(
        grams.repartition("part")
        .mapInArrow(repeated_grams, "id bigint, tie bigint, body binary")
        .groupBy("id", "tie")
        .agg(F.collect_list("body").alias("bodies"))
    )
    suffixes = (
        texts.select("id", "tie", "z")
        .join(found, ["id", "tie"])
        .mapInArrow(partial(suffix_runs, bits=bits), "part int, kind int, id bigint, tie bigint, s bigint, e bigint, body binary")
    )

    out = materialize(
        suffixes.repartition("part").mapInArrow(partial(repeats, crowd=crowd), "id bigint, tie bigint, s bigint, e bigint, g bigint, w bigint")
    )
    strings = out.filter("g IS NOT NULL")
    at = F.struct("id", "tie", "s")
    first = strings.groupBy("g", "w").agg(F.min(at).alias("m"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = strings.join(first, ["g", "w"]).filter(at > F.col("m")).select("id", "tie", "s", "e")
    return texts, out.filter("g IS NULL").select("id", "tie", "s", "e").union(late)


def without_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD
) -> DataFrame:
    """Per row: id, kept (binary), n_bytes, spans (removed runs, start and exclusive end).

    Texts are taken as UTF-8 bytes, null texts as empty. Earlier means a smaller id,
    or an earlier start in one text; rows without an id come after all others. Rows
    with one id follow each other by a hash of their text, and rows equal in id and
    text count as one text, so they get one result. Texts shorter than ``WIDTH``
    bytes stay whole; an empty table gives an empty result; other columns are not
    looked at. Ids are whole numbers.
    """
    texts, ranges = repeated_ranges(df, id_col, text_col, crowd)
    by_text = ranges.distinct().groupBy("id", "tie").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    rows = texts.join(by_text, ["id", "tie"], "left").select(
        F.col("_id"), "z", F.coalesce("ranges", F.array().cast(_RANGES)).alias("ranges")
    )
    schema = pa.schema([
        (id_col, pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in sliced(batches, 1, ZIPPED_BYTES):
            out = []
            for i, z, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = unzip.decompress(z)
                kept, spans = cut(text, found)
                out.append((i, kept, len(text), [{"s": s, "e": e} for s, e in spans]))
            yield record(schema, out)

    return rows.mapInArrow(run, f"`{id_col}` bigint, kept binary, n_bytes bigint, spans {_RANGES}")
