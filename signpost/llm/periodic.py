"""Periodic runs of words, by suffix trees.

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends. By the runs theorem every run with two or more periods holds a Lyndon
root: at some place the longest Lyndon word, under the order of the words or under its
reverse, has length q. So each place gives two candidates (place, length), and a
candidate is a run if the longest common extensions of ``place`` and ``place + q`` to
the right and to the left cover enough.

The extensions are depths of lowest common ancestors in two suffix trees, of the
words and of their reversal, built by Ukkonen's algorithm. The Euler tour of a tree
turns an ancestor into a range minimum; blocks of the tour with a sparse table over
their minima answer it in constant time and linear memory. The leaves' order in the
tree gives the longest Lyndon words: they reach to the next smaller suffix.

A run of e periods holds each of its words e times. So words that are rarer in a
stretch break every run, and trees are built over what lies between them; the tree of
the reversal only if some candidate extends far enough to the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.shipping import ship_code
from signpost.llm.slices import lists_of, slices

MIN_LENGTH = 6
MIN_EXPONENT = 4
SLICE_BYTES = 2 << 20
TOUR_BLOCK = 32
ROUNDS = 40


def ukkonen(symbols: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """The suffix tree of ``symbols`` (1 and up) and a closing 0.

    Edges by ``node * width + first symbol``, each node's label as start and end, width.
    """
    s = [*symbols, 0]
    n, width = len(s), max(s) + 1
    edges: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = rest = 0
    for i, symbol in enumerate(s):
        made = 0  # the inner node that still lacks its suffix link
        rest += 1
        while rest:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                begin = start[child]
                span = min(end[child], i + 1) - begin
                if length >= span:
                    node, edge, length = child, edge + span, length - span
                    continue
                if s[begin + length] == symbol:
                    length += 1
                    if made:
                        link[made] = node
                    break
                split = len(start)
                edges[key] = split
                edges[split * width + s[begin + length]] = child
                edges[split * width + symbol] = split + 1
                start += (begin, i)
                end += (begin + length, n)
                link += (0, 0)
                start[child] = begin + length
                if made:
                    link[made] = split
                made = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return edges, start, end, width


class Tour:
    """The Euler tour of a suffix tree: suffixes in order, common prefixes in constant time."""

    def __init__(self, symbols: list[int]) -> None:
        edges, start, end, width = ukkonen(symbols)
        n = len(symbols) + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        first = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
        tour: list[int] = []  # depth at every visit
        leaves: list[int] = []  # places in the tour, in order
        suffixes: list[int] = []
        stack, depths, nexts = [0], [0], first[:]
        while stack:
            node, depth = stack[-1], depths[-1]
            tour.append(depth)
            at = nexts[node]
            if at < first[node + 1]:
                nexts[node] = at + 1
                child = children[at]
                below = depth + end[child] - start[child]
                if first[child] == first[child + 1]:
                    leaves.append(len(tour))
                    suffixes.append(n - below)
                    tour.append(below)
                else:
                    stack.append(child)
                    depths.append(below)
            else:
                stack.pop()
                depths.pop()
        self.order = np.array(suffixes, np.int64)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = leaves
        blocks = -(-len(tour) // TOUR_BLOCK)
        self.tour = np.zeros(blocks * TOUR_BLOCK, np.int32)
        self.tour[: len(tour)] = tour
        grid = self.tour.reshape(blocks, TOUR_BLOCK)
        self.head = np.minimum.accumulate(grid, axis=1).ravel()
        self.tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b`` (different places, up to the end)."""
        lo, hi = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        left, right = lo // TOUR_BLOCK, hi // TOUR_BLOCK
        out = np.minimum(self.tail[lo], self.head[hi])
        between = np.flatnonzero(right - left > 1)
        if len(between):
            x, y = left[between] + 1, right[between]
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                some = level == k
                at = between[some]
                inner = np.minimum(self.table[k][x[some]], self.table[k][y[some] - (1 << k)])
                out[at] = np.minimum(out[at], inner)
        for at in np.array_split(inside := np.flatnonzero(left == right), len(inside) // 4096 + 1):
            steps = lo[at, None] + np.arange(TOUR_BLOCK)
            # past the other leaf the leaf itself stands in
            out[at] = self.tour[np.minimum(steps, hi[at, None])].min(axis=1)
        return out.astype(np.int64)


def next_smaller(rank: list[int]) -> list[int]:
    """For every place the next one of smaller rank, or the end."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Runs ``[start, length, period]`` of a stretch, in order of start, then period."""
    n = len(symbols)
    names = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    forward = Tour(names)
    rank = np.empty(n + 1, np.int64)
    rank[forward.order] = np.arange(n + 1)
    ends = [next_smaller(r.tolist()) for r in (rank, -rank)]
    place = np.tile(np.arange(n), 2)
    period = np.concatenate([np.array(e[:n], np.int64) for e in ends]) - place
    fits = np.flatnonzero(place + (min_exponent - 1) * period < n)
    place, period = place[fits], period[fits]
    # the first root of a run has all but a part of one period behind it
    right = forward.common(place, place + period)
    far = np.flatnonzero(right > (min_exponent - 2) * period)
    del forward
    if not len(far):
        return np.empty((0, 3), np.int64)
    place, period, right = place[far], period[far], right[far]
    left = Tour(names[::-1]).common(n - place, n - place - period)
    found = np.stack([place - left, left + period + right, period], axis=1)
    length = found[:, 1]
    return np.unique(found[length >= np.maximum(min_length, min_exponent * period)], axis=0)


def stretches(symbols: np.ndarray, times: int, min_length: int) -> list[tuple[int, int]]:
    """Parts outside of which no run lies: each word occurs ``times`` or more within its part.

    A part cut ROUNDS times is taken as it is: the trees do without, and rounds stay few.
    """
    out, todo = [], [(0, len(symbols), 0)]
    while todo:
        lo, hi, turn = todo.pop()
        _, which, counts = np.unique(symbols[lo:hi], return_inverse=True, return_counts=True)
        often = counts[which] >= times
        if often.all() or turn == ROUNDS:
            out.append((lo, hi))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        wide = end - begin >= min_length
        todo += [(a + lo, b + lo, turn + 1) for a, b in zip(begin[wide].tolist(), end[wide].tolist(), strict=True)]
    return sorted(out)


def word_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Runs ``[start, length, period]`` of a text's words, in order of start, then period."""
    numbers: dict[bytes, int] = {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    parts = []
    for lo, hi in stretches(symbols, min_exponent, max(min_length, min_exponent)) if len(words) else []:
        found = runs_of(symbols[lo:hi], min_length, min_exponent)
        found[:, 0] += lo
        parts.append(found)
    return np.concatenate(parts) if parts else np.empty((0, 3), np.int64)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a blank, without those that a run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period by start, then period), collapsed.

    Words are what stands between blanks and tab to carriage return. A run has
    ``min_length`` words and ``min_exponent`` (2 or more) periods at least; ``collapsed`` is the text
    without what runs repeat, its words joined by a blank. Null and empty texts have no
    words, no runs and an empty collapsed text. Every row stands for itself, so repeated
    rows and ids stay as they are; an empty table gives an empty one; other columns are
    not looked at. One pass over the scan, no shuffle; memory is linear in the longest
    stretch of repeated words of one text.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    ship_code(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                texts = [(t or "").encode().split() for t in part.column(1).to_pylist()]
                found = [word_runs(words, min_length, min_exponent) for words in texts]
                flat = np.concatenate(found)
                spans = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"]
                )
                short = [collapsed(words, runs) for words, runs in zip(texts, found, strict=True)]
                columns = {
                    id_col: part.column(0),
                    "n_words": pa.array([len(words) for words in texts], pa.int64()),
                    "runs": lists_of(spans, np.array([len(x) for x in found], np.int64)),
                    "collapsed": pa.array(short, pa.binary()).cast(pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"`{id_col}` {kind}, n_words bigint, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    )
