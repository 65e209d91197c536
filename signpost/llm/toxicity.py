"""Toxicity by compression distance.

Three zstandard dictionaries are trained on windows of labelled running text: a large one
on ordinary text, which both sides share, and one of equal size for each side, on toxic
text and on other ordinary text. What a side's own dictionary knows and the shared one
does not is what its texts have in common beyond ordinary language. There are FOLDS such
pairs, each trained on all but one part of the labelled documents.

A window to judge is one word between blanks with a fixed tail (zstandard looks for no match in
the last bytes of a block). Its distance is the length it is compressed to with the
ordinary dictionary less that with the toxic one; for ordinary words the two differ by
chance either way. A pair's score of a document is a logistic curve over its largest
distances, the mean of all, and the numbers of windows beyond three thresholds and of all,
calibrated on the part of the labelled documents that its dictionaries have not seen. The
document's score is the mean over the pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from signpost.llm.shipping import ship_code
from signpost.llm.worker import give_back, held
from signpost.operators.ranking import first_rows
from signpost.session import materialize

# The sample that a model is fitted on: labelled rows per label, and characters of each.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
# Training: words of a window, windows per dictionary, bytes of the shared and of either side's dictionary.
TRAIN_WORDS = 4
TRAIN_WINDOWS = 120_000
SHARED_BYTES = 112_640
SIDE_BYTES = 16_384
FOLDS = 3
SEGMENT, GRAM = 30, 6  # of zstandard's cover trainer
LEVEL = 6
FAR = (3, 4, 5)  # thresholds of distance, in bytes
CACHE_WORDS = 200_000
TEXTS = 256  # scored at once
FEATURES = 4 + len(FAR)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# a tail no text is likely to hold, so that it costs every window the same
TAIL = ("".join(chr(33 + i * 37 % 90) for i in range(40)).lower() + " ").encode()


@dataclass(frozen=True)
class Pair:
    """What the ordinary, the toxic and both dictionaries hold, and the weights from features to a score."""

    ordinary: bytes
    toxic: bytes
    shared: bytes
    weights: tuple[float, ...]


@dataclass(frozen=True)
class Model:
    """The pairs; without any every text has the score ``share``."""

    pairs: tuple[Pair, ...]
    share: float


class Scorer:
    """Distances of words under pairs of dictionaries, kept for words met again."""

    def __init__(self, pairs: Sequence[tuple[bytes, bytes, bytes]]) -> None:
        self.pairs = []
        for ordinary, toxic, shared in pairs:
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL,
                source_size=64,
                dict_size=len(shared) + max(len(ordinary), len(toxic)),
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
            )
            sides = []
            for own in (ordinary, toxic):
                made = zstandard.ZstdCompressionDict(own + shared + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(compression_params=params)
                sides.append(zstandard.ZstdCompressor(dict_data=made, compression_params=params))
            known = {own[i : i + GRAM] for own in (ordinary, toxic) for i in range(len(own) - GRAM + 1)}
            self.pairs.append((*sides, known))
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.distances = np.zeros((len(self.pairs), 1 << 12), np.int8)

    def distance(self, word: bytes) -> list[int]:
        """Bytes that each pair's toxic dictionary saves over its ordinary one; negative if it costs more.

        A window without GRAM bytes that either side's own part has can't tell the two
        apart: 0, without compressing it.
        """
        window = b" " + word + b" "
        grams = [window[i : i + GRAM] for i in range(len(window) - GRAM + 1)]
        out = []
        for plain, harsh, known in self.pairs:
            d = 0
            if not known.isdisjoint(grams):
                d = len(plain.compress(window + TAIL)) - len(harsh.compress(window + TAIL))
            out.append(max(-100, min(100, d)))
        return out

    def numbered(self, words: list[bytes]) -> list[int]:
        """The column of every word in ``distances``; words not met before are compressed."""
        numbers = self.numbers
        new = [w for w in dict.fromkeys(words) if w not in numbers]
        if new:
            first = len(numbers)
            while first + len(new) > self.distances.shape[1]:
                self.distances = np.concatenate([self.distances, np.zeros_like(self.distances)], axis=1)
            for i, word in enumerate(new, first):
                numbers[word] = i
                self.distances[:, i] = self.distance(word)
        return [numbers[w] for w in words]

    def features(self, texts: Sequence[str]) -> np.ndarray:
        """``[pair, text, feature]``: the two largest distances of a text's words, ten times the mean, how
        many reach each of FAR, and how many words there are (logarithms)."""
        if len(self.numbers) > CACHE_WORDS:
            self._forget()
        # bytes.split() parts at exactly blank, \t, \n, \v, \f and \r
        words = [t.lower().encode().split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(self.pairs), len(texts), FEATURES))
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        at = np.array(self.numbered([w for ws in words for w in ws]), np.int64)
        starts, n = (np.cumsum(sizes) - sizes)[some], sizes[some]
        for k in range(len(self.pairs)):
            d = self.distances[k, at].astype(np.int64)
            first = np.maximum.reduceat(d, starts)
            # without one word of the largest distance per text
            top = np.flatnonzero(d == np.repeat(first, n))
            rest = d.copy()
            rest[top[np.unique(np.searchsorted(starts, top, side="right"), return_index=True)[1]]] = -128
            second = np.where(n > 1, np.maximum.reduceat(rest, starts), 0)
            columns = [np.minimum(first, 12), np.minimum(second, 12), 10 * np.add.reduceat(d, starts) / n]
            columns += [np.log1p(np.add.reduceat((d >= least).astype(np.int64), starts)) for least in FAR]
            out[k, some] = np.stack([*columns, np.log(n)], axis=1)
        return out


def score_of(features: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    z = features @ np.array(weights[1:]) + weights[0]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def calibrate(features: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, ...]:
    """Logistic weights by Newton steps with a small ridge; ``share`` weighs each row."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1)) * share.sum()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - labels)) + ridge @ w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def trained(texts: Sequence[str], size: int) -> bytes:
    """Dictionary content trained on windows of running text, at most TRAIN_WINDOWS evenly taken from all."""
    windows = []
    for text in texts:
        found = _WORD.findall(text.lower())
        parts = (found[i : i + TRAIN_WORDS] for i in range(0, len(found), TRAIN_WORDS))
        windows += [(" " + " ".join(p) + " ").encode() for p in parts]
    windows = [w for w in windows if len(w) >= GRAM]
    step = max(1, len(windows) / TRAIN_WINDOWS)
    windows = [windows[int(i * step)] for i in range(min(len(windows), TRAIN_WINDOWS))]
    try:
        return zstandard.train_dictionary(size, windows, k=SEGMENT, d=GRAM).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is its own dictionary
        return b"".join(windows)[-size:]


def dictionaries(toxic: Sequence[str], ordinary: Sequence[str]) -> tuple[bytes, bytes, bytes]:
    """What the ordinary dictionary, the toxic one and both hold: a side's own part stands before the shared one."""
    parts: list[list[str]] = [[], []]
    for text in ordinary:
        parts[hashlib.md5(b"side" + text.encode()).digest()[0] % 2].append(text)
    return trained(parts[1], SIDE_BYTES), trained(toxic, SIDE_BYTES), trained(parts[0], SHARED_BYTES)


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> Model:
    """A model from a bounded sample: at most ``rows`` labelled rows of either label.

    Rows are picked by a hash of the id; of texts alike (see ``one_per_likeness``) one
    counts, with its first ``chars`` characters. Each pair is calibrated on the part it was not
    trained on; labels weigh as often as they occur. Rows without id, text or label
    teach nothing. With one label only the score is that label's share everywhere.
    """
    marked = (
        labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("_y"))
        .filter(F.col("_lid").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_lid")
        .agg(F.max("_y").alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit("toxicity"), F.col("_lid"))
    # found by counting: no task holds a label's rows
    picked = materialize(first_rows(marked, "_y", "_lid", rows, seed=0).withColumn("_h", order))
    texts = df.select(F.col(id_col).alias("_id"), F.substring(F.col(text_col), 1, chars).alias("_t"))
    found = (
        texts.join(picked, F.col("_id") == F.col("_lid"))
        .filter(F.col("_t").isNotNull())
        # one text per id: ids may repeat without bound
        .groupBy("_lid")
        .agg(F.min(F.struct("_y", "_h", "_t")).alias("_one"))
        .select("_one.*")
        .collect()
    )
    seen: dict[str, tuple[int, int]] = {}
    for r in sorted(found, key=lambda r: (r["_h"], r["_t"])):
        seen.setdefault(r["_t"], (r["_y"], len(seen)))
    own = set(one_per_likeness(list(seen)))
    seen = {t: v for t, v in seen.items() if t in own}
    parts: list[list[tuple[str, int]]] = [[] for _ in range(FOLDS)]
    for t, (y, _) in seen.items():
        parts[int(hashlib.md5(t.encode()).hexdigest(), 16) % FOLDS].append((t, y))
    total = sum(counts.values())
    share = min(max(counts.get(1, 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
    pairs = []
    for k, unseen in enumerate(parts):
        learn = [x for j, part in enumerate(parts) if j != k for x in part]
        if any(len({y for _, y in rows}) < 2 for rows in (learn, unseen)):
            return Model((), share)
        made = dictionaries([t for t, y in learn if y], [t for t, y in learn if not y])
        x = Scorer([made]).features([t for t, _ in unseen])[0]
        y = np.array([float(v) for _, v in unseen])
        weigh = {v: counts[v] / total / (y == v).sum() for v in (0, 1)}
        pairs.append(Pair(*made, calibrate(x, y, np.array([weigh[int(v)] for v in y]))))
    return Model(tuple(pairs), share)


def one_per_likeness(texts: Sequence[str], width: int = 5, marks: int = 6) -> list[str]:
    """Texts that share none of their smallest shingle hashes with one before: copies
    with small edits would make their own words look toxic, or ordinary."""
    out, met = [], set()
    for text in texts:
        words = _WORD.findall(text.lower())
        shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
        least = sorted({hashlib.md5(x.encode()).digest()[:8] for x in shingles})[:marks]
        if not met.intersection(least):
            out.append(text)
        met.update(least)
    return out


def scorer(model: Model) -> Scorer:
    """One scorer per model and worker."""
    key = hashlib.sha256(repr(model).encode()).hexdigest()
    return held("toxicity" + key, lambda: Scorer([(p.ordinary, p.toxic, p.shared) for p in model.pairs]))


def with_score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability that a text is toxic, from the text alone.

    Null and empty texts have the score of a text whose windows have no distance. Equal
    texts score alike; all rows and columns stay (a column named ``score_col`` is
    replaced). One pass, no shuffle; the model (under 1 MB) is broadcast.
    """
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(
        ([(p.ordinary, p.toxic, p.shared, p.weights) for p in model.pairs], model.share)
    )

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(tuple(Pair(*p) for p in shared.value[0]), shared.value[1])
        judge = scorer(own)
        for texts in batches:
            if not own.pairs:
                yield pd.Series(np.full(len(texts), own.share))
                continue
            parts = [np.zeros(0)]
            for lo in range(0, len(texts), TEXTS):
                x = judge.features([t or "" for t in texts.iloc[lo : lo + TEXTS]])
                parts.append(np.mean([score_of(x[k], p.weights) for k, p in enumerate(own.pairs)], axis=0))
            yield pd.Series(np.concatenate(parts))
            give_back()

    return df.withColumn(score_col, score(F.col(text_col)))
