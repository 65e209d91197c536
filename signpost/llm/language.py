"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text knows every string of that text.
A text is parsed against it into phrases, each the longest match from where the last
one ended; the language whose text explains it in the fewest phrases, normalised by
length, wins. Automata are laid out as dense transition tables, so a parse is one
gather per letter, done for many blocks of many texts at once. A block is a fixed
number of letters and begins a new phrase, which costs each language at most one
phrase per block and bounds the work of one very long text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from signpost.llm.shipping import ship_code
from signpost.llm.worker import held
from signpost.operators.ranking import top_n_per_group
from signpost.session import materialize

BLOCK = 256
SAMPLE_ROWS = 64  # texts per language
SAMPLE_CHARS = 24_000  # characters per language, an equal part of each text
GAP = 1  # the symbol of everything that is no letter, once between words
UNKNOWN = "und"
SLICE_CHARS = 1 << 20


def letter_table() -> np.ndarray:
    """The lower-cased code point of every letter, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        char = chr(cp)
        if char.isalpha():
            low = char.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Suffix automaton as a table ``[state, symbol] -> next state``; 0 is no move, 1 the root."""
    limit = 2 * len(symbols) + 2
    step = np.zeros((limit, alphabet), np.int32)
    moves: list[dict[int, int]] = [{}, {}]
    link, longest = [0, 0], [0, 0]
    last = 1
    for c in symbols:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(1)
        at = last
        while at and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at:
            to = moves[at][c]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    for state, out in enumerate(moves):
        for c, to in out.items():
            step[state, c] = to
    return step[: len(moves)]


class Parser:
    """The automata of all languages over one alphabet."""

    def __init__(self, samples: Mapping[str, str]) -> None:
        self.letters = letter_table()
        self.languages = sorted(samples)
        read = {k: self._fold(samples[k])[0] for k in self.languages}
        used = np.unique(np.concatenate([*read.values(), np.array([0], np.uint32)]))
        used = used[used > 0]
        # symbol 0: a letter no sample has, which matches nowhere; 1: a gap
        self.alphabet = len(used) + 2
        self.symbols = np.zeros(0x110000, np.uint8 if self.alphabet < 256 else np.uint16)
        self.symbols[used] = np.arange(2, self.alphabet)
        self.tables = []
        for k in self.languages:
            own = self.symbols[read[k]]
            own[read[k] == 0] = GAP
            self.tables.append(automaton(own.tolist(), self.alphabet).ravel())
        self.bits = [np.log2(max(2, len(read[k]))) for k in self.languages]

    def _fold(self, text: str) -> tuple[np.ndarray, bool]:
        """Lower-cased letters with one 0 between words; whether there is a letter."""
        cps = self.letters[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        keep = cps > 0
        keep[1:] |= cps[:-1] > 0
        return cps[keep], bool((cps > 0).any())

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ``[text, language]`` and symbols per text."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        lengths = np.zeros(len(texts), np.int64)
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= SLICE_CHARS):
                chars += len(texts[stop])
                stop += 1
            self._parse_slice(texts[start:stop], out[start:stop], lengths[start:stop])
            start = stop
        return out, lengths

    def _parse_slice(self, texts: list[str], out: np.ndarray, lengths: np.ndarray) -> None:
        # every text ends in a character that is no letter
        joined = "\n".join(texts) + "\n"
        cps = self.letters[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        letter = cps > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of others is the gap
        cps, owner = cps[keep], owner[keep]
        if not len(cps):
            return
        symbols = self.symbols[cps]
        symbols[cps == 0] = GAP
        n = np.bincount(owner, minlength=len(texts))
        lengths[:] = n
        # blocks of BLOCK symbols, long ones first: the lanes still open are a prefix
        blocks = -(-n // BLOCK)
        whose = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(whose)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(n) - n)[whose] + nth * BLOCK
        size = np.minimum(BLOCK, n[whose] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        whose, begin, size = whose[order], begin[order], size[order]
        open_lanes = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        for which, table in enumerate(self.tables):
            state = np.ones(len(size), np.int32)
            phrases = np.zeros(len(size), np.int32)
            for i, lanes in enumerate(open_lanes.tolist()):
                symbol = symbols[begin[:lanes] + i].astype(np.int32)
                to = table[state[:lanes] * self.alphabet + symbol]
                ended = np.flatnonzero(to == 0)
                if len(ended):
                    phrases[ended] += 1
                    # the symbol opens the next phrase; one the language lacks is a phrase of its own
                    again = table[self.alphabet + symbol[ended]]
                    to[ended] = np.where(again == 0, 1, again)
                state[:lanes] = to
            phrases += 1
            out[:, which] = np.bincount(whose, weights=phrases, minlength=len(out)).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and how sure it is (a share of likelihood, 0 to 1)."""
        found, lengths = self.parse(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = found * np.array(self.bits)[None, :]
        best = bits.argmin(axis=1)
        spread = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0) / 8)
        score = 1.0 / spread.sum(axis=1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, lengths, strict=True)]
        return names, np.where(lengths > 0, score, 0.0)


def parser(samples: Mapping[str, str]) -> Parser:
    """One parser per set of samples and worker."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return held("language" + key, lambda: Parser(samples))


def fit(
    df: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
    seed: int = 0,
) -> dict[str, str]:
    """Reference text per language from a bounded sample of labelled rows.

    Per language at most ``rows`` different texts, picked by a hash of the text, give
    ``chars // rows`` characters each, from their first letter on. Rows without a
    language, a text or a letter teach nothing. Copies are one text. Hashes are folded
    and cut before anything moves; the texts picked are then read by their hash. What
    reaches the driver is languages x ``chars``.
    """
    part = max(1, chars // rows)
    useful = df.select(
        F.col(lang_col).alias("_lang"),
        F.xxhash64(F.lit(seed), F.col(text_col)).alias("_h"),
        F.regexp_substr(F.col(text_col), F.lit(rf"(?s)\p{{L}}.{{0,{part - 1}}}")).alias("_text"),
    ).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    hashes = useful.select("_lang", "_h").distinct()
    picked = materialize(top_n_per_group(hashes, ["_lang"], [F.col("_h")], rows, rank_col="_at"))
    chosen = useful.join(picked, ["_lang", "_h"]).dropDuplicates(["_lang", "_h"])
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen.select("_lang", "_at", "_text").collect(), key=lambda r: (r["_lang"], r["_at"])):
        samples.setdefault(r["_lang"], []).append(r["_text"])
    return {k: "\n".join(v) for k, v in samples.items()}


def identify(
    df: DataFrame, samples: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, lang_pred, score, from the text alone.

    A null text and one without a letter are ``und`` with score 0; equal texts get
    equal answers; ties go to the smaller name. Repeated rows stay rows; other
    columns are not looked at. One pass, no shuffle; the samples are broadcast
    (languages x ``SAMPLE_CHARS`` characters).
    """
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(dict(samples))

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = parser(shared.value)
        for texts in batches:
            names, score = own.predict([t or "" for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": score})

    found = df.select(F.col(id_col).alias("_id"), predict(F.col(text_col)).alias("p"))
    return found.select(F.col("_id").alias(id_col), "p.lang_pred", "p.score")
