r"""BPE encoding and decoding as streaming transducers.

Text goes in by parts of any size, tokens come out as soon as no later text can change
them, and what is held in between has a fixed bound:

* ``Cutter`` cuts pieces as the pattern
  ``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`` does.
  The last piece of a part is held back, as it may go on; one that grows past
  ``LONG`` characters is passed on unfinished, with only its kind kept.
* ``Merges.lookahead`` is computed from the merge list: how many bytes before the end
  of what is known a later byte can still change a token. ``Merger`` merges what it
  holds, emits the tokens that end before that and keeps the rest.
* ``Decoder`` is a byte-to-text machine: its state is the unfinished UTF-8 sequence.

**The lookahead.** Take the merges one by one in order of rank. At first a text ``w``
and ``w`` with more behind it agree up to the end of ``w``. A rule ``(u, v)`` moves the
place up to which they agree only if it joins a ``u`` before that place with a ``v``
behind it in one of the two: then by the length of ``u``. The place was set by an
earlier rule ``(u', v')`` (or is the end of ``w``), so the token behind it begins with
``u'``: ``u'`` lies on the left spine of ``v``. The longest chain of such rules, found in
one pass over the list, bounds the bytes in doubt. A merge list must be proper for
this: parts are made before what is made of them, and every token by one rule.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.shipping import ship_code
from signpost.llm.slices import lists_of, slices
from signpost.llm.worker import held

PART_CHARS = 1 << 16  # characters fed at a time
LONG = 256  # characters from which a piece is merged before it ends
MERGE_BYTES = 4096  # bytes merged at a time, besides the lookahead
CACHE_PIECES = 200_000  # of each of two generations
SLICE_BYTES = 4 << 20
NONE = 1 << 60

_WHITE, _LETTER, _NUMBER, _OTHER = r"\p{White_Space}", r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?{_OTHER}+|{_WHITE}+(?!\P{{White_Space}})|{_WHITE}+"
)
# What goes on with a piece of each kind, and how its first character tells the kind.
RUNS = [regex.compile(f"{c}*") for c in (_WHITE, _LETTER, _NUMBER, _OTHER)]
FIRST = [regex.compile(c) for c in (_WHITE, _LETTER, _NUMBER, _OTHER)]
WHITE = 0


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others for the code points from
    256 on, in their order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b if b in printable else next(rest)): b for b in range(256)}


class Merges:
    """The merge list of a byte-level BPE file and the tokens it makes."""

    def __init__(self, model: bytes) -> None:
        spec = json.loads(model)
        before, bpe = spec["pre_tokenizer"], spec["model"]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if spec["normalizer"] or not plain or any(bpe.get(o) for o in options):
            raise ValueError("only byte-level BPE without normalizer, prefix space and options")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they are")
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in bpe["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: token for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [vocab.get(bytes([b])) for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("every byte must be a token")
        self.width = max(self.tokens) + 1
        self.rules: dict[int, int] = {}  # left id * width + right id -> rank
        self.made: list[int] = []  # by rank
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, rule in enumerate(bpe["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            u, v = (vocab[bytes(letters[c] for c in x)] for x in (left, right))
            new = vocab[self.tokens[u] + self.tokens[v]]
            for x in (u, v):
                if len(self.tokens[x]) > 1 and x not in self.parts:
                    raise ValueError(f"merge {rank} uses a token made later")
            if new in self.parts:
                raise ValueError(f"merge {rank} makes a token again")
            self.parts[new] = (u, v)
            self.rules[u * self.width + v] = rank
            self.made.append(new)
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes before the end of a text in which later bytes can change a token (see above)."""
        reach: dict[int, int] = {}  # by left part: the longest chain that ends in a rule with it
        longest = 0
        for new in self.made:
            u, v = self.parts[new]
            chain, spine = 0, v
            while True:
                chain = max(chain, reach.get(spine, 0))
                if spine not in self.parts:
                    break
                spine = self.parts[spine][0]
            chain += len(self.tokens[u])
            reach[u] = max(reach.get(u, 0), chain)
            longest = max(longest, chain)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Tokens of ``data`` alone: the pair of least rank is joined, leftmost first, till none is left."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 40:
            return self._merge_by_heap(ids)
        rules, width = self.rules, self.width
        made = self.made
        ranks = [rules.get(a * width + b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rules.get(new * width + ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rules.get(ids[i - 1] * width + new, NONE)
        return ids

    def _merge_by_heap(self, ids: list[int]) -> list[int]:
        """The same with the pairs in a heap and the tokens in a linked list; joined ones become -1."""
        n, rules, width = len(ids), self.rules, self.width
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rules.get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rules.get(ids[i] * width + ids[j]) != rank:
                continue  # one of the two was joined with another token meanwhile
            ids[i], ids[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rules.get(ids[i] * width + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rules.get(ids[h] * width + ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


class Merger:
    """One long piece by parts: emits what the lookahead shows to be stable."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.rest = merges, bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        self.rest += data
        size = MERGE_BYTES + self.merges.lookahead
        while len(self.rest) >= size:
            stable, end = size - self.merges.lookahead, 0
            for token in self.merges.merge(bytes(self.rest[:size])):
                after = end + len(self.merges.tokens[token])
                if after > stable:
                    break
                end = after
                yield token
            del self.rest[:end]

    def close(self) -> list[int]:
        out = self.merges.merge(bytes(self.rest))
        self.rest.clear()
        return out


class Encoder:
    """Text in by parts of any size, tokens out; ``close`` ends the text and starts anew."""

    def __init__(self, merges: Merges, specials: bool = True) -> None:
        self.merges = merges
        self.cache: dict[str, list[int]] = {}  # pieces met since the last turn of generations
        self.older: dict[str, list[int]] = {}  # those met in the one before
        names = sorted(merges.special, key=len, reverse=True) if specials else []
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.heads = {name[:k] for name in names for k in range(1, len(name))}
        self.longest_head = max(map(len, self.heads), default=0)
        self.merger = Merger(merges)
        self.held = ""  # may begin a special token
        self.tail = ""  # the piece that may go on
        self.kind: int | None = None  # of a long piece under way

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        if self.special is None:
            self._cut(part, False, out)
            return out
        part, at = self.held + part, 0
        for found in self.special.finditer(part):
            self._cut(part[at : found.start()], True, out)
            out.append(self.merges.special[found.group()])
            at = found.end()
        rest = part[at:]
        keep = next((k for k in range(min(self.longest_head, len(rest)), 0, -1) if rest[-k:] in self.heads), 0)
        self.held = rest[len(rest) - keep :]
        self._cut(rest[: len(rest) - keep], False, out)
        return out

    def close(self) -> list[int]:
        out: list[int] = []
        self._cut(self.held, True, out)
        self.held = ""
        return out

    def encode(self, text: str) -> list[int]:
        """A whole text, fed by parts."""
        out: list[int] = []
        for lo in range(0, len(text), PART_CHARS):
            out += self.feed(text[lo : lo + PART_CHARS])
        return out + self.close()

    def _cut(self, part: str, last: bool, out: list[int]) -> None:
        text = self.tail + part
        self.tail = ""
        if self.kind is not None:
            text = self._go_on(text, last, out)
        if not text:
            return
        pieces = PIECES.findall(text)
        if not last:
            self.tail = pieces.pop()
            if len(self.tail) == 1 and pieces and pieces[-1] == "'":
                self.tail = pieces.pop() + self.tail  # 'r may become 're
        cache = self.cache
        for piece in pieces:
            known = cache.get(piece)
            if known is None:
                known = self._learn(piece)
                cache = self.cache
            out += known
        if len(self.tail) > LONG:
            self._open(out)

    def _learn(self, piece: str) -> list[int]:
        if len(piece) > LONG:
            return [*self.merger.feed(piece.encode()), *self.merger.close()]
        if len(self.cache) >= CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        ids = self.older.get(piece)
        if ids is None:
            ids = self.merges.merge(piece.encode())
        self.cache[piece] = ids
        return ids

    def _open(self, out: list[int]) -> None:
        """Pass the unfinished piece on; of white space the last one waits, it may belong to what follows."""
        first = self.tail[1] if self.tail[0] == " " else self.tail[0]
        self.kind = next(k for k, one in enumerate(FIRST) if one.match(first))
        keep = 1 if self.kind == WHITE else 0
        out.extend(self.merger.feed(self.tail[: len(self.tail) - keep].encode()))
        self.tail = self.tail[len(self.tail) - keep :]

    def _go_on(self, text: str, last: bool, out: list[int]) -> str:
        """Feed what belongs to the long piece; the text behind it."""
        end = RUNS[self.kind].match(text).end()
        ended = last or end < len(text)
        if self.kind == WHITE and (end < len(text) or not last):
            end -= 1
        out.extend(self.merger.feed(text[:end].encode()))
        if not ended:
            self.tail = text[end:]
            return ""
        out += self.merger.close()
        self.kind = None
        return text[end:]


class Decoder:
    """Tokens in, text out; a broken UTF-8 sequence becomes one U+FFFD, unknown ids are left out."""

    def __init__(self, merges: Merges) -> None:
        self.tokens = merges.tokens
        self.texts: dict[int, str] = {}  # tokens that are whole text by themselves
        for i, token in merges.tokens.items():
            try:
                self.texts[i] = token.decode()
            except UnicodeDecodeError:
                continue
        self._start()

    def _start(self) -> None:
        self.code, self.left, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for i in ids:
            text = self.texts.get(i)
            if text is not None and not self.left:
                out.append(text)
            else:
                for byte in self.tokens.get(i, b""):
                    self._byte(byte, out)
        return "".join(out)

    def close(self) -> str:
        broken = "�" if self.left else ""
        self._start()
        return broken

    def _byte(self, byte: int, out: list[str]) -> None:
        if self.left:
            if self.low <= byte <= self.high:
                self.code, self.left = self.code << 6 | byte & 0x3F, self.left - 1
                self.low, self.high = 0x80, 0xBF
                if not self.left:
                    out.append(chr(self.code))
                return
            out.append("�")
            self._start()
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xDF:
            self.code, self.left = byte & 0x1F, 1
        elif 0xE0 <= byte <= 0xEF:
            self.code, self.left = byte & 0x0F, 2
            # no overlong forms, no surrogates
            self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
        elif 0xF0 <= byte <= 0xF4:
            self.code, self.left = byte & 0x07, 3
            self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
        else:
            out.append("�")


class Codec:
    """What a worker keeps: the merges with an encoder, its cache and a decoder."""

    def __init__(self, model: bytes) -> None:
        self.merges = Merges(model)
        self.encoder, self.decoder = Encoder(self.merges), Decoder(self.merges)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.close()


def codec(model: bytes) -> Codec:
    return held("transducer" + hashlib.sha256(model).hexdigest(), lambda: Codec(model))


def read_model(path: str) -> bytes:
    """A tokenizer file (JSON), read where the driver runs."""
    with open(path, "rb") as file:
        return file.read()


def encode(
    df: DataFrame,
    model: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_decoded: bool = False,
) -> DataFrame:
    """Per row: id, ids (array of int), n_tokens; with ``with_decoded`` also the text decoded.

    Special tokens of the model are found in texts. Null texts count as empty and have
    no tokens. Every row stands for itself, so repeated rows and ids stay as they are;
    an empty table gives an empty one; other columns are not looked at. One pass over
    the scan, no shuffle; the model (a few MB at most) is broadcast. Besides a text and its tokens
    a worker holds the cache of pieces and the transducers' bounded state.
    """
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                coded = [np.array(own.encoder.encode(t or ""), np.int32) for t in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in coded], np.int64)
                columns = {
                    id_col: part.column(0),
                    "ids": lists_of(pa.array(np.concatenate(coded)), sizes),
                    "n_tokens": pa.array(sizes),
                }
                if with_decoded:
                    columns["decoded"] = pa.array([own.decode(x.tolist()) for x in coded], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = rows.schema["_id"].dataType.simpleString()
    more = ", decoded string" if with_decoded else ""
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens bigint{more}")


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``decoded``, the text of the ids; null ids give null, unknown ids nothing."""
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [None if x is None else own.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[id_col, "decoded"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, decoded string")
