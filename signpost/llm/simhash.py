"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint has 64 bits, in three segments of 22, 21 and 21. The binary Golay code
of length 23 is perfect: every word of 23 bits lies within three bits of exactly one
codeword. The code indices of a segment are those of the codewords that itself and
its 23 neighbours at one bit decode to, 1 or 6 of them; two segments that differ in
at most two bits have a neighbour in common and so share an index.

Two fingerprints within two bits agree in at least one whole segment (pigeonhole),
and their next segment differs in at most two bits. So a fingerprint gets the keys
(segment e as it is, one code index of segment e + 1), at most 18 keys of 33 bits and
more, and every pair to link meets under one of them. Distinct fingerprints are
joined by key and verified; fingerprints that share a key with many others are linked
another exact way, see ``linked``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from signpost.llm.components import components
from signpost.llm.exprs import let
from signpost.llm.shipping import ship_code
from signpost.llm.worker import held
from signpost.session import materialize

BANDS = 20
BAND_ROWS = 5
SKETCH = 128
# The segments as (shift, bits), and the code's generator polynomial
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b110001110101
HASH_SEED = 42
CROWD = 32
# Classes of one block, and the standard errors by which a sketch must miss to rule a pair out.
BLOCK = 256
ERRORS = 5
BLOCK_SHINGLES = 1 << 20  # of all classes of a block together


def words_of(text: str) -> list[bytes]:
    """Words between blanks and tab to carriage return, with A to Z lower-cased, as UTF-8."""
    data = text.encode().translate(_LOWER)
    return data.split()


# bytes.split() parts at exactly blank, \t, \n, \v, \f and \r
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words: the whole sequence; none: empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, HASH_SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    begins = ends - lengths + 1
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    pairs = zip(begins[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(view[a:b], HASH_SEED) for a, b in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def code_indices() -> np.ndarray:
    """The index (12 bits) of the codeword nearest to every word of 23 bits."""
    def remainder(words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for bit in range(22, 10, -1):
            out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
        return out

    # the error of up to three bits that leaves each of the 2 ** 11 remainders
    errors = [0]
    for i in range(23):
        errors.append(1 << i)
        for j in range(i):
            errors.append(1 << i | 1 << j)
            errors.extend(1 << i | 1 << j | 1 << k for k in range(j))
    errors = np.array(errors, np.int64)
    fix = np.zeros(1 << 11, np.int64)
    fix[remainder(errors)] = errors
    out = np.empty(1 << 23, np.uint16)
    for lo in range(0, 1 << 23, 1 << 18):
        words = np.arange(lo, lo + (1 << 18), dtype=np.int64)
        out[lo : lo + len(words)] = (words ^ fix[remainder(words)]) >> 11
    return out


def neighbour_indices(segments: np.ndarray) -> np.ndarray:
    """Code indices ``[word, 24]`` of each word of 23 bits and its neighbours, repeats included."""
    indices = held("golay", code_indices)
    masks = np.array([0] + [1 << i for i in range(23)], np.int64)
    return indices[segments[:, None] ^ masks[None, :]]


def keys_of(prints: np.ndarray) -> list[np.ndarray]:
    """The distinct Golay keys of each fingerprint (int64; 60 bits are used)."""
    parts = [(prints >> np.uint64(s)).astype(np.int64) & ((1 << b) - 1) for s, b in SEGMENTS]
    out = []
    for e in range(3):
        near = neighbour_indices(parts[(e + 1) % 3]).astype(np.int64)
        out.append(np.int64(e) << 58 | parts[e][:, None] << 12 | near)
    return [np.unique(row) for row in np.concatenate(out, axis=1)]


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3
) -> DataFrame:
    """``_id``, ``_fp`` (64 bits as a bigint): texts are read once and do not move."""
    ship_code(df.sparkSession)

    @pandas_udf("bigint")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = [fingerprint(shingle_hashes(t or "", width)) for t in texts]
            yield pd.Series(np.array(prints, np.uint64).view(np.int64))

    return df.select(F.col(id_col).alias("_id"), sign(F.col(text_col)).alias("_fp"))


def linked(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``a``-``b`` that connect all distinct ``_fp`` within two bits of each other.

    Under a key with at most ``crowd`` fingerprints every pair is compared. Those of a
    more crowded key are linked through what lies between them: two fingerprints are
    within two bits exactly if some word is within one bit of both. Each sends itself
    and its 64 neighbours as words; all that send one word are linked with the
    smallest of them. That is linear whatever the crowd, and loses no link that
    connects, though fewer pairs are listed.
    """
    ship_code(prints.sparkSession)

    @pandas_udf("array<bigint>")
    def golay(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(keys_of(values.to_numpy(np.int64).view(np.uint64)))

    keyed = materialize(prints.select("_fp", F.explode(golay("_fp")).alias("_key")))
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    met = materialize(keyed.join(sizes, "_key"))
    few = met.filter(F.col("_n") <= crowd).select("_key", "_fp")
    listed = few.groupBy("_key").agg(F.collect_list("_fp").alias("_all"))
    pairs = (
        listed.select(F.explode("_all").alias("a"), "_all")
        .select("a", F.explode(F.filter("_all", lambda b: (b > F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(b)) <= 2))).alias("b"))
        .distinct()
    )
    crowded = met.filter(F.col("_n") > crowd).select("_fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    sent = crowded.select("_fp", F.explode(F.transform(flips, lambda m: F.col("_fp").bitwiseXOR(m))).alias("_word"))
    centres = sent.groupBy("_word").agg(F.min("_fp").alias("a"), F.count("*").alias("_n")).filter("_n > 1")
    stars = sent.join(centres.select("_word", "a"), "_word").filter("a <> _fp").select("a", F.col("_fp").alias("b")).distinct()
    return pairs.union(stars)


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, crowd: int = CROWD
) -> DataFrame:
    """Per row: id, ``_fp``, component_id (the smallest id reachable, itself included).

    Rows with one fingerprint are one class, so copies are never paired. Null and
    empty texts have fingerprint 0, linked like any other. Repeated ids stay rows; a
    null id is not the smallest unless its component has no other. An empty table
    gives an empty result; other columns are not looked at.
    """
    signed = materialize(fingerprints(df, id_col, text_col, width))
    classes = materialize(signed.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(linked(classes.select("_fp"), crowd))
    rooted = classes.join(roots, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = materialize(rooted.join(least, "_root").select(F.col("_fp").alias("_class"), "component_id"))
    return signed.join(named, F.col("_fp") == F.col("_class")).select(
        F.col("_id").alias(id_col), "_fp", "component_id"
    )


# ---- by similarity ------------------------------------------------------------------


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """Keys of BANDS bands of BAND_ROWS least hashes each; two sets of Jaccard likeness j
    share a band with probability j ** BAND_ROWS."""
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(distinct), 4096):
            part = distinct[lo : lo + 4096, None] * factors[None, :]
            part ^= part >> np.uint64(32)
            part *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least, part.min(axis=0), out=least)
        least = least.reshape(BANDS, BAND_ROWS)
        key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in range(BAND_ROWS):
            key = (key ^ least[:, row]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key


def least_of(distinct: np.ndarray) -> np.ndarray:
    """The SKETCH smallest hashes by their upper 31 bits (of sorted hashes): half the bytes to move."""
    return np.unique((distinct[: SKETCH + 8] >> np.uint64(33)).astype(np.int32))[:SKETCH]


def set_hash(distinct: np.ndarray) -> np.int64:
    """Hash of a set of shingle hashes (sorted)."""
    whole = xxhash.xxh64_intdigest(distinct.tobytes()) if len(distinct) else 0
    return np.uint64(whole).view(np.int64)


def text_tie(text_col: str) -> Column:
    """Hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``_id``, ``_tie`` (hash of the text), ``_set`` (hash of the set of shingles), ``_fp``, ``_bands``."""
    ship_code(df.sparkSession)

    @pandas_udf("_set bigint, _fp bigint, _bands array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                hashes = shingle_hashes(t or "", width)
                distinct = np.unique(hashes)
                rows.append((
                    set_hash(distinct), np.uint64(fingerprint(hashes)).view(np.int64),
                    band_keys(distinct).view(np.int64),
                ))
            yield pd.DataFrame(rows, columns=["_set", "_fp", "_bands"])

    found = df.select(F.col(id_col).alias("_id"), text_tie(text_col).alias("_tie"), sign(F.col(text_col)).alias("s"))
    return found.select("_id", "_tie", "s._set", "s._fp", "s._bands")


def whole_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``_set``, ``_n``, ``_sketch``, ``_whole`` (all shingle hashes) of the ``wanted`` (``_set``, ``_id``, ``_tie``)."""

    @pandas_udf("_n int, _sketch array<int>, _whole array<bigint>")
    def open_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            # whole sets are larger than the texts: few at a time
            for lo in range(0, len(texts), 256):
                rows = []
                for t in texts.iloc[lo : lo + 256]:
                    distinct = np.unique(shingle_hashes(t or "", width))
                    rows.append((len(distinct), least_of(distinct), distinct.view(np.int64)))
                yield pd.DataFrame(rows, columns=["_n", "_sketch", "_whole"])

    texts = df.select(F.col(id_col).alias("_did"), text_tie(text_col).alias("_dtie"), F.col(text_col).alias("_text"))
    found = texts.join(wanted, (F.col("_dtie") == F.col("_tie")) & F.col("_did").eqNullSafe(F.col("_id")))
    one = found.dropDuplicates(["_set"]).select("_set", open_up("_text").alias("s"))
    return one.select("_set", "s._n", "s._sketch", "s._whole")


def alike(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sorted bottom-SKETCH sketches.

    Exact for sets of at most SKETCH shingles together, else an estimate from the
    SKETCH smallest of both (standard error 0.035 at 0.8). Two empty sketches: null.
    """
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return let(
        union, lambda u: F.try_divide(F.size(F.array_intersect(F.array_intersect(u, a), b)), F.size(u))
    )


def floor_of(similarity: float) -> float:
    """The likeness by sketch that is ERRORS standard errors below ``similarity``."""
    return similarity - ERRORS * (similarity * (1 - similarity) / SKETCH) ** 0.5


def likeness_of_blocks(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Likeness by sketch of every pair ``[left, right]``.

    Up to the smaller of two sketches' last values both sets are known in full, so
    the estimate counts what lies below; at least SKETCH hashes of the union do.
    """
    end = np.iinfo(np.int64).max
    last = [np.array([s[-1] if len(s) >= SKETCH else end for s in side], np.int64) for side in (left, right)]
    known = np.minimum(last[0][:, None], last[1][None, :])
    below_l = np.stack([np.searchsorted(s, known[i], "right") for i, s in enumerate(left)])
    below_r = np.stack([np.searchsorted(s, known[:, j], "right") for j, s in enumerate(right)], axis=1)
    sides = []
    for side in (left, right):
        rows = np.repeat(np.arange(len(side)), [len(s) for s in side])
        sides.append((np.concatenate(side), rows))
    common = np.intersect1d(sides[0][0], sides[1][0])
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), 4096):
        part = common[lo : lo + 4096]
        ones = []
        for (values, rows), side in zip(sides, (left, right), strict=True):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            grid = np.zeros((len(side), len(part)), np.float32)
            grid[rows[hit], at[hit]] = 1
            ones.append(grid)
        both += ones[0] @ ones[1].T
    return both / np.maximum(below_l + below_r - both, 1)


def in_blocks(rows: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``rows`` (``_key``, ``_set``, ``_root``, ``_n``, ..) for every meeting of two blocks of a key.

    Every class of a key is in one block (``_own``) of about ``block`` classes and
    ``shingles`` shingles, the key's most common root in blocks of its own, which needn't meet each
    other; every other pair of blocks meets in one group (``_key``, ``_lo``, ``_hi``).
    """
    by_root = rows.groupBy("_key", "_root").agg(F.count("*").alias("_c"), F.sum("_n").alias("_s"))
    most = F.max_by(F.struct("_root", "_c", "_s"), F.struct("_c", "_root"))
    plan = by_root.groupBy("_key").agg(most.alias("_m"), F.sum("_c").alias("_all"), F.sum("_s").alias("_size"))

    def blocks(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / block), F.ceil(size / shingles))

    large = blocks(F.col("_m._c"), F.col("_m._s"))
    small = blocks(F.col("_all") - F.col("_m._c"), F.col("_size") - F.col("_m._s"))
    plan = plan.select("_key", F.col("_m._root").alias("_main"), large.alias("_large"), small.alias("_small"))
    main = F.col("_root") == F.col("_main")
    here = F.pmod(F.xxhash64(F.lit(1), "_set"), F.when(main, F.col("_large")).otherwise(F.col("_small")))
    zero = F.lit(0).cast("bigint")
    meets = F.when(main, F.sequence(zero, F.col("_small") - 1)).otherwise(
        F.sequence(zero, F.col("_small") + F.col("_large") - 1)
    )
    return (
        rows.join(plan, "_key")
        .withColumn("_own", F.when(main, here + F.col("_small")).otherwise(here))
        .withColumn("_other", F.explode(meets))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
        .drop("_main", "_large", "_small", "_other")
    )


def still_open(meetings: DataFrame, similarity: float) -> DataFrame:
    """``_key``, ``_lo``, ``_hi``, ``_own``, ``_set``, ``_root`` of the classes that, by the sketches, may be
    linked with one of another root in their meeting.

    ``meetings``: ``in_blocks`` with ``_bands`` and ``_sketch``. A pair that shares several
    keys counts under the first of them. What comes out is some of what went in, however
    many pairs are alike.
    """
    kind = "_key bigint, _lo bigint, _hi bigint, _own bigint, _set bigint, _root bigint"
    names = [c.split()[0] for c in kind.split(", ")]

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["_lo"].iloc[0], group["_hi"].iloc[0]
        left, right = group[group["_own"] == lo], group[group["_own"] == hi]
        if left.empty or right.empty:
            return group[names].iloc[:0]
        sets = [side["_set"].to_numpy(np.int64) for side in (left, right)]
        roots = [side["_root"].to_numpy(np.int64) for side in (left, right)]
        sizes = [side["_n"].to_numpy(np.int64) for side in (left, right)]
        open_pairs = roots[0][:, None] != roots[1][None, :]
        if lo == hi:
            open_pairs &= sets[0][:, None] < sets[1][None, :]
        open_pairs &= np.minimum(sizes[0][:, None], sizes[1]) >= similarity * np.maximum(sizes[0][:, None], sizes[1])
        bands = [np.stack(side["_bands"].to_list()) for side in (left, right)]
        at = int(np.flatnonzero(bands[0][0] == group["_key"].iloc[0])[0])
        for k in range(at):
            open_pairs &= bands[0][:, k][:, None] != bands[1][:, k]
        open_pairs &= likeness_of_blocks(left["_sketch"].to_list(), right["_sketch"].to_list()) >= floor_of(similarity)
        i, j = open_pairs.any(axis=1), open_pairs.any(axis=0)
        if lo == hi:
            return left.loc[i | j, names]
        return pd.concat([left.loc[i, names], right.loc[j, names]])

    return meetings.groupBy("_key", "_lo", "_hi").applyInPandas(meet, kind)


def likeness_of_sets(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard likeness of every pair ``[left, right]`` of sets, none of them empty, exactly."""
    sides = [(np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])) for side in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    if left is right:
        values, counts = np.unique(sides[0][0], return_counts=True)
        common = values[counts > 1]  # what one set alone has is common to no pair
    both = np.zeros((len(left), len(right)))
    for lo in range(0, len(common), 4096):
        part, ones = common[lo : lo + 4096], []
        for (values, rows), side in zip(sides, (left, right), strict=True):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            grid = np.zeros((len(side), len(part)), np.float32)
            grid[rows[hit], at[hit]] = 1
            ones.append(grid)
        both += ones[0] @ ones[1].T
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    return both / (sizes[0][:, None] + sizes[1][None, :] - both)


def links_in_blocks(open_rows: DataFrame, wholes: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: links of classes decided on their whole sets, of every meeting those that connect.

    A meeting puts out a forest over its roots: at most one link less than it has classes,
    however many of its pairs are alike.
    """

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["_lo"].iloc[0], group["_hi"].iloc[0]
        left, right = group[group["_own"] == lo], group[group["_own"] == hi]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [left["_whole"].to_list()]
        sets.append(sets[0] if lo == hi else right["_whole"].to_list())
        i, j = np.nonzero(likeness_of_sets(*sets) >= similarity)
        names = [side["_set"].to_numpy(np.int64).tolist() for side in (left, right)]
        roots = [side["_root"].to_numpy(np.int64).tolist() for side in (left, right)]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(roots[0][x]), top(roots[1][y])
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((names[0][x], names[1][y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    sent = open_rows.join(wholes.select("_set", "_whole"), "_set")
    return sent.groupBy("_key", "_lo", "_hi").applyInPandas(meet, "a bigint, b bigint")


def near_classes(
    df: DataFrame, id_col: str, text_col: str, width: int, similarity: float, crowd: int
) -> tuple[DataFrame, DataFrame]:
    """The rows' ``signatures``, written, and per class ``_set`` the ``_root`` of its group."""
    signed = materialize(signatures(df, id_col, text_col, width))
    classes = materialize(
        signed.groupBy("_set").agg(
            F.min(F.struct("_id", "_tie")).alias("_one"),
            F.first("_fp").alias("_fp"),
            F.first("_bands").alias("_bands"),
        )
    )
    by_print = classes.groupBy("_fp").agg(F.min("_set").alias("_rep"))
    same_print = classes.join(by_print, "_fp").filter("_set <> _rep").select(F.col("_rep").alias("a"), F.col("_set").alias("b"))
    print_links = linked(by_print.select("_fp"), crowd)
    prints = (
        print_links.join(by_print.select(F.col("_fp").alias("a"), F.col("_rep").alias("ra")), "a")
        .join(by_print.select(F.col("_fp").alias("b"), F.col("_rep").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    keyed = classes.select("_set", F.explode("_bands").alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_set").alias("_hub")).filter("_n > 1")
    met = materialize(keyed.join(sizes, "_key").withColumnRenamed("_n", "_met"))
    stars = met.select(F.col("_hub").alias("a"), F.col("_set").alias("b"))
    first = materialize(
        stars.union(same_print).union(prints).filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    wanted = first.select(F.col("a").alias("_set")).union(first.select("b")).distinct()
    wholes = materialize(
        whole_sets(df, classes.select("_set", "_one.*").join(wanted, "_set", "left_semi"), id_col, text_col, width)
    )
    sketches = wholes.select("_set", "_n", "_sketch")

    def sketched(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketches.select(F.col("_set").alias("a"), F.col("_n").alias("na"), F.col("_sketch").alias("sa")), "a")
        both = both.join(sketches.select(F.col("_set").alias("b"), F.col("_n").alias("nb"), F.col("_sketch").alias("sb")), "b")
        sized = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
        return both.filter(sized).filter(alike(F.col("sa"), F.col("sb")) >= floor_of(similarity)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(wholes.select(F.col("_set").alias("a"), F.col("_whole").alias("wa")), "a")
        both = both.join(wholes.select(F.col("_set").alias("b"), F.col("_whole").alias("wb")), "b")
        met_in = let(
            F.size(F.array_intersect("wa", "wb")), lambda n: F.try_divide(n, F.size("wa") + F.size("wb") - n)
        )
        return materialize(both.filter(met_in >= similarity).select("a", "b"))

    links = verified(sketched(first))
    # What the hubs connect needs no further pair; all others that share a key are compared.
    roots = components(links)
    rooted = materialize(
        met.join(roots, F.col("_set") == F.col("node"), "left").select(
            "_key", "_met", "_set", F.coalesce("root", "_set").alias("_root")
        )
    )
    parted = rooted.groupBy("_key").agg(F.min("_root").alias("_u"), F.max("_root").alias("_v")).filter("_u <> _v")
    still = materialize(rooted.join(parted.select("_key"), "_key"))
    few = still.filter((F.col("_met") <= crowd) & (F.col("_met") > 2)).groupBy("_key").agg(
        F.collect_list(F.struct("_set", "_root")).alias("_all")
    )
    pairs = (
        few.select(F.explode("_all").alias("x"), "_all")
        .select(
            F.col("x._set").alias("a"),
            F.explode(F.filter("_all", lambda y: (y["_set"] > F.col("x._set")) & (y["_root"] != F.col("x._root")))).alias("y"),
        )
        .select("a", F.col("y._set").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    many = still.filter(F.col("_met") > crowd).join(classes.select("_set", "_bands"), "_set").join(sketches, "_set")
    open_rows = materialize(still_open(in_blocks(materialize(many.drop("_met"))), similarity))
    blocks = links_in_blocks(open_rows, wholes, similarity)
    ends = components(links.union(verified(sketched(pairs))).union(materialize(blocks)))
    named = classes.select("_set").join(ends, F.col("_set") == F.col("node"), "left")
    return signed, materialize(named.select("_set", F.coalesce("root", "_set").alias("_root")))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    crowd: int = CROWD,
) -> DataFrame:
    """Per row: id, component_id (smallest id of its group of near duplicates).

    Links are pairs of texts whose shingle sets are alike by ``similarity`` or more.
    Candidates come from fingerprints within two bits (Golay keys) and, as 64 bits
    can't see a likeness of 0.8 at two bits, from bands of least hashes. Texts with
    one set of shingles are one class, so copies are never paired. Each class is
    compared with the smallest under each of its band keys; then all pairs that share
    a key and are not connected yet, under keys with more than ``crowd`` classes in
    blocks that put out no more links than they have classes. Sketches rule out what is
    ERRORS standard errors below; every other pair is decided on the whole sets. Null and empty texts are one class. Ids are
    whole numbers; every row has the answer of its own text, also among repeated and
    null ids; an empty table gives an empty result.
    """
    signed, named = near_classes(df, id_col, text_col, width, similarity, crowd)
    rows = materialize(signed.select("_id", "_set").join(named, "_set"))
    least = rows.groupBy("_root").agg(F.min("_id").alias("component_id"))
    return rows.join(least, "_root").select(F.col("_id").alias(id_col), "component_id")


def one_per_group(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    crowd: int = CROWD,
) -> DataFrame:
    """``df`` with one row of each group of near duplicates: the one with the smallest id.

    All columns stay. A row is found again by id and text, so rows that share an id,
    or have none, are told apart; a row without an id is kept if its group has no
    other. Of rows equal in id and text one stays.
    """
    signed, named = near_classes(df, id_col, text_col, width, similarity, crowd)
    rows = signed.select("_id", "_tie", "_set").join(named, "_set")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_kid"), F.col("_tie").alias("_ktie"))
    best = rows.groupBy("_root").agg(F.min(order).alias("k")).select("k._kid", "k._ktie")
    counts = signed.groupBy("_id", "_tie").agg(F.count("*").alias("_n"))
    same = F.col("_kid").eqNullSafe(F.col("_id")) & (F.col("_ktie") == F.col("_tie"))
    keep = materialize(best.join(counts, same).select("_kid", "_ktie", "_n"))
    packed = df.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), text_tie(text_col).alias("_tie"))
    if not keep.filter("_n > 1").limit(1).count():
        return packed.join(keep, same, "left_semi").select("_doc.*")
    alone = packed.join(keep.filter("_n = 1"), same, "left_semi")
    copied = packed.join(keep.filter("_n > 1"), same, "left_semi").dropDuplicates(["_id", "_tie"])
    return alone.union(copied).select("_doc.*")
