"""Mixing sources to target weights in fixed-length blocks.

The words of a source, its documents one after the other in a pseudorandom order,
are cut into blocks of a fixed number of words. A source gets as many slots as its
target holds blocks; the slots are drawn over the output shards by a multinomial
draw per source, numbered through the shards, and slot i takes block
``perm(i mod blocks)`` of pass ``i div blocks``, where perm is a pseudorandom
permutation of the source's block numbers for that pass. Documents meet the drawn
blocks in a join on (source, block): texts never move, and a source that holds most
rows is as spread as its blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.exprs import NOT_SPACE, words
from signpost.llm.shipping import ship_code
from signpost.operators.ranking import global_index
from signpost.session import materialize

BLOCK = 64
SHARDS = 64
BUCKETS = 1024
CHUNK = 1 << 16


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0 .. n - 1 sends ``index``.

    Four Feistel rounds on the next even number of bits; a value beyond n goes
    through again until it falls below, which keeps it a permutation. Nothing of
    size n is held.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    mixed = (key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
    keys = [np.uint64((mixed * (2 * r + 3) ^ (mixed >> 29)) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(29)) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (beyond := out >= np.uint64(n)).any():
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``_id``, ``_source``, ``_tie``, ``size`` (words; null text: 0), written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(
        df.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            F.xxhash64(text).alias("_tie"),
            F.size(words(text)).cast("bigint").alias("size"),
        )
    )


def source_targets(
    rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``_source``, ``_k`` (its number), ``source_size``, ``target`` in words.

    Sources in order of code points (null last) weigh ``weights``, repeated, and
    share ``share`` times all words. A target stops at ``most`` times its source's
    size and the excess is shared by weight among the others, again and again until
    none is above. Only sums over the table of sources reach the driver.
    """
    sums = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    keyed = sums.withColumn("_key", F.struct(F.col("_source").isNull(), F.col("_source")))
    weight = F.get(F.lit([float(w) for w in weights]), F.pmod(F.col("_k"), F.lit(len(weights))).cast("int"))
    sources = materialize(
        global_index(keyed, "_key", "_k")
        .drop("_key")
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    )
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    goal, full, rate = share * total, -1, 0.0
    while True:
        at_cap = F.col("_w") * F.lit(rate) > F.col("_cap")
        row = sources.agg(
            F.count(F.when(at_cap, 1)).alias("full"),
            F.coalesce(F.sum(F.when(at_cap, F.col("_cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~at_cap, F.col("_w"))), F.lit(0.0)).alias("w"),
        ).first()
        if row["full"] == full or not row["w"]:
            break
        full, rate = row["full"], (goal - row["held"]) / row["w"]
    return sources.select(
        "_source",
        "_k",
        "source_size",
        F.least(F.col("_w") * F.lit(rate), F.col("_cap")).alias("target"),
    )


def placed(rows: DataFrame, sources: DataFrame, block: int = BLOCK, buckets: int = BUCKETS, seed: int = 0) -> DataFrame:
    """Rows with the place of their first word in their source (``_off``), and ``_k``.

    The order inside a source is a hash of the id, then id and text. A running sum
    over a whole source would be one task: sums per (source, bucket of the hash) are
    added up first, and rows inside their bucket.
    """
    hashed = (
        rows.join(sources.select("_source", "_k").alias("s"), F.col("s._source").eqNullSafe(rows["_source"]))
        .drop(F.col("s._source"))
        .withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id").cast("string"), F.col("_tie")))
        .withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets)))
    )
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_k", "_bucket")
        .agg(F.sum("size").alias("_n"))
        .select("_k", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy("_k", "_bucket")
        .orderBy("_h", "_id", "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hashed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["_k", "_bucket"])
        .withColumn("_off", F.col("_start") + F.col("_in"))
        .drop("_h", "_bucket", "_in", "_start")
    )


def drawn_slots(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix: ``_k``, ``shard``, ``slot`` (within source), ``_block``, one row per block drawn.

    Slots per source: its target over the mean words of its blocks, at most twice
    its blocks. Their spread over the shards is one multinomial draw per source;
    draws and permutations are seeded by the source's number, so reruns agree.
    """
    ship_code(sources.sparkSession)
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    plan = (
        sources.filter("source_size > 0")
        .withColumn("_blocks", blocks)
        .withColumn(
            "_slots",
            F.least(
                F.round(F.col("target") * F.col("_blocks") / F.col("source_size")).cast("bigint"),
                2 * F.col("_blocks"),
            ),
        )
        .select("_k", "_blocks", "_slots")
    )

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, n, slots in frame.itertuples(index=False):
                rng = np.random.default_rng([seed, int(k)])
                counts = rng.multinomial(int(slots), [1.0 / shards] * shards)
                ends = np.cumsum(counts)
                rows = [
                    (k, n, s, lo, min(lo + CHUNK, int(end)))
                    for s, (c, end) in enumerate(zip(counts, ends, strict=True))
                    for lo in range(int(end - c), int(end), CHUNK)
                ]
                yield pd.DataFrame(rows, columns=["_k", "_blocks", "shard", "_lo", "_hi"])

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, n, shard, lo, hi in frame.itertuples(index=False):
                slot = np.arange(lo, hi, dtype=np.int64)
                block_no = np.empty_like(slot)
                for turn in np.unique(slot // n):
                    own = slot // n == turn
                    key = (int(seed) * 1_000_003 + int(k)) * 4 + int(turn)
                    block_no[own] = permuted(slot[own] % n, int(n), key)
                yield pd.DataFrame({"_k": k, "shard": shard, "slot": slot, "_block": block_no})

    kinds = "_k bigint, _blocks bigint, shard int, _lo bigint, _hi bigint"
    # chunks of bounded size over as many tasks as a shuffle has; the number is named, since rows
    # this few would be put together into one task, and each makes up to CHUNK others
    tasks = max(shards, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = plan.mapInPandas(shares, kinds).repartition(tasks, "_k", "shard", "_lo")
    return chunks.mapInPandas(slots, "_k bigint, shard int, slot bigint, _block bigint")


def pieces(located: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document and block it has words in: ``_block``, ``_from`` (its first word there), ``_n``."""
    first = F.call_function("div", F.col("_off"), F.lit(block))
    last = F.call_function("div", F.col("_off") + F.col("size") - 1, F.lit(block))
    start = F.greatest(F.col("_off"), F.col("_block") * block)
    end = F.least(F.col("_off") + F.col("size"), (F.col("_block") + 1) * block)
    return (
        located.filter("size > 0")
        .withColumn("_block", F.explode(F.sequence(first, last)))
        .withColumn("_from", start - F.col("_off"))
        .withColumn("_n", end - start)
    )


def mix_words(
    df: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = 0,
) -> DataFrame:
    """Per row of ``df``: id, size, source_size, target, taken (words the mix takes).

    A null text has no words and a null source is a source of its own; both keep
    their row. Rows with one id are rows of their own, told apart by text; rows equal
    in id and text share what is taken evenly by place. An empty table, or one
    without words, has targets and takes of 0. Other columns are not looked at.
    """
    rows = sized(df, id_col, text_col, source_col)
    sources = materialize(source_targets(rows, weights, share))
    # a key of its own for every row, fixed by writing it
    located = materialize(
        placed(rows, sources, block, BUCKETS, seed).withColumn("_row", F.monotonically_increasing_id())
    )
    times = drawn_slots(sources, block, shards, seed).groupBy("_k", "_block").agg(F.count("*").alias("_times"))
    taken = (
        pieces(located, block)
        # as many rows as there are blocks: merged, never held whole by a task
        .join(times.hint("shuffle_merge"), ["_k", "_block"])
        .groupBy("_row")
        .agg(F.sum(F.col("_n") * F.col("_times")).alias("_taken"))
    )
    return (
        located.join(taken, "_row", "left")
        .join(sources.select("_k", "source_size", "target"), "_k")
        .select(
            F.col("_id").alias(id_col),
            "size",
            "source_size",
            "target",
            F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"),
        )
    )


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word, spaces as they are."""

    def chars(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, n.cast("int")), F.lit(0), lambda a, x: a + F.length(x))

    gaps = F.split(text, NOT_SPACE + "+", -1)
    return F.substring(text, F.lit(1), chars(words(text)) + chars(gaps))


def mixed_documents(
    df: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> DataFrame:
    """Documents in the mix: the words of every source meet its target to the word.

    A source that is to give q times its words and r more gives all its documents q
    times, and in their pseudorandom order the documents that hold its first r words
    once more; the one in which they end is cut after the last of them. So a source at
    or above its size loses no document. All columns of ``df`` stay; only the text is
    cut. A document without words comes once. Rows equal in id and text can't be told
    apart: what they give is dealt out among them.
    """
    rows = sized(df, id_col, text_col, source_col)
    sources = materialize(source_targets(rows, weights, share))
    located = placed(rows, sources, seed=seed).join(sources.select("_k", "source_size", "target"), "_k")
    turns = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round(F.col("target") - turns * F.col("source_size")).cast("bigint")
    piece = F.least(F.greatest(rest - F.col("_off"), F.lit(0)), F.col("size"))

    # one key without nulls for the window and the join: texts cross one exchange
    def key(id_of: str, tie: Column) -> Column:
        return F.xxhash64(F.lit("row"), F.col(id_of).cast("string"), tie)

    # the lengths in words in which a row comes, one per time it comes
    cuts = F.when(F.col("size") == 0, F.array(F.col("size"))).otherwise(
        F.concat(
            F.array_repeat(F.col("size"), turns.cast("int")),
            F.when(piece > 0, F.array(piece)).otherwise(F.array().cast("array<bigint>")),
        )
    )
    takes = materialize(
        located.select(key("_id", F.col("_tie")).alias("_dkey"), F.col("_tie").alias("_dtie"), "size", cuts.alias("_cuts"))
        .groupBy("_dkey", "_dtie", "size")
        .agg(F.collect_list("_cuts").alias("_takes"))
    )
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    packed = df.select(F.struct("*").alias("_doc"), tie.alias("_dtie"), key(id_col, tie).alias("_dkey"))
    nth = F.row_number().over(Window.partitionBy("_dkey", "_dtie").orderBy(F.lit(1)))
    joined = packed.withColumn("_nth", nth).join(takes, ["_dkey", "_dtie"])
    text = F.col(f"_doc.`{text_col}`")
    cut = F.when(F.col("_cut") < F.col("size"), first_words(text, F.col("_cut"))).otherwise(text)
    return (
        joined.select("_doc", "size", F.explode(F.get("_takes", F.col("_nth") - 1)).alias("_cut"))
        .select(F.col("_doc").withField(f"`{text_col}`", cut).alias("_doc"))
        .select("_doc.*")
    )


def drawn_texts(text: Column, parts: Column) -> Column:
    """The texts a row gives: per time, each run of neighbouring drawn words, spaces inside as they are.

    ``parts`` are (_from, _n, _times) in order. A run from the first word to the last is
    the whole text. The words are found once, in time linear in the text.
    """
    not_space = NOT_SPACE + "+"

    def cut(text: str, parts: list[dict]) -> list[str]:
        ends = [m.span() for m in re.finditer(not_space, text)]
        out = []
        for time in range(1, max(p["_times"] for p in parts) + 1):
            runs: list[list[int]] = []
            for p in parts:
                if p["_times"] >= time:
                    if runs and runs[-1][1] == p["_from"]:
                        runs[-1][1] += p["_n"]
                    else:
                        runs.append([p["_from"], p["_from"] + p["_n"]])
            for lo, hi in runs:
                out.append(text[ends[lo][0] if lo else 0 : ends[hi - 1][1] if hi < len(ends) else len(text)])
        return out

    @F.arrow_udf("array<string>")
    def cut_all(texts: pa.Array, parts: pa.Array) -> pa.Array:
        made = (None if t is None else cut(t, p) for t, p in zip(map(_value, texts), map(_value, parts)))
        return pa.array(made, pa.list_(pa.string()))

    return cut_all(text, parts)


def _value(scalar: pa.Scalar):
    return scalar.as_py()


def drawn_documents(
    df: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = 0,
) -> DataFrame:
    """Documents in the mix of ``mix_words``: what the drawn blocks hold of every document.

    A document all of whose blocks are drawn comes whole, once per time; of any other
    comes, per time, one row for each run of neighbouring words that are drawn, so
    that every source gives the words ``taken`` says, and texts that were apart are
    not put together. All columns of ``df`` stay; only the text is cut. A document without
    words comes once. Of rows equal in id and text each gives what one of their places is drawn.
    """
    ship_code(df.sparkSession)
    rows = sized(df, id_col, text_col, source_col)
    sources = materialize(source_targets(rows, weights, share))
    located = materialize(
        placed(rows, sources, block, BUCKETS, seed).withColumn("_row", F.monotonically_increasing_id())
    )
    times = drawn_slots(sources, block, shards, seed).groupBy("_k", "_block").agg(F.count("*").alias("_times"))
    drawn = (
        pieces(located, block)
        .join(times.hint("shuffle_merge"), ["_k", "_block"])
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("_from", "_n", "_times"))).alias("_parts"))
    )

    # one key without nulls for the window and the join: texts cross one exchange
    def key(id_of: str, tie: Column) -> Column:
        return F.xxhash64(F.lit("row"), F.col(id_of).cast("string"), tie)

    takes = materialize(
        located.join(drawn, "_row", "left")
        .select(key("_id", F.col("_tie")).alias("_dkey"), F.col("_tie").alias("_dtie"), F.struct("size", "_parts").alias("_take"))
        .groupBy("_dkey", "_dtie")
        .agg(F.collect_list("_take").alias("_takes"))
    )
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    packed = df.select(F.struct("*").alias("_doc"), tie.alias("_dtie"), key(id_col, tie).alias("_dkey"))
    nth = F.row_number().over(Window.partitionBy("_dkey", "_dtie").orderBy(F.lit(1)))
    joined = (
        packed.withColumn("_nth", nth)
        .join(takes, ["_dkey", "_dtie"])
        .withColumn("_take", F.get("_takes", F.col("_nth") - 1))
        .select("_doc", "_take.size", "_take._parts")
        .filter("size = 0 OR _parts IS NOT NULL")
    )
    text = F.col(f"_doc.`{text_col}`")
    counts = F.transform("_parts", lambda p: p["_times"])
    words_in = F.aggregate("_parts", F.lit(0).cast("bigint"), lambda a, p: a + p["_n"])
    whole = (F.col("size") == 0) | ((words_in == F.col("size")) & (F.array_min(counts) == F.array_max(counts)))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.array_max(counts)).cast("int")
    # only texts that are cut go to Python
    given = joined.withColumn("_whole", whole).withColumn(
        "_cut", drawn_texts(F.when(~F.col("_whole"), text), F.when(~F.col("_whole"), F.col("_parts")))
    )
    texts = F.when(F.col("_whole"), F.array_repeat(text, copies)).otherwise(F.col("_cut"))
    return (
        given.select("_doc", F.explode(texts).alias("_text"))
        .select(F.col("_doc").withField(f"`{text_col}`", F.col("_text")).alias("_doc"))
        .select("_doc.*")
    )


def packed_blocks(
    df: DataFrame, slots: DataFrame, located: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """The text of every drawn block: shard, slot, ``_k``, ``_block``, text.

    Each block is gathered from at most ``block`` pieces of documents.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(F.col(id_col).alias("_did"), F.xxhash64(text).alias("_dtie"), words(text).alias("_words"))
    cut = (
        pieces(located, block)
        .join(split.dropDuplicates(["_did", "_dtie"]), F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_tie") == F.col("_dtie")))
        .select(
            "_k",
            "_block",
            F.struct(
                (F.col("_off") + F.col("_from")).alias("at"),
                F.slice("_words", (F.col("_from") + 1).cast("int"), F.col("_n").cast("int")).alias("w"),
            ).alias("part"),
        )
    )
    texts = cut.groupBy("_k", "_block").agg(
        F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["w"])), " ").alias("text")
    )
    return slots.join(texts, ["_k", "_block"]).select("shard", "slot", "_k", "_block", "text")
