"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) of a ring; a row belongs to the first
point clockwise of its hash. A shard takes rows up to its capacity; rows that find
it full go on clockwise to the next shard with room. With capacities that add up
to the number of rows the shards are equal to within one row, and a change in the
number of shards moves little more than the rows the new shard takes.

The ring is cut into ``2 ** cell_bits`` cells and points stand on cell borders, so
that a cell has one owner. Only the number of rows per cell (a table of bounded
size) reaches the driver, which walks the ring once and says for each cell which of
its ranks go to which shard, and at which slot they start. Rows are then ranked
inside their cell, a window of narrow rows over many small groups, and look their
shard up. Texts never move.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECES = T.StructType(
    [
        T.StructField("_pc", T.IntegerType()),
        T.StructField("_from", T.LongType()),
        T.StructField("_to", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("_slot", T.LongType()),
    ]
)


def ring_owners(shards: int, vnodes: int = 128, cell_bits: int = 13, seed: int = 0) -> list[int]:
    """The shard that owns each cell of the ring.

    A point's place depends on its shard and its number alone, so a further shard
    adds points and moves none. Two points on one border: the smaller shard's stays.
    """
    cells = 1 << cell_bits
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"{seed}:{shard}:{v}".encode(), digest_size=8).digest()
            points.setdefault(int.from_bytes(digest, "big") % cells, shard)
    owners = [0] * cells
    # the first point clockwise, round the end of the ring if need be
    owner = points[min(points)]
    for cell in range(cells - 1, -1, -1):
        owner = points.get(cell, owner)
        owners[cell] = owner
    return owners


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Room per shard: an equal part, the first shards one row more; ``slack`` adds to it."""
    base, extra = divmod(rows, shards)
    room = [base + (s < extra) for s in range(shards)]
    return [r + int(r * slack) for r in room]


def bounded_pieces(
    counts: dict[int, int], owners: list[int], room: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for every part of every cell.

    All rows try their owner first, in ring order; those it has no room for wait in
    a queue that goes on clockwise and is served first come, first served.
    """
    free = list(room)
    slots = [0] * len(room)
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(cell: int, start: int, n: int, shard: int) -> None:
        pieces.append((cell, start, start + n, shard, slots[shard]))
        slots[shard] += n
        free[shard] -= n

    over: dict[int, tuple[int, int]] = {}
    for cell in sorted(counts):
        n = counts[cell]
        taken = min(n, free[owners[cell]])
        if taken:
            put(cell, 0, taken, owners[cell])
        if n > taken:
            over[cell] = (taken, n - taken)
    waiting: deque[list[int]] = deque()
    for lap in range(2):
        for cell in range(len(owners)):
            if lap == 0 and cell in over:
                waiting.append([cell, *over[cell]])
            shard = owners[cell]
            while waiting and free[shard]:
                head = waiting[0]
                n = min(head[2], free[shard])
                put(head[0], head[1], n, shard)
                head[1] += n
                head[2] -= n
                if not head[2]:
                    waiting.popleft()
    if waiting:
        raise ValueError("the shards have less room than there are rows")
    return pieces


def shard_rows(
    df: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    vnodes: int = 128,
    cell_bits: int = 13,
    slack: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1 and text_crc32 the CRC of those bytes; a
    null text counts as empty. A row's place on the ring is the hash of its id; rows
    without an id are placed by their text. Rows with one id share a place and are
    told apart by their CRC and size; rows equal in all of it are interchangeable.
    An empty table gives an empty result. Other columns are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    cells = 1 << cell_bits
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = (
        df.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col).cast("string")))
            .otherwise(F.xxhash64(F.lit(seed), F.lit("null"), text))
            .alias("_h"),
        )
        .withColumn("_cell", F.pmod(F.col("_h"), F.lit(cells)).cast("int"))
    )
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    owners = ring_owners(shards, vnodes, cell_bits, seed)
    pieces = bounded_pieces(counts, owners, capacities(sum(counts.values()), shards, slack))
    # at most one piece per cell and one per step of the walk: bounded by the ring, not the data
    table = spark.createDataFrame(pieces, _PIECES).coalesce(1)
    order = Window.partitionBy("_cell").orderBy("_h", "_id", "text_crc32", "size")
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1)
    return (
        ranked.join(
            F.broadcast(table),
            (F.col("_cell") == F.col("_pc"))
            & (F.col("_rank") >= F.col("_from"))
            & (F.col("_rank") < F.col("_to")),
        )
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            "shard",
            (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"),
        )
    )
