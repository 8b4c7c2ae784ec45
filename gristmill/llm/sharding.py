"""Consistent-hash sharding with virtual nodes and bounded loads.

Keys and virtual nodes share a ring of 2**32 positions; a key belongs to the next
virtual node clockwise. A shard takes rows only up to its bound; what overflows goes
on clockwise to the next node whose shard has room. The bounds add up to the number of
rows exactly, so every shard ends full and counts differ by one at most.

The ring is cut into cells, each inside one arc. Only the cells' counts come to the
driver, where the overflow is settled as ranges of ranks within a cell; the rows then
find their shard and slot by their rank in their cell. Cells are made fine enough
that none holds many rows, and one that still does, because many rows have one key, is
dealt over parts, so no task sorts more than about a cell's worth at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import settle

SHARDS = 24
VIRTUAL_NODES = 64
RING = 1 << 32
#: Rows that a cell should hold at most, if keys differ.
CELL_ROWS = 50_000
GRID_BITS = 14


@dataclass
class Ring:
    """Owners of the ring's ``1 << GRID_BITS`` equal sectors, and each sector's virtual node.

    A virtual node sits at the end of a sector; no two share one.
    """

    owner: list[int]
    node: list[int]

    @staticmethod
    def of(shards: int, nodes: int = VIRTUAL_NODES) -> Ring:
        sectors = 1 << GRID_BITS
        if shards * nodes > sectors // 4:
            raise ValueError("too many virtual nodes for the ring's sectors")
        taken: dict[int, int] = {}
        for shard in range(shards):
            for v in range(nodes):
                at = xxhash.xxh32_intdigest(f"shard {shard} node {v}") >> (32 - GRID_BITS)
                while at in taken:
                    at = (at + 1) % sectors
                taken[at] = shard
        ends = sorted(taken)
        node = [bisect_left(ends, s) % len(ends) for s in range(sectors)]
        return Ring([taken[e] for e in ends], node)


def bounds(rows: int, shards: int) -> list[int]:
    """Rows that each shard takes: as equal as whole numbers can be."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle_overflow(ring: Ring, cells: list[tuple[int, int, int]], limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges of ranks for cells ``(cell, node, count)``: (cell, first rank, end rank, shard, first slot).

    First every shard takes from its own arcs, clockwise, up to its bound; then what is
    left over goes clockwise to the nearest nodes whose shards have room. A cell's lowest
    ranks stay at home.
    """
    free, used, ranges, over = list(limit), [0] * len(limit), [], []

    def give(cell: int, first: int, shard: int, n: int) -> None:
        ranges.append((cell, first, first + n, shard, used[shard]))
        used[shard] += n
        free[shard] -= n

    for cell, node, count in cells:
        shard = ring.owner[node]
        n = min(count, free[shard])
        if n:
            give(cell, 0, shard, n)
        if n < count:
            over.append((cell, node, n, count))
    size = len(ring.owner)
    ahead = list(range(1, size + 1))  # next node worth asking, with path compression

    def open_from(node: int) -> int:
        path = []
        node %= size
        while not free[ring.owner[node]]:
            path.append(node)
            node = ahead[node] % size
        for p in path:
            ahead[p] = node
        return node

    for cell, node, at, count in over:
        while at < count:
            node = open_from(node + 1)
            n = min(count - at, free[ring.owner[node]])
            give(cell, at, ring.owner[node], n)
            at += n
    return ranges


def key_position(key: str, order: tuple[str, ...] = ()) -> Column:
    """Place of a key on the ring. Rows without a key are spread by the columns ``order``."""
    instead = [F.when(F.col(key).isNull(), F.col(c)) for c in order]
    return F.pmod(F.xxhash64(F.col(key), *instead), F.lit(RING)).cast("long")


def assign(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, nodes: int = VIRTUAL_NODES, cell_rows: int = CELL_ROWS, order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Rows of a cell are ranked by ring position, key and the columns ``order``; rows that
    agree in all of these can be told apart by nobody and take any of their slots. A cell
    of many rows of one key is ranked part by part, rows dealt by their number. Pass no
    payload: all columns of ``rows`` are written once and sorted within cells. Rows
    without a key are spread by ``order``. Columns of the new names give way. An empty
    table gives none.
    """
    if key in ("shard", "slot"):
        raise ValueError(f"the key column cannot be called {key}")
    rows = rows.drop("shard", "slot")
    payload = rows.columns
    # plain names inside, whatever the columns are called
    rows = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(payload)])
    key, order = f"c{payload.index(key)}", tuple(f"c{payload.index(c)}" for c in order)
    spark = rows.sparkSession
    ring = Ring.of(shards, nodes)
    total = rows.count()
    finer = max(0, (-(-total // cell_rows) - 1).bit_length() - GRID_BITS)
    placed = rows.withColumn("_at", key_position(key, order))
    # written once, so that a row keeps its number
    placed = settle(placed.withColumn("_cell", F.shiftright("_at", 32 - GRID_BITS - finer))).withColumn("_row", F.monotonically_increasing_id())
    per_cell = placed.groupBy("_cell").count()
    # at most total / (2 * cell_rows) cells are full
    full = [(r["_cell"], -(-r["count"] // cell_rows)) for r in per_cell.where(F.col("count") > 2 * cell_rows).collect()]
    split = spark.createDataFrame(full, "_cell long, _parts long")
    part = F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1).cast("long")))
    placed = placed.join(split, "_cell", "left").withColumn("_part", part).drop("_row", "_parts")
    counts = placed.groupBy("_cell", "_part").count().orderBy("_cell", "_part").collect()
    cells = [(k, ring.node[r["_cell"] >> finer], r["count"]) for k, r in enumerate(counts)]
    ranges = [(counts[k]["_cell"], counts[k]["_part"], *rest) for k, *rest in settle_overflow(ring, cells, bounds(total, shards))]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_cell", "_part", "_first", "_end", "_shard", "_slot")])
    by_cell = spark.createDataFrame(ranges, schema).groupBy("_cell", "_part").agg(F.sort_array(F.collect_list(F.struct("_first", "_end", "_shard", "_slot"))).alias("_ranges"))
    window = Window.partitionBy("_cell", "_part").orderBy("_at", key, *order)
    ranked = placed.withColumn("_rank", F.row_number().over(window) - 1)
    joined = ranked.join(by_cell, ["_cell", "_part"])
    mine = F.filter("_ranges", lambda r: (r["_first"] <= F.col("_rank")) & (F.col("_rank") < r["_end"]))[0]
    return joined.withColumn("_mine", mine).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(payload)],
        F.col("_mine._shard").cast("int").alias("shard"),
        (F.col("_mine._slot") + F.col("_rank") - F.col("_mine._first")).alias("slot"),
    )


def op5_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document under the law ``rows``: counts differ by one at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = assign(sized, order=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
