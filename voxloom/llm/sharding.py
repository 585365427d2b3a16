"""Sharding (native): a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells; each shard owns the cells that its virtual nodes close off
clockwise.  A key lies in the cell of its hash and goes to that cell's shard; when that shard is
full it continues clockwise to the next shard that is not.  Keys of one cell differ in nothing that
matters here but their rank, so the walk needs only the cells' counts: a table whose size is the
number of ring cells, whatever the data's.  Ranks come from one shuffle of narrow rows by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.common import read_table, settle

RING_CELLS = 1 << 14
VIRTUAL_NODES = 64


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = RING_CELLS) -> list[int]:
    """The owner of each cell: that of the first virtual node at or clockwise after it."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            cell = _mix(shard * 1_000_003 + v) % cells
            while cell in nodes:
                cell = (cell + 1) % cells
            nodes[cell] = shard
    owners, owner = [0] * cells, nodes[min(nodes)]
    for cell in range(cells - 1, -1, -1):
        owner = nodes.get(cell, owner)
        owners[cell] = owner
    return owners


def bounded_walk(counts: dict[int, int], owners: list[int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): every shard takes its own cells' keys in ring
    order up to its quota; the rest continue clockwise, in ring order, to the next shard with room."""
    cells, room = len(owners), list(quotas)
    pieces, waiting = [], []
    slot = [0] * len(quotas)

    def take(cell: int, lo: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            pieces.append((cell, lo, lo + got, shard, slot[shard]))
            room[shard] -= got
            slot[shard] += got
        return got

    for cell in sorted(counts):
        got = take(cell, 0, counts[cell], owners[cell])
        if got < counts[cell]:
            waiting.append((cell, got, counts[cell] - got))
    # The distinct shards met clockwise from the end of each cell's arc.
    ahead: list[tuple[int, ...]] = [()] * cells
    order: list[int] = []
    for cell in range(2 * cells - 1, -1, -1):
        s = owners[cell % cells]
        if not order or order[0] != s:
            if s in order:
                order.remove(s)
            order.insert(0, s)
        ahead[cell % cells] = tuple(order)
    for cell, lo, n in waiting:
        for shard in ahead[cell]:
            got = take(cell, lo, n, shard)
            lo, n = lo + got, n - got
            if not n:
                break
    return pieces


def assign_shards(df: DataFrame, key: Column, tie: list[Column], shards: int = 8, virtual_nodes: int = VIRTUAL_NODES, cells: int = RING_CELLS) -> DataFrame:
    """df with `shard` int and `slot` long (gapless from 0 in each shard); df must have no columns of
    these names.

    Quotas are the row counts at most one apart that add up to all rows, so the load bound is exact.
    `key` (64-bit, not null) places a row on the ring; rows of one cell are ranked by key and `tie`.
    Rows equal in all of these may change places between runs; the set of (shard, slot) stays.
    An empty df gives an empty result.
    """
    placed = df.withColumn("__cell", F.pmod(F.shiftright(key, 7), F.lit(cells)).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy("__cell").count().collect()}  # at most `cells` rows
    total = sum(counts.values())
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = bounded_walk(counts, ring(shards, virtual_nodes, cells), quotas)
    plan = df.sparkSession.createDataFrame(pieces, "__cell int, __lo long, __hi long, shard int, __slot long")
    ranked = placed.withColumn("__rank", F.row_number().over(W.partitionBy("__cell").orderBy(key, *tie)).cast("long") - 1)
    # The plan has at most one row for each cell and shard: bounded by the ring, so broadcast.
    joined = ranked.join(F.broadcast(plan), (ranked["__cell"] == plan["__cell"]) & (ranked["__rank"] >= plan["__lo"]) & (ranked["__rank"] < plan["__hi"]))
    return joined.select(*[ranked[c] for c in df.columns], "shard", (F.col("__slot") + F.col("__rank") - F.col("__lo")).alias("slot"))


def op5_sharding(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """Documents on 8 shards by the law `rows`: bounded loads give counts at most one apart.

    A null doc_id is placed by its text; a null text has size 1 and the checksum of an empty text.
    """
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    docs = settle(docs)  # narrow; read twice below
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    out = assign_shards(docs, key, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
