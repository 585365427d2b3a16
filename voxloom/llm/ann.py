"""Approximate nearest neighbours with an inverted multi-index.

The two halves of each unit vector are quantised separately; a vector lies in the cell of its pair of
centroids.  A query walks the pairs by summed distance with a heap until the cells it has met hold the
wanted share of the index, and its candidates are reranked by exact cosine in double precision.

Equal vectors are indexed once with their smallest ids, which is all that a result of k rows can use,
so a vector that a third of the rows repeat costs one entry.  Cells are laid out in blocks of bounded
size.  The index is shuffled once, whatever the number of queries: queries go to the blocks that their
walks met, and a task reads a block's entries, then streams the queries by, a batch at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.common import read_table, settle

TRAIN_ROWS = 10_000  # bound of the sample that centroids are fitted on
PROBE_SHARE = 0.4  # share of the index a query's cells must hold; measured recall is in the tests
BLOCK = 4096
CENTROIDS = 128  # of each half at most


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; an empty cluster keeps its centre."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.stack([np.bincount(a, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def walk(d0: np.ndarray, d1: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells i * K1 + j in order of d0[i] + d1[j] until they hold `wanted` entries.

    The heap holds one pair for each first centroid that has been opened; the next is opened when the
    first pair of the last one is taken, as none of its pairs can come before.
    """
    o0, o1 = np.argsort(d0, kind="stable"), np.argsort(d1, kind="stable")
    a, b, k0, k1 = d0[o0].tolist(), d1[o1].tolist(), len(d0), len(d1)
    held = counts.reshape(k0, k1)[np.ix_(o0, o1)].tolist()
    heap, have, out = [(a[0] + b[0], 0, 0)], 0, []
    while heap and have < wanted:
        _, i, j = heap[0]
        if n := held[i][j]:
            have += n
            out.append((i, j))
        if j + 1 < k1:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < k0:
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    at = np.array(out, dtype=np.int64).reshape(-1, 2)
    return (o0[at[:, 0]] * k1 + o1[at[:, 1]]).tolist()


def nearest_of(v: np.ndarray, norm: np.ndarray, ids: list, cells: np.ndarray, q: int, qv: np.ndarray, met: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best (id, cosine) for one query among a block's entries in the cells that it met."""
    at = np.flatnonzero(np.isin(cells, met))
    if not len(at):
        return []
    s = (v[at] @ qv) / (norm[at] * np.linalg.norm(qv))
    least = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -np.inf
    own = [(s[i], int(x)) for i in np.flatnonzero(s >= least) for x in ids[at[i]] if x != q]
    own.sort(key=lambda t: (-t[0], t[1]))
    return [(x, float(y)) for y, x in own[:k]]


FOUND = pa.schema([("query_id", pa.int64()), ("qh", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def meet(k: int):
    """For rows (block, kind, id, h, v, ids, cells) sorted by block and kind: entries (kind 0) are kept until
    the block ends, queries (kind 1) pass by.  A block has at most about BLOCK entries, so what is kept is
    bounded, however many queries there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vs, idss, cellss, ready = None, [], [], [], None
        for batch in batches:
            out = []
            cols = {n: batch.column(n) for n in ("block", "kind", "id", "h")}
            blocks, kinds, ids, hs = (c.to_numpy(zero_copy_only=False) for c in cols.values())
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(blocks), -1)
            edge = np.concatenate(([0], np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1, [len(blocks)]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if blocks[lo] != block:
                    block, vs, idss, cellss, ready = blocks[lo], [], [], [], None
                if kinds[lo] == 0:
                    vs.append(flat[lo:hi].copy())
                    idss += batch.column("ids").slice(lo, hi - lo).to_pylist()
                    cellss += [c[0] for c in batch.column("cells").slice(lo, hi - lo).to_pylist()]
                    continue
                if not vs:
                    continue
                if ready is None:
                    v = np.concatenate(vs)
                    ready = v, np.linalg.norm(v, axis=1), idss, np.array(cellss)
                met = batch.column("cells").slice(lo, hi - lo)
                for i in range(lo, hi):
                    out += [(ids[i], hs[i], x, y) for x, y in nearest_of(*ready, ids[i], flat[i], met[i - lo].values.to_numpy(zero_copy_only=False), k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v double array) of the vectors that take part: id and vector not null, all components
    present and finite, norm not zero, and as long as most such vectors are."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    v = v.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    top = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return v.where(F.size("v") == (top["dim"] if top else 0))


def scaled(v: Column) -> Column:
    """A vector divided by the power of two of its largest component: the same cosines to the last bit, and
    squares that neither overflow nor vanish, however large or small the components are."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(v, F.abs)))))
    # zip_with takes the power as an array, so that it is found once a vector and not once a component.
    return F.zip_with(v, F.array_repeat(power, F.size(v)), lambda x, y: x / y)


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, share: float = PROBE_SHARE, train_rows: int = TRAIN_ROWS, centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest
    found by cosine among all rows but its own id; ties to the smaller id.

    Rows that repeat id and vector count once; a repeated id with other vectors is a row of its own
    (as a query it gets a ranking for each).  With fewer than k candidates all are returned, and
    without usable rows nothing.  Vectors of another length than most are left out, as no cosine with
    the others exists.  Components may have any finite value (see scaled).  Other columns are ignored.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = settle(usable(df, id_col, vec_col).distinct().select("vec_id", F.xxhash64("v").alias("h"), scaled(F.col("v")).alias("v")))
    total = rows.count()
    if total < 2:
        return spark.createDataFrame([], schema)
    # The k + 1 smallest ids of equal vectors, in two steps so that no vector's rows meet in one task.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(W.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = some.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    sample = np.array([r[0] for r in rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).collect()])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    half = max(1, sample.shape[1] // 2)
    size = centroids or 2 ** min(int(math.log2(CENTROIDS)), max(4, round(math.log2(total / 8))))
    books = kmeans(sample[:, :half], size), kmeans(sample[:, half:], size) if sample.shape[1] > half else np.zeros((1, 0))
    k1 = len(books[1])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                pdf = pdf.assign(cell=nearest(x[:, :half], books[0]) * k1 + nearest(x[:, half:], books[1]))
                yield pdf[["v", "ids", "cell"]]

    index = settle(entries.mapInPandas(place, "v array<double>, ids array<long>, cell int"))
    counts = np.zeros(len(books[0]) * k1, dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # one row for each pair of centroids at most
        counts[r[0]] = r[1]
    # Blocks: consecutive cells of about BLOCK entries; a larger cell has several blocks to itself.
    first, parts, block, fill = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if fill and fill + n > BLOCK:
            block, fill = block + 1, 0
        first[c], parts[c] = block, max(1, -(-n // BLOCK))
        if parts[c] > 1:
            block, fill = block + int(parts[c]), 0
        else:
            fill += n
    wanted = share * counts.sum()

    def route(batches):
        for pdf in batches:
            out = []
            for q, h, v in zip(pdf["vec_id"], pdf["h"], pdf["v"], strict=True):
                x = v / np.linalg.norm(v)
                d = [(b**2).sum(1) - 2 * b @ p for b, p in zip(books, (x[:half], x[half:]), strict=True)]
                by: dict[int, list[int]] = {}
                for c in walk(*d, counts, max(wanted, k + 1)):
                    for m in range(int(parts[c])):
                        by.setdefault(int(first[c]) + m, []).append(c)
                out += [(b, q, h, v, cells) for b, cells in by.items()]
            yield pd.DataFrame(out, columns=["block", "id", "h", "v", "cells"])

    asked = rows.where(F.col("vec_id") % every == 0).mapInPandas(route, "block long, id long, h long, v array<double>, cells array<int>")

    @F.arrow_udf("long")
    def block_of(cell: pa.Array, h: pa.Array) -> pa.Array:
        c = cell.to_numpy(zero_copy_only=False)
        return pa.array(first[c] + h.to_numpy(zero_copy_only=False) % parts[c])

    none = F.lit(0).cast("long")
    entries = index.select(block_of("cell", F.xxhash64("v")).alias("block"), F.lit(0).alias("kind"), none.alias("id"), none.alias("h"), "v", "ids", F.array("cell").alias("cells"))
    queries = asked.select("block", F.lit(1).alias("kind"), "id", "h", "v", F.array().cast("array<long>").alias("ids"), "cells")
    by_block = entries.unionByName(queries).repartition("block").sortWithinPartitions("block", "kind")
    found = by_block.mapInArrow(meet(k), "query_id long, qh long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann_search(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every 50th vector, against all vectors."""
    return search(read_table(spark, sf_dir, "embeddings"))
