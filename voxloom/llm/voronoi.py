"""Exact top-k by inner product as a Voronoi join.

Queries and data are grouped by their nearest pivots.  For a pivot p, a row x of its cell and a query q,
q.x lies within |q| |x - p| of q.p.  So a summary of each cell (rows, the smallest distances to its pivot)
says for every cell of queries which score its k-th best row reaches at least, and from which distance
to its pivot on a row of another cell can reach that score.  Only such rows are sent to the cell's
group of queries, where the join is solved.

A group of queries fits a fixed number of bytes; a larger cell is dealt over several groups.  The rows sent
to a group are dealt over tasks by their id, so a cell that holds most rows is not one task, and rows stream
past the queries of a task.  On data without clusters the bounds exclude little and every row meets every group, which is
what an exact answer needs there: rows move once for each group, a group holds tens of thousands of queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from voxloom.llm.ann import kmeans, nearest
from voxloom.llm.common import read_table, settle

TRAIN_ROWS = 10_000  # bound of the sample that pivots are fitted on; it decides how much is sent, not what is found
PIVOTS = 128
GROUP_BYTES = 16 << 20  # of one group's queries as doubles
SPLIT_ROWS = 1 << 16  # rows that a task streams past a group
LEAST_SPLITS = 32
SCALE = 256.0
EXACT = 2.0**53  # below, sums of products of integers are exact in double precision
MAX_LONG = 2**63 - 1


def whole(v: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component; exact, as 256 is a power of two."""
    return np.floor(v.astype(np.float64) * SCALE)


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def placed(pivots: np.ndarray, dim: int):
    """Adds each row's cell, its distance to the pivot and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors(batch.column("v"), dim)
                with np.errstate(over="ignore", invalid="ignore"):  # beyond the range of doubles the bounds exclude nothing
                    cell = nearest(x, pivots)
                    d, size = (np.nan_to_num(np.sqrt((y**2).sum(1)), nan=np.inf, posinf=np.inf) for y in (x - pivots[cell], x))
                cols = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d), pa.array(size)]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "asks", "cell", "d", "len"])

    return run


def summary(placed_rows: DataFrame, k: int) -> pd.DataFrame:
    """For each cell: rows, queries, farthest row and query, longest query, the k + 1 smallest distances.
    Each partition folds its rows first; at most one row a cell reaches the driver."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            q = pdf["asks"]
            part = pd.DataFrame({"cell": pdf["cell"], "n": 1, "q": q.astype("int64"), "far": pdf["d"], "q_far": pdf["d"].where(q, 0.0), "q_len": pdf["len"].where(q, 0.0)})
            part = part.groupby("cell", as_index=False).agg({"n": "sum", "q": "sum", "far": "max", "q_far": "max", "q_len": "max"})
            near = pdf.sort_values("d").groupby("cell")["d"].apply(lambda s: s.to_numpy()[: k + 1])
            part["near"] = part["cell"].map(near)
            held = part if held is None else merged(pd.concat([held, part]), k)
        if held is not None:
            yield held

    parts = placed_rows.select("cell", "d", "len", "asks").mapInPandas(fold, "cell int, n long, q long, far double, q_far double, q_len double, near array<double>")
    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.max("far").alias("far"), F.max("q_far").alias("q_far"), F.max("q_len").alias("q_len"), near).orderBy("cell").toPandas()


def merged(parts: pd.DataFrame, k: int) -> pd.DataFrame:
    near = parts.groupby("cell")["near"].apply(lambda s: np.sort(np.concatenate(s.to_list()))[: k + 1])
    out = parts.groupby("cell", as_index=False).agg({"n": "sum", "q": "sum", "far": "max", "q_far": "max", "q_len": "max"})
    return out.assign(near=out["cell"].map(near))


@np.errstate(over="ignore", invalid="ignore", divide="ignore")
def needs(s: pd.DataFrame, pivots: np.ndarray, k: int) -> np.ndarray:
    """need[i, j]: the least distance to its pivot of a row of the j-th cell of `s` that can be among the k
    best of a query of the i-th (infinite for a cell without queries), with room for rounding."""
    p, far, longest = pivots[s["cell"]], s["q_far"].to_numpy(), s["q_len"].to_numpy()
    norm = np.sqrt((p**2).sum(1))
    dot, spread = p @ p.T, far[:, None] * norm[None, :]  # of q.p over the queries of a cell
    near_cell = np.repeat(np.arange(len(s)), [len(x) for x in s["near"]])
    near_d = np.concatenate(s["near"].to_list())
    need = np.full(dot.shape, np.inf)
    for i in np.flatnonzero(s["q"].to_numpy()):
        at_least = np.nan_to_num(dot[i, near_cell] - spread[i, near_cell] - longest[i] * near_d, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
        # one of the k + 1 best may be the query itself
        bar = np.partition(at_least, -(k + 1))[-(k + 1)] if len(at_least) > k else -np.inf
        slack = 1e-9 * (np.abs(dot[i]) + spread[i] + longest[i] * s["far"].to_numpy() + (abs(bar) if np.isfinite(bar) else 0.0)) + 1e-9
        room = bar - dot[i] - spread[i] - slack
        need[i] = np.where(room > 0, room / longest[i], -np.inf)
    need[np.isnan(need)] = -np.inf
    return need


def grouped(s: pd.DataFrame, need: np.ndarray, pivots: np.ndarray, size: int) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
    """Cells of queries -> (first group, number of groups), and need[group, cell]: neighbouring cells share a
    group up to `size` queries, a larger cell is dealt over groups of its own."""
    asked = [i for i in range(len(s)) if s["q"][i]]
    order, left = [], set(asked)
    while left:  # from each cell to the nearest one left, so that a group's cells need much the same rows
        here = order[-1] if order else min(left)
        nxt = min(left, key=lambda i: (((pivots[s["cell"][i]] - pivots[s["cell"][here]]) ** 2).sum(), i))
        order.append(nxt)
        left.remove(nxt)
    where, rows, fill = {}, [], size
    for i in order:
        n = int(s["q"][i])
        if n > size:
            parts = -(-n // size)
            where[int(s["cell"][i])] = (len(rows), parts)
            rows += [need[i]] * parts
            fill = size
        else:
            if fill + n > size:
                rows.append(np.full(need.shape[1], np.inf))
                fill = 0
            fill += n
            rows[-1] = np.minimum(rows[-1], need[i])
            where[int(s["cell"][i])] = (len(rows) - 1, 1)
    return where, np.array(rows)


def sent(need: np.ndarray, cells: np.ndarray, where: dict[int, tuple[int, int]], first: np.ndarray, splits: np.ndarray):
    """Rows (part, kind, vec_id, v): a query (kind 0) goes to every task of its group, a row (kind 1) to one
    task of each group that needs it."""
    at = {int(c): j for j, c in enumerate(cells)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, d, h = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "d", "h"))
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            col = np.array([at[int(c)] for c in cell])
            pick, part, kind = [], [], []
            for g in range(len(need)):
                go = np.flatnonzero(d >= need[g, col])
                pick.append(go)
                part.append(first[g] + h[go] % splits[g])
                kind.append(np.ones(len(go), dtype=np.int8))
            home = {c: where[c] for c in set(cell[asks].tolist())}
            g = np.array([home[c][0] + int(x) % home[c][1] for c, x in zip(cell[asks].tolist(), h[asks].tolist(), strict=True)], dtype=np.int64)
            for group in np.unique(g).tolist():
                mine, n = asks[g == group], int(splits[group])
                pick.append(np.repeat(mine, n))
                part.append(np.tile(np.arange(n) + first[group], len(mine)))
                kind.append(np.zeros(len(mine) * n, dtype=np.int8))
            take, part, kind = (np.concatenate(x) for x in (pick, part, kind))
            for lo in range(0, len(take), 10_000):
                some = pa.array(take[lo : lo + 10_000])
                cols = [pa.array(part[lo : lo + 10_000]), pa.array(kind[lo : lo + 10_000]), batch.column("vec_id").take(some), batch.column("v").take(some)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "kind", "vec_id", "v"])

    return run


class Best:
    """The k best (score, id) of each query of a task, as arrays."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k, self.top = ids, q, k, np.abs(q).max(axis=1, initial=0.0)
        self.big = self.top * max(1, q.shape[1])
        self.score, self.who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        self.exact: dict[int, list[tuple[int, int]]] = {}  # queries with sums beyond double precision

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Some rows pass, in blocks that keep a matrix of scores to a few MB."""
        step = max(1, (4 << 20) // (8 * max(1, len(self.ids))))
        for lo in range(0, len(x), step):
            n, rows = ids[lo : lo + step], x[lo : lo + step]
            own = self.ids[:, None] == n[None, :]
            top = np.abs(rows).max(axis=1, initial=0.0)
            s = self.q @ rows.T
            if self.big.max() * top.max() >= EXACT:
                large = ~(np.outer(self.big, top) < EXACT)
                self.see_large(n, rows, large & ~own)
                own |= large
            s[own] = -np.inf
            self.take(n, s)

    def take(self, ids: np.ndarray, s: np.ndarray) -> None:
        # A row enters with the k-th score too: ids decide ties.
        hit = np.flatnonzero(((s >= self.score[:, -1:]) & (s > -np.inf)).any(axis=1))
        if not len(hit):
            return
        every = np.concatenate([self.score[hit], s[hit]], axis=1)
        who = np.concatenate([self.who[hit], np.broadcast_to(ids, (len(hit), len(ids)))], axis=1)
        order = np.lexsort((who, -every), axis=1)[:, : self.k]
        self.score[hit], self.who[hit] = np.take_along_axis(every, order, 1), np.take_along_axis(who, order, 1)

    def see_large(self, ids: np.ndarray, x: np.ndarray, large: np.ndarray) -> None:
        """The pairs whose sums may not fit a double, in whole numbers of any size."""
        for i in np.flatnonzero(large.any(axis=1)).tolist():
            q = [int(y) for y in self.q[i]]
            have = self.exact.setdefault(i, [])
            have += [(-sum(a * int(b) for a, b in zip(q, x[j], strict=True)), int(ids[j])) for j in np.flatnonzero(large[i])]
            self.exact[i] = sorted(have)[: self.k]

    def rows(self) -> pa.RecordBatch | None:
        found = [(int(self.ids[i]), i, int(self.who[i, j]), int(self.score[i, j])) for i, j in zip(*np.nonzero(self.score > -np.inf), strict=True)]
        found += [(int(self.ids[i]), i, n, -s) for i, have in self.exact.items() for s, n in have]
        if not found:
            return None
        q, at, n, s = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([digest(self.q[i]) for i in at], pa.int64()), pa.array(n, pa.int64()), pa.array([str(x) for x in s])], names=["query_id", "qh", "vec_id", "score"])


def digest(v: np.ndarray) -> int:
    """Tells queries that repeat an id apart."""
    return int.from_bytes(hashlib.sha256(v.tobytes()).digest()[:8], "big", signed=True)


def solved(dim: int, k: int):
    """Rows sorted by part and kind: a part's queries are kept, its rows pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, vs, best = None, [], [], None
        for batch in batches:
            parts, kinds, who = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "kind", "vec_id"))
            x = vectors(batch.column("v"), dim)
            edge = np.concatenate(([0], np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1, [len(parts)]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    if best and (out := best.rows()):
                        yield out
                    part, ids, vs, best = parts[lo], [], [], None
                if kinds[lo] == 0:
                    ids.append(who[lo:hi])
                    vs.append(x[lo:hi])
                elif ids:
                    best = best or Best(np.concatenate(ids), np.concatenate(vs), k)
                    best.see(who[lo:hi], x[lo:hi])
        if best and (out := best.rows()):
            yield out

    return run


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: id and vector not null, all components present and finite, 256-fold too."""
    kind = "float" if df.schema[vec_col].dataType == T.ArrayType(T.FloatType(), df.schema[vec_col].dataType.containsNull) else "double"
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return v.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) * SCALE < float("inf")) & ~F.isnan(x)))


def join_one(rows: DataFrame, dim: int, unique: bool, k: int, every: int, train_rows: int, pivots: int, splits: int | None) -> DataFrame:
    """The join of rows (vec_id, v) of one length; score as a decimal string.  Where ids are not unique more
    than one row may be a query's own, and the bounds are not used."""
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).toArrow().column("v").combine_chunks()
    x = vectors(sample, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        centres = kmeans(x, min(pivots, max(1, len(x) // 16))) if dim else x[:1]
    asks = (F.col("vec_id") % every == 0).alias("asks")
    kind = rows.schema["v"].dataType.simpleString()
    laid = rows.select("vec_id", "v", asks).mapInArrow(placed(centres, dim), f"vec_id long, v {kind}, asks boolean, cell int, d double, len double")
    s = summary(laid, k)
    need = needs(s, centres, k) if unique else np.full((len(s), len(s)), -np.inf)
    where, need = grouped(s, need, centres, max(256, GROUP_BYTES // (8 * max(1, dim))))
    if not len(need):
        return rows.sparkSession.createDataFrame([], "query_id long, qh long, vec_id long, score string")
    most = np.where(s["far"].to_numpy()[None, :] >= need, s["n"].to_numpy()[None, :], 0).sum(1)
    tasks = np.full(len(need), splits) if splits else np.maximum(LEAST_SPLITS, -(-most // SPLIT_ROWS))
    first = np.concatenate(([0], np.cumsum(tasks)[:-1])).astype(np.int64)
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("h")
    met = laid.select("vec_id", "v", "asks", "cell", "d", h).mapInArrow(sent(need, s["cell"].to_numpy(), where, first, tasks.astype(np.int64)), f"part long, kind byte, vec_id long, v {kind}")
    by_part = met.repartition("part").sortWithinPartitions("part", "kind")
    return by_part.mapInArrow(solved(dim, k), "query_id long, qh long, vec_id long, score string")


def lengths(rows: DataFrame) -> dict[int, int]:
    """The lengths of vectors, and how many rows of one share an id at most."""
    ids = rows.groupBy(F.size("v").alias("dim"), "vec_id").count()
    return {r["dim"]: r["n"] for r in ids.groupBy("dim").agg(F.max("count").alias("n")).orderBy("dim").collect()}


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, train_rows: int = TRAIN_ROWS, pivots: int = PIVOTS, splits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows of another id with
    the largest inner product of vectors floor(256 x); ties to the smaller id.

    Rows that repeat id and vector count once; a repeated id with other vectors is a row of its own (as a
    query it gets a ranking for each).  Vectors of different lengths have no inner product and are not compared.
    Null ids, null vectors and vectors with null or non-finite components take no part.  With fewer than k candidates
    all are returned; an empty table gives nothing.  Scores are exact at any size; one beyond a long is
    returned as the long nearest to it, after the ranking.  Other columns are ignored.
    """
    rows = usable(df, id_col, vec_col)
    dims = lengths(rows)
    if any(n > 1 for n in dims.values()):
        rows = settle(rows.distinct())
        dims = lengths(rows)
    found = rows.sparkSession.createDataFrame([], "query_id long, qh long, vec_id long, score string")
    for dim, n in dims.items():
        found = found.unionByName(join_one(rows.where(F.size("v") == dim), dim, n == 1, k, every, train_rows, pivots, splits))
    # decimal strings in order of their values: sign, digits, then the digits themselves
    sign = F.when(F.col("score").startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace("score", "^-", "")
    order = [(sign * F.length(digits)).desc(), F.when(sign > 0, digits).desc_nulls_last(), F.when(sign < 0, digits).asc_nulls_last(), F.asc("vec_id")]
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "qh").orderBy(*order))).where(F.col("rank") <= k)
    limit = F.when(sign > 0, F.lit(MAX_LONG)).otherwise(F.lit(-MAX_LONG - 1))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.coalesce(F.expr("try_cast(score AS bigint)"), limit).alias("score"))


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 rows of largest inner product of every 50th vector, among all vectors."""
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.v) = len(r.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
