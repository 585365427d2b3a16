"""The map, kept up to date by a stream: cells that are fused, voted on, killed and revived.

The state lies in Spark's state store, where the cells of a bucket share a row (see keyed.fold_stream).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.operators.votes import SATURATION
from voxloom.streaming.keyed import RowStep, fold_stream

#: What a row does to its cell.
FUSE, VOTE, KILL = 0, 1, 2


def fuse_stream(points: DataFrame, cell: list[str], sums: list[str]) -> DataFrame:
    """Running totals of each cell (for update mode); the state has a row for each occupied cell."""
    return points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in sums))


class CellState:
    """One cell: dead until its first point; a kill ends an epoch, the next point starts another from nothing.
    Votes for a dead cell are void, and so is a kill of one."""

    def __init__(self, epoch: int = 0, alive: bool = False, n: int = 0, sums: tuple = (), votes: dict[int, int] | None = None):
        self.epoch, self.alive, self.n, self.sums, self.votes = epoch, alive, n, list(sums), Counter(votes or {})

    def apply(self, ops: list[int], values: list[list], classes: list[int]) -> None:
        for i, op in enumerate(ops):
            if op == FUSE:
                if not self.alive:
                    self.alive, self.n, self.votes = True, 0, Counter()
                    self.sums = [0] * len(values)
                self.n += 1
                self.sums = [s + v[i] for s, v in zip(self.sums, values, strict=True)]
            elif self.alive and op == VOTE:
                self.votes[classes[i]] = min(SATURATION, self.votes[classes[i]] + 1)
            elif self.alive and op == KILL:
                self.epoch, self.alive, self.n, self.votes = self.epoch + 1, False, 0, Counter()
                self.sums = [0] * len(values)


def cell_step(cell: list[str], op: str, cls: str, values: list[str], kind: str) -> RowStep:
    """Rows (cell, op, class, values...) of a cell and micro-batch, in their order -> the cell as it is then."""
    n, as_kind = len(cell), int if kind == "long" else float

    def fold(state: CellState, rows: list[tuple]) -> tuple[CellState, list[tuple]]:
        ops, classes, *cols = zip(*(r[n:] for r in rows), strict=True)
        state.apply(ops, [[0 if v is None or v != v else v for v in c] for c in cols], [-1 if c is None or c != c else int(c) for c in classes])
        state.sums = [as_kind(s) for s in state.sums]
        votes = [{"class_id": c, "votes": v} for c, v in sorted(state.votes.items())]
        return state, [(*rows[0][:n], state.epoch, state.alive, state.n, *state.sums, votes)]

    return RowStep([*cell, op, cls, *values], [*cell, "epoch", "alive", "n", *(f"sum_{v}" for v in values), "votes"], fold)


def map_stream(ops: DataFrame, cell: list[str], order: list[str], op: str, cls: str, values: list[str], kind: str = "long") -> DataFrame:
    """Cells as each micro-batch leaves them (update mode): cell..., epoch (kills that met a live cell), alive, n and
    sums since the last revival, and votes.

    `op` is FUSE, VOTE or KILL, `cls` the class of a vote, `values` are summed as `kind` (long or double; null: 0).
    Rows of a micro-batch are taken in `order`, micro-batches as they come: a row that comes late counts
    when it comes.  Start the query inside state_store().
    """
    types = {f.name: f.dataType.simpleString() for f in ops.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in cell), "epoch long, alive boolean, n long", *(f"sum_{v} {kind}" for v in values), "votes array<struct<class_id:int,votes:int>>"])
    slim = ops.select(*cell, *dict.fromkeys([*order, op, cls, *values]))
    start = partial(CellState, sums=(0,) * len(values))
    return fold_stream(slim, cell, order, start, cell_step(cell, op, cls, values, kind), schema, "update")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk (RocksDB), as map_stream needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def publish(totals: DataFrame, folder: str, name: str):
    """Start writing changed cells with the number of their batch, for all that the sources have now."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces what it had written.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}.parquet")

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()


def snapshot(spark, folder: str, name: str, cell: list[str]) -> DataFrame:
    """The latest state of each cell."""
    rows = spark.read.parquet(f"{folder}/{name}/*.parquet")
    rank = F.row_number().over(W.partitionBy(*cell).orderBy(F.desc("batch")))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r", "batch")
