"""Requests to a slow reader and what it answers, matched by id.

A run has one request under way.  What comes meanwhile is turned away, a result opens the gate again,
whatever its id.  A result of an id that is not pending is unknown and changes nothing else; one that
failed or is empty ends its request without a text.  As any result opens the gate, more requests than one
may be pending; the queue of the reader bounds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.streaming.keyed import RowStep, fold_stream

#: What became of a row.
SENT, BUSY, FULL, READ, FAILED, UNKNOWN = "SENT", "BUSY", "FULL", "READ", "FAILED", "UNKNOWN"


class Gate:
    """The state of one run: the next id, whether the gate is shut, and the items of pending ids."""

    def __init__(self, next_id: int = 1, shut: bool = False, pending: dict[int, int] | None = None):
        self.next_id, self.shut, self.pending = next_id, shut, dict(pending or {})

    def request(self, item: int, queue: int) -> tuple[str, int | None]:
        if self.shut:
            return BUSY, None
        if len(self.pending) >= queue:
            self.next_id += 1  # the id was reserved and is not used again
            return FULL, None
        at, self.next_id, self.shut = self.next_id, self.next_id + 1, True
        self.pending[at] = item
        return SENT, at

    def result(self, at: int, ok: bool, text: str | None) -> tuple[str, int | None]:
        """What became of it, and the item that it belongs to."""
        self.shut = False
        if at not in self.pending:
            return UNKNOWN, None
        item = self.pending.pop(at)
        return (READ if ok and text else FAILED), item


def gate_step(run: str, queue: int) -> RowStep:
    """Fold step for rows (run, t, is_request, item, id, ok, text)."""

    def fold(state: Gate, rows: list[tuple]) -> tuple[Gate, list[tuple]]:
        out = []
        for key, t, is_request, item, at, ok, text in rows:
            if is_request:
                status, at = state.request(int(item), queue)
                out.append((key, t, int(item), at, status, None))
            else:
                status, item = state.result(int(at), bool(ok), text)
                out.append((key, t, item, int(at), status, text if status == READ else None))
        return state, out

    return RowStep([run, "t", "is_request", "item", "id", "ok", "text"], [run, "t", "item", "id", "status", "text"], fold)


def match_stream(requests: DataFrame, results: DataFrame, run: str, queue: int = 4) -> DataFrame:
    """(run, t, item, id, status, text) of requests(run, t, item) and results(run, t, id, ok, text), for append mode.

    Rows of a micro-batch are taken in order of time, results before requests of the same time, micro-batches as they
    come.  A request has the status SENT (with its id), BUSY or FULL; a result READ, FAILED (both with the item
    that its request was for) or UNKNOWN.  Start the query inside mapstate.state_store().
    """
    kind = requests.schema[run].dataType.simpleString()
    # What the other kind of row lacks is 0, as nulls would make numbers of 64 bits inexact in pandas.
    zero = F.lit(0).cast("long")
    asked = requests.select(run, F.col("t").cast("long"), F.lit(1).alias("is_request"), F.col("item").cast("long"), zero.alias("id"), F.lit(False).alias("ok"), F.lit(None).cast("string").alias("text"))
    given = results.select(run, F.col("t").cast("long"), F.lit(0).alias("is_request"), zero.alias("item"), F.col("id").cast("long"), F.coalesce("ok", F.lit(False)).alias("ok"), "text")
    schema = f"{run} {kind}, t long, item long, id long, status string, text string"
    return fold_stream(asked.unionByName(given), run, ["t", "is_request", "item", "id"], Gate, gate_step(run, queue), schema)
