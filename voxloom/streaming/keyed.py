"""Folds with one state for each key, over streams and over tables alike."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]

#: Fixed value: groups of keys that share a row of the state store.  A checkpoint holds for one value of it.
BUCKETS = 512


class RowStep:
    """A step over plain rows: fold(state, rows of `inputs` in order) -> (state, rows of `outputs`).

    Called with a table, it is a Step; fold_stream gives it the rows of many keys without a table for each.
    """

    def __init__(self, inputs: list[str], outputs: list[str], fold: Callable[[Any, list[tuple]], tuple[Any, list[tuple]]]):
        self.inputs, self.outputs, self.fold = inputs, outputs, fold

    def rows(self, pdf: pd.DataFrame) -> list[tuple]:
        return list(zip(*(pdf[c].tolist() for c in self.inputs), strict=True))

    def table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.outputs, dtype=object)  # whole numbers stay so beside nulls

    def __call__(self, state: Any, pdf: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        state, out = self.fold(state, self.rows(pdf))
        return state, self.table(out)


def bucket(key: list[str]) -> Column:
    """Keys with nulls have buckets of their own, below 0, so that nulls change no other key's type."""
    nulls = reduce(add, (F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(key)))
    return F.when(nulls > 0, -nulls).otherwise(F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))


def fold_keys(held: dict, pdf: pd.DataFrame, key: list[str], order: list[str], start: Callable[[], Any], step: Step) -> pd.DataFrame:
    """step() for each key of pdf with its state in `held`, which is brought up to date; the outputs."""
    pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
    number = pdf.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
    pdf = pdf.iloc[np.argsort(number, kind="stable")].reset_index(drop=True)
    ends = np.cumsum(np.bincount(number)).tolist()
    begins = [0, *ends[:-1]]
    keys = [tuple(None if v is None or v != v else v for v in k) for k in zip(*(pdf[c].iloc[begins].tolist() for c in key), strict=True)]
    plain = isinstance(step, RowStep)
    rows, out = step.rows(pdf) if plain else pdf, []
    for k, a, b in zip(keys, begins, ends, strict=True):
        state = held[k] if k in held else start()
        if plain:
            held[k], got = step.fold(state, rows[a:b])
            out += got
        else:
            held[k], got = step(state, rows.iloc[a:b].reset_index(drop=True))
            out.append(got)
    return step.table(out) if plain else pd.concat(out, ignore_index=True)


def fold_stream(rows: DataFrame, key: str | list[str], order: list[str], start: Callable[[], Any], step: Step, schema: str, mode: str = "append") -> DataFrame:
    """step(state, rows of one key of a micro-batch in order) -> (state, output), in append (or update) mode.

    The state is kept in Spark's state store, so a restarted query goes on where its checkpoint ends.  Keys are
    brought together in BUCKETS groups, one call and one row of the store for each, as both cost far more than
    the few rows of a key; a bucket that a micro-batch touches is read and written whole.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    key = [key] if isinstance(key, str) else key

    def run(_, frames, state):
        held = pickle.loads(state.get[0]) if state.exists else {}
        out = fold_keys(held, pd.concat(list(frames), ignore_index=True), key, order, start, step)
        state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        if len(out):
            yield out

    return rows.withColumn("__bucket", bucket(key)).groupBy("__bucket").applyInPandasWithState(run, schema, "blob binary", mode, GroupStateTimeout.NoTimeout)


def fold_batch(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Step, schema: str) -> DataFrame:
    """The same fold over a whole table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(start(), pdf.sort_values(order, kind="stable", ignore_index=True))[1]

    return rows.groupBy(key).applyInPandas(run, schema)


def run_once(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run an append stream over what its sources have now, into Parquet, and read the result."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")
