"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes (the splitters hold a short prefix, a digest
that splits what has the same prefix, and the id, so that they stay small however long texts are), an
external sort places equal texts side by side, and each text is compared in full with its neighbour.
A group of copies may span many partitions: the first and last run of each partition are stitched
afterwards, by full text.  Texts cross the network once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import WS_RUN, read_table, settle, text_hash

HEAD = 16  # characters of a text in the splitters

_RUNS = "doc_id long, th long, sha string, part long, run long, ord long, keep_id long, n long, edge boolean, edge_text string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("sha", pa.string()), ("part", pa.int64()), ("run", pa.int64()), ("ord", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_()), ("edge_text", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours.  Only the ids of the run at hand are kept, never its texts."""
    from pyspark import TaskContext

    part, run, text, sha = TaskContext.get().partitionId(), -1, None, None
    ids: list = []
    ths: list = []
    ready: dict[str, list] = {k: [] for k in _SCHEMA.names}

    def close(last: bool) -> None:
        if run < 0:
            return
        edge = last or run == 0
        n = len(ids)
        for name, values in zip(_SCHEMA.names, (ids, ths, [sha] * n, [part] * n, [run] * n, range(n), [ids[0]] * n, [n] * n, [edge] * n, [text if edge else None] + [None] * (n - 1)), strict=True):
            ready[name].extend(values)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(ready[k], type=_SCHEMA.field(k).type) for k in _SCHEMA.names], schema=_SCHEMA)
        for v in ready.values():
            v.clear()
        return out

    for batch in batches:
        for i, th, digest, norm in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if run < 0 or digest != sha or norm != text:
                close(False)
                run, text, sha, ids, ths = run + 1, norm, digest, [], []
            ids.append(i)
            ths.append(th)
        if len(ready["run"]) >= 8192:
            yield flush()
    close(True)
    if ready["run"]:
        yield flush()


def _sorted(df: DataFrame, id_col: str, text_col: str, extra: list[Column]) -> DataFrame:
    """(doc_id, sha, norm, extra...) in order of content, then id, dealt by ranges of it."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WS_RUN, " ")
    one = df.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), *extra)
    keyed = one.select("doc_id", F.sha2("norm", 256).alias("sha"), "norm", *one.columns[2:], F.substring("norm", 1, HEAD).alias("head"))
    last_null = F.col("doc_id").asc_nulls_last()
    return keyed.repartitionByRange(F.col("head"), F.col("sha"), last_null).sortWithinPartitions("head", "sha", "norm", last_null).drop("head")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, keep_id, group_size, first, text_sha256) for every row of df.

    Texts are equal when they are so after each run of ASCII white space becomes one space; null
    counts as empty.  keep_id is the smallest id of the group (null only when all its ids are null);
    `first` marks exactly one row of each group, one with that id; group_size counts rows, so a row
    that is repeated counts each time.  An empty df gives an empty result.  Other columns of df are
    ignored.
    """
    ranged = _sorted(df, id_col, text_col, [text_hash(text_col).alias("th")])
    runs = settle(ranged.select("doc_id", "th", "sha", "norm").mapInArrow(_runs, _RUNS))
    # At most two edge runs for each partition; equal texts among them are one group.
    edges = runs.where(F.col("edge") & (F.col("ord") == 0)).select("part", "run", "keep_id", "n", "edge_text")
    whole = edges.groupBy("edge_text").agg(F.min("keep_id").alias("w_keep"), F.sum("n").alias("w_n"), F.min(F.struct(F.col("keep_id").isNull(), "keep_id", "part", "run")).alias("w_first"))
    fixed = (
        edges.join(whole, "edge_text")
        .select("part", "run", "w_keep", "w_n", ((F.col("part") == F.col("w_first.part")) & (F.col("run") == F.col("w_first.run"))).alias("w_here"))
    )
    inner = runs.where(~F.col("edge")).select("doc_id", "th", "sha", "ord", "keep_id", "n", F.lit(True).alias("here"))
    outer = runs.where("edge").join(F.broadcast(fixed), ["part", "run"]).select("doc_id", "th", "sha", "ord", F.col("w_keep").alias("keep_id"), F.col("w_n").alias("n"), F.col("w_here").alias("here"))
    return inner.unionByName(outer).select("doc_id", "th", "keep_id", F.col("n").alias("group_size"), ((F.col("ord") == 0) & F.col("here")).alias("first"), F.col("sha").alias("text_sha256"))


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, sha, norm, columns...) the first of each run of equal neighbours, as (part, edge,
    doc_id, edge_text, columns...).  A row is held back until its run ends, as the last run is an edge."""
    from pyspark import TaskContext

    part, sha, text, held, run = TaskContext.get().partitionId(), None, None, None, -1

    def shaped(rows: pa.RecordBatch, edges: list[int]) -> pa.RecordBatch:
        """edges: 0 inside, 1 the first run, 2 the last."""
        out = [pa.array([part] * rows.num_rows, pa.int64()), pa.array(edges, pa.int32()), rows.column(0), pa.array([t.as_py() if e else None for t, e in zip(rows.column(2), edges, strict=True)], pa.string())]
        return pa.RecordBatch.from_arrays([*out, *rows.columns[3:]], names=["part", "edge", "edge_id", "edge_text", *rows.schema.names[3:]])

    for batch in batches:
        shas, starts = batch.column(1).to_pylist(), []
        for i, digest in enumerate(shas):
            if digest != sha or (norm := batch.column(2)[i].as_py()) != text:
                text, sha = batch.column(2)[i].as_py() if digest != sha else norm, digest
                starts.append(i)
        if not starts:
            continue
        if held is not None:
            yield shaped(held, [1 if run == 0 else 0])
        if len(starts) > 1:
            yield shaped(batch.take(pa.array(starts[:-1])), [1 if run + 1 + k == 0 else 0 for k in range(len(starts) - 1)])
        run += len(starts)
        held = batch.take(pa.array(starts[-1:]))  # a copy: the batch is let go
    if held is not None:
        yield shaped(held, [1 if run == 0 else 2])


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the copies: of equal texts the row with the smallest id, all its columns.

    Rows that repeat both id and text are one row afterwards (any of them: they may differ only in
    other columns).  Whole rows go through the sort, once; only the edges of partitions are looked at
    again.
    """
    extra = [F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    fields = [T.StructField("part", T.LongType()), T.StructField("edge", T.IntegerType()), T.StructField("edge_id", df.schema[id_col].dataType), T.StructField("edge_text", T.StringType())]
    schema = T.StructType([*fields, *(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields))])
    rows = settle(_sorted(df, id_col, text_col, extra).mapInArrow(_firsts, schema))
    edges = rows.where("edge > 0").select("part", "edge", "edge_id", "edge_text")  # at most two for each partition
    best = edges.groupBy("edge_text").agg(F.min(F.struct(F.col("edge_id").isNull(), "edge_id", "part", "edge")).alias("m")).select("m.part", "m.edge")
    kept = rows.where("edge = 0").unionByName(rows.join(F.broadcast(best), ["part", "edge"], "left_semi").select(rows.columns))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    out = exact_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
