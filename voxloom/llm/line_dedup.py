r"""Line dedup (native): explode normalised lines, hash, count distinct documents per hash, drop
lines over the threshold, reassemble by position.

Texts cross the network once.  What is counted and joined are narrow rows of hashes: a key is counted
once for each document before the counts meet.  Keys that a thousandth of all documents hold are few
(at most a thousand times the lines of a mean document), so they can be broadcast and their lines
never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import WS_CHARS, settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT_SHARE = 1000  # a key is hot from one document in so many
BROADCAST_KEYS = 200_000  # so many keys are broadcast at most, 16 bytes of hash and an id each


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, UPPER.lower())


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def held_keys(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the keys held by at least min_docs distinct documents."""
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) >= min_chars), _key))
    mine = docs.where("NOT nul").select("id", F.explode(keys).alias("key")).select("id", *_hashes("key"))
    once = mine.distinct()  # a document may be spread over rows that repeat its id
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def lost_lines(lines: DataFrame, held: DataFrame, documents: int, broadcast_keys: int) -> DataFrame:
    """The lines whose key is held, with its keeper.  Few keys are broadcast whole; of many, those that a
    thousandth of all documents hold are, and the others are joined by hash.  All ways give the same rows."""
    keys = held.select("h1", "h2", "keeper")
    if held.count() <= broadcast_keys:
        return lines.join(F.broadcast(keys), ["h1", "h2"])
    hot = held.where(F.col("n_docs") * HOT_SHARE >= documents).select("h1", "h2", "keeper")
    if hot.count() > BROADCAST_KEYS:
        return lines.join(keys, ["h1", "h2"])
    cold = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    return lines.join(F.broadcast(hot), ["h1", "h2"]).unionByName(cold.join(keys, ["h1", "h2"]))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    r"""(doc_id, n_lines, n_dropped, kept_text) for every document of df.

    Keys of at least `min_chars` code points held by at least `min_docs` documents lose all their lines
    but those of the largest id that holds them.  A document is all rows of one id: its rows count once
    for a key, and its lines are those of all its rows, by position and, at one position, by line.  Rows
    without an id are one document more, which counts for no key and keeps none that is dropped.  A null
    or empty text is one empty line.  An empty df gives an empty result.  Other columns of df are
    ignored, whatever their names.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("nul"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = docs.groupBy("id", "nul").count()
    repeated = rows.where("count > 1").select("id", "nul")
    documents, again = rows.agg(F.count(F.lit(1)), F.max("count")).first()
    held = settle(held_keys(docs, min_chars, min_docs))
    lines = docs.select("id", "nul", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "nul", "th", "pos", _key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select("id", "nul", "th", "pos", *_hashes("key"))
    lost = lost_lines(lines, held, documents, broadcast_keys).where(F.col("nul") | (F.col("id") != F.col("keeper")))
    dropped = lost.groupBy("id", "nul", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    joined = docs.join(dropped, ["id", "nul", "th"], "left")
    # Flags by position: runs of false up to each dropped position, so that lookups are O(1).
    flags = F.flatten(
        F.transform("gone", lambda p, i: F.concat(F.array_repeat(F.lit(False), (p - F.when(i > 0, F.get("gone", i - 1)).otherwise(F.lit(-1)) - 1).cast("int")), F.array(F.lit(True))))
    )
    parts = joined.select("id", "nul", F.split("text", "\n", -1).alias("lines"), F.coalesce(flags, F.array().cast("array<boolean>")).alias("flags"))
    n_lines, n_dropped = F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("flags", lambda x: x)).cast("long").alias("n_dropped")
    kept = lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False))
    name = F.when(~F.col("nul"), F.col("id")).alias("doc_id")
    one = lambda d: d.select(name, n_lines, n_dropped, F.array_join(F.filter("lines", kept), "\n").alias("kept_text"))
    if (again or 1) == 1:
        return one(parts)
    # Rows that repeat an id become one document.
    at = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line"), kept(x, i).alias("kept"))), lambda x: x["kept"])
    several = parts.join(repeated, ["id", "nul"], "left_semi").select("id", "nul", n_lines, n_dropped, at.alias("at"))
    merged = several.groupBy("id", "nul").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_dropped").alias("n_dropped"), F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    merged = merged.select(name, "n_lines", "n_dropped", F.array_join(F.transform("at", lambda x: x["line"]), "\n").alias("kept_text"))
    return one(parts.join(repeated, ["id", "nul"], "left_anti")).unionByName(merged)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept, for every document."""
    from voxloom.llm.common import read_table

    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
parts AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM parts
), held AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, pos, line, (keeper IS NOT NULL AND keeper <> doc_id) AS gone
  FROM keyed LEFT JOIN held ON keyed.k = held.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
