"""Token counts through a digest cache.

Contents are keyed by the digest of the normalised text and of the tokenizer's file.  Normalised means:
what the tokenizer itself cannot tell apart is made equal, and nothing else.  Counts that the cache
already has are joined; only distinct missing contents are encoded, once each, and appended to the
cache as Parquet.  Copies cost one encoding; a new tokenizer file never meets old counts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import read_table, scratch, settle

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
HOT_SHARE = 1000  # a content is hot from one row in so many: there are at most so many hot contents
SPACE_MARK = "\u2581"  # a fixed value: how sentencepiece writes a space
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    """text -> number of tokens; sentencepiece for .model, tokenizers for .json, library defaults."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda text: len(sp.encode(text))
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    return _loaded[path]


def normal_form(path: str) -> Callable[[Column], Column]:
    """What to do to a text before its digest is taken, so that texts with equal ids have equal digests.

    A sentencepiece model whose own normaliser changes nothing still writes spaces as a mark, and cannot
    tell that mark in a text from a space.  For all other files texts stay as they are.
    """
    if path.endswith(".model"):
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:  # without its protocol classes the model's normaliser is not known
            return lambda text: text
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name == "identity" and not spec.precompiled_charsmap and spec.escape_whitespaces:
            return lambda text: F.translate(text, SPACE_MARK, " ")
    return lambda text: text


def encode_counts(texts: DataFrame, path: str, version: str) -> DataFrame:
    """(content, tokenizer, n_tokens) for rows (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        seen: set[str] = set()
        for batch in batches:
            # Rows that repeat both id and text meet in one task; the first of them is encoded.
            contents = batch.column(0).to_pylist()
            fresh = [i for i, c in enumerate(contents) if not (c in seen or seen.add(c))]
            values = [batch.column(1)[i].as_py() for i in fresh]
            yield pa.RecordBatch.from_arrays(
                [pa.array([contents[i] for i in fresh], pa.string()), pa.array([version] * len(values), pa.string()), pa.array([count(x) for x in values], pa.int64())],
                names=["content", "tokenizer", "n_tokens"],
            )

    return texts.mapInArrow(run, CACHE_SCHEMA)


def read_cache(spark, cache_dir: str) -> DataFrame:
    """The cache's rows; an absent folder is an empty cache.  Looked up by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache_dir)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def token_counts(df: DataFrame, path: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; a null text is an empty one.

    Repeated rows each get a row.  The cache may hold a content twice (two jobs that missed together);
    it is read as a set.  An empty df gives an empty result.  Other columns of df are ignored.
    """
    spark, version, form = df.sparkSession, tokenizer_digest(path), normal_form(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), form(text).alias("text")).withColumn("content", F.sha2("text", 256))
    # Narrow rows first: which id encodes each content.  Copies fold before the shuffle.
    marked = settle(rows.select("doc_id", "n_bytes", "content"))
    have = lambda: read_cache(spark, cache_dir).where(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])
    contents = settle(marked.groupBy("content").agg(F.min("doc_id").alias("m_id"), F.count(F.lit(1)).alias("copies")))
    missing = contents.join(have(), "content", "left_anti").select(F.col("content").alias("m_content"), "m_id")
    # The text of each distinct miss, taken from the row with the smallest id.
    texts = rows.join(missing, (rows["content"] == missing["m_content"]) & rows["doc_id"].eqNullSafe(missing["m_id"])).select("content", "text")
    encode_counts(texts, path, version).write.mode("append").parquet(cache_dir)
    known = have()
    # A content that a thousandth of all rows hold would meet in one task; there are at most a thousand such.
    hot = contents.where(F.col("copies") * HOT_SHARE >= marked.count()).select("content")
    often = marked.join(F.broadcast(known.join(F.broadcast(hot), "content")), "content")
    rest = marked.join(F.broadcast(hot), "content", "left_anti").join(known, "content")
    return often.unionByName(rest).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of piece_bpe_32k.model for all documents; the cache begins empty for each call.

    The documents come in two deliveries, as a growing corpus does: those up to the middle of the ids,
    then all others, whose copies of earlier contents are found in the cache.
    """
    import public_tokenizers as P

    docs = read_table(spark, sf_dir, "documents")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    early = F.coalesce(F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(False))
    path, cache = P.path("piece_bpe_32k.model"), f"{scratch(spark)}/cache"
    # Kept before the cache grows: two reads of one folder in one plan would count as the same rows.
    first = settle(token_counts(docs.where(early), path, cache))
    return first.unionByName(settle(token_counts(docs.where(~early), path, cache)))
