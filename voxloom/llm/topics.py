"""Topics of documents: clusters of hashed words, fitted on all documents.

Words say little across languages, so each language has its own clusters: spherical k-means over
hashed words weighted by rarity.  Texts are read once to hashed words, which are written, and again as
blocks of some documents of a language a row; from there on a round of k-means is one pass over the blocks
whose tasks add up the vectors of each cluster, so the driver and the tasks hold the centres only.  Every document is then assigned by the hashed words of its whole text.  A table that has a
topic column needs none of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.common import settle, vector_sums
from voxloom.llm.textnum import U64, batch_texts, chunks, words

DIMS = 1 << 11
TOPICS = 6  # of each language
LEAST_ROWS = 30  # documents of a language for each of its topics
ROUNDS = 15


@dataclass
class Topics:
    weight: np.ndarray  # (DIMS,) rarity of a hashed word
    centres: dict[str | None, np.ndarray]  # by language: (DIMS, topics)


def chunk_bags(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of texts the distinct hashed words of its texts, 1 + log of their counts, and the first of
    each text with the total at the end."""
    for lo, hi in chunks(texts):
        h, first = words(texts[lo:hi])
        owner = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(first)) * DIMS
        both, n = np.unique(owner + (h & U64(DIMS - 1)).astype(np.int64), return_counts=True)
        yield both & (DIMS - 1), 1 + np.log(n), np.searchsorted(both, np.arange(hi - lo + 1) * DIMS)


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct hashed words and 1 + log of their counts."""
    return [(ids[a:b], n[a:b]) for ids, n, first in chunk_bags(texts) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def bag_of(text: Column) -> Column:
    """struct(ids, n): bags() of a text, packed as 16-bit numbers and single floats."""

    @F.arrow_udf("struct<ids: binary, n: binary>")
    def run(texts: pa.Array) -> pa.Array:
        held = bags(batch_texts(texts))
        return pa.StructArray.from_arrays([pa.array([x[i].astype(t).tobytes() for x in held], pa.binary()) for i, t in ((0, np.int16), (1, np.float32))], names=["ids", "n"])

    return run(text.cast("string"))


def nearest(key: np.ndarray, value: np.ndarray, first: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The most similar of the centres (topics, keys) of each text's weighed words, the first of equals; 0 without words."""
    near = np.zeros(len(first) - 1, dtype=np.int64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        near[some] = np.stack([np.add.reduceat(value * c.take(key), first[some]) for c in centres]).argmax(0)
    return near


SCALE = 1 << 20  # units of vectors that are added up: whole numbers, so sums do not depend on the order of rows


def sums(key: np.ndarray, value: np.ndarray, size: np.ndarray, scale: np.ndarray, near: np.ndarray) -> np.ndarray:
    """(TOPICS * DIMS): the sums of the texts' unit vectors by cluster, in SCALE; `scale` makes a text's values units."""
    return np.bincount(np.repeat(near * DIMS, size) + key, np.rint(value * np.repeat(scale, size)), minlength=TOPICS * DIMS)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of packed arrays, and the first of each row with the total at the end."""
    rows = column.to_pylist()
    out = np.frombuffer(b"".join(rows), dtype=kind)
    return out, np.cumsum([0, *(len(x) // out.itemsize for x in rows)])


NONE = -1e30  # of a centre that a language has not; finite, as a word may weigh 0
ROWS = 512  # rows of a batch that are worked on at once, so that what they need stays in the cache
BLOCK = 128  # documents of a block at most, so a block has DIMS * BLOCK words of 3 bytes at most, 0.8 MB


class Centres:
    """The centres of all languages in one table (topics, languages * DIMS), so that texts of several meet theirs together."""

    def __init__(self, centres: dict[str | None, np.ndarray]):
        self.code = {lang: i for i, lang in enumerate(centres)}
        self.table = np.full((TOPICS, len(centres) * DIMS), NONE, dtype=np.float32)
        for i, c in enumerate(centres.values()):
            self.table[: c.shape[1], i * DIMS : (i + 1) * DIMS] = c.T

    def found(self, weight: np.ndarray, langs: pa.Array, ids: pa.Array, n: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """(rows, keys in the table, values, firsts, nearest) of rows whose language has centres."""
        code = np.array([self.code.get(x, -1) for x in langs.to_pylist()], dtype=np.int64)
        for lo in range(0, len(code), ROWS):
            i, first = _flat(ids.slice(lo, ROWS), np.int16)
            own, size = code[lo : lo + ROWS], np.diff(first)
            value = _flat(n.slice(lo, ROWS), np.float32)[0] * weight[i]
            rows = np.flatnonzero(own >= 0)
            if len(rows) < len(own):
                some = np.repeat(own >= 0, size)
                i, value, size = i[some], value[some], size[rows]
                first = np.concatenate(([0], np.cumsum(size)))
            key = np.repeat(own[rows] * DIMS, size) + i
            yield lo + rows, key, value, first, nearest(key, value, first, self.table)


BLOCKS = "lang int, size binary, ids binary, at binary, n binary, scale binary"


def blocks(rows: DataFrame, weight: np.ndarray, code: dict[str | None, int]) -> DataFrame:
    """BLOCKS: the bags of rows(lang, ids, n) whose language has a code, of BLOCK documents of it a row or fewer: the
    words of each document (32 bits), its ids, where its n are (8 bits, if those suffice) in the block's distinct n, and
    what makes its weighed words a unit vector in SCALE (double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            own = np.array([code.get(x, -1) for x in batch.column(0).to_pylist()], dtype=np.int64)
            order = np.argsort(own, kind="stable")[np.count_nonzero(own < 0) :]
            for lang in np.unique(own[order]).tolist():
                these = order[np.searchsorted(own[order], lang) : np.searchsorted(own[order], lang, "right")]
                for lo in range(0, len(these), BLOCK):
                    few = pa.array(these[lo : lo + BLOCK])
                    (ids, first), (n, _) = _flat(batch.column(1).take(few), np.int16), _flat(batch.column(2).take(few), np.float32)
                    size = np.diff(first)
                    value = n * weight[ids]
                    norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), value * value, minlength=len(size)))
                    some, at = np.unique(n, return_inverse=True)
                    out.append((lang, *(x.tobytes() for x in (size.astype(np.int32), ids, at.astype(np.min_scalar_type(len(some))), some, SCALE / np.maximum(norm, 1e-12)))))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["lang", "size", "ids", "at", "n", "scale"])

    return rows.mapInArrow(run, BLOCKS)


def train(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> Topics:
    """fit() on all documents."""
    return fit(settle(docs.select(row_hash(id_col, text_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), bag_of(F.col(text_col)).alias("bag"))))


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def fit(rows: DataFrame) -> Topics:
    """Fitted on all rows of a table (h, lang, bag).  The first centres of a language are the documents with the
    smallest hashes; an empty cluster keeps its centre.  ROUNDS rounds, or fewer where no centre moves."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many documents each word is, as ids of a row without h; of each language the TOPICS rows with words that
        have the smallest hashes."""
        have = np.zeros(DIMS, dtype=np.int64)
        best: dict = {}
        for batch in batches:
            have += np.bincount(_flat(batch.column(2), np.int16)[0], minlength=DIMS)
            size = pc.binary_length(batch.column(2)).to_pylist()
            for i, (h, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = best.setdefault(lang, {})
                if size[i] and (len(own) < TOPICS or h < max(own)):
                    own[h] = (h, lang, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                    if len(own) > TOPICS:
                        del own[max(own)]
        rows = [(None, None, have.tobytes(), None), *(r for own in best.values() for r in own.values())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["h", "lang", "ids", "n"])

    columns = "h long, lang string, ids binary, n binary"
    held = rows.select("h", "lang", "bag.ids", "bag.n")
    total = 0
    counts: dict = {}
    for r in held.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect():
        total += r["n"]
        if r["n"] >= 2 * LEAST_ROWS:
            counts[r["lang"]] = min(TOPICS, r["n"] // LEAST_ROWS)
    seen = settle(held.mapInArrow(survey, columns))
    have = vector_sums(seen.where("h is null").select(F.lit(0).alias("part"), F.col("ids").alias("x"))).get(0, np.zeros(DIMS))
    weight = np.log((1 + total) / (1 + have)).astype(np.float32)
    centres: dict = {}
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "ids"))
    few = seen.where("h is not null").dropDuplicates(["lang", "h"]).withColumn("r", rank).where(F.col("r") <= TOPICS)
    for r in few.collect() if counts else []:
        own = centres.setdefault(r["lang"], np.zeros((DIMS, counts[r["lang"]]), dtype=np.float32)) if r["lang"] in counts else None
        if own is not None and r["r"] <= own.shape[1]:
            ids = np.frombuffer(r["ids"], dtype=np.int16)
            own[ids, r["r"] - 1] = np.frombuffer(r["n"], dtype=np.float32) * weight[ids]
    for c in centres.values():
        c /= np.maximum(np.linalg.norm(c, axis=0), 1e-12)

    def added(now: dict):
        table = [np.ascontiguousarray(c.T) for c in now.values()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(table), TOPICS * DIMS))
            for batch in batches:
                for i, lang in enumerate(batch.column(0).to_pylist()):
                    size, ids, at, n, scale = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=t) for k, t in enumerate((np.int32, np.int16, np.uint8, np.float32, np.float64), 1))
                    key = ids.astype(np.intp)
                    value = n.take(at.view(f"u{len(at) // max(len(ids), 1) or 1}")) * weight.take(key)
                    total[lang] += sums(key, value, size, scale, nearest(key, value, np.concatenate(([0], np.cumsum(size))), table[lang]))
            parts = total.astype(np.int64).reshape(-1, DIMS)
            some = np.flatnonzero(parts.any(1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["part", "x"])

        return run

    packed = settle(blocks(held.select("lang", "ids", "n"), weight, {lang: i for i, lang in enumerate(centres)})) if centres else held
    for _ in range(ROUNDS if centres else 0):
        got = vector_sums(packed.mapInArrow(added(centres), "part int, x binary"))
        new = {lang: c.copy() for lang, c in centres.items()}
        langs = list(new)
        for part, c in got.items():
            new[langs[part // TOPICS]][:, part % TOPICS] = c / max(float(np.linalg.norm(c)), 1e-12)
        still = all((new[lang] == c).all() for lang, c in centres.items())
        centres = new
        if still:
            break
    return Topics(weight, centres)


def assign(model: Topics, langs: list, texts: list[bytes]) -> list[str]:
    """`language/number` of each text; a language without clusters has number 0, and so has a text without
    words; of equally near clusters the first."""
    out = []
    for lang, (ids, n) in zip(langs, bags(texts), strict=True):
        c = model.centres.get(lang)
        best = int(((n * model.weight[ids]) @ c[ids]).argmax()) if c is not None and len(ids) else 0
        out.append(f"{'' if lang is None else lang}/{best}")
    return out


def topic_of(model: Topics, lang: Column, text: Column) -> Column:
    @F.arrow_udf("string")
    def run(langs: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array(assign(model, langs.to_pylist(), batch_texts(texts)), pa.string())

    return run(lang.cast("string"), text.cast("string"))


def topic_of_bag(model: Topics, lang: Column, bag: Column) -> Column:
    """topic_of() where bag_of() is at hand."""
    at = Centres(model.centres)

    @F.arrow_udf("string")
    def run(langs: pa.Array, ids: pa.Array, n: pa.Array) -> pa.Array:
        best = np.zeros(len(langs), dtype=np.int64)
        if at.code:
            for rows, _, _, _, near in at.found(model.weight, langs, ids, n):
                best[rows] = near
        return pa.array([f"{lang or ''}/{k}" for lang, k in zip(langs.to_pylist(), best.tolist(), strict=True)], pa.string())

    return run(lang.cast("string"), bag["ids"], bag["n"])
