"""Language identification by prediction by partial matching.

Each language has a byte context tree of order up to three, with PPM's escape method C and exclusion.
The trees are frozen after training, so the exact code length of a byte after a context is a constant.
What a language has not seen after a context costs its escape there plus the code length one order
below, and exclusion only scales all that is left by one factor; so a tree is kept as what it has seen:
a code length for each (context, byte) and an escape length for each context, by language.  A text's
code lengths under all languages are sums over its four-byte sequences.  Lengths are whole numbers of
2^-20 bits, so sums are exact, whatever they are grouped by: equal texts and equal trees have equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.common import read_table, settle
from voxloom.llm.textnum import batch_texts, chunks

TRAIN_ROWS = 400  # bound of the training sample: rows of each language
ORDER = 3
UNIT = 1 << 20  # code lengths are kept as whole numbers of 1 / UNIT bits
SLICE = 1 << 16  # byte positions scored at a time
CELLS = 1 << 20  # (position, language) pairs held at a time
_PAD = b"\n" * ORDER


def units(p: np.ndarray) -> np.ndarray:
    """Code lengths of probabilities, or of ratios of them."""
    return np.rint(-np.log2(p) * UNIT).astype(np.int32)


@dataclass
class Lists:
    """Values by language for sorted keys: those of keys[i] are lang and bits from start[i] to start[i + 1]."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, lang: np.ndarray, bits: np.ndarray, langs: int) -> Lists:
        by = np.lexsort((lang, key))
        keys, start = np.unique(key[by], return_index=True)
        kind = np.uint16 if langs <= 1 << 16 else np.int32
        return cls(keys.astype(np.uint32), np.append(start, len(key)).astype(np.int64), lang[by].astype(kind), bits[by])

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in asked, language, bits) of all values of the keys asked for."""
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == asked)
        lo, n = self.start[at[hit]], self.start[at[hit] + 1] - self.start[at[hit]]
        every = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(hit, n), self.lang[every], self.bits[every]

    def nbytes(self) -> int:
        return self.keys.nbytes + self.start.nbytes + self.lang.nbytes + self.bits.nbytes


@dataclass
class Model:
    langs: list[str]
    alone: np.ndarray  # (256, languages): units of a byte without any context
    seen: list[Lists]  # orders 1 to ORDER: units of a byte after a context that has had it
    escape: list[Lists]  # orders 1 to ORDER: units by which a byte that a context has not had is dearer than one order below

    def nbytes(self) -> int:
        """Size: some 12 bytes for each byte sequence of each order that a language has in its sample."""
        return self.alone.nbytes + sum(x.nbytes() for x in (*self.seen, *self.escape))


def fit(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """From counts n of four-byte grams (oldest byte highest) by language number.

    Bytes that no language has share one symbol, which no context has seen.
    """
    lang, gram, n, k = lang.astype(np.int64), gram.astype(np.int64), n.astype(np.int64), len(langs)
    known = np.unique([(gram >> s) & 255 for s in (24, 16, 8, 0)])
    last = np.bincount(lang * 256 + (gram & 255), n, minlength=k * 256).reshape(k, 256)
    kinds, rest = (last > 0).sum(1, keepdims=True), len(known) + 1 - (last > 0).sum(1, keepdims=True)
    whole = last.sum(1, keepdims=True) + kinds
    # PPM-C below a uniform law: what a language has not seen shares its escape alike.
    p = np.where(last > 0, last / np.maximum(whole, 1), np.where(kinds > 0, kinds / np.maximum(whole, 1), 1) / rest)
    seen, escape = [], []
    below, below_p = np.arange(k * 256), p.ravel()  # (language, sequence) one order below, and its probability
    for order in range(1, ORDER + 1):
        span = 8 * (order + 1)
        key, at = np.unique((lang << span) | (gram & ((1 << span) - 1)), return_inverse=True)
        count = np.bincount(at, n, minlength=len(key))
        who, sequence = key >> span, key & ((1 << span) - 1)
        context, of = np.unique(key >> 8, return_inverse=True)
        kinds = np.bincount(of, minlength=len(context))
        whole = np.bincount(of, count, minlength=len(context)) + kinds
        own = count / whole[of]
        # Exclusion: below, only what the context has not seen is left.
        short = (who << (span - 8)) | (sequence & ((1 << (span - 8)) - 1))
        left = 1 - np.bincount(of, below_p[np.searchsorted(below, short)], minlength=len(context))
        seen.append(Lists.of(sequence, who, units(own), k))
        escape.append(Lists.of(context & ((1 << (span - 8)) - 1), context >> (span - 8), units(kinds / whole / left), k))
        below, below_p = key, own
    return Model(langs, units(p.T), seen, escape)


def gram_lengths(model: Model, grams: np.ndarray) -> np.ndarray:
    """(grams, languages): units of each four-byte gram's last byte after the three before it."""
    bits = model.alone[grams & 255].astype(np.float64)
    for order, (seen, escape) in enumerate(zip(model.seen, model.escape, strict=True), 1):
        sequence = grams & ((1 << 8 * (order + 1)) - 1)
        at, lang, more = escape.find(sequence >> 8)
        bits[at, lang] += more
        at, lang, own = seen.find(sequence)
        bits[at, lang] = own
    return bits


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): bits of each whole text under each language.  A slice of positions is held at a
    time, however long a text is or however many languages there are."""
    out = np.zeros((len(texts), len(model.langs)))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    if not size.sum():
        return out
    buf = np.frombuffer(_PAD + _PAD.join(texts), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum(size + ORDER)  # of each text in buf, as the padding goes before it
    step = max(1, min(SLICE, CELLS // len(model.langs)))
    for lo in range(ORDER, len(buf), step):
        b = buf[lo - ORDER : lo + step]
        grams, which = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_inverse=True)
        bits = gram_lengths(model, grams.astype(np.int64))[which]
        first, last = np.searchsorted(ends, [lo, lo + len(which) - 1], side="right")
        t = np.arange(first, last + 1)
        x, y = np.maximum(ends[t] - size[t], lo) - lo, np.minimum(ends[t], lo + len(which)) - lo
        t, marks = t[x < y], np.stack([x, y], axis=1)[x < y].ravel()
        if len(t):
            out[t] += np.add.reduceat(bits, marks[marks < len(bits)], axis=0)[::2]
    return out / UNIT


def train(df: DataFrame, text_col: str, lang_col: str, id_col: str, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most `rows` texts of each language, those with the smallest hashes of their ids.

    Gram counts are made where the texts are; the driver gets counts only, at most the distinct grams
    of the sample.  None if there is nothing to learn from.
    """
    known = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h")).where("lang IS NOT NULL AND text <> ''")
    sizes = settle(known.groupBy("lang").count())
    langs = sorted(r["lang"] for r in sizes.collect())
    if not langs:
        return None
    share = F.least(F.lit(1.0), 2 * rows / F.col("count"))
    near = known.join(sizes, "lang").where(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20))
    sample = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts = batch.column(0).to_pylist(), batch_texts(batch.column(1))
            for lang in set(kinds):
                for lo, hi in chunks(own := [t for k, t in zip(kinds, texts, strict=True) if k == lang]):
                    b = np.frombuffer(b"".join(_PAD + t for t in own[lo:hi]), dtype=np.uint8).astype(np.int64)
                    gram, n = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(grams):
        return None
    number = {x: i for i, x in enumerate(langs)}
    return fit(langs, grams["lang"].map(number).to_numpy(), grams["gram"].to_numpy(), grams["n"].to_numpy())


def identify(df: DataFrame, model: Model | None, text_col: str, keep: list[str]) -> DataFrame:
    """Columns `keep` with lang_pred and score for every row.

    score is the posterior at one byte of evidence: 2^-(bits per byte), over all languages.  A null text
    or one without a letter is `und` with score 0, and so is every text without a model; equal code
    lengths go to the language first in order.  Texts are scored whole, however long; repeated rows alike.
    The model goes to each executor once; it grows with what training has seen (Model.nbytes), not with
    languages times contexts.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    cols = df.select(*keep, letters.alias("__letters"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch_texts(batch.column(len(keep) + 1))
            ok = np.array(batch.column(len(keep)).to_pylist(), dtype=bool)
            pred = np.full(len(texts), "und", dtype=object)
            score = np.zeros(len(texts))
            if model is not None:
                names = np.array(model.langs, dtype=object)
                for lo, hi in chunks(texts):
                    bits = code_lengths(model, texts[lo:hi])
                    per = bits / np.maximum([[len(t)] for t in texts[lo:hi]], 1)
                    like = np.exp2(per.min(1, keepdims=True) - per)
                    pred[lo:hi] = names[bits.argmin(1)]
                    score[lo:hi] = 1 / like.sum(1)
            pred[~ok], score[~ok] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are in the way of the result's; keep others")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[: len(keep)])
    return cols.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents whose crc32 is not 0 modulo 5.

    A null doc_id is neither held out nor learned from.
    """
    docs = read_table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs.where(fold != 0), "text", "lang", "doc_id")
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model, "text", ["doc_id", "held_out"])
