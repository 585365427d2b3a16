"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (low quality), 1 (sound but toxic) or 2 (sound and clean).  Hashed features of
the whole text share one weight vector; ordered thresholds t_1 < t_2 turn its score f into the tail
probabilities P(grade >= k) = sigmoid(f - t_k), from which the expected grade and the selection follow.
The model is fitted on all labelled rows: their hashed features are written once, and each step of L-BFGS is a
pass over them whose tasks add up loss and slopes.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import read_table, settle, vector_sums
from voxloom.llm.textnum import U64, _BYTE, _LOWER, _P_INV, _pow, batch_texts, chunks, mix

BROADCAST_LABELS = 1_000_000  # labelled rows up to which they are sent to the documents, so that texts stay where they are
SCALE = 1 << 24  # units of sums of loss and slopes: whole numbers, so sums do not depend on the order of rows
SLICE = 1 << 14  # features whose sums travel together
STEPS = 45  # of L-BFGS
PAIRS = 8  # last steps from which L-BFGS knows the curvature
DECAY = 1e-4
BALANCE = 0.2
DIM_BITS = 20
DIMS = 1 << DIM_BITS
GRADES = 3
LAYOUT = 0.5  # value of a layout feature
STEMS = (4, 5, 7)  # bytes of a longer word that count as its stem
_SHAPES = 6 * 24  # layout features, one-hot, after the hashed words
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_BAR = np.zeros(256, dtype=bool)
_BAR[[124, 42, 35, 36, 37, 38, 33]] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, values, first feature of each text with the total at the end).

    Distinct words (runs of letters and digits, A-Z lower-cased) and their beginnings, hashed; and six figures of the layout
    (repetition, capitals, marks, symbols, words a line, length) by size class.
    """
    n = len(texts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _LETTER[buf])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _pow(len(buf) + 1)
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * power[: len(buf)], out=run[1:])
    long = ends - starts

    def hashed(which: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = starts[which]
        return mix((run[at + length] - run[at]) * inverse[at] + length.astype(np.uint64))

    words = np.diff(np.searchsorted(starts, at))
    doc = np.repeat(np.arange(n, dtype=np.uint64), words) << U64(DIM_BITS)
    every = np.arange(len(starts))
    parts = [doc | (hashed(every, long) & U64(DIMS - 1))]
    for k in STEMS:
        which = np.flatnonzero(long > k)
        parts.append(doc[which] | (hashed(which, np.full(len(which), k)) + U64(k) & U64(DIMS - 1)))
    both = np.unique(np.concatenate(parts))
    owner, ids = (both >> U64(DIM_BITS)).astype(np.int64), (both & U64(DIMS - 1)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[buf])))
        return (total[at[1:] - 1] - total[at[:-1]]) / np.maximum(of, 1)

    size = np.diff(at) - 1
    lines = np.zeros(256, dtype=bool)
    lines[10] = True
    alpha = share(_ALPHA, np.ones(n))
    shape = np.stack([
        np.clip(np.log2(np.maximum(words, 1) / np.maximum(distinct, 1)) * 4, 0, 23),
        np.clip(share(_UPPER, alpha) * 24, 0, 23),
        np.clip((size - alpha - share(_BLANK, np.ones(n))) / np.maximum(size, 1) * 60, 0, 23),
        np.clip(share(_BAR, np.maximum(words, 1)) * 24, 0, 23),
        np.clip(np.log2(np.maximum(words, 1) / (share(lines, np.ones(n)) + 1) + 1) * 2, 0, 23),
        np.clip(np.log2(words + 1), 0, 23),
    ], axis=1).astype(np.int64) + np.arange(6) * 24 + DIMS
    owner = np.concatenate([owner, np.repeat(np.arange(n), 6)])
    ids = np.concatenate([ids, shape.ravel()])
    value = np.concatenate([(np.maximum(distinct, 1) ** -0.25)[owner[: len(both)]], np.full(n * 6, LAYOUT)])
    order = np.argsort(owner, kind="stable")
    return ids[order], value[order], np.concatenate(([0], np.cumsum(distinct + 6)))


@dataclass
class Ordinal:
    weight: np.ndarray  # float32, DIMS + _SHAPES
    cut: np.ndarray  # GRADES - 1 thresholds, increasing

    def latent(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in chunks(texts):
            ids, value, first = features(texts[lo:hi])
            out[lo:hi] = np.add.reduceat(self.weight[ids] * value, first[:-1])
        return out

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """(rows, GRADES - 1): P(grade >= k) for k = 1, 2."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.cut[None, :], -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cuts_of(base: float, steps: np.ndarray) -> np.ndarray:
    """Increasing thresholds: base, base + e^steps[1], ..."""
    return base + np.concatenate(([0.0], np.cumsum(np.exp(steps[1:]))))


def row_slopes(f: np.ndarray, y: np.ndarray, base: float, steps: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the weighed negative log likelihood of grade y given score f, and the slopes of the logistic
    functions at the thresholds above and below it."""
    pad = np.concatenate(([-np.inf], cuts_of(base, steps), [np.inf]))
    up, down = _sigmoid(pad[y + 1] - f), _sigmoid(pad[y] - f)
    p = np.maximum(up - down, 1e-9)
    du, dd = (heavy[y] * s * (1 - s) / p for s in (up, down))
    return -heavy[y] * np.log(p), du, dd


def cut_slopes(du: np.ndarray, dd: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes in the thresholds."""
    return np.array([-du[y == k].sum() + dd[y == k + 1].sum() for k in range(GRADES - 1)])


def step_slopes(dc: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Slopes in (base, steps[1:]), given those in the thresholds."""
    return np.array([dc.sum(), *(dc[k:].sum() * np.exp(steps[k]) for k in range(1, GRADES - 1))])


def loss_and_slopes(f: np.ndarray, y: np.ndarray, base: float, steps: np.ndarray, heavy: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(weighed negative log likelihood of grades y given scores f, its slopes in f, in (base, steps[1:]))."""
    loss, du, dd = row_slopes(f, y, base, steps, heavy)
    return float(loss.sum()), du - dd, step_slopes(cut_slopes(du, dd, y), steps)


def grade_weights(count: np.ndarray, balance: float) -> np.ndarray:
    """Rare grades weigh more; count: rows of each grade."""
    return (np.maximum(count / count.sum(), 1e-9) * GRADES) ** -balance


def common_features(held: np.ndarray, rows: int, min_held: int | None = None) -> np.ndarray:
    """Features held by at least min_held rows; fewer would only be learned by heart.  One row in a thousand
    where nothing is given, and three at least."""
    return np.flatnonzero(held >= (max(3, rows // 1000) if min_held is None else min_held))


def places(common: np.ndarray) -> np.ndarray:
    """The number of each feature among the common ones, or -1."""
    place = np.full(DIMS + _SHAPES, -1, dtype=np.int32)
    place[common] = np.arange(len(common))
    return place


def total(place: np.ndarray, x: np.ndarray, heavy: np.ndarray, ids: np.ndarray, first: np.ndarray, scale: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Over some rows, in SCALE: slopes in the weights of common features, in the thresholds, and the loss; x: weights, base, steps[1:]."""
    size = len(x) - GRADES + 1
    at = place[ids]
    some = at >= 0
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[some]
    at, val = at[some], np.where(ids[some] < DIMS, scale[owner], LAYOUT)
    f = np.bincount(owner, x[at] * val, minlength=len(first) - 1)
    loss, du, dd = row_slopes(f, grade, x[size], np.concatenate(([0.0], x[size + 1 :])), heavy)
    inner = np.bincount(at, np.rint((du - dd)[owner] * val * SCALE), minlength=size)
    return np.concatenate([inner, cut_slopes(np.rint(du * SCALE), np.rint(dd * SCALE), grade), [np.rint(loss * SCALE).sum()]])


def descend(sums: Callable[[np.ndarray], np.ndarray], size: int, rows: int, steps: int, decay: float) -> np.ndarray:
    """L-BFGS on the mean loss of `rows` rows with a ridge of `decay` on the weights; sums(x) is total() over all rows."""
    x = np.concatenate([np.zeros(size), [-1.5], np.zeros(GRADES - 2)])

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        got = sums(x) / (SCALE * rows)
        slope = np.concatenate([got[:size] + decay * x[:size], step_slopes(got[size : size + GRADES - 1], np.concatenate(([0.0], x[size + 1 :])))])
        return got[-1] + decay / 2 * float(x[:size] @ x[:size]), slope

    now, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, back = -g, []
        for s, y in reversed(pairs):
            back.append((s @ q) / (s @ y))
            q = q - back[-1] * y
        q = q * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(float(np.linalg.norm(g)), 1e-12))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            q = q + (a - (y @ q) / (s @ y)) * s
        down, t = float(g @ q), 1.0
        if down > -1e-12:
            break
        while True:
            new = x + t * q
            new[size + 1 :] = np.clip(new[size + 1 :], -5, 4)
            then, slope = value(new)
            if then <= now + 1e-4 * t * down or t < 1e-4:
                break
            t /= 3
        if then >= now:
            break
        s, y, gain = new - x, slope - g, now - then
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-PAIRS:]
        x, now, g = new, then, slope
        if gain < 1e-7 * now:
            break
    return x


def model_of(x: np.ndarray, common: np.ndarray) -> Ordinal:
    weight = np.zeros(DIMS + _SHAPES, dtype=np.float32)
    weight[common] = x[: len(common)]
    return Ordinal(weight, cuts_of(x[len(common)], np.concatenate(([0.0], x[len(common) + 1 :]))))


def fit(rows: list[np.ndarray], scale: np.ndarray, grade: np.ndarray, epochs: int = STEPS, decay: float = DECAY, balance: float = BALANCE, min_held: int | None = None) -> Ordinal | None:
    """train() for rows of features at hand (a row has each once).  None without rows.  Thresholds of absent grades
    stay in order."""
    if not len(rows):
        return None
    ids, first = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    common = common_features(np.bincount(ids, minlength=DIMS + _SHAPES), len(rows), min_held)
    heavy, place = grade_weights(np.bincount(grade, minlength=GRADES), balance), places(common)
    return model_of(descend(lambda x: total(place, x, heavy, ids, first, scale, grade), len(common), len(rows), epochs, decay), common)


def _sliced(x: np.ndarray) -> pa.RecordBatch:
    """Parts of a vector of whole numbers, for vector_sums()."""
    cut = [x[lo : lo + SLICE].astype(np.int64).tobytes() for lo in range(0, len(x), SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["part", "x"])


def _summed(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of add(batch) over all batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                more = add(batch.slice(lo, 1000))
                have = more if have is None else have + more
        if have is not None:
            yield _sliced(have)

    got = vector_sums(rows.mapInArrow(run, "part int, x binary"))
    return np.concatenate([got[k] for k in sorted(got)])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.int32), np.cumsum([0, *(len(x) // 4 for x in rows)])


def train(docs: DataFrame, labels: DataFrame, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """Fit on all labelled documents; with `rows` on at most so many, those with the smallest hashes of their ids.

    Labels with a null id or quality are left out; a null toxic counts as 0.  An id that is repeated, in
    the labels or in docs, counts once for each pair.  Sums are of whole numbers, so the model does not depend
    on how the files are laid out.  Labels are broadcast up to BROADCAST_LABELS rows and joined in a shuffle
    beyond; the driver and the tasks hold vectors of features only.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) != 0, 1).otherwise(2)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("l_id"), grade.cast("int").alias("grade"))
    if rows is not None:
        chosen = chosen.orderBy(F.xxhash64("l_id"), "l_id", "grade").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(2))
            ids, scale = [], []
            for lo, hi in chunks(texts):
                i, v, first = features(texts[lo:hi])
                ids += [i[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                scale += [float(v[a]) for a in first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(scale, pa.float64())], names=["h", "grade", "ids", "scale"])

    known = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_LABELS else chosen
    joined = known.join(few, F.col("d_id") == F.col("l_id")).select(F.xxhash64("l_id").alias("h"), "grade", "text")
    found = settle(joined.mapInArrow(run, "h long, grade int, ids binary, scale double"))
    if rows is not None and found.count() > rows:  # only where ids are repeated
        found = settle(found.orderBy("h", "grade", "scale", "ids").limit(rows))
    count = np.zeros(GRADES)
    for k, n in found.groupBy("grade").agg(F.count(F.lit(1))).collect():
        count[k] = n
    n = int(count.sum())
    if not n:
        return None
    common = common_features(_summed(found.select("ids"), lambda batch: np.bincount(_ids(batch.column(0))[0], minlength=DIMS + _SHAPES)), n)
    heavy = grade_weights(count, BALANCE)

    def sums(x: np.ndarray) -> np.ndarray:
        kept: list[np.ndarray] = []

        def add(batch: pa.RecordBatch) -> np.ndarray:
            if not kept:  # once a task
                kept.append(places(common))
            return total(kept[0], x, heavy, *_ids(batch.column(0)), *(batch.column(i).to_numpy() for i in (1, 2)))

        return _summed(found.select("ids", "scale", "grade"), add)

    return model_of(descend(sums, len(common), n, STEPS, DECAY), common)


def judge(df: DataFrame, model: Ordinal | None, keep: list[str], text_col: str = "text", least: float = 0.7, filtered: bool = False) -> DataFrame:
    """Columns `keep`, then expected_grade, p_sound, p_clean and selected; or, with `filtered`, the
    columns `keep` of the selected rows only.

    selected: P(grade = 2) >= `least`.  A null or empty text, or one without words, is scored by its
    layout alone like any other; without a model every row is selected with all probabilities 1.
    """
    extra = ["expected_grade", "p_sound", "p_clean", "selected"]
    cols = df.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(len(keep)))
            tails = np.ones((len(texts), GRADES - 1)) if model is None else model.tails(model.latent(texts))
            good = tails[:, -1] >= least
            own = [batch.column(i) for i in range(len(keep))]
            if filtered:
                yield pa.RecordBatch.from_arrays(own, names=keep).filter(pa.array(good))
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(good)], names=[*keep, *extra])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[: len(keep)]]
    if not filtered:
        kinds += ["expected_grade double", "p_sound double", "p_clean double", "selected boolean"]
    return cols.mapInArrow(run, ", ".join(kinds))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_sound, p_clean, selected for every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, model, ["doc_id"])
