"""Mixing sources to target weights by iterative proportional fitting.

Documents' tokens are counted by the vocabulary and summed by cell, a combination of the margins' values;
raking scales the cells until each margin has its target shares.  Raked once more under the bound that no
cell is drawn more than whole, the factors become sampling probabilities, and a document is drawn by a hash
of its id against its cell's probability: the same documents each time, without a shuffle of texts.

Margins need not be compatible.  How far raking is from its targets where it ends is part of the result.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.common import read_table, settle, text_hash
from voxloom.llm.packing import default_paths, token_count
from voxloom.llm.topics import bag_of, fit, row_hash, topic_of_bag

DRIVER_CELLS = 2_000_000  # bound of the cells, which the driver rakes; more are an error, not another method
BROADCAST_CELLS = 100_000
TOLERANCE = 1e-9
ROUNDS = 400
KEEP_SHARE = 0.6
POWER = 0.7
REPORTED = 0.01  # distance of a share from its target that draw() warns of
LEAST = 1e-3  # of a value's goal for its other cells, where cells that are kept whole take all of it

log = logging.getLogger("voxloom.mixing")

Targets = dict[str, dict]  # by margin and value: shares; they need not add up to 1


@dataclass
class Margin:
    """The values of one margin: their code in each cell, their tokens and their target shares; where it
    lies inside another margin, the number of that and the outer value of each value."""

    code: np.ndarray
    have: np.ndarray
    share: np.ndarray
    outer: tuple[int, np.ndarray] | None = None


def tempered(have: np.ndarray, power: float) -> np.ndarray:
    """Target shares flatter than the data for powers below 1."""
    goal = (have / have.sum()) ** power
    return goal / goal.sum()


def margins_of(cells: list[list], tokens: np.ndarray, names: list[str], power: float, targets: Targets | None = None, inside: dict[str, str] | None = None) -> list[Margin]:
    """The margins of cells (a list of values for each margin).

    A margin in `targets` has the shares given there, for every one of its values; else those of the
    data, tempered.  A margin `inside` another (topics inside languages) tempers its values within each
    value of the other, whose target it divides, so that both can be met.
    """
    out: dict[str, Margin] = {}
    for name, values in zip(names, cells, strict=True):
        at = {v: i for i, v in enumerate(dict.fromkeys(values))}
        code = np.fromiter((at[v] for v in values), dtype=np.int64, count=len(values))
        have, within = np.bincount(code, tokens), None
        if targets and name in targets:
            given = targets[name]
            if missing := [v for v in at if v not in given]:
                raise ValueError(f"no target weight of {name} for {missing[:5]}")
            share = np.array([float(given[v]) for v in at])
            if (share < 0).any() or share.sum() <= 0:
                raise ValueError(f"target weights of {name} must not be negative, and one must be positive")
            share /= share.sum()
        elif inside and name in inside:
            outer = out[inside[name]]
            share = have**power
            first = np.zeros(len(have), dtype=np.int64)
            first[code] = outer.code
            share *= (outer.share / np.bincount(first, share, minlength=len(outer.share)))[first]
            within = names.index(inside[name]), first
        else:
            share = tempered(have, power)
        out[name] = Margin(code, have, share, within)
    return [out[n] for n in names]


def rake(tokens: np.ndarray, margins: list[Margin], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(factor of each cell, residual): the residual is the largest distance of a margin's share from its
    target, after the last round.  It is not near 0 where no weights meet all margins."""
    total, w = tokens.sum(), tokens.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for m in margins:
            have = np.bincount(m.code, w, minlength=len(m.share))
            ratio = np.where(have > 0, m.share * total / np.where(have > 0, have, 1), 1)
            worst = max(worst, float(np.abs(ratio - 1).max(initial=0)))
            w *= ratio[m.code]
        if worst < tolerance:
            break
    return w / tokens, residual(w, [m.share for m in margins], margins)


def residual(w: np.ndarray, shares: list[np.ndarray], margins: list[Margin]) -> float:
    return max((float(np.abs(np.bincount(m.code, w, minlength=len(s)) / w.sum() - s).max()) for m, s in zip(margins, shares, strict=True)), default=0.0)


def scale_for(factor: np.ndarray, tokens: np.ndarray, wanted: float) -> float:
    """s such that the sum of tokens * min(1, s * factor) is `wanted`."""
    order = np.argsort(-factor, kind="stable")
    f, t = factor[order], tokens[order].astype(float)
    if not len(f):
        return 0.0
    full = np.concatenate(([0.0], np.cumsum(t)[:-1]))
    rest = np.cumsum((f * t)[::-1])[::-1]
    s = np.where(rest > 0, (wanted - full) / np.where(rest > 0, rest, 1), 0.0)
    ok = np.flatnonzero(s * f <= 1 + 1e-12)
    return float(s[ok[0]]) if len(ok) else 1 / float(f[f > 0].min())


def bounded(tokens: np.ndarray, factor: np.ndarray, margins: list[Margin], keep_share: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(probability of each cell, at most 1; residual of the kept tokens' shares).

    A value has its target share of keep_share of the tokens as its goal; one that has fewer tokens is kept
    whole and the others of its margin (inside one outer value, where the margin has an outer one) share
    the rest in proportion to their targets.  Cells are scaled to
    the goals in turn and cut at 1, which ends where all goals are met if they can be met together.
    """
    tokens = tokens.astype(float)
    wanted = keep_share * tokens.sum()
    goals, whole = [], np.zeros(len(tokens), dtype=bool)
    for m in margins:
        lift = m.share / m.have
        if m.outer is None:
            lift = lift * scale_for(lift, m.have, wanted)
        else:
            of, first = m.outer
            for v, goal in enumerate(goals[of].tolist()):
                own = first == v
                lift[own] *= scale_for(lift[own], m.have[own], goal)
        goals.append(m.have * np.minimum(1, lift))
        whole |= (lift >= 1 - 1e-12)[m.code]
    w = np.where(whole, tokens, np.minimum(1, keep_share * factor) * tokens)
    for _ in range(rounds):
        worst = 0.0
        for m, goal in zip(margins, goals, strict=True):
            held, free = (np.bincount(m.code, w * x, minlength=len(goal)) for x in (whole, ~whole))
            ratio = np.where(free > 0, np.maximum(goal - held, goal * LEAST) / np.where(free > 0, free, 1), 1)
            worst = max(worst, float(np.abs(ratio - 1).max()))
            w = np.where(whole, tokens, np.minimum(tokens, w * ratio[m.code]))
        if worst < tolerance:
            break
    p = w / tokens
    p = np.minimum(1, p * scale_for(p, tokens, wanted))
    return p, residual(p * tokens, [m.share for m in margins], margins)


RESULT = ("n_tokens", "weight", "p", "drawn", "raked_residual", "residual")


def calibrate(df: DataFrame, margins: dict[str, Column], tokens: Column, row_key: list[Column], keep: list[str], keep_share: float = KEEP_SHARE, power: float = POWER, targets: Targets | None = None, inside: dict[str, str] | None = None, tolerated: float | None = None, seed: int = 0) -> DataFrame:
    """Columns `keep` of df, then the margins by name and RESULT.  Other columns of df may have any names.

    A document weighs `tokens` (null: 0) plus one, so that empty texts belong to the mix; null values of a
    margin are a value of their own.  Targets are those given by margin and value, else the data's own
    shares tempered by `power` (see margins_of).  `weight` is the raked weight over the weight that a cell
    has, `p` the probability raked under the bound of 1 with keep_share of all tokens expected.  The
    residuals, the same in all rows, are the largest distances of a margin's share from its target: of the
    raked weights (not near 0: the margins are not compatible), and of the expected sample (not near 0:
    besides, a value is too scarce).  With `tolerated`, raked weights further from their targets are a
    ValueError.  Rows are drawn by a hash of row_key (an id and a text's hash): rows that repeat it stand
    or fall together.  An empty df gives an empty result.
    """
    names = list(margins)
    if taken := [c for c in keep if c in (*names, *RESULT)]:
        raise ValueError(f"columns {taken} are in the way of the result's; keep others")
    draw = F.pmod(F.xxhash64(F.lit(seed), *row_key), F.lit(1 << 52)) / float(1 << 52)
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *(m.alias(f"m{i}") for i, m in enumerate(margins.values())), (F.coalesce(tokens, F.lit(0)).cast("long") + 1).alias("n"), draw.alias("draw"))
    ms = [f"m{i}" for i in range(len(names))]
    cells = settle(rows.groupBy(*ms).agg(F.sum("n").alias("n")))
    count = cells.count()
    if count > DRIVER_CELLS:
        raise ValueError(f"{count} combinations of {names}: more than {DRIVER_CELLS}; put rare values together first")
    got = cells.toArrow()
    have = got.column("n").to_numpy().astype(float)
    values = [got.column(m).to_pylist() for m in ms]
    factor, p, off, short = have, have, 0.0, 0.0
    if count:
        found = margins_of(values, have, names, power, targets, inside)
        factor, off = rake(have, found)
        if tolerated is not None and off > tolerated:
            raise ValueError(f"no weights meet the targets of {names}: a share stays {off:.4g} away")
        p, short = bounded(have, factor, found, keep_share)
    fields = {f"r{i}": got.column(m) for i, m in enumerate(ms)}
    right = df.sparkSession.createDataFrame(pa.table({**fields, "weight": factor, "p": p}))
    if count <= BROADCAST_CELLS:  # checked size, so texts stay where they are
        right = F.broadcast(right)
    joined = rows.join(right, reduce(lambda a, b: a & b, (F.col(m).eqNullSafe(F.col(f"r{i}")) for i, m in enumerate(ms))))
    kept, drawn = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("draw") < F.col("p")
    return joined.select(*kept, *(F.col(m).alias(c) for m, c in zip(ms, names, strict=True)), F.col("n").alias("n_tokens"), "weight", "p", drawn.alias("drawn"), F.lit(off).alias("raked_residual"), F.lit(short).alias("residual"))


def margins_met(mixed: DataFrame, margins: list[str]) -> DataFrame:
    """(margin, value, actual, raked, expected, taken, raked_residual, residual): token shares of what
    calibrate() returned, of all rows, of the raked weights (the targets, where they can be met), of the
    expected and the drawn sample, with the residuals of the whole.  Rows are read once."""
    out, t = [], F.col("n_tokens")
    whole = [F.max(c).alias(c) for c in ("raked_residual", "residual")]
    cells = settle(mixed.groupBy(*margins).agg(F.sum(t).alias("a"), F.sum(t * F.col("weight")).alias("r"), F.sum(t * F.col("p")).alias("e"), F.sum(F.when(F.col("drawn"), t).otherwise(0)).alias("d"), *whole))
    for m in margins:
        g = cells.groupBy(F.col(m).cast("string").alias("value")).agg(*(F.sum(c).alias(c) for c in "ared"), *whole)
        share = lambda c: F.col(c) / F.sum(c).over(W.partitionBy())
        out.append(g.select(F.lit(m).alias("margin"), "value", share("a").alias("actual"), share("r").alias("raked"), share("e").alias("expected"), share("d").alias("taken"), "raked_residual", "residual"))
    return reduce(DataFrame.unionByName, out)


MARGINS = ("source", "lang", "topic")
INSIDE = {"topic": "lang"}


def marks() -> list[Column]:
    """What is read from a text: its tokens, and its hashed words for topics."""
    return [token_count(F.col("text"), default_paths()).alias("n"), row_hash("doc_id", "text").alias("h"), bag_of(F.col("text")).alias("bag")]


def topic(read: DataFrame, lang: Column) -> Column:
    """The topic of each row of a table with `lang` and marks(), fitted on all of them."""
    return topic_of_bag(fit(read.select("h", lang.cast("string").alias("lang"), "bag")), lang, F.col("bag"))


def mix(docs: DataFrame, keep_share: float = KEEP_SHARE, power: float = POWER, targets: Targets | None = None, tolerated: float | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, RESULT) for every row of docs(doc_id, text, lang, source): narrow rows,
    each text is read once.

    Margins are source, language and topic (topics.py; a topic's target divides its language's).
    """
    read = settle(docs.select("doc_id", text_hash().alias("th"), "source", "lang", *marks()))
    narrow = settle(read.select("doc_id", "th", "source", "lang", topic(read, F.col("lang")).alias("topic"), "n"))
    margins = {m: F.col(m) for m in MARGINS}
    return calibrate(narrow, margins, F.col("n"), [F.col("doc_id"), F.col("th")], ["doc_id"], keep_share, power, targets, INSIDE, tolerated)


def draw(docs: DataFrame, keep_share: float = KEEP_SHARE, power: float = POWER, targets: Targets | None = None, tolerated: float | None = None, report: str | None = None) -> DataFrame:
    """The rows of docs that mix() draws, with all their columns, which may have any names.

    Texts are read once for their hashed words and tokens and written with them, so they do not cross the
    network, and are drawn from there.  With `report`, margins_met() is written to that path, and a warning
    logged where the expected shares stay further than REPORTED from their targets; with `tolerated`, raked
    weights further from theirs are a ValueError.
    """
    keep = {f"c{i}": c for i, c in enumerate(docs.columns)}
    read = settle(docs.select(*(F.col(c).alias(k) for k, c in keep.items()), "source", "lang", F.col("doc_id").alias("i"), text_hash().alias("th"), *marks()))
    marked = read.withColumn("topic", topic(read, F.col("lang")))
    mixed = calibrate(marked, {m: F.col(m) for m in MARGINS}, F.col("n"), [F.col("i"), F.col("th")], list(keep), keep_share, power, targets, INSIDE, tolerated)
    if report is not None:
        margins_met(mixed, list(MARGINS)).write.parquet(report)
        found = docs.sparkSession.read.parquet(report).select("raked_residual", "residual").first()
        if found and found["residual"] > REPORTED:
            log.warning("shares of the sample stay %.4f from their targets (%.4f after raking): %s", found["residual"], found["raked_residual"], report)
    return mixed.where("drawn").select(*(F.col(k).alias(c) for k, c in keep.items()))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (raked over actual), p, drawn and both residuals for
    every document."""
    return mix(read_table(spark, sf_dir, "documents"))
