"""Merging proposals into persistent components.

The fold is sequential in frames and proposals, but where proposals only meet components of their own
class (the default) it is independent by class, so it runs as one state for each class; ids are given
afterwards by birth order.  The state is a handful of arrays: a matrix of bits says which cells a
component has, others its votes, support and birth, and evidence between components is a list of
pairs.  Overlaps, affinities and neighbourhood scores are array operations on them.  The relational
forms (containment graph, edge affinities, region scores, absorption) are single steps over whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.contain import contained
from voxloom.operators.tables import components, dense_ids, settle, top1

#: The shipped thresholds by level.
BARS = (0.50, 0.45, 0.35, 0.30, 0.30, 0.25, 0.25, 0.25, 0.25, 0.25, 0.20)


@dataclass(frozen=True)
class Merging:
    bars: tuple[float, ...] = BARS
    min_merges: int = 10  # support from which a component is an object
    deferred: bool = True  # merge on accumulated evidence instead of at once
    min_evidence: float = 2.0
    decay: float = 0.3
    overlap: bool = True  # an element may belong to several components
    same_class: bool = True
    semantic: bool = True  # evidence weighs by the cosine of classes
    contained: bool = True  # and by containment
    small: int = 0  # at the end components with less support join their best neighbour

    def bar(self, level: np.ndarray) -> np.ndarray:
        bars = np.array(self.bars or (0.3,))
        return bars[np.clip(level, 1, len(bars)) - 1]


def grown(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """a with at least so many rows and columns; what is new is 0."""
    if rows <= a.shape[0] and cols <= a.shape[1]:
        return a
    out = np.zeros((max(rows, 2 * a.shape[0]) if rows > a.shape[0] else a.shape[0], max(cols, 2 * a.shape[1]) if cols > a.shape[1] else a.shape[1]), dtype=a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


class Components:
    """The fold's state: row i of each array is component i, as long as `home[i]` is i; a component that
    has been taken in has the number of the one that did as its home.  Ties that no rule settles go to the
    older component."""

    def __init__(self, p: Merging):
        self.p, self.n = p, 0
        self.code: dict[tuple, int] = {}  # cell -> column of bits
        self.kind: dict[int, int] = {}  # class -> column of votes
        self.bits = np.zeros((8, 8), dtype=np.uint64)
        self.votes = np.zeros((8, 2), dtype=np.int64)
        self.facts = np.zeros((8, 4), dtype=np.int64)  # support, birth frame, birth proposal, home
        self.ids: list[set] = []
        self.pairs = np.zeros((0, 2), dtype=np.int64)  # evidence: lower and higher component, ...
        self.sums = np.zeros((0, 2))  # ... weighed similarity and weight

    # Columns of `facts`, of the components there are.
    support = property(lambda self: self.facts[: self.n, 0])
    home = property(lambda self: self.facts[: self.n, 3])

    @property
    def live(self) -> np.ndarray:
        return np.flatnonzero(self.home == np.arange(self.n))

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[which]).sum(1).astype(np.int64)

    def mask(self, cells: list[tuple]) -> np.ndarray:
        """A row of bits for a set of cells."""
        at = np.array(sorted({self.code.setdefault(c, len(self.code)) for c in cells}), dtype=np.int64)
        self.bits = grown(self.bits, 0, -(-len(self.code) // 64))
        out = np.zeros(self.bits.shape[1], dtype=np.uint64)
        np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return out

    def majority(self, which: np.ndarray) -> np.ndarray:
        """The class with the most votes, of equals the lower; -1 without votes."""
        kinds = np.array(sorted(self.kind), dtype=np.int64)
        if not len(kinds) or not len(which):
            return np.full(len(which), -1)
        v = self.votes[np.ix_(which, [self.kind[k] for k in kinds.tolist()])]
        return np.where(v.max(1) > 0, kinds[v.argmax(1)], -1)

    def _new(self, frame: int, prop: int) -> int:
        self.bits, self.votes, self.facts = (grown(a, self.n + 1, 0) for a in (self.bits, self.votes, self.facts))
        self.facts[self.n] = 0, frame, prop, self.n
        self.ids.append(set())
        self.n += 1
        return self.n - 1

    def add(self, frame: int, prop: int, cls: int, cells: list[tuple], ids: set = frozenset(), view: np.ndarray | None = None) -> np.ndarray:
        """One proposal of a class; returns the pairs of components on which it left evidence."""
        p, own, live = self.p, self.mask(cells), self.live
        view = None if view is None else np.pad(view, (0, len(own) - len(view)))  # new cells may have come
        n = int(np.bitwise_count(own).sum())
        met = np.bitwise_count(self.bits[live] & own).sum(1).astype(np.int64)
        alike = (met > 0) & (np.isin(self.majority(live), (-1, cls)) if p.same_class and cls >= 0 else True)
        rivals, met, held = live[alike], met[alike], np.bitwise_or.reduce(self.bits[live], axis=0) if len(live) else np.uint64(0)
        part = met / np.maximum(1, np.minimum(n, self.sizes(rivals)))
        cleared = part >= p.bar(self.support[rivals])
        order = np.lexsort((rivals, -part))
        order = order[cleared[order]]
        fresh = own if p.overlap else own & ~held
        home = int(rivals[order[0]]) if len(order) else self._new(frame, prop) if fresh.any() else -1
        touched = np.zeros((0, 2), dtype=np.int64)
        if p.deferred:
            base = home if home >= 0 else int(rivals[np.lexsort((rivals, -met))[0]]) if len(rivals) else -1
            touched = self._deposit(base, cls, rivals, part, own, view)
        elif len(order) > 1:
            home = self.unite(rivals[order], home)
        if home >= 0:
            self.kind.setdefault(cls, len(self.kind))
            self.votes = grown(self.votes, 0, len(self.kind))
            self.bits[home] |= fresh
            self.votes[home, self.kind[cls]] += n
            self.facts[home, 0] += 1
            self.ids[home] |= {i for i in ids if i >= 0}
        return touched

    def _deposit(self, base: int, cls: int, rivals: np.ndarray, part: np.ndarray, own: np.ndarray, view: np.ndarray | None) -> np.ndarray:
        """Evidence between the base and each other component that the proposal overlaps: similarity of
        classes times containment, weighed by how much of both sides is in view."""
        other = rivals != base
        k, weight = rivals[other], np.ones(int(other.sum()))
        if view is not None:
            seen = lambda b, size: np.bitwise_count(b & view).sum(-1) / np.maximum(size, 1)
            weight = seen(self.bits[k], self.sizes(k)) * seen(own, np.bitwise_count(own).sum())
        like = np.ones(len(k))
        if self.p.semantic and cls in self.kind:
            v = self.votes[k].astype(float)
            norm = np.sqrt((v * v).sum(1))
            like = np.where(norm > 0, v[:, self.kind[cls]] / np.where(norm > 0, norm, 1), 0.0)
        elif self.p.semantic:
            like = np.zeros(len(k))
        on = weight > 0
        pairs = np.sort(np.stack([np.full(len(k), base), k], axis=1), axis=1)[on]
        gain = (like * (part[other] if self.p.contained else 1.0) * weight)[on]
        self.pairs, self.sums = np.concatenate([self.pairs, pairs]), np.concatenate([self.sums, np.stack([gain, weight[on]], axis=1)])
        return pairs

    def unite(self, group: np.ndarray, first: int = -1) -> int:
        """Of a group of components the one with the most cells takes the others in; of equals `first`, then
        the oldest."""
        group = np.unique(group)
        size = self.sizes(group)
        top = int(group[np.lexsort((group, group != first, -size))[0]])
        rest = group[group != top]
        self.bits[top] |= np.bitwise_or.reduce(self.bits[rest], axis=0)
        self.votes[top] += self.votes[rest].sum(0)
        self.facts[top, 0] += self.facts[rest, 0].sum()
        births = self.facts[group, 1:3]
        self.facts[top, 1:3] = births[np.lexsort((births[:, 1], births[:, 0]))[0]]
        self.ids[top] = set().union(*(self.ids[i] for i in group))
        self.bits[rest], self.votes[rest] = 0, 0
        self.facts[: self.n, 3][np.isin(self.home, rest)] = top
        return top

    def graph(self) -> tuple[np.ndarray, np.ndarray]:
        """The evidence summed by pair of live components, kept so from now on."""
        ends = np.sort(self.home[self.pairs], axis=1).reshape(-1, 2)
        apart = ends[:, 0] != ends[:, 1]
        self.pairs, back = np.unique(ends[apart], axis=0, return_inverse=True)
        self.sums = np.stack([np.bincount(back.ravel(), self.sums[apart, c], minlength=len(self.pairs)) for c in (0, 1)], axis=1)
        return self.pairs, self.sums

    def settle_frame(self, touched: np.ndarray) -> None:
        """Merge the touched pairs whose evidence and neighbourhoods allow it, all judged on one snapshot."""
        pairs, sums = self.graph()
        ask = np.unique(np.sort(self.home[touched], axis=1).reshape(-1, 2), axis=0)
        ask = ask[ask[:, 0] != ask[:, 1]]
        if not len(ask):
            return
        near = pairs[np.isin(pairs, ask).any(1)]
        nodes = np.unique(near)
        at = lambda x: np.searchsorted(nodes, x)
        inside = np.isin(pairs, nodes).all(1)
        adj, linked = np.zeros((len(nodes), len(nodes))), np.zeros((len(nodes), len(nodes)))
        i, j = at(pairs[inside]).T
        adj[i, j] = adj[j, i] = sums[inside, 0] / np.maximum(sums[inside, 1], 1e-300)
        linked[i, j] = linked[j, i] = 1.0
        score = neighbourhood(adj, linked, np.maximum(1, self.sizes(nodes)).astype(float), self.p.decay)
        weight = np.zeros_like(adj)
        weight[i, j] = weight[j, i] = sums[inside, 1]
        a, b = at(ask).T
        bar = self.p.bar(np.minimum(self.support[ask[:, 0]], self.support[ask[:, 1]]))
        ready = ask[(weight[a, b] >= self.p.min_evidence) & (np.minimum(np.minimum(adj[a, b], score[a, b]), score[b, a]) >= bar)]
        for group in joined(ready):
            self.unite(group)
        if len(ready):
            self.graph()

    def absorb_small(self) -> None:
        """Components of little support join the neighbour with the best affinity, of equals the older, until
        none moves."""
        moved = self.p.deferred and self.p.small > 0
        while moved:
            moved = False
            pairs, sums = self.graph()
            adj = np.where(sums[:, 1] > 0, sums[:, 0] / np.where(sums[:, 1] > 0, sums[:, 1], 1), 0.0)
            both, twice = np.concatenate([pairs, pairs[:, ::-1]]), np.concatenate([adj, adj])
            order = np.lexsort((both[:, 1], -twice, both[:, 0]))
            which, first = np.unique(both[order, 0], return_index=True)
            for i, k in zip(which.tolist(), both[order][first, 1].tolist(), strict=True):
                to = int(self.home[k])
                if self.home[i] == i and self.support[i] < self.p.small and to != i:
                    self.unite(np.array([i, to]))
                    moved = True

    def table(self) -> pd.DataFrame:
        """(cls, support, n_cells, birth_frame, birth_prop, promoted) of the live components."""
        live = self.live
        out = pd.DataFrame({"cls": self.majority(live), "support": self.support[live], "n_cells": self.sizes(live), "birth_frame": self.facts[live, 1], "birth_prop": self.facts[live, 2]})
        return out.assign(promoted=out["support"] >= self.p.min_merges)

    def cells(self) -> list[list[list]]:
        """The cells of each live component, sorted."""
        cell = np.array(list(self.code), dtype=np.int64).reshape(len(self.code), -1)
        order = np.lexsort(cell.T[::-1]) if len(cell) else np.zeros(0, dtype=np.int64)
        has = lambda i: (self.bits[i, order >> 6] >> (order & 63).astype(np.uint64)) & np.uint64(1) == 1
        return [cell[order[has(i)]].tolist() for i in self.live]


def neighbourhood(adj: np.ndarray, linked: np.ndarray, weight: np.ndarray, decay: float) -> np.ndarray:
    """Entry (a, b): the affinity of a to b and, decayed, to b's other neighbours, weighed by their sizes."""
    rest = linked * weight[None, :]  # row b: the weights of b's neighbours
    top = adj * weight[None, :] + decay * (adj @ rest.T)
    low = weight[None, :] + decay * (rest.sum(1)[None, :] - rest.T)
    return top / low


def joined(pairs: np.ndarray) -> list[np.ndarray]:
    """Groups of numbers that pairs connect, by least labels."""
    nodes = np.unique(pairs)
    label, ends = np.arange(len(nodes)), np.searchsorted(nodes, pairs).reshape(-1, 2)
    while True:
        least = label.copy()
        np.minimum.at(least, ends[:, 0], label[ends[:, 1]])
        np.minimum.at(least, ends[:, 1], label[ends[:, 0]])
        least = least[least]
        if (least == label).all():
            return [nodes[label == k] for k in np.unique(label)]
        label = least


#: The number of a proposal whose rows are the cells in view of the frame.
VIEW = -1


def add_frame(state: Components, frame: int, rows: pd.DataFrame, cell: list[str]) -> None:
    """The proposals of one frame in their order, then the merges that they allow."""
    touched, view = [], None
    for prop, g in rows.groupby("prop", sort=True):
        cells = list(g[cell].itertuples(index=False, name=None))
        if prop == VIEW:
            view = cells
        else:
            seen = None if view is None else state.mask(view)
            touched.append(state.add(frame, int(prop), int(g["cls"].iloc[0]), cells, set(g["inst"].tolist()), seen))
    if touched and state.p.deferred:
        state.settle_frame(np.concatenate(touched))


def fold(rows: pd.DataFrame, cell: list[str], p: Merging) -> Components:
    """All proposals of rows(frame, prop, cls, inst, cell...), in order of frame and proposal."""
    state = Components(p)
    for frame, f in rows.groupby("frame", sort=True):
        add_frame(state, int(frame), f, cell)
    state.absorb_small()
    return state


def with_views(props: DataFrame, views: DataFrame, cell: list[str]) -> DataFrame:
    """props with the cells in view of each frame, once for each class that has proposals there, so that
    evidence weighs by how much of both sides is seen."""
    asked = props.select("run", "frame", "cls").distinct()
    seen = views.select("run", "frame", *cell).distinct().join(asked, ["run", "frame"]).select("run", "frame", F.lit(VIEW).cast("long").alias("prop"), "cls", F.lit(-1).alias("inst"), *cell)
    return props.select("run", "frame", "prop", "cls", "inst", *cell).unionByName(seen)


def consolidate(props: DataFrame, cell: list[str], p: Merging = Merging()) -> DataFrame:  # noqa: B008
    """(comp, cls, support, n_cells, birth_frame, birth_prop, promoted): components after all frames.

    props(frame, prop, cls, inst, cell...).  One fold for each class, or one in all where classes may mix
    or elements have single owners.  comp numbers components by birth from 0.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf, cell, p).table()

    key = F.col("cls") if p.same_class and p.overlap else F.lit(0)
    out = props.select("frame", "prop", "cls", "inst", *cell).distinct().groupBy(key.alias("__part")).applyInPandas(run, "cls int, support long, n_cells long, birth_frame long, birth_prop long, promoted boolean")
    return dense_ids(settle(out), "birth_frame", [F.col("birth_prop"), F.col("cls")], "comp")


def consolidate_members(props: DataFrame, cell: list[str], p: Merging = Merging()) -> DataFrame:  # noqa: B008
    """As consolidate(), by run, with each component's cells: (run, comp, cls, support, n_cells,
    birth_frame, birth_prop, promoted, cells)."""
    kind = props.schema["run"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = fold(pdf, cell, p)
        out = s.table().assign(cells=s.cells())
        out.insert(0, "run", pdf["run"].iloc[0])
        return out

    key = F.col("cls") if p.same_class and p.overlap else F.lit(0)
    rows = props.select("run", "frame", "prop", "cls", "inst", *cell).distinct()
    out = rows.groupBy("run", key.alias("__part")).applyInPandas(run, f"run {kind}, cls int, support long, n_cells long, birth_frame long, birth_prop long, promoted boolean, cells array<array<int>>")
    return dense_ids(settle(out), "birth_frame", [F.col("run"), F.col("birth_prop"), F.col("cls")], "comp")


# --- relational forms -----------------------------------------------------------------------------


def merge_sets(sets: DataFrame, set_id: str, on: list[str], bar: float) -> DataFrame:
    """(set, comp): sets united along containment edges; a set without edges is its own component."""
    labels = components(contained(sets, set_id, on, bar))
    return sets.select(set_id).distinct().join(labels.withColumnRenamed("node", set_id), set_id, "left").withColumn("comp", F.coalesce("comp", F.col(set_id)))


def edge_sums(deposits: DataFrame) -> DataFrame:
    """deposits(a, b, sim, conf) summed by unordered pair: (lo, hi, sim_conf, conf, adj)."""
    e = deposits.where("a <> b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum(F.col("sim") * F.col("conf")).alias("sim_conf"), F.sum("conf").alias("conf"))
    return e.withColumn("adj", F.when(F.col("conf") > 0, F.col("sim_conf") / F.col("conf")).otherwise(F.lit(0.0)))


def reroot(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges(lo, hi, sim_conf, conf) between the components of labels(node, comp); inner ones go."""
    a, b = (labels.select(F.col("node").alias(c), F.col("comp").alias(f"r_{c}")) for c in ("lo", "hi"))
    r = edges.join(a, "lo", "left").join(b, "hi", "left").select(F.coalesce("r_lo", "lo").alias("x"), F.coalesce("r_hi", "hi").alias("y"), "sim_conf", "conf").where("x <> y")
    e = r.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.sum("sim_conf").alias("sim_conf"), F.sum("conf").alias("conf"))
    return e.withColumn("adj", F.when(F.col("conf") > 0, F.col("sim_conf") / F.col("conf")).otherwise(F.lit(0.0)))


def region_scores(edges: DataFrame, weights: DataFrame, decay: Column) -> DataFrame:
    """(a, b, region): the affinity of a to b and, decayed, to b's other neighbours, weighted by size.

    edges(lo, hi, adj), weights(node, w).  Both directions of each edge.  The edges are read several
    times, so they are kept first.
    """
    edges = settle(edges.select("lo", "hi", "adj"))
    both = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "adj").unionByName(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"), "adj"))
    w = weights.select(F.col("node").alias("k"), F.greatest(F.lit(1), F.col("w")).cast("double").alias("w"))
    own = both.select("a", "b", F.col("b").alias("k"), F.lit(1.0).alias("f"))
    others = both.select("a", "b").join(both.select(F.col("a").alias("b"), F.col("b").alias("k")), "b").where("k <> a").select("a", "b", "k", decay.alias("f"))
    terms = own.unionByName(others).join(w, "k").join(both.select("a", F.col("b").alias("k"), "adj"), ["a", "k"], "left")
    return terms.groupBy("a", "b").agg((F.sum(F.col("f") * F.col("w") * F.coalesce("adj", F.lit(0.0))) / F.sum(F.col("f") * F.col("w"))).alias("region"))


def absorb_once(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(node, target): nodes(node, support) below `least` with their best neighbour, ties to the lower id."""
    both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("target"), "adj").unionByName(edges.select(F.col("hi").alias("node"), F.col("lo").alias("target"), "adj"))
    return top1(both, ["node"], [F.col("adj").desc(), F.col("target")]).join(nodes.where(F.col("support") < least), "node").select("node", "target", "adj", "support")


def visible_ratio(cells: DataFrame, view: DataFrame, set_id: str, on: list[str]) -> DataFrame:
    """(set, ratio): the share of each set's cells that the view has."""
    v = view.select(*on).distinct().withColumn("__in", F.lit(1))
    return cells.select(set_id, *on).distinct().join(v, on, "left").groupBy(set_id).agg((F.count("__in") / F.count(F.lit(1))).alias("ratio"))
