"""Exact top-k and conversation repair against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.llm import conversations as C
from voxloom.llm import voronoi as V


def brute_top(rows, k=5, every=50):
    """rows (id, components): the answer in whole numbers of any size, once for each distinct query row."""
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x * 256) for x in v)}
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    out = []
    for q, a in whole:
        if q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(found)]
    return sorted(out)


def top(spark, rows, kind="double", **kw):
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, score double, rank string")
    return sorted(map(tuple, V.top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect()))


def clustered(n, dim, centres, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 3
    return [(i, (c[rng.integers(centres)] + rng.normal(size=dim) * 0.05).tolist()) for i in range(n)]


def test_clustered_data_prunes_and_stays_exact(spark, monkeypatch):
    rows = clustered(3000, 6, 12, 1)
    monkeypatch.setattr(V, "GROUP_BYTES", 1)  # groups of 256 queries
    want = brute_top(rows, every=3)
    assert top(spark, rows, every=3, pivots=24, splits=3) == want
    x = V.whole(np.array([v for _, v in rows]))
    centres = V.kmeans(x, 24)
    cell = V.nearest(x, centres)
    d = np.sqrt(((x - centres[cell]) ** 2).sum(1))
    ask = np.array([i % 3 == 0 for i, _ in rows])
    s = pd.DataFrame({"cell": cell, "n": 1, "q": ask.astype(int), "far": d, "q_far": np.where(ask, d, 0), "q_len": np.where(ask, np.sqrt((x**2).sum(1)), 0)})
    s = s.groupby("cell", as_index=False).agg({"n": "sum", "q": "sum", "far": "max", "q_far": "max", "q_len": "max"})
    s["near"] = [np.sort(d[cell == c])[:6] for c in s["cell"]]
    where, need = V.grouped(s, V.needs(s, centres, 5), centres, 256)
    assert len(need) > 3 and sum(n for _, n in where.values()) >= len(where)
    at = {c: j for j, c in enumerate(s["cell"])}
    sent = sum((d >= need[g, [at[c] for c in cell]]).sum() for g in range(len(need)))
    assert sent < 0.5 * len(need) * len(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_noise_and_ties(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]  # few distinct vectors: many ties
    assert top(spark, rows, kind="float", every=7) == brute_top(rows, every=7)


def test_one_vector_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUP_BYTES", 1)
    rows = clustered(1200, 4, 5, 3)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    assert top(spark, rows, every=2, pivots=8, splits=4) == brute_top(rows, every=2)


def test_odd_vectors(spark):
    odd = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-1.0, 0.5]), (100, None), (None, [1.0, 1.0]), (150, [None, 1.0]),
        (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, []), (301, []), (350, [1.0, 2.0, 3.0]), (351, [0.5, 0.5, 0.5]),
        (400, [0.0, 0.0]), (450, [1e300, -1e300]), (451, [1e30, 1.0]), (452, [3e5, 3e5]), (500, [1.7e308, 1.0]), (7, [-3.0, -4.0]), (8, [1e-300, 0.001]),
    ]
    assert top(spark, odd) == brute_top(odd)
    assert top(spark, []) == []
    assert top(spark, [(0, [1.0])]) == []
    assert top(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


ROLES = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "": ""}


def brute_repair(rows):
    """Cheapest (cost, audit, repaired) of (role, text) by trying all edits, at most two inserts a gap."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        extra = 5 if fault == "truncated" else 0
        mine = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            mine += [(extra, "K", (role, text))] if role else []
            mine += [(1 + extra, "R", (r, text)) for r in ("user", "assistant")]
        choices.append(mine)
    gaps = [[]] + [[r] for r in ("user", "assistant")] + [["user", "assistant"], ["assistant", "user"]]
    for plan in itertools.product(*choices):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(fill):
                for r in gap:
                    cost, audit = cost + 5, audit + "I"
                    out.append((r, ""))
                if i < len(rows):
                    cost, audit = cost + plan[i][0], audit + plan[i][1]
                    if plan[i][2]:
                        out.append(plan[i][2])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                key = (cost, audit, out)
                best = key if best is None or key[:2] < best[:2] else best
    return faults, *best


def conversation_rows(seed, sizes):
    rng = random.Random(seed)
    texts = ["Good.", "Fine?", "no end", " \n", "", "Same!", "x. "]
    return [(c, t, rng.choice(list(ROLES.values())), rng.choice(texts)) for c, n in enumerate(sizes) for t in range(n)]


def repair(spark, rows, ids=None):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
    found, edits = C.repair(df, ids)
    return {r["conv_id"]: r for r in found.collect()}, edits


def test_against_all_edits(spark):
    sizes = [0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3]
    rows = conversation_rows(5, sizes)
    found, edits = repair(spark, rows)
    repaired = {}
    for r in edits.where("role IS NOT NULL").orderBy("conv_id", "pos").collect():
        repaired.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for c, n in enumerate(sizes):
        if not n:
            continue
        faults, cost, audit, out = brute_repair([(r, x) for i, _, r, x in rows if i == c])
        got = found[c]
        assert (got["cost"], got["audit"]) == (cost, audit)
        assert repaired.get(c, []) == out
        assert [got[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in C.hashed(edits, "conv_id").collect()}
    assert hashes == {c: hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest() for c, out in repaired.items()}


def linear(signature):
    """The cheapest (cost, audit), row by row."""
    ways = [(0, ""), None, None, None]
    for ch in signature:
        step = C.solve(ch)
        ways = [min(((w[0] + step[s][t][0], w[1] + step[s][t][1]) for s, w in enumerate(ways) if w and step[s][t]), default=None) for t in range(4)]
    return C.closed(ways)


def test_long_conversations_in_pieces(spark):
    rows = [(c, t, r, x) for c, t, r, x in conversation_rows(9, [700, 64, 65])] + [(3, 5, "user", "Again.")] * 300
    found, edits = repair(spark, rows)
    for c in range(4):
        mine, seen, sig = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1], r[2], hashlib.sha256(r[3].encode()).digest())), set(), ""
        for _, _, role, text in mine:
            body, gone = text.strip(" \t\n\x0b\x0c\r"), (role, text) in seen
            seen.add((role, text))
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            sig += "x" if not body or gone else i if body[-1] in ".!?" else i.upper()
        assert (found[c]["cost"], found[c]["audit"]) == linear(sig)
        pairs = ["".join(p) for p in itertools.pairwise([r[2][:1] or "o" for r in mine])]
        assert found[c]["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
    assert found[3]["duplicate"] == 299 and found[3]["gaps"] == 0
    out = edits.where("conv_id = 0 AND role IS NOT NULL").orderBy("pos").select("role").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] for r in out))
    assert edits.where("conv_id = 0").count() == len(found[0]["audit"])


def test_odd_conversations(spark):
    rows = [(1, None, "user", "A."), (1, 0, "assistant", "B."), (1, 4, None, None), (None, 3, "user", "C."), (None, 3, "user", "C."), (2, None, None, "q")]
    found, edits = repair(spark, rows, spark.createDataFrame([(9,), (1,)], "conv_id long"))
    assert set(found) == {1, None, 2, 9}
    assert (found[1]["gaps"], found[1]["blank"], found[1]["audit"]) == (3, 1, "KKD")
    assert (found[None]["duplicate"], found[None]["audit"], found[None]["cost"]) == (1, "DD", 4)
    assert (found[9]["cost"], found[9]["audit"], found[9]["gaps"]) == (0, "", 0)
    assert found[2]["audit"] == "D" and found[2]["truncated"] == 1 and found[2]["gaps"] == 0
    assert edits.where("conv_id = 9").count() == 0
    found, edits = repair(spark, [])
    assert not found and not edits.count()


def test_damage(spark):
    rows = [(c, t, "system", f"One. Two! {c}?") for c in range(60) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        if hit:
            row = (c, t, "user" if hit == 4 else r, "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x)
            want += [row] * (2 if hit == 3 else 1)
    assert sorted(map(tuple, C.damaged(df).collect())) == sorted(want)
    odd = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in C.damaged(odd).collect()] == [(None, None, " ", " ")]
    assert odd.select(F.crc32(F.lit(" : ").cast("binary")) % 20).first()[0] > 4
