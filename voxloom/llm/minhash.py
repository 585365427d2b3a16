"""MinHash near-dedup with sequential Bayesian verification.

Documents with the same set of shingles form one class, which takes part once.  Classes that agree
on a band of their MinHash signatures are candidates.  A candidate's 1-bit signatures are compared
batch by batch; it is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below the chosen miss probability.  Survivors are compared on their full sets.

Buckets are worked off in stars: members against one leader, never all pairs.  What matters are the
components, so members already linked need no more comparisons; buckets that still hold several
components take further leaders, and what is then left is joined exactly on rare shingles.  No
candidate is given up, and a group of copies of any size costs comparisons in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import HOT_SHARE, hot_join, read_table, settle, small_batches, text_hash, trim_memory
from voxloom.llm.textnum import U64, batch_texts, chunks, mix, shingles
from voxloom.operators.tables import components

BANDS, ROWS = 44, 5
BIT_WORDS = 3  # batches of 64 one-bit hashes each
SHINGLE_WORDS = 5
SIM_NUM, SIM_DEN = 75, 100
MISS = 1e-7
STAR_ROUNDS = 5
RARITY_SLOTS = 1 << 20
GROUP_SHINGLES = 1 << 20  # of the partners in one group of the exact comparison, about
HOT_CLASSES = 2000  # classes that share a rare shingle in one task, about

_g = np.random.Generator(np.random.PCG64(7))
_A = (_g.integers(0, 2**32, size=BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _g.integers(0, 2**32, size=BANDS * ROWS, dtype=np.uint32)[:, None]
_BAND = _g.integers(1, 2**63, size=(BANDS, ROWS + 1), dtype=np.uint64)


def minhashes(s: np.ndarray) -> np.ndarray:
    """The signature (BANDS * ROWS values) of a set of 64-bit hashes."""
    x = (s >> U64(32)).astype(np.uint32)
    x ^= s.astype(np.uint32) * np.uint32(0x85EBCA6B)
    best = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 1024):
        h = _A * x[None, lo : lo + 1024]
        h ^= h >> np.uint32(15)
        h += _B
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(best, h.min(axis=1), out=best)
    return best


def digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, th, digest, n, bits, bands) for every row; n = 0 and nulls for rows without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(2))
            digests: list = []
            sizes: list[int] = []
            bits: list = []
            bands: list = []
            for lo, hi in chunks(texts):
                for s in shingles(texts[lo:hi], width):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None)
                        bits.append(None)
                        bands.append(None)
                        continue
                    m = minhashes(s)
                    digests.append(digest(s))
                    one = (m[: 64 * BIT_WORDS] * np.uint32(0x9E3779B1)) >> np.uint32(31)
                    bits.append(np.packbits(one.astype(np.uint8)).view(np.int64))
                    keyed = (m.reshape(BANDS, ROWS).astype(np.uint64) + U64(1)) * _BAND[:, :ROWS]
                    bands.append(mix(keyed.sum(axis=1, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "th", "digest", "n", "bits", "bands"],
            )
            trim_memory()

    cols = df.select(F.col(id_col).cast("long"), text_hash(text_col), F.col(text_col).cast("string"))
    return cols.mapInArrow(run, "doc_id long, th long, digest binary, n long, bits array<long>, bands array<long>")


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch, the fewest matching bits so far with which a pair goes on.

    A bit of two sets of similarity s agrees with probability c = (1 + s) / 2.  With a flat prior for
    s, P(s >= threshold | m of n bits agree) must be at least `miss`.
    """
    c = np.linspace(0.5, 1.0, 20_001)[:-1] + 0.5 / 40_000
    high = c >= (1 + threshold) / 2
    out = []
    for n in range(64, 64 * BIT_WORDS + 1, 64):
        for m in range(n + 1):
            like = m * np.log(c) + (n - m) * np.log1p(-c)
            p = np.exp(like - like.max())
            if p[high].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def _promising(least: tuple[int, ...]):
    """Sequential comparison of a.bits and b.bits; later batches are only looked at if needed."""
    ok, seen = None, None
    for k, m in enumerate(least):
        same = F.lit(64) - F.bit_count(F.get("a_bits", k).bitwiseXOR(F.get("b_bits", k)))
        seen = same if seen is None else seen + same
        ok = (seen >= m) if ok is None else ok & (seen >= m)
    return ok


def rare_prefixes(own: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(cid, comp, i, s) for own(cid, comp, text): each class's rarest shingles, as many as must hold one of
    any partner's.  Two sets of similarity num / den share more than that share of either, so among the
    first n - ceil(n * num / den) + 1 of each, in one order of all shingles, there is a common one.  The
    position i of the first common one in each set bounds what they can have in common.

    Rarity comes from a table of counts by hash, whose size is fixed; the order only has to be the same
    for all, so collisions cost time and no link.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(0))
            for lo, hi in chunks(texts):
                slot, n = np.unique(np.concatenate(shingles(texts[lo:hi], width)) & U64(RARITY_SLOTS - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n, pa.int64())], names=["slot", "n"])

    got = own.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    order = np.zeros(RARITY_SLOTS, dtype=np.int32)
    order[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    del got

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(2))
            out = []
            for lo, hi in chunks(texts):
                for s in shingles(texts[lo:hi], width):
                    keep = len(s) - -(-len(s) * num // den) + 1
                    out.append(s[np.lexsort((s, order[s & U64(RARITY_SLOTS - 1)]))[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["cid", "comp", "s"])

    listed = own.select("cid", "comp", "text").mapInArrow(prefix, "cid long, comp long, s array<long>")
    return listed.select("cid", "comp", F.posexplode("s").alias("i", "s"))


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, miss: float, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked: Bayesian pruning, then full sets."""
    c = classes.select("cid", "n", "bits")
    left = hot_join(settle(pairs), c.select(F.col("cid").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits")), "a")
    both = left.join(c.select(F.col("cid").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits")), "b")
    fits = den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")
    alive = settle(both.where(fits & _promising(least_matches(num / den, miss))).select("a", "b", "b_n"))
    return exact_links(alive, texts, width, num, den)


def exact_links(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b, b_n) whose full sets are similar enough.  A class with many partners is dealt into
    groups of about 64 partners, or fewer large ones, so that no group is large and its own text moves once
    for each group."""
    many = pairs.groupBy("a").agg(F.greatest(F.count(F.lit(1)) / 64, F.sum("b_n") / GROUP_SHINGLES).cast("long").alias("k"))
    dealt = hot_join(pairs, many, "a").select("a", "b", F.pmod(F.xxhash64("b", "a"), F.col("k") + 1).alias("salt"))
    asks = dealt.select("a", "salt", F.col("b").alias("cid")).unionByName(dealt.select("a", "salt", F.col("a").alias("cid")).distinct())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = int(pdf["a"].iloc[0])
        blobs, ids = [bytes(t) for t in pdf["text"]], pdf["cid"].tolist()
        sets = {}
        for lo, hi in chunks(blobs):
            sets.update(zip(ids[lo:hi], shingles(blobs[lo:hi], width), strict=True))
        out, own = [], sets[a]
        for b, s in sets.items():
            if b != a:
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                common = int((own[at] == s).sum())
                if den * common >= num * (len(own) + len(s) - common):
                    out.append(b)
        return pd.DataFrame({"a": pd.Series([a] * len(out), dtype="int64"), "b": pd.Series(out, dtype="int64")})

    got = asks.join(texts, "cid").select("a", "salt", "cid", "text")
    return got.groupBy("a", "salt").applyInPandas(run, "a long, b long")


def contract(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels(node, comp) of linked nodes after the links more(a, b): components of the components only."""
    own = lambda c: more.join(labels.withColumnRenamed("node", c), c, "left").select("a", "b", F.coalesce("comp", c).alias(f"c_{c}"))
    ends = own("a").join(own("b"), ["a", "b"]).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b").distinct()
    over = components(ends)
    moved = hot_join(labels, over.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return settle(moved.unionByName(over.join(labels, "node", "left_anti").select("node", "comp")))


def similar(rare: DataFrame, num: int, den: int, miss: float) -> DataFrame:
    """(a, b, b_n): pairs of classes of different components that share a rare shingle at positions that
    allow the similarity, and whose bits do.  A shingle of very many classes is dealt: one side's rows by a
    hash, the other side's to each share; there are few such shingles, so the list is broadcast."""
    n = rare.count()
    hot = rare.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where((F.col("k") > HOT_CLASSES) & (F.col("k") * HOT_SHARE >= n))
    hot = F.broadcast(settle(hot.select("s", (F.col("k") / HOT_CLASSES).cast("int").alias("shares"))))
    x, y = (rare.select("s", F.col("i").alias(f"{c}_i"), F.col("cid").alias(c), F.col("comp").alias(f"{c}_comp"), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")).join(hot, "s", "left").withColumn("shares", F.coalesce("shares", F.lit(0))) for c in "ab")
    x = x.withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares") + 1).cast("int"))
    y = y.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares"))))
    fits = (num + den) * F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i")) >= num * (F.col("a_n") + F.col("b_n"))
    # Pruned inside the join: only pairs of different components that may be similar are made.
    return x.join(y, (x["s"] == y["s"]) & (x["share"] == y["share"]) & (x["a_comp"] < y["b_comp"]) & fits & _promising(least_matches(num / den, miss))).select("a", "b", "b_n").distinct()


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, num: int = SIM_NUM, den: int = SIM_DEN, miss: float = MISS) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) for every row of df.

    Links: den * |intersection| >= num * |union| of the sets of distinct `width`-word shingles (A-Z
    lower-cased; words are runs of anything but ASCII white space; a text of fewer words has its whole
    sequence as the one shingle).  Rows without words (null, empty, white space) are linked with
    nothing.  component_id is the smallest id reachable, and kept tells whether it is the row's own; a
    component whose ids are all null has a null component_id and keeps its rows.  Rows that repeat an
    id and belong to one component are all kept, or none.  Other columns of df are ignored.
    A pair of similarity 0.75 is a candidate with probability 1 - 7e-6, and above it more surely.
    """
    with small_batches(df.sparkSession):
        base = settle(sketches(df, id_col, text_col, width).withColumn("rid", F.monotonically_increasing_id()))
    full = base.where("n > 0")
    # Classes of equal sets; one row stands for each.  Copies fold before the shuffle.
    first = full.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("r")).select("r.rid")
    reps = full.join(first, "rid")
    classes = settle(reps.select(F.col("rid").alias("cid"), F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "digest", "n", "bits", "bands"))

    bands = classes.select("cid", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("leader")).where("k > 1").select("key", "leader")
    members = settle(bands.join(shared, "key"))
    wanted = members.select("cid").distinct().join(classes.select("cid", "c_id", "c_th"), "cid")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    texts = docs.join(wanted, (docs["th"] == wanted["c_th"]) & docs["doc_id"].eqNullSafe(wanted["c_id"])).select("cid", "text")
    texts = settle(texts)

    links = settle(verify(members.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct(), classes, texts, width, miss, num, den))
    labels = components(links)
    before = float("inf")
    for turn in range(1, STAR_ROUNDS + 1):
        owned = members.select("key", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
        sizes = owned.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64("cid", "key", F.lit(turn)).alias("h"), "cid")).alias("lead"))
        mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.max(F.struct("k", "lead", "comp")).alias("top")).where("comps > 1")
        mixed = settle(mixed.select("key", "k", "kk", F.col("top.lead.cid").alias("leader"), F.col("top.comp").alias("l_comp")))
        left_over = mixed.agg(F.sum("k").alias("k"), F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("pairs")).first()
        if not left_over["k"]:
            break
        # Another star pays as long as it halves what would have to be compared pair by pair.
        last = turn == STAR_ROUNDS or left_over["pairs"] <= 4 * left_over["k"] or left_over["pairs"] > before / 2
        before = left_over["pairs"]
        within = owned.join(mixed, "key")
        if last:
            # What is left is joined on rare shingles, which finds every link among these classes.
            own = settle(within.select("cid", "comp").distinct().join(texts, "cid"))
            with small_batches(df.sparkSession):
                rare = settle(rare_prefixes(own, width, num, den).join(classes.select("cid", "n", "bits"), "cid"))
            more = exact_links(settle(similar(rare, num, den, miss)), texts, width, num, den)
        else:
            pairs = within.where("comp <> l_comp").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
            more = verify(pairs, classes, texts, width, miss, num, den)
        more = settle(more)
        if not more.isEmpty():
            labels = contract(labels, more)
        if last:
            break

    named = classes.select("digest", "cid", "c_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("digest", "c_id", F.coalesce("comp", "cid").alias("comp"))
    named = settle(named)
    ids = hot_join(named, named.groupBy("comp").agg(F.min("c_id").alias("component_id")), "comp").select(F.col("digest").alias("d"), "component_id")
    rows = base.select("doc_id", "th", "digest", "n")
    out = rows.join(ids, rows["digest"] == ids["d"], "left")
    comp = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return near_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs of documents that share a shingle, confirmed on whole sets: what op4 must return.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS s, doc_id AS t FROM n UNION SELECT r.s, u.b FROM reach r JOIN u ON r.t = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(t) AS component_id, n.doc_id = min(t) AS kept FROM n JOIN reach ON s = n.doc_id GROUP BY n.doc_id, n.n
"""
