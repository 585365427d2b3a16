"""Line dedup, exact dedup, near-dedup and token counts against brute force, and their edge cases."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from voxloom.llm.exact_dedup import drop_exact_copies, exact_groups
from voxloom.llm.line_dedup import OP2_SQL, dedup_lines, op2_line_dedup
from voxloom.llm.minhash import OP4_SQL, contract, least_matches, near_components, op4_minhash_near_dedup, similar
from voxloom.llm.token_cache import CACHE_SCHEMA, op10_token_counts, read_cache, token_counts
from voxloom.operators.tables import components

SCHEMA = "doc_id long, text string, lang string, source string, shard int, kept boolean"  # clashing names


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, True) for i, t in rows], SCHEMA)


LONG = "A line of more than twenty characters"
CASES = [
    (1, f"{LONG}\nshort\nother line that nobody else has"),
    (2, f"  {LONG.upper()}\t\nshort"),
    (3, f"{LONG}\n{LONG}\n"),
    (4, None), (5, ""), (6, "\n\n"), (7, f"x\n{LONG} "), (8, " \x0b\t "), (None, LONG), (9, " " + LONG),
    (10, ("word " * 5000 + "\n") * 3),
]


def brute_lines(rows, least=20, many=3):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held, docs = collections.defaultdict(set), collections.defaultdict(list)
    for i, t in rows:
        docs[i] += enumerate((t or "").split("\n"))
        if i is not None:
            for x in (t or "").split("\n"):
                held[key(x)].add(i)
    out = []
    for i, lines in docs.items():
        gone = lambda x: len(key(x)) >= least and len(held[key(x)]) >= many and i != max(held[key(x)])  # noqa: B023, E731
        keep = [x for _, x in sorted(lines) if not gone(x)] if len([r for r in rows if r[0] == i]) > 1 else [x for _, x in lines if not gone(x)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


REPEATED = [(1, LONG)] * 3 + [(2, LONG)], [(1, f"{LONG}\nb")] * 2 + [(2, LONG), (3, f"a\n{LONG}"), (3, f"a\n{LONG}"), (4, "x\ny")]


@pytest.mark.parametrize("broadcast_keys", [200_000, 0])
def test_line_dedup(spark, broadcast_keys):
    for rows in (CASES, *REPEATED, []):
        got = dedup_lines(table(spark, rows), broadcast_keys=broadcast_keys).collect()
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=repr) == sorted(brute_lines(rows), key=repr)
    got = {r["doc_id"]: r["kept_text"] for r in dedup_lines(table(spark, REPEATED[0])).collect()}
    assert got == {1: f"{LONG}\n{LONG}\n{LONG}", 2: LONG}  # two documents hold the line, whatever their rows


def test_line_dedup_is_its_sql_on_repeated_rows(spark, tmp_path):
    import duckdb

    for k, rows in enumerate(REPEATED):
        table(spark, rows).write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        got = op2_line_dedup(spark, str(tmp_path / str(k))).collect()
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/documents.parquet/*.parquet'")
        want = c.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP2_SQL})").fetchall()
        assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("broadcast_keys", [200_000, 0])
def test_line_dedup_many_lines(spark, broadcast_keys):
    rows = [(i, "\n".join(f"line number {(i * k) % 50} of the document" for k in range(60))) for i in range(30)]
    got = dedup_lines(table(spark, rows), broadcast_keys=broadcast_keys).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == sorted(brute_lines(rows))


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return sorted(((i, min((j for j in groups[norm(t)] if j is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("parts", [1, 13])
def test_exact_dedup(spark, parts):
    rows = [*CASES, (11, "a  b"), (12, "a\tb"), (3, "a b"), (11, "a  b"), *[(100 + k, "hot text") for k in range(300)], *[(500 + k, f"t {k % 7}") for k in range(50)]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_groups(table(spark, rows).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_exact(rows)
    first = collections.Counter(r["text_sha256"] for r in got if r["first"])
    assert set(first.values()) == {1} and len(first) == len({x[3] for x in brute_exact(rows)})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["first"])


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_drop_exact_copies(spark, parts):
    rows = [(5, "a b"), (3, "a  b"), (3, "a  b"), (5, "other"), (None, None), (None, ""), (7, "a b"), *[(100 + k, "hot  text" if k % 2 else "hot text") for k in range(200)], *[(500 + k, f"a long common beginning {k % 7}") for k in range(50)]]
    df = table(spark, rows).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = drop_exact_copies(df)
        assert got.columns == df.columns
        found = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t in rows:
        least[norm(t)] = min(least.get(norm(t), (True, 0)), (i is None, i or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted(least.values()) and len(found) == len(least)
    assert all((r["doc_id"], r["text"]) in rows and r["kept"] for r in found)
    assert drop_exact_copies(table(spark, [])).count() == 0


def test_drop_exact_copies_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 3, [1.5], "x"), (2, "a", 4, None, None), (3, None, 5, [], "y")], "doc_id long, text string, part int, edge array<double>, c0 string")
    got = drop_exact_copies(df)
    assert got.schema == df.schema or got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a", 3, [1.5], "x"), (3, None, 5, [], "y")]


def brute_near(rows, num=75, den=100):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    p = list(range(len(sets)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                p[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def near_rows():
    import random

    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, n = [*CASES, (20, "One two"), (21, "one  TWO"), (22, "one two three"), (23, "... ")], 100
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(6, 150))]
        rows.append((n, " ".join(base)))
        for _ in range(r.randint(0, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(words)
            n += 1
            rows.append((n, " ".join(copy)))
        n += 1
    return rows


def test_near_dedup(spark):
    rows = near_rows()
    got = near_components(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_components(table(spark, [])).count() == 0
    assert near_components(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_near_dedup_large_family(spark):
    import random

    r = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(250):
        copy = list(base)
        for _ in range(r.randint(0, 9)):  # from equal to just under the threshold
            copy[r.randrange(120)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    got = near_components(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(rows)


def test_pruning_keeps_true_pairs():
    import random

    r, least = random.Random(1), least_matches(0.75, 1e-7)
    lost = 0
    for _ in range(20_000):
        m = 0
        for k, need in enumerate(least):
            m += sum(r.random() < 0.875 for _ in range(64))
            if m < need:
                lost += 1
                break
    assert lost == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(64)] + [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(65), 0), **dict.fromkeys(range(100, 140), 100)}


def test_contracted_components(spark):
    """Components of all links at once, and of the later ones over the labels of the earlier."""
    import random

    r = random.Random(4)
    edges = [tuple(sorted(r.sample(range(120), 2))) for _ in range(90)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    want = {x["node"]: x["comp"] for x in components(frame(edges)).collect()}
    labels = components(frame(edges[:40]))
    for part in (edges[40:70], edges[70:]):
        labels = contract(labels, frame(part))
    assert {x["node"]: x["comp"] for x in labels.collect()} == want


def test_hot_shingles_are_dealt(spark, monkeypatch):
    from voxloom.llm import minhash

    rows = [(s, 0, c, c, 4, [0, 0, 0]) for s, n in ((1, 90), (2, 30), (3, 5)) for c in range(n)]
    df = spark.createDataFrame(rows, "s long, i int, cid long, comp long, n long, bits array<long>")
    want = sorted((r["a"], r["b"]) for r in similar(df, 75, 100, 1e-7).collect())
    monkeypatch.setattr(minhash, "HOT_CLASSES", 10)
    assert sorted((r["a"], r["b"]) for r in similar(df, 75, 100, 1e-7).collect()) == want == [(a, b) for a in range(90) for b in range(a + 1, 90)]


def test_near_dedup_is_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({OP4_SQL})").fetchall()
    assert sorted(tuple(r) for r in op4_minhash_near_dedup(spark, sf).collect()) == sorted(want)


def test_hot_join(spark):
    from voxloom.llm.common import hot_join

    left = spark.createDataFrame([(1, k) for k in range(500)] + [(k, k) for k in range(2, 300)], "a long, v long")
    right = spark.createDataFrame([(k, k * k) for k in range(200)], "a long, w long")
    assert sorted(map(tuple, hot_join(left, right, "a").collect())) == sorted(map(tuple, left.join(right, "a").collect()))


def piece_model():
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_token_counts(spark, tmp_path):
    import public_tokenizers as P

    path, sp = piece_model()
    marks = [(60, "one \u2581two"), (61, "one  two"), (62, "\u2581")]  # the first two have equal ids
    rows = [*CASES, *marks, (30, "<s> hi </s>"), (31, "héllo ﬁ 漢字 🙂"), (30, "<s> hi </s>"), (None, None), (40, "the same"), (41, "the same")]
    cache = str(tmp_path / "cache")
    got = token_counts(table(spark, rows), path, cache, limit=5).collect()
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in got)
    n = read_cache(spark, cache).select("content").distinct().count()
    assert n == len({(t or "").replace("\u2581", " ") for _, t in rows})
    assert read_cache(spark, cache).count() <= n + 1  # copies are encoded once; a repeated row once a task
    token_counts(table(spark, [*rows, (50, "something new")]), path, cache).collect()
    assert read_cache(spark, cache).select("content").distinct().count() == n + 1
    other = token_counts(table(spark, rows[:3]), P.path("byte_bpe_50k.json"), cache)
    assert other.count() == 3 and read_cache(spark, cache).select("tokenizer").distinct().count() == 2
    assert token_counts(table(spark, []), path, str(tmp_path / "none")).count() == 0


def test_token_counts_of_a_cache_written_twice(spark, tmp_path):
    """Two jobs that missed together leave contents twice; and a hit is believed, not counted again."""
    path, sp = piece_model()
    rows, cache = [(1, "a b"), (2, "c d e"), (3, "a b")], str(tmp_path / "cache")
    token_counts(table(spark, rows), path, cache)
    twice = read_cache(spark, cache).collect()
    spark.createDataFrame(twice, CACHE_SCHEMA).write.mode("append").parquet(cache)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(table(spark, rows), path, cache).collect())
    assert got == [(i, len(sp.encode(t))) for i, t in rows] and read_cache(spark, cache).count() == 2 * len(twice)
    wrong = str(tmp_path / "wrong")
    spark.createDataFrame([(r["content"], r["tokenizer"], 77) for r in twice], CACHE_SCHEMA).write.parquet(wrong)
    assert {r["n_tokens"] for r in token_counts(table(spark, rows), path, wrong).collect()} == {77}


def test_token_counts_of_a_hot_content(spark, tmp_path):
    path, sp = piece_model()
    rows = [(i, "hot content") for i in range(900)] + [(1000 + i, f"rare {i}") for i in range(1200)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(table(spark, rows), path, str(tmp_path / "c")).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in rows}


def test_space_mark_is_a_space_to_the_model():
    import random

    _, sp = piece_model()
    r = random.Random(0)
    for _ in range(20_000):
        t = "".join(r.choice("ab \u2581 \t\nxé漢<s>") for _ in range(r.randint(0, 12)))
        assert sp.encode(t) == sp.encode(t.replace("\u2581", " "))


def test_token_query_against_the_library(spark):
    _, sp = piece_model()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op10_token_counts(spark, "/root/testdata/sf0.001").collect()}
    want = {r.doc_id: (len(r.text.encode()), n := len(sp.encode(r.text)), n > 4096) for r in docs.itertuples()}
    assert got == want


def test_hash_tells_rows_apart(spark):
    from voxloom.llm.common import text_hash

    df = spark.createDataFrame([(None,), ("",), ("a",)], "text string").select(text_hash("text").alias("h"))
    assert df.select(F.countDistinct("h")).first()[0] == 3
