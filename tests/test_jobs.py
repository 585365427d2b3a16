"""Jobs over growing input, interrupted and repeated."""

import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import common, map_update, vocabulary

SF = "/root/testdata/sf0.001"
MAP, WORDS = common.default_config("map_update"), common.default_config("vocabulary")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def batches(spark, at):
    return sorted(r[0] for r in spark.read.parquet(f"{at}/updates").select("batch").distinct().collect())


@pytest.fixture
def logs(spark, tmp_path):
    """lineitem in three files to come, the folder they come to, and a way to bring one."""
    li, folder = spark.read.parquet(f"{SF}/lineitem.parquet"), str(tmp_path / "logs")

    def bring(k):
        li.where(F.pmod("l_orderkey", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(folder)

    return bring, folder


def expected_map(spark):
    """By hand, from the whole table."""
    n, q, p, v = Counter(), Counter(), Counter(), defaultdict(Counter)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        c = (int(r.l_quantity // 5), int(r.l_extendedprice // 5000), round(r.l_discount * 100) // 2)
        n[c] += 1
        q[c] += int(r.l_quantity)
        p[c] += round(r.l_extendedprice * 100)
        v[c][ord(r.l_returnflag)] += 1
    out = []
    for c in n:
        best = max(v[c], key=lambda k: (v[c][k] * (2 if k == 78 else 1), -k))
        total = sum(v[c].values())
        cls = best if total >= 4 and v[c][best] >= 0.2 * total else None
        out.append((cls, *c, n[c], p[c], q[c], c[0], total))
    return sorted(out, key=repr)


def test_map_grows_with_its_input(spark, logs, tmp_path):
    bring, folder = logs
    target, mark = str(tmp_path / "target"), str(tmp_path / "checkpoint")
    bring(0)
    first = rows(map_update.run(spark, folder, target, mark, MAP))
    assert sum(r[4] for r in first) == spark.read.parquet(folder).count()
    had = batches(spark, target)
    bring(1)
    bring(2)
    second = rows(map_update.run(spark, folder, target, mark, MAP | {"max_files_per_batch": 1}))
    assert second == expected_map(spark) and len(batches(spark, target)) == len(had) + 2
    before = batches(spark, target)
    assert rows(map_update.run(spark, folder, target, mark, MAP)) == second  # nothing new
    assert batches(spark, target) == before and spark.read.parquet(f"{target}/marks").count() == 2


@pytest.mark.parametrize("fails", ["state", "map"])
def test_map_after_a_run_that_ended_early(spark, logs, tmp_path, monkeypatch, fails):
    bring, folder = logs
    target, mark = str(tmp_path / "target"), str(tmp_path / "checkpoint")
    bring(0)
    map_update.run(spark, folder, target, mark, MAP)
    bring(1)
    bring(2)

    def broken(df, path, part):
        common.write_parts(df, path, part)
        if path.endswith(fails):
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(map_update, "write_parts", broken)
        with pytest.raises(OSError):
            map_update.run(spark, folder, target, mark, MAP)
    assert rows(map_update.run(spark, folder, target, mark, MAP)) == expected_map(spark)


def test_only_touched_tiles_are_renewed(spark, tmp_path):
    config = {"format": "parquet", "max_files_per_batch": 1, "max_file_age": "36500d", "cell": {"x": "x"}, "tile": "x DIV 10", "values": {"v": "v"}, "class_id": "c", "stuff": [], "stuff_bias": 1.0, "min_votes": 1, "min_conf": 0.0}
    folder, target, mark = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "x int, v long, c int"
    spark.createDataFrame([(1, 5, 7), (1, 6, None), (None, 1, 1), (25, 1, 2)], schema).coalesce(1).write.parquet(folder)
    assert rows(map_update.run(spark, folder, target, mark, config)) == [(2, 1, 1, 2, 1, 25), (7, 2, 11, 0, 1, 1)]
    files = {f for f in os.listdir(f"{target}/map/tile=0") if f.endswith(".parquet")}
    spark.createDataFrame([(25, 2, 3), (26, 1, None)], schema).coalesce(1).write.mode("append").parquet(folder)
    assert rows(map_update.run(spark, folder, target, mark, config)) == [(2, 2, 3, 2, 2, 25), (7, 2, 11, 0, 1, 1), (None, 1, 1, 2, 0, 26)]
    assert files == {f for f in os.listdir(f"{target}/map/tile=0") if f.endswith(".parquet")}


def test_map_of_no_points(spark, tmp_path):
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(str(tmp_path / "in"))
    out = map_update.run(spark, *(str(tmp_path / n) for n in ("in", "out", "checkpoint")), MAP)
    assert out.count() == 0 and set(out.columns) == {"tile", "cx", "cy", "cz", "n", "sum_q", "sum_price", "class_id", "total"}


def expected_votes(docs, cap=65535):
    first, n = {}, Counter()
    for i, text, group in docs:
        if i is None or text is None:
            continue
        words = re.split(r"[\x20\x09-\x0D]+", text.translate(str.maketrans(vocabulary.UPPER, vocabulary.LOWER)))
        for w in {re.sub(r"^[.,;:!?()]+|[.,;:!?()]+$", "", w) for w in words} - {""}:
            n[group, w] += 1
            first[w] = min(first.get(w, i), i)
    ids = {w: k for k, w in enumerate(sorted(first, key=lambda w: (first[w], w.encode())))}
    return sorted(((ids[w], g, w, "g_" + (g or ""), min(cap, c)) for (g, w), c in n.items()), key=repr)


def test_vocabulary_grows_with_its_input(spark, tmp_path, monkeypatch):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10**6, "Über (chair) CHAIR, table!", None), (10**6 + 1, None, "web"), (10**6 + 2, "", ""), (10**6 + 3, "chair ... x", ""), (10**6 + 3, "x", "a=b/c"), (None, "never", "web")]
    schema, folder, target = "doc_id long, text string, source string", str(tmp_path / "in"), str(tmp_path / "out")

    def write(upto):
        df = spark.createDataFrame(docs, schema)
        df.where((F.col("doc_id") < upto) | F.col("doc_id").isNull()).write.mode("overwrite").parquet(folder)

    write(60)
    first = vocabulary.run(spark, folder, target, WORDS)
    assert rows(first) == expected_votes([d for d in docs if d[0] is not None and d[0] < 60])
    ids = {r["name"]: r["class_id"] for r in first.select("name", "class_id").distinct().collect()}
    write(2 * 10**6)
    real = common.write_parts

    def broken(df, path, part):
        real(df, path, part)
        if path.endswith("names"):
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(vocabulary, "write_parts", broken)
        with pytest.raises(OSError):
            vocabulary.run(spark, folder, target, WORDS)
    second = rows(vocabulary.run(spark, folder, target, WORDS))
    assert second == expected_votes(docs)
    assert {r[2]: r[0] for r in second if r[2] in ids} == ids  # no id has moved
    assert rows(vocabulary.run(spark, folder, target, WORDS)) == second
    assert [tuple(r) for r in spark.read.parquet(f"{target}/marks").orderBy("run").select("run", "upto").collect()] == [(0, 59), (1, 10**6 + 3)]


def test_votes_saturate_over_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vocabulary, "SATURATION", 3)
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(10 * k + i, "a b" if i else "a", "s") for i in range(2)], "doc_id long, text string, source string").write.mode("append").parquet(folder)
        out = vocabulary.run(spark, folder, target, WORDS)
    assert {r["name"]: r["votes"] for r in out.collect()} == {"a": 3, "b": 2}


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "in"))
    assert vocabulary.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), WORDS).count() == 0


def test_command_line(tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    at = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = [sys.executable, "-m", "jobs.map_update", "--source", f"{SF}/lineitem[.]parquet", "--target", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "checkpoint")]
    done = subprocess.run(args, cwd=at, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 6005 new points" in done.stderr or re.search(r"read \d{4} new points", done.stderr)
    assert "published batches 0 to 0" in done.stderr
