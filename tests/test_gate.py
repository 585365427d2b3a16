"""Requests and results of a slow reader over several micro-batches."""

import random

from pyspark.sql import functions as F

from voxloom.streaming import gate, keyed, mapstate


def by_hand(rows, queue):
    """run -> what became of each row, with a dictionary of pending ids."""
    out, state = [], {}
    for run, t, is_request, item, at, ok, text in sorted(rows, key=lambda r: (r[1], r[2], r[3] or 0, r[4] or 0)):
        s = state.setdefault(run, {"next": 1, "busy": False, "wait": {}})
        if is_request:
            if s["busy"]:
                out.append((run, t, item, None, "BUSY", None))
                continue
            at, s["next"] = s["next"], s["next"] + 1
            if len(s["wait"]) == queue:
                out.append((run, t, item, None, "FULL", None))
                continue
            s["wait"][at], s["busy"] = item, True
            out.append((run, t, item, at, "SENT", None))
        else:
            s["busy"] = False
            whose = s["wait"].pop(at, None)
            good = whose is not None and ok and bool(text)
            out.append((run, t, whose, at, "UNKNOWN" if whose is None else "READ" if good else "FAILED", text if good else None))
    return sorted(out, key=repr)


def test_three_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for t in range(90):
        run = rng.choice("ab")
        if rng.random() < 0.5:
            rows.append((run, t, 1, 1000 + t, None, None, None))
        else:  # late, unknown and failed ones among them
            rows.append((run, t, 0, None, rng.randrange(1, 2 + t // 4), rng.random() < 0.7, rng.choice(["exit", "", None])))
    schema = "run string, t long, is_request int, item long, id long, ok boolean, text string"
    at = str(tmp_path)

    def start():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/rows")
        with mapstate.state_store(spark):
            return keyed.run_once(gate.match_stream(s.where("is_request = 1"), s.where("is_request = 0"), "run", 2), at, "out")

    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(f"{at}/rows")
        if k:
            got = start()
    assert sorted(map(tuple, got.select("run", "t", "item", "id", "status", "text").collect()), key=repr) == by_hand(rows, 2)
    seen = {r["status"] for r in got.select("status").distinct().collect()}
    assert seen == {"SENT", "BUSY", "FULL", "READ", "FAILED", "UNKNOWN"}
    assert got.where(F.col("status") == "READ").where("text = '' OR text IS NULL").count() == 0
