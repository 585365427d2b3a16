"""Keeps a vocabulary of the names in texts, with ids that never change.

Labels of an open vocabulary come as free text.  The engine wants a small id for each name, in order of
first sight, and ids must not shift when more texts follow.  Each run takes the rows whose id is beyond
the high-water mark, gives names that were never seen the next ids, and counts for each group of texts (a
source) how many of its texts use each name, up to the saturation of votes.  The configuration names
the columns and what separates names.

Folders in the target:

    names/run=K            names first seen by run K: name, class_id, first_id
    counts/run=K/part=P    what run K adds to the counts of each group and name
    votes/part=P           all counts, renewed for the groups that the run touched: source, name, class_id, votes
    marks                  one row a finished run: run, upto (the high-water mark), rows taken

A run that ends early has no mark; the next one has its number and replaces what it wrote.  Rows without an
id have no place beyond a mark and are not taken; the log says how many there are.

    python -m jobs.vocabulary --source /notes/documents.parquet --target /notes/vocabulary
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, read_or_empty, table_of, write_parts
from voxloom.operators.tables import dense_ids, settle
from voxloom.operators.votes import SATURATION

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ID_BITS = 10  # ids are given inside buckets of so many bits of the row id
MARKS = table_of(run="long", upto="long", rows="long")
NAMES = table_of(name="string", class_id="long", first_id="long", run="long")
COUNTS = table_of(group="string", name="string", n="long", run="long", part="string")
VOTES = table_of(group="string", name="string", class_id="long", votes="long", part="string")


def names_of(docs: DataFrame, config: dict) -> DataFrame:
    """(id, group, name): the names of each row, once each; A-Z in lower case, stripped."""
    words = F.split(F.translate(F.col(config["text"]), UPPER, LOWER), config["separator"])
    named = F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, config["strip"], "")))
    rows = docs.select(F.col(config["id"]).cast("long").alias("id"), F.col(config["group"]).cast("string").alias("group"), F.explode(named).alias("name"))
    return rows.where("name <> ''")


def part_of(group: str) -> F.Column:
    """A folder's name for a group that may be null or empty."""
    return F.concat(F.lit("g_"), F.coalesce(F.col(group), F.lit("")))


def run(spark: SparkSession, source: str, target: str, config: dict) -> DataFrame:
    """Take the rows beyond the mark and return all votes: part, group, name, class_id, votes."""
    votes = f"{target}/votes"
    done = read_or_empty(spark, f"{target}/marks", MARKS).agg(F.max("run"), F.max("upto")).first()
    number, mark = (0, None) if done[0] is None else (done[0] + 1, done[1])
    docs = spark.read.parquet(source)
    key = F.col(config["id"]).cast("long")
    fresh = docs.where(key.isNotNull() if mark is None else key > mark)
    rows, upto, lost = (fresh.agg(F.count(F.lit(1)), F.max(key)).first()) + (docs.where(key.isNull()).count(),)
    log.info("read %s: %d rows beyond mark %s, up to %s; %d rows without an id left out", source, rows, mark, upto, lost)
    if not rows:
        return read_or_empty(spark, votes, VOTES)

    # Rows that arrive meanwhile are beyond `upto` and wait for the next run.
    seen = settle(names_of(fresh.where(key <= upto), config).groupBy("group", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")))
    known = read_or_empty(spark, f"{target}/names", NAMES).where(F.col("run") < number)
    base = known.agg(F.coalesce(F.max("class_id") + 1, F.lit(0))).first()[0]
    new = seen.groupBy("name").agg(F.min("first_id").alias("first_id")).join(known, "name", "left_anti")
    numbered = dense_ids(new.withColumn("bucket", F.shiftright("first_id", ID_BITS)), "bucket", [F.col("first_id"), F.col("name")], "class_id")
    write_parts(numbered.select("name", (F.col("class_id") + base).alias("class_id"), "first_id", F.lit(number).cast("long").alias("run")), f"{target}/names", "run")

    adds = seen.select("group", "name", "n", F.lit(number).cast("long").alias("run"), part_of("group").alias("part"))
    adds.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(f"{target}/counts")
    touched = seen.select(part_of("group").alias("part")).distinct()
    counts = read_or_empty(spark, f"{target}/counts", COUNTS).where(F.col("run") <= number).join(touched, "part", "left_semi")
    total = counts.groupBy("part", "group", "name").agg(F.least(F.sum("n"), F.lit(SATURATION)).cast("long").alias("votes"))
    ids = read_or_empty(spark, f"{target}/names", NAMES).where(F.col("run") <= number).select("name", "class_id")
    write_parts(total.join(ids, "name").select("group", "name", "class_id", "votes", "part"), votes, "part")

    done = spark.range(1).select(F.lit(number).alias("run"), F.lit(upto).alias("upto"), F.lit(rows).alias("rows"))
    done.select(*(F.col(f.name).cast("long") for f in MARKS)).write.mode("append").parquet(f"{target}/marks")
    after = ids.count()
    log.info("wrote %s: run %d, %d new names of %d, %d groups renewed", target, number, after - base, after, touched.count())
    return read_or_empty(spark, votes, VOTES)


if __name__ == "__main__":
    command_line("vocabulary", __doc__.splitlines()[0], run, ("target",))
