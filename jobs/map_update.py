"""Keeps a labelled cell map up to date with new log files.

A robot's logs arrive as files in a folder.  Each run takes the files that came since the last one (a file
stream with its checkpoint), folds their points to sums and class votes of cells, and renews the tiles
of the map that they touch.  The configuration says which expressions are a point's cell, tile, values
and class, and how votes become a class.

Folders in the target:

    updates/batch=N/tile=T   what micro-batch N brings to each cell and class; written anew if N is repeated
    state/tile=T             sums of each cell and class, `upto` the last batch that is in them
    map/tile=T               one row a cell: n, sums, class_id, total votes
    marks                    the batches up to which the map is published

A run that ends early leaves nothing half done that the next one does not finish: batches beyond the
last mark are folded again, into each tile only those beyond its own `upto`.

    python -m jobs.map_update --source /logs/points --target /maps/site --checkpoint /maps/site-checkpoint
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import command_line, log, read_or_empty, table_of, write_parts
from voxloom.operators import votes
from voxloom.operators.tables import settle


def folded(points: DataFrame, config: dict) -> DataFrame:
    """(tile, cell..., class_id, n, sum_*) of points; points without a whole cell are left out."""
    cell, values = config["cell"], config["values"]
    rows = points.selectExpr(*(f"{e} AS {n}" for n, e in cell.items()), *(f"{e} AS {n}" for n, e in values.items()), f"CAST({config['class_id']} AS INT) AS class_id")
    rows = rows.na.drop(subset=list(cell)).withColumn("tile", F.expr(config["tile"]))
    return rows.groupBy("tile", *cell, "class_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"sum_{v}") for v in values))


def take_new(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict, schema: T.StructType) -> None:
    """Fold the files that the stream has not seen, batch by batch."""

    def write(batch: DataFrame, number: int) -> None:
        folded(batch, config).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tile").parquet(f"{target}/updates/batch={number}")

    stream = spark.readStream.format(config["format"]).schema(schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).option("maxFileAge", config["max_file_age"]).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    log.info("read %d new points of %s in %d batches", sum(p["numInputRows"] for p in progress), source, len([p for p in progress if p["numInputRows"]]))


def publish(spark: SparkSession, target: str, config: dict, shape: T.StructType) -> None:
    """Fold batches beyond the mark into the state, renew the tiles of the map that they touch, set the mark."""
    cell, sums = list(config["cell"]), ["n", *(f"sum_{v}" for v in config["values"])]
    at = T.StructField("batch", T.LongType())
    mark = read_or_empty(spark, f"{target}/marks", table_of(batch="long")).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    pending = read_or_empty(spark, f"{target}/updates", T.StructType([*shape.fields, at])).where(F.col("batch") > mark)
    last = pending.agg(F.max("batch")).first()[0]
    if last is None:
        log.info("nothing to publish beyond batch %d", mark)
        return
    state = read_or_empty(spark, f"{target}/state", T.StructType([*shape.fields, T.StructField("upto", T.LongType())]))
    touched = settle(pending.select("tile").distinct())
    before = state.join(touched, "tile", "left_semi")
    seen = before.groupBy("tile").agg(F.max("upto").alias("seen"))
    fresh = pending.join(seen, "tile", "left").where(F.col("seen").isNull() | (F.col("batch") > F.col("seen"))).drop("seen").withColumnRenamed("batch", "upto")
    # Kept before it replaces what it was made from.
    now = settle(before.unionByName(fresh).groupBy("tile", *cell, "class_id").agg(*(F.sum(s).alias(s) for s in sums), F.max("upto").alias("upto")))
    write_parts(now, f"{target}/state", "tile")
    key = ["tile", *cell]
    ballots = now.where("class_id IS NOT NULL").select(*key, "class_id", F.least("n", F.lit(votes.SATURATION)).cast("long").alias("votes"))
    won = votes.resolve(ballots, key, "class_id", F.col("class_id").isin(config["stuff"]), config["stuff_bias"], config["min_votes"], config["min_conf"])
    cells = now.groupBy(*key).agg(*(F.sum(s).alias(s) for s in sums)).join(won.select(*key, "class_id", "total"), key, "left")
    write_parts(cells.withColumn("total", F.coalesce("total", F.lit(0))), f"{target}/map", "tile")
    spark.range(1).select(F.lit(last).cast("long").alias("batch")).write.mode("append").parquet(f"{target}/marks")
    log.info("published batches %d to %d: %d tiles, %d rows of cells and classes", mark + 1, last, touched.count(), now.count())


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new in source, publish, and return the map: tile, cell..., n, sum_*, class_id, total.
    The source has at least one file, or the configuration a `schema`."""
    schema = T.StructType.fromDDL(config["schema"]) if "schema" in config else spark.read.format(config["format"]).load(source).schema
    shape = folded(spark.createDataFrame([], schema), config).schema
    take_new(spark, source, target, checkpoint, config, schema)
    publish(spark, target, config, shape)
    kept = [f for f in shape.fields if f.name not in ("class_id", "tile")]
    tile = next(f for f in shape.fields if f.name == "tile")
    table = read_or_empty(spark, f"{target}/map", T.StructType([*kept, T.StructField("class_id", T.IntegerType()), T.StructField("total", T.LongType()), tile]))
    log.info("map at %s/map", target)
    return table


if __name__ == "__main__":
    command_line("map_update", __doc__.splitlines()[0], run, ("target", "checkpoint"))
