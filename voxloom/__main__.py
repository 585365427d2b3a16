"""python -m voxloom: run the pipeline over a log, or a query of the catalogue over tables."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxloom")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="scans, images and label pixels to objects")
    run.add_argument("--config", required=True)
    run.add_argument("--images", required=True, help="Parquet of run, image_id, t")
    run.add_argument("--pixels", required=True, help="Parquet of run, image_id, u, v, name, instance")
    run.add_argument("--out", required=True)
    run.add_argument("--run-id", default="run")
    q = sub.add_parser("query", help="a query of the catalogue")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--show", type=int, default=20)
    return p


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("voxloom").getOrCreate()
    if a.command == "query":
        from voxloom.plans.catalogue import QUERIES

        QUERIES[a.name](spark, a.tables).show(a.show, truncate=False)
        return
    from voxloom.plans import pipeline, report
    from voxloom.sources import calib, config, scanbin

    scanbin.register(spark)
    c = config.load(a.config)
    k = calib.for_sensor(calib.load(spark, c.calib), c.cam).first()
    camera = pipeline.Camera(k["fu"], k["fv"], k["cu"], k["cv"], k["width"], k["height"], k["rotation"], k["offset"])
    points = spark.read.format("scanbin").load(c.log)
    poses = spark.read.format("scanposes").load(c.log).select("scan", "px", "py", "pz", "roll", "pitch", "yaw")
    scans = points.join(poses, "scan").select(F.lit(a.run_id).alias("run"), F.col("t_ns").alias("t"), "x", "y", "z", "intensity", "px", "py", "pz", "roll", "pitch", "yaw")
    images = spark.read.parquet(a.images)
    number = F.row_number().over(pipeline.W.partitionBy("run").orderBy("t", "image_id")) - 1
    images = images.withColumn("n", number).where((F.col("n") >= c.start) & (F.col("n") < c.start + c.count) & ((F.col("n") - c.start) % c.stride == 0)).drop("n")
    report.save(pipeline.Pipeline(spark, camera, c).batch(scans, images, spark.read.parquet(a.pixels)), a.out)


if __name__ == "__main__":
    main()
