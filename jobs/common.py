"""What the jobs share: command line, log, tables that may not exist yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

log = logging.getLogger("jobs")


def table_of(**columns: str) -> StructType:
    """A schema of long and string columns; needs no session."""
    kinds = {"long": LongType(), "string": StringType()}
    return StructType([StructField(n, kinds[k]) for n, k in columns.items()])


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at a path; an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """Replace those partitions of a table that df has rows of; others stay.  Rows of a partition are brought
    together, large ones over several files."""
    df.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def default_config(name: str) -> dict:
    """The configuration beside the jobs."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def command_line(name: str, about: str, run: Callable[..., DataFrame], folders: tuple[str, ...]) -> None:
    """Parse --source, the folders and --config, start a session, run, log, stop."""
    args = argparse.ArgumentParser(prog=f"jobs.{name}", description=about)
    for folder in ("source", *folders):
        args.add_argument(f"--{folder}", required=True, help="a path that Spark can reach")
    args.add_argument("--config", help=f"a JSON file instead of jobs/{name}.json")
    given = vars(args.parse_args())
    path = given.pop("config")
    config = json.loads(Path(path).read_text()) if path else default_config(name)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(f"jobs.{name}").getOrCreate()
    try:
        from voxloom import ship

        ship(spark)
        run(spark, **given, config=config)
    finally:
        spark.stop()
