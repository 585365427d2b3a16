"""A training corpus from raw documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxloom import ship
from voxloom.llm.common import read_table, scratch, semi_rows
from voxloom.llm.exact_dedup import drop_exact_copies
from voxloom.llm.minhash import near_components
from voxloom.llm.mixing import draw
from voxloom.llm.packing import default_paths, pack, pieces
from voxloom.llm.quality import judge, train
from voxloom.operators.tables import cleared, remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is 0.7 or more."""
    ship(spark)
    return judge(docs, train(docs, read_table(spark, sf_dir, "labels")), docs.columns, filtered=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    ship(spark)
    found = near_components(docs).where("kept").selectExpr("doc_id AS id", "th")
    return semi_rows(docs, found, "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, report: str | None = None) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights; values too scarce
    for theirs are kept whole.  Shares and what they miss their targets by are written to `report`, by
    default a new folder mixing-report-* of the shared folder, which stays."""
    ship(spark)
    return draw(docs, report=report or f"{shared_dir(spark)}/mixing-report-{uuid.uuid4().hex}")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents left, in sequences of 2048."""
    ship(spark)
    return pack(pieces(docs, default_paths()))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("minhash near-dedup", near), ("mixing", mixing), ("packing", packing)]

#: Trained weights, hashes and search have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what each stage returns is written to the shared folder and reread."""
    docs, folder = read_table(spark, sf_dir, "documents"), scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        with cleared(spark):  # what a stage kept for itself goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
