"""The jobs over the given tables, as queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import map_update, vocabulary
from jobs.common import default_config
from voxloom.operators.tables import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_map_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell map of lineitem after two runs; the second finds nothing new."""
    at = _folder(spark, "job1")
    for _ in range(2):  # the pattern lets a single file stand for a folder
        out = map_update.run(spark, f"{sf_dir}/lineitem[.]parquet", f"{at}/target", f"{at}/checkpoint", default_config("map_update"))
    return out


def job2_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and votes of the sources of documents after two runs; the second finds nothing new."""
    at = _folder(spark, "job2")
    for _ in range(2):
        out = vocabulary.run(spark, f"{sf_dir}/documents.parquet", f"{at}/target", default_config("vocabulary"))
    return out.select("group", "name", "class_id", "votes", "part")


QUERIES = {"job1_map_update": job1_map_update, "job2_vocabulary": job2_vocabulary}

ORACLES = {
    "job1_map_update": """
WITH pts AS (
  SELECT floor(l_quantity / 5)::INT AS cx, floor(l_extendedprice / 5000)::INT AS cy, floor(round(l_discount * 100)::BIGINT / 2)::INT AS cz,
    l_quantity::BIGINT AS q, round(l_extendedprice * 100)::BIGINT AS price, ascii(l_returnflag) AS c FROM lineitem
), v AS (
  SELECT cx, cy, cz, c, least(count(*), 65535) AS votes FROM pts WHERE c IS NOT NULL GROUP BY ALL
), r AS (
  SELECT *, sum(votes) OVER (PARTITION BY cx, cy, cz) AS total,
    row_number() OVER (PARTITION BY cx, cy, cz ORDER BY votes * CASE WHEN c = 78 THEN 2.0 ELSE 1.0 END DESC, c) AS rk FROM v
), m AS (SELECT cx, cy, cz, count(*) AS n, sum(q) AS sum_q, sum(price) AS sum_price FROM pts GROUP BY ALL)
SELECT m.cx AS tile, m.cx, m.cy, m.cz, n::BIGINT AS n, sum_q::BIGINT AS sum_q, sum_price::BIGINT AS sum_price,
  CASE WHEN total >= 4 AND votes >= 0.2 * total THEN c END::INT AS class_id, coalesce(total, 0)::BIGINT AS total
FROM m LEFT JOIN r ON m.cx = r.cx AND m.cy = r.cy AND m.cz = r.cz AND rk = 1""",
    "job2_vocabulary": r"""
WITH w AS (
  SELECT doc_id, source, unnest(list_distinct(list_transform(
    string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: regexp_replace(x, '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g')))) AS name FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), k AS (SELECT source, name, count(*) AS n, min(doc_id) AS f FROM w WHERE name <> '' GROUP BY ALL),
i AS (SELECT name, row_number() OVER (ORDER BY min(f), name) - 1 AS class_id FROM k GROUP BY name)
SELECT source AS "group", name, class_id::BIGINT AS class_id, least(n, 65535)::BIGINT AS votes, 'g_' || coalesce(source, '') AS part FROM k JOIN i USING (name)""",
}
