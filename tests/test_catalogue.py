"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from voxloom.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, int | float | np.number):
        return round(float(x), 9)
    return str(x)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(x) for x in r] for r in df[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert rows(got.toPandas()) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert got.count() >= 0 and got.columns


#: Spark's and DuckDB's names of the types that queries return.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_types(spark, duck):
    for name, sql in ORACLES.items():
        if not name.startswith("stream_"):
            want = {r[0]: r[1] for r in duck.sql(f"DESCRIBE {sql}").fetchall()}
            assert {c: TYPES.get(t, t) for c, t in QUERIES[name](spark, SF).dtypes} == want, name


def test_no_row_filter_by_id():
    """Oracles read whole tables: no sampling, no limits."""
    for sql in ORACLES.values():
        assert "LIMIT" not in sql.upper() and "SAMPLE" not in sql.upper()


def test_mask_ops_without_pixels(spark, tmp_path):
    """Where every pixel is in both masks, `minus` is empty and has no row, as in the SQL."""
    spark.range(64 * 48).selectExpr("id AS p_partkey", "CAST(id DIV 64 AS INT) AS p_size", "'Brand#23' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = rows(QUERIES["mask_set_ops"](spark, str(tmp_path)).toPandas())
    assert got == rows(c.sql(ORACLES["mask_set_ops"]).df()) and len(got[1]) == 4
