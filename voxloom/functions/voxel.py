"""Cell keys and radius cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOXEL = 0.05


def cell(x: Column, size: float) -> Column:
    """floor(x / size) as an integer; a size of 0 or less falls back to the default edge."""
    edge = size if size > 0 else DEFAULT_VOXEL
    return F.floor(x / F.lit(edge)).cast("int")


def cell_key(xs: list[Column], size: float) -> list[Column]:
    return [cell(x, size) for x in xs]


def around(c: Column, reach: int = 1) -> Column:
    """The cells within `reach` of c, to be exploded."""
    return F.sequence(c - F.lit(reach), c + F.lit(reach))
