"""Names, lists and instructions."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_home(path: str) -> str:
    """A leading ~ becomes the home folder."""
    return os.environ.get("HOME", "~") + path[1:] if path == "~" or path.startswith("~/") else path


def split_list(text: Column) -> Column:
    """Comma-separated names, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_ints(text: Column) -> Column:
    return F.transform(split_list(text), lambda x: x.cast("int"))


def synonyms(canonical: Column, others: Column) -> Column:
    """The canonical name first, then the comma-separated others, each once."""
    return F.array_distinct(F.concat(F.array(F.trim(canonical)), split_list(F.coalesce(others, F.lit("")))))


def join_instructions(pairs: Column) -> Column:
    """'content: direction; ...' of an array of structs; pairs without content and direction are left out."""
    kept = F.filter(pairs, lambda p: (F.coalesce(p["content"], F.lit("")) != "") | (F.coalesce(p["direction"], F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.coalesce(p["content"], F.lit("")), F.lit(": "), F.coalesce(p["direction"], F.lit("")))), "; ")


def image_name(t_ns: Column) -> Column:
    return F.concat(F.lit("img"), t_ns.cast("string"))
