"""Keys, fingerprints and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multiplier of Knuth's multiplicative hash, and the size of the palette.
KNUTH = 2654435761
PALETTE = 20


def node_key(vehicle: Column, tick: Column) -> Column:
    """64-bit key of (vehicle, tick): vehicle in the top 16 bits, xor the tick."""
    return F.shiftleft(vehicle.cast("long"), 48).bitwiseXOR(tick.cast("long"))


def is_null_node(vehicle: Column, tick: Column) -> Column:
    return (vehicle == 0) & (tick == 0)


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def fingerprint(*cols: Column) -> Column:
    """Changes when one of the columns does; for comparing, not for keeping."""
    return F.xxhash64(*cols)


def membership_signature(members: Column, cls: Column, level: Column, samples: int = 16) -> Column:
    """Changes when an object's class, level or number of members does, or one of about `samples` evenly
    spaced members of its sorted list, or the last; for comparing, not for keeping."""
    n = F.size(members)
    step = F.greatest(F.lit(1), F.floor(n / samples)).cast("int")
    some = F.filter(members, lambda _, i: (i % step == 0) | (i == n - 1))
    return F.xxhash64(n, cls, level, some)


def colour_hash(i: Column) -> Column:
    """The 32-bit multiplicative hash of an id."""
    return (i.cast("long") * F.lit(KNUTH)).bitwiseAND(F.lit(0xFFFFFFFF))


def palette_index(i: Column) -> Column:
    return F.pmod(i.cast("long"), F.lit(PALETTE)).cast("int")


def rgb_of(colour: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of id = r + 256 g + 65536 b."""
    return tuple(F.shiftright(colour, s).bitwiseAND(F.lit(255)).cast("int") for s in (0, 8, 16))


def id_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return r.cast("long") + g.cast("long") * 256 + b.cast("long") * 65536


def export_label(class_id: Column) -> Column:
    """Label of a point in an exported cloud: class id plus one, 0 for none."""
    return F.coalesce(class_id + 1, F.lit(0))
