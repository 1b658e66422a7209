"""Column functions: arithmetic with the numerics that pandas users expect, names and ids, and vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def half_even(c: Column) -> Column:
    """Round to a whole number, halves to even."""
    return F.rint(c)


def bin_of(c: Column, width: Column | float, origin: Column | float = 0.0) -> Column:
    return F.floor((c - origin) / width).cast("long")


def zero_if_missing(c: Column) -> Column:
    """0 for null, NaN and infinities."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def clip_low(c: Column, low: float = 0.0) -> Column:
    return F.greatest(c, F.lit(low))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, and ``otherwise`` where b is 0 or null."""
    out = F.when(b != 0, a / b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def gene_key(c: Column) -> Column:
    """The key by which genes of different platforms meet: lower case, outer white space off."""
    return F.lower(F.trim(c))


def composed_id(*parts: Column, separator: str = "_") -> Column:
    return F.concat_ws(separator, *[p.cast("string") for p in parts])


def run_name(parameters: dict[str, Column]) -> Column:
    """``key-value`` pairs joined by underscores, in the given order."""
    return F.concat_ws("_", *[F.concat_ws("-", F.lit(k), v.cast("string")) for k, v in parameters.items()])


def run_parameter(name: Column, key: str) -> Column:
    """The value of one parameter in a run name, null where it has none."""
    hit = F.filter(F.split(name, "_"), lambda p: F.startswith(p, F.lit(f"{key}-")))
    return F.substring_index(F.get(hit, F.lit(0)), "-", -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))
