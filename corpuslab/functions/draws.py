"""Seeded randomness that any engine can repeat: md5 of what is drawn for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(*parts) -> Column:
    """The parts joined by bars; nulls become empty."""
    return F.concat_ws("|", *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts])


def order_key(*parts) -> Column:
    """A hex digest to sort by: a seeded permutation."""
    return F.md5(text(*parts))


def draw(n, *parts) -> Column:
    """An integer from 0 to n - 1."""
    value = F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("long")
    return F.pmod(value, n if isinstance(n, Column) else F.lit(n))


def uniform(*parts) -> Column:
    """A number from 0 to below 1."""
    return F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
