"""Deterministic draws: the same on every cluster and partitioning, unlike rand()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*key: Column | str | int) -> Column:
    """Uniform integer in [0, 2**32) from the key's parts; strings are taken as they are, columns by value."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def draw_below(n: Column | int, *key: Column | str | int) -> Column:
    return F.pmod(draw(*key), F.lit(n) if isinstance(n, int) else n)
