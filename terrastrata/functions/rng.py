"""Seeded pseudo-random columns that depend on nothing but the seed and a key: any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def priority(seed: int, *key: Column) -> Column:
    """A string to sort by, in effect a shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def uniform(seed: int, *key: Column) -> Column:
    """A double in [0, 1)."""
    return F.conv(F.substring(priority(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
