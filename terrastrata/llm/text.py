"""Words and keys that several operators share.

A word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes: bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside the whole row as one struct ``row__``, so that no other column name can clash."""
    return df.select(F.struct("*").alias("row__"), *[F.col(f"`{c}`").alias(c) for c in columns])


_memories: dict[str, tuple[dict, ...]] = {}


def remembering(operator: str, *caches: dict) -> None:
    """Called by an operator in a Python worker before it uses its caches: empties those of all others.

    A worker serves one stage after the other, and what they all remember would add up. What is freed goes back to the system.
    """
    first = operator not in _memories
    _memories[operator] = caches
    emptied = False
    for other, kept in _memories.items():
        if other != operator:
            emptied |= any(kept)
            for cache in kept:
                cache.clear()
    if emptied or first:
        _release()


def _release() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
