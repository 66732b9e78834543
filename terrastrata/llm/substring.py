"""Substring dedup by level-wise doubling: only windows whose half is repeated are looked at in full length.

Level 1 looks at windows of half the length. Any run of ``half + 1`` neighbouring half windows lies in one full window,
so it is enough to look at the one with the smallest hash in each run: equal full windows choose the same one, and if
the full window is repeated, so is its chosen half. Halves found in one document alone end there. Level 2 extends the
surviving ones to the full length and keeps, for each window, the smallest doc_id in which it starts; longer levels
(``levels``) go on doubling until no candidate survives.

Windows are told apart by 96 bits of two polynomial hashes over the words' own 64-bit hashes.
A null text has no words. A null doc_id comes after all others. Repeated rows stay repeated: a row is never repeated
by a row of the same doc_id. Texts shorter than a window are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .text import byte_words, packed, remembering

#: Distinct words that a worker remembers before it starts afresh.
MEMORY = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LAST = (1 << 63) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_known = _Hashes()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, base, np.uint64)]), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windows(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """Mixed polynomial hash, modulo 2**64, of each run of ``size`` word hashes."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    base, bits = _BASES[which], max(12, len(words).bit_length())
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(base, bits)[: len(words)], dtype=np.uint64)])
        back = _powers(pow(base, -1, 1 << 64), bits)[: len(words) - size + 1]
        return _mixed((sums[size:] - sums[:-size]) * back)


def _smallest(half: np.ndarray, run: int) -> np.ndarray:
    """The smallest hash in each run of ``run`` half windows: one for each full window."""
    if len(half) < run:
        return np.empty(0, np.uint64)
    low, size = half, 1
    while size < run:
        step = min(size, run - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return low


def _halves(window: int):
    """For each text, the chosen half windows without repeats; copies of a text that a task has met already give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembering("substring", _known)
        met: set[int] = set()
        for rows in batches:
            tags, parts = [], []
            for tag, text in zip(rows["tag"].tolist(), rows["text"], strict=True):
                words = byte_words(text)
                if len(words) < window or tag in met:
                    continue
                if len(met) >= MEMORY:
                    met.clear()
                met.add(tag)
                got = np.unique(_smallest(_windows(_hashes(words), window // 2, 0), window - window // 2 + 1))
                tags.append(np.full(len(got), tag, np.int64))
                parts.append(got)
            if tags:
                yield pd.DataFrame({"tag": np.concatenate(tags), "half": np.concatenate(parts).view(np.int64)})

    return run


def _keys(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that tell windows apart."""
    with np.errstate(over="ignore"):
        second = _mixed(words * np.uint64(_BASES[0])) >> np.uint64(1)
    low = (_windows(second, window, 1) >> np.uint64(32)).astype(np.uint32)
    return _windows(words, window, 0).view(np.int64), low.view(np.int32)


def _extended(window: int):
    """The distinct windows of full length of each text whose chosen half is repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembering("substring", _known)
        for rows in batches:
            out = []
            for doc, tag, tag2, text, halves in zip(*(rows[c] for c in ("doc", "tag", "tag2", "text", "halves")), strict=True):
                words = _hashes(byte_words(text))
                met = np.isin(_smallest(_windows(words, window // 2, 0), window - window // 2 + 1), np.asarray(halves, np.int64).view(np.uint64))
                h1, h2 = _keys(words, window)
                h1, first = np.unique(h1[met], return_index=True)
                out.append(pd.DataFrame({"doc": doc, "tag": tag, "tag2": tag2, "h1": h1, "h2": h2[met][first]}))
                if sum(map(len, out)) > 1 << 18:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

    return run


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, text and 128 bits that stand for the text: tag and tag2."""
    docs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return docs.withColumns({"tag": F.xxhash64("text"), "tag2": F.xxhash64(F.lit(1), "text")})


def _repeated(texts: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """Windows found in two different texts or more, of the first document of each text: doc, tag, tag2, h1, h2, first."""
    if window < 2:
        raise ValueError("a window has two words or more")
    halves = checkpointed(texts.select("tag", "text").mapInPandas(_halves(window), "tag long, half long"))
    met = halves.groupBy("half").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low <> high").select("half")
    # the keys of the smaller sides are computed anew, so that each join has an exchange of its own on either side, which adaptive
    # execution can split at a window that very many texts share, or at a text with very many copies
    met = met.select(F.col("half").bitwiseXOR(0).alias("met"))
    listed = checkpointed(halves.join(met, F.col("half") == F.col("met")).groupBy("tag").agg(F.collect_set("half").alias("halves")))
    listed = listed.join(firsts, "tag").select(F.col("tag").bitwiseXOR(0).alias("t"), F.col("tag2").bitwiseXOR(0).alias("t2"), "first", "halves")
    # first is the smallest doc of the text, so <= keeps the rows of that doc
    wide = texts.join(listed, (F.col("tag") == F.col("t")) & (F.col("tag2") == F.col("t2")) & (F.col("doc") <= F.col("first")))
    wide = wide.select("doc", "tag", "tag2", "text", "halves")
    found = wide.mapInPandas(_extended(window), "doc long, tag long, tag2 long, h1 long, h2 int")
    first = found.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    first = first.select(F.col("h1").bitwiseXOR(0).alias("k1"), F.col("h2").bitwiseXOR(0).alias("k2"), "first")
    return found.join(first, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).drop("k1", "k2")


def _firsts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("tag", "tag2").agg(F.min("doc").alias("first"))


def repeated_windows(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows that start in two documents of different texts: doc, tag, tag2, h1, h2, and first, the smallest doc_id with it.

    Exact copies of a text are listed once, as the smallest of their doc_ids, and a window once for a text; tag and tag2 stand for
    the text, h1 and h2 for the window. doc_id: whole numbers, null as the largest long.
    """
    texts = _texts(docs, doc_id, text)
    return _repeated(texts, _firsts(texts), window)


def levels(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> dict[int, DataFrame]:
    """Repeated windows of window, 2 * window, 4 * window, ... words, until no candidate survives."""
    out: dict[int, DataFrame] = {}
    while True:
        level = checkpointed(repeated_windows(docs, window, doc_id, text))
        if level.isEmpty():
            return out
        out[window] = level
        # a text without a repeated window of this length has none of twice the length
        docs = packed(docs, doc_id, text).withColumn("tag", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
        docs = docs.join(level.select("tag").distinct(), "tag", "left_semi").select("row__.*")
        window *= 2


def _covered(words: list[bytes], keys: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a window with one of the keys."""
    at = np.flatnonzero(np.isin(_keys(_hashes(words), window)[0], keys))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _kept(window: int):
    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def run(texts: pd.Series, copies: pd.Series, keys: pd.Series) -> pd.DataFrame:
        remembering("substring", _known)
        out = []
        for text, copy, gone in zip(texts, copies, keys, strict=True):
            words = byte_words(text)
            left = words
            if copy and len(words) >= window:
                left = []
            elif not copy and gone is not None and len(gone):
                left = [w for w, g in zip(words, _covered(words, np.asarray(gone, np.int64), window).tolist(), strict=True) if not g]
            out.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    return run


def without_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space) of each row.

    Removed is each word that a window covers whose words also start in a document with a smaller doc_id; windows are
    judged on the input. A text that is an exact copy of one with a smaller doc_id and has a window loses all its words.
    """
    texts = _texts(docs, doc_id, text)
    firsts = _firsts(texts)
    covered = _repeated(texts, firsts, window).where("first < doc").groupBy("tag", "tag2").agg(F.collect_set("h1").alias("gone"))
    # the keys are computed anew so that the join below gets an exchange on either side, which adaptive execution can split
    # where one text has very many copies
    judged = firsts.join(covered, ["tag", "tag2"], "left").select(F.col("tag").bitwiseXOR(0).alias("t"), F.col("tag2").bitwiseXOR(0).alias("t2"), "first", "gone")
    rows = texts.join(judged, (F.col("tag") == F.col("t")) & (F.col("tag2") == F.col("t2")))
    got = _kept(window)(F.col("text"), F.col("doc") > F.col("first"), F.col("gone"))
    return rows.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), got.alias("got")).select("doc_id", "got.*")
