"""URL filters: rules on host and path, and a Bloom filter cascade over the hosts of the corpus.

Level 1 of the cascade encodes the listed keys; level 2 the other keys of the corpus that level 1 lets through by mistake;
level 3 the listed keys that level 2 lets through; and so on until a level has no false positive over the complete
key universe. Then each key of the corpus is told apart exactly by the filters alone: pages are not joined with a list.

The keys are a url's host and its parent domains, as far as they have no more labels than some listed key: longer ones cannot be listed, and a host of very many labels costs no
more than others. Filters larger than ``max_bytes`` in all are not broadcast at once: keys are
cut into shards by hash, each with a cascade of its own, and pages pass one shard after the other.

A null url, or one without ``://``, has an empty host and path, fits no rule, is on no list, and is allowed. Repeated
rows stay repeated. An empty list blocks nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: What the filters of one shard may take on the driver and on each executor.
MAX_BYTES = 64 << 20
MAX_LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and the start of the path. Null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted((r for _, r in rules), key=lambda r: (len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def domains(host_: Column, most: int | None = None) -> Column:
    """The host and its parent domains, of ``most`` labels or fewer if given; none for an empty host."""
    parts = F.split(host_, r"\.")
    n = F.size(parts)
    first = F.lit(1) if most is None else F.greatest(F.lit(1), n - most + 1)
    up = F.transform(F.sequence(first, n), lambda k: F.array_join(F.slice(parts, k, n), "."))
    return F.when((host_ == "") if most != 0 else F.lit(True), F.array().cast("array<string>")).otherwise(up)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, keys: list[str], level: int) -> np.ndarray:
        places = _places(keys, level, self.bits, self.hashes)
        return ((self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def _places(keys: list[str], level: int, bits: int, hashes: int) -> np.ndarray:
    import xxhash

    both = np.array([divmod(xxhash.xxh3_128_intdigest(k.encode(), level), 1 << 64) for k in keys], np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        all_ = both[:, :1] + np.arange(hashes, dtype=np.uint64) * (both[:, 1:] | np.uint64(1))
    return (all_ % np.uint64(bits)).astype(np.int64)


def listed(keys: list[str], levels: list[Level]) -> np.ndarray:
    """Whether each key of the universe is listed: the first level that a key fails decides, odd ones for, even against."""
    out, at = np.zeros(len(keys), bool), np.arange(len(keys))
    for number, level in enumerate(levels):
        if not len(at):
            break
        through = level.has([keys[k] for k in at], number)
        out[at[~through]] = number % 2 == 1
        at = at[through]
    out[at] = len(levels) % 2 == 1
    return out


def _build(keys: DataFrame, count: int, others: int, level: int) -> Level:
    """One filter from a column ``key``: only its words travel to the driver."""
    rate = min(0.5, count / (math.sqrt(2) * max(others, 1))) if level == 0 else 0.5
    bits = max(64, math.ceil(count * 1.4427 * math.log2(1 / rate)))
    hashes = max(1, round(math.log2(1 / rate)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            places = _places(rows["key"].tolist(), level, bits, hashes).ravel()
            word, inverse = np.unique(places >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, inverse, np.uint64(1) << (places & 63).astype(np.uint64))
            yield pd.DataFrame({"word": word, "mask": mask.view(np.int64)})

    got = keys.select("key").mapInPandas(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def cascade(list_: DataFrame, universe: DataFrame) -> list[Level]:
    """Filters for the keys of ``list_`` that are in ``universe``; both have distinct strings in a column ``key``."""
    inside = checkpointed(universe.join(list_, "key", "left_semi"))
    outside = checkpointed(universe.join(list_, "key", "left_anti"))
    levels: list[Level] = []
    n_inside, n_outside = inside.count(), outside.count()
    while n_inside:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"false positives are left after {MAX_LEVELS} levels")
        number = len(levels)
        level = _build(inside, n_inside, n_outside, number)
        levels.append(level)
        sent = list_.sparkSession.sparkContext.broadcast(level)
        wrong = checkpointed(outside.mapInPandas(_through(sent, number), "key string"))
        inside, outside, n_outside = wrong, inside, n_inside
        n_inside = wrong.count()
    return levels


def shards(list_: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> list[list[Level]]:
    """A cascade for each shard of the keys, so few shards that the filters of each stay within ``max_bytes``.

    A listed key costs log2(other keys / listed keys) + 3 bits or so over all levels.
    """
    n, others = list_.count(), universe.count()
    wanted = n * (math.log2(max(2.0, others / max(n, 1))) + 4) * 1.5 / 8
    count = max(1, math.ceil(wanted / max_bytes))
    shard = F.pmod(F.xxhash64("key"), F.lit(count))
    return [cascade(list_.where(shard == k), universe.where(shard == k)) for k in range(count)]


def _any_listed(sent):
    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        flat = sorted({k for some in keys for k in some})
        found = dict(zip(flat, listed(flat, sent.value).tolist(), strict=True))
        return pd.Series([any(found[k] for k in some) for some in keys], dtype=bool)

    return run


def _through(sent, number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows[sent.value.has(rows["key"].tolist(), number)]

    return run


def judge(
    pages: DataFrame, list_: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null) and verdict of each row.

    verdict is the rule's; without a rule it is block if the host or a parent domain of it is listed, else allow.
    """
    list_ = list_.select(F.translate(F.col(f"`{list_.columns[0]}`"), _UPPER, _LOWER).alias("key")).where("key <> ''").distinct()
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    most = list_.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0
    universe = checkpointed(rows.select("host").distinct().select(F.explode(domains(F.col("host"), most)).alias("key")).distinct())
    cascades = shards(list_, universe, max_bytes)
    rows = rows.withColumn("hit", F.lit(False))
    for number, levels in enumerate(cascades):
        sent = pages.sparkSession.sparkContext.broadcast(levels)

        mine = F.filter(domains(F.col("host"), most), lambda k: F.pmod(F.xxhash64(k), F.lit(len(cascades))) == number)
        rows = rows.withColumn("hit", F.col("hit") | _any_listed(sent)(mine))
        if len(cascades) > 1:
            rows = checkpointed(rows)
            sent.unpersist()
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule)
    verdict = F.when(F.col("hit"), "block").otherwise("allow")
    for kind, text in rules:
        verdict = F.when(F.col("rule") == text, F.lit(kind)).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
