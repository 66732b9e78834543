"""Quality rules: plain counts, and the hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into ``buckets``. Two multinomials over the buckets, one of the target
documents and one of all documents, are estimated with add-one smoothing from every document. A document's ratio is the
mean, over its n-grams, of the difference of the two log-probabilities; it is kept if the ratio reaches a threshold, so
that every document is decided alike in each run. All of it is DataFrame functions.

A blocked Bloom filter of the target's ids, of bounded size, is broadcast: rows that it stops cannot be in the target, and are counted without being
shuffled; the rest meet the ids in an exact join.

A null or empty text has no words: all counts are 0, its ratio is 0 and the base rules fail it. Repeated rows count as often as they
stand. Where the target is empty, all ratios rest on the smoothing alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words

BUCKETS = 1 << 13
#: Blocks of the filter of target ids, some 100 bytes each in a broadcast table.
MAX_BLOCKS = 1 << 18


def _grams(w: Column, buckets: int) -> Column:
    """Bucket of each word and of each pair of neighbours."""
    n = F.size(w)
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    left, right = F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0)))
    two = F.zip_with(left, right, lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text", target: Column | None = None) -> tuple[list[int], list[int]]:
    """Counts of each bucket over the rows for which ``target`` holds, and over all rows: ``buckets`` numbers, whatever the input."""
    flag = F.lit(False) if target is None else F.coalesce(target, F.lit(False))
    grams = docs.select(flag.alias("t"), F.explode(_grams(words(F.col(f"`{text}`")), buckets)).alias("bucket"))
    inside, all_ = [0] * buckets, [0] * buckets
    for bucket, n, some in grams.groupBy("bucket").agg(F.count("*"), F.count_if("t")).collect():
        all_[bucket], inside[bucket] = n, some
    return inside, all_


def _places(id_: Column, blocks: int) -> tuple[Column, Column]:
    """Block of an id in the filter, and its bits there as four numbers below 512."""
    h = F.xxhash64(id_)
    return F.pmod(h, F.lit(blocks)), F.array(*[F.pmod(F.shiftright(F.xxhash64(F.lit(1), id_), 9 * k), F.lit(512)).cast("int") for k in range(4)])


def possible(docs: DataFrame, ids: DataFrame, count: int, id_: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows with ``possible__``: whether their ``id_`` may be among ``ids`` (its first column); true of all that are and of a few others.

    The filter has blocks of 512 bits, one for 40 ids, and ``max_blocks`` at most; it is broadcast.
    """
    blocks = max(1, min(max_blocks, count // 40))
    block, bits = _places(F.col(ids.columns[0]), blocks)
    marks = ids.select(block.alias("block__"), F.explode(bits).alias("bit")).groupBy("block__", F.expr("bit div 64").cast("int").alias("word"))
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask")).groupBy("block__")
    filter_ = marks.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words__"))
    block, bits = _places(F.col(id_), blocks)
    rows = docs.withColumn("block__", block).join(F.broadcast(filter_), "block__", "left")
    hit = lambda b: F.coalesce(F.try_element_at("words__", F.floor(b / 64).cast("int")), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)) != 0
    return rows.select(*docs.columns, F.forall(bits, hit).alias("possible__"))


def log_ratios(target: list[int], raw: list[int]) -> list[float]:
    b, t, r = len(target), sum(target), sum(raw)
    return [math.log((x + 1) / (t + b)) - math.log((y + 1) / (r + b)) for x, y in zip(target, raw, strict=True)]


def _covered(sorted_windows: Column, size: int) -> Column:
    """Words covered by windows that stand twice or more: windows come sorted as (hash, place)."""
    n = F.size(sorted_windows)
    same = F.zip_with(
        F.slice(sorted_windows, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(sorted_windows, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])),
    )
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((p + size).alias("end"), (acc["total"] + F.least(F.lit(size), p + size - acc["end"])).alias("total"))

    return F.aggregate(places, start, step, lambda acc: acc["total"])


def judge(
    docs: DataFrame,
    ratios: list[float],
    threshold: float,
    min_words: int = 50,
    repeat_percent: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    n = F.size("w")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    third = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice("w", F.lit(k), third).alias(f"w{k}") for k in (1, 2, 3)])
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(windows, lambda x: F.xxhash64(x)).alias("h"),
        _grams(F.col("w"), len(ratios)).alias("g"),
    )
    again = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    rows = rows.withColumn("placed", placed)
    total = F.aggregate("g", F.lit(0.0), lambda a, b: a + F.get(table, b))
    rows = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("placed"), 3), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.size("g") > 0, total / F.size("g")).otherwise(0.0).alias("llr"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    return rows.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def quality_rules(docs: DataFrame, target_ids: DataFrame, threshold: float = -0.06, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """judge() over all rows; the target is the rows whose doc_id is in the first column of ``target_ids``."""
    ids = target_ids.select(F.col(f"`{target_ids.columns[0]}`").alias("target__")).where("target__ IS NOT NULL").distinct()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id__"), F.col(f"`{text}`").alias("text__"))
    marked = possible(rows, ids, ids.count(), "id__")
    _, outside = bucket_counts(marked.where("NOT possible__"), buckets, "text__")
    # the list grows with the corpus: it is not broadcast, and a hash join spares sorting the texts
    met = marked.where("possible__").join(ids.hint("shuffle_hash"), F.col("id__") == F.col("target__"), "left")
    inside, some = bucket_counts(met, buckets, "text__", F.col("target__").isNotNull())
    ratios = log_ratios(inside, [a + b for a, b in zip(outside, some, strict=True)])
    return judge(docs, ratios, threshold, doc_id=doc_id, text=text)
