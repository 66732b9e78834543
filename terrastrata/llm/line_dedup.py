"""Line dedup by site-relative frequency, in DataFrame functions alone.

Pages are grouped by site: the host of a url, or the whole name where it is no url. For each site, the number of its pages that contain a line is
divided by the number of its pages; lines above ``ratio`` are boilerplate and dropped from every page of the site. Lines are what newlines separate,
compared whole and unchanged; a line without a word is never dropped. A page counts once for a line, however often the line stands in it.
Lines on fewer than ``min_pages`` pages of the site are kept: one page, or a page and its copy, is no boilerplate.

A null text has no lines and stays null; rows without a site are pages of one site of their own. Repeated rows are
pages of their own. A page whose lines are all dropped has an empty text.

Counts are summed by site and line before they are shuffled, so that a site with very many pages is no hot group. The
boilerplate of one site is at most (lines per page) / ratio lines, whatever the number of its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .text import packed

#: Boilerplate tables of at most so many lines (some 40 bytes each) are broadcast; larger ones are joined.
BROADCAST_LINES = 100_000


def _site(site: Column) -> Column:
    name = site.cast("string")
    host = F.lower(F.regexp_extract(name, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.concat(F.lit("="), F.when(F.contains(name, F.lit("://")), host).otherwise(name)), F.lit(""))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, ratio: float, min_pages: int = 3, site: str = "source", text: str = "text") -> DataFrame:
    """site__ (the site's key) and key__ (MD5 of the line) of each boilerplate line, with pages and site_pages."""
    pages = docs.select(_site(F.col(f"`{site}`")).alias("site__"), F.col(f"`{text}`").alias("text__"))
    totals = pages.groupBy("site__").agg(F.count("*").alias("site_pages"))
    lines = pages.select("site__", F.explode(F.array_distinct(F.filter(_lines(F.col("text__")), _has_word))).alias("line"))
    counts = lines.groupBy("site__", _key(F.col("line")).alias("key__")).agg(F.count("*").alias("pages"))
    counts = counts.where(F.col("pages") >= min_pages)
    return counts.join(totals, "site__").where(F.col("pages") > ratio * F.col("site_pages"))


def drop_boilerplate(
    docs: DataFrame, ratio: float = 0.08, min_pages: int = 3, site: str = "source", text: str = "text", dropped: str | None = None
) -> DataFrame:
    """All rows and columns, with boilerplate lines taken out of ``text``; ``dropped``: name of a column for their number."""
    found = boilerplate(docs, ratio, min_pages, site, text)
    found = checkpointed(found.groupBy("site__").agg(F.collect_list("key__").alias("keys__")))
    listed = found.agg(F.sum(F.size("keys__"))).first()[0] or 0
    if listed <= BROADCAST_LINES:
        found = F.broadcast(found)
    rows = packed(docs, text).withColumnRenamed(text, "text__").withColumn("site__", _site(F.col(f"row__.`{site}`")))
    rows = rows.join(found, "site__", "left").select("row__", "text__", "keys__")
    kept = F.filter(_lines(F.col("text__")), lambda line: ~(_has_word(line) & F.array_contains(F.col("keys__"), _key(line))))
    rows = rows.withColumn("kept__", F.when(F.col("keys__").isNull(), _lines(F.col("text__"))).otherwise(kept))
    out = [(F.array_join("kept__", "\n") if c == text else F.col(f"row__.`{c}`")).alias(c) for c in docs.columns]
    if dropped:
        out.append((F.size(_lines(F.col("text__"))) - F.size("kept__")).cast("long").alias(dropped))
    return rows.select(*out)
