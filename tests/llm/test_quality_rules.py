import math
import random
from collections import Counter

import xxhash
from pyspark.sql import types as T

from terrastrata.llm import quality_rules

from .cases import TEXTS, brute_words, documents, no_documents, odd_documents


def grams(w, buckets):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    two = [xxhash.xxh64_intdigest(y.encode(), h) for h, y in zip(one, w[1:])]
    return [signed(h) % buckets for h in one + two]


def brute(rows, trusted, threshold, buckets):
    raw, target = Counter(), Counter()
    for doc, text in rows:
        g = grams(brute_words(text), buckets)
        raw.update(g)
        if doc in trusted:
            target.update(g)
    ratio = {b: math.log((target[b] + 1) / (target.total() + buckets)) - math.log((raw[b] + 1) / (raw.total() + buckets)) for b in range(buckets)}
    out = []
    for doc, text in rows:
        w = brute_words(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(windows)
        covered = {p for k, x in enumerate(windows) if many[x] > 1 for p in range(k, k + 3)}
        lines = [x for x in (text or "").split("\n") if brute_words(x)]
        g = grams(w, buckets)
        llr = sum(ratio[b] for b in g) / len(g) if g else 0.0
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= threshold, round(llr, 9)))
    return sorted(out, key=str)


def run(docs, spark, trusted, threshold, buckets):
    ids = spark.createDataFrame([(t,) for t in trusted], T.StructType([T.StructField("doc_id", T.LongType())]))
    got = quality_rules.quality_rules(docs, ids, threshold, buckets).collect()
    return sorted(((*r[:8], round(r[8], 9)) for r in got), key=str)


def test_matches_brute_force(spark):
    r = random.Random(1)
    rows = []
    for k in range(60):
        words = [r.choice(["the", "of", "and", "é", "it##", "a|b", f"w{r.randint(0, 30)}"]) + r.choice(["", "", "\n"]) for _ in range(r.randint(0, 150))]
        rows.append((k, r.choice([" ", "  ", "\t"]).join(words)))
    rows += [(60, "spam eggs ham " * 40), (61, "x y " * 30 + " ".join(f"u{k}" for k in range(100))), (60, "spam eggs ham " * 40)]
    trusted = list(range(0, 60, 2)) + [2, 2, None, 777]
    assert run(documents(spark, rows), spark, trusted, -0.02, 64) == brute(rows, set(trusted) - {None}, -0.02, 64)


def test_odd_rows(spark):
    rows = [(row[0], row[1]) for row in TEXTS]
    assert run(odd_documents(spark), spark, [1, None], -0.05, 256) == brute(rows, {1}, -0.05, 256)


def test_empty_tables(spark):
    assert run(no_documents(spark), spark, [1], 0, 32) == []
    assert len(run(odd_documents(spark), spark, [], 0, 32)) == len(TEXTS)


def test_no_python_in_the_plan(spark):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    for df in (quality_rules.quality_rules(documents(spark, [(1, "a b")]), ids), quality_rules.possible(documents(spark, [(1, "a b")]), ids, 1, "doc_id")):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_filter_of_ids_loses_none_and_stops_most(spark):
    ids = spark.range(0, 30_000, 3).select("id")
    for most, allowed in ((1 << 18, 0.02), (40, 0.95), (1, 1.0)):
        got = quality_rules.possible(spark.range(30_000), ids, 10_000, "id", most)
        kept = {r["id"] for r in got.where("possible__").collect()}
        assert kept >= set(range(0, 30_000, 3)) and got.columns == ["id", "possible__"] and got.count() == 30_000
        assert len(kept) - 10_000 <= allowed * 20_000


def test_only_possible_rows_are_shuffled(spark, monkeypatch):
    """The filter stands before the exchange of the texts."""
    seen = []
    counts = quality_rules.bucket_counts
    monkeypatch.setattr(quality_rules, "bucket_counts", lambda docs, *a: seen.append(docs._jdf.queryExecution().executedPlan().toString()) or counts(docs, *a))
    quality_rules.quality_rules(documents(spark, [(k, f"a b {k}") for k in range(40)]), spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert len(seen) == 2 and "Exchange hashpartitioning(id__" not in seen[0]
    below = seen[1][seen[1].index("Exchange hashpartitioning(id__") :]
    assert "Filter forall" in below and "BroadcastHashJoin" in below
