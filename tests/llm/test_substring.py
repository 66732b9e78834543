import random

from terrastrata.llm import substring

from .cases import TEXTS, brute_words, documents, no_documents, odd_documents


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = brute_words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if doc is None else doc)
    out = []
    for doc, text in rows:
        w = brute_words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (float("inf") if doc is None else doc):
                gone.update(range(k, k + window))
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def made(seed, count, window):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 40)}"
    passages = [[word() for _ in range(r.randint(window - 2, 3 * window))] for _ in range(5)]
    rows = []
    for k in range(count):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(passages) if r.random() < 0.6 else [word() for _ in range(r.randint(1, 2 * window))]
        rows.append((r.randint(0, 3 * count), " ".join(w)))
    return rows + rows[:3] + [(r.randint(0, 99), rows[4][1]), (None, rows[5][1]), (999, "ab " * (3 * window)), (998, "ab " * (2 * window))]


def test_matches_brute_force(spark):
    for seed, window in ((1, 10), (2, 7), (3, 2), (4, 50)):
        rows = made(seed, 40, window)
        got = substring.without_repeats(documents(spark, rows), window).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, window), window


def test_odd_rows(spark):
    got = substring.without_repeats(odd_documents(spark), 10).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r[0], r[1]) for r in TEXTS], 10)


def test_empty_table(spark):
    assert substring.without_repeats(no_documents(spark)).collect() == []


def test_levels_double_until_nothing_is_left(spark):
    shared = [f"s{k}" for k in range(45)]
    rows = [(1, " ".join(["a"] + shared)), (2, " ".join(["b"] + shared)), (3, "c d e")]
    found = substring.levels(documents(spark, rows), 10)
    assert {n: df.count() for n, df in found.items()} == {10: 72, 20: 52, 40: 12}


def test_joins_can_be_split(spark):
    """The joins of texts and of windows have an exchange of their own on either side, so that adaptive execution can split a hot key."""
    import re

    rows = [(k, " ".join(f"w{k % 7}x{j}" for j in range(60))) for k in range(40)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = substring.without_repeats(documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = re.findall(r"SortMergeJoin \[(\w+)#\d+L?, \w+#\d+L?\], \[(t|k1)#\d+L?", plan)
    assert set(joins) == {("h1", "k1"), ("tag", "t")}
    for key in ("tag", "t", "h1", "k1"):
        assert re.search(rf"Exchange hashpartitioning\({key}#", plan)


def test_copies_in_one_task_are_judged_alike(spark):
    text = " ".join(f"w{j}" for j in range(80))
    rows = [(k, text) for k in range(30)] + [(100, "x " + text), (101, " ".join(f"v{j}" for j in range(70)))]
    for parts in (1, 5):
        got = {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(documents(spark, rows).repartition(parts)).collect()}
        assert got == {0: 0, 100: 80, 101: 0} | {k: 80 for k in range(1, 30)}
