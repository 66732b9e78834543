import random

import pytest

from terrastrata.llm import decontaminate

from .cases import TEXTS, documents, no_documents, odd_documents


def words(r, n):
    return [r.choice(["the", "of", "and"]) if r.random() < 0.3 else f"w{r.randint(0, 400)}" for _ in range(n)]


def items(seed=1, count=30):
    r = random.Random(seed)
    return [(k, " ".join(words(r, r.randint(8, 30))) + ". " + " ".join(words(r, r.randint(3, 10))).capitalize() + ".") for k in range(count)]


def planted(benchmark, seed=2):
    r = random.Random(seed)
    rows, truth = [], set()
    for k in range(80):
        w = words(r, r.randint(0, 300))
        if k % 3 == 0:
            item, text = r.choice(benchmark)
            at = r.randint(0, len(w))
            w[at:at] = text.upper().split() if k % 2 else text.split()
            truth.add((k, item))
        rows.append((k, " ".join(w)))
    return rows, truth


def frame(spark, benchmark):
    return spark.createDataFrame([(*i, "x") for i in benchmark], "item_id long, text string, score string")


def test_every_planted_item_and_nothing_else(spark):
    benchmark = items()
    rows, truth = planted(benchmark)
    got = decontaminate.matches(documents(spark, rows), frame(spark, benchmark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth and len(got) == len(truth)
    kept = decontaminate.without_matches(documents(spark, rows), frame(spark, benchmark)).collect()
    assert {r["doc_id"] for r in kept} == {k for k, _ in rows} - {d for d, _ in truth}


def partly(benchmark, seed=6):
    """Documents that hold a random part of the words of an item."""
    r = random.Random(seed)
    rows = []
    for k in range(120):
        w = r.choice(benchmark)[1].split()
        w = w[: r.randint(len(w) // 3, len(w))]
        rows.append((k, " ".join(words(r, r.randint(0, 90)) + w + words(r, r.randint(0, 90)))))
    return rows


@pytest.mark.parametrize("most", [30, 100, 10**6])
def test_scores_do_not_depend_on_the_parts(spark, most):
    benchmark = items()
    rows = planted(benchmark)[0] + [(1000 + k, t) for k, t in partly(benchmark)]
    found = lambda n: {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.matches(documents(spark, rows), frame(spark, benchmark), 0.4, 0.1, max_index_words=n).collect()}
    got = found(most)
    assert got == found(2_000_000) and len(got) > 40


def full_scores(index, passage):
    weight = {}
    for t in passage:
        for at in range(index.starts[t], index.starts[t + 1]):
            weight[index.items[at]] = weight.get(index.items[at], 0) + index.impacts[at]
    return weight


@pytest.mark.parametrize("block", [1, 4, 50])
def test_search_finds_all_scores_from_the_threshold(block):
    benchmark = items(3, 120)
    index = decontaminate.Index(benchmark, block=block)
    r = random.Random(5)
    texts = [" ".join(words(r, 60)) for _ in range(40)] + [t for _, t in partly(benchmark)]
    for threshold in (0.1, 0.25, 0.4, 0.6):
        for text in texts:
            passage = sorted({index.vocabulary[w] for w in decontaminate.terms(text) if w in index.vocabulary})
            got = dict(index.search(passage, threshold))
            want = {i: s for i, s in full_scores(index, passage).items() if s >= threshold}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_most_postings_are_never_read():
    r = random.Random(9)
    draw = lambda n: [f"w{r.randint(0, 40) if r.random() < 0.4 else r.randint(0, 9000)}" for _ in range(n)]  # noqa: E731  some words are in many items, most in few
    benchmark = [(k, " ".join(draw(r.randint(20, 60)))) for k in range(300)]
    index, total = decontaminate.Index(benchmark), 0
    for k in range(200):
        text = " ".join(draw(100) + (r.choice(benchmark)[1].split() if k % 20 == 0 else []) + draw(100))
        assert list(index.matches(text, 0.6)) or k % 20
        w = decontaminate.terms(text)
        for n in range(max(1, -(-(len(w) - index.longest) // index.longest))):
            passage = {index.vocabulary[x] for x in w[n * index.longest : (n + 2) * index.longest] if x in index.vocabulary}
            total += sum(index.starts[t + 1] - index.starts[t] for t in passage)
    assert index.read < 0.15 * total, (index.read, total)


@pytest.mark.parametrize("threshold", [0.2, 0.6, 1.0])
def test_matches_are_those_of_full_scoring(threshold):
    """Through the bound on rare terms, too: over all passages of texts that hold parts of items, none at or above the threshold is lost."""
    benchmark = items(4, 60)
    index = decontaminate.Index(benchmark)
    some = 0
    for _, text in planted(benchmark)[0] + partly(benchmark):
        w = decontaminate.terms(text)
        best = {}
        for k in range(max(1, -(-(len(w) - index.longest) // index.longest))):
            passage = {index.vocabulary[x] for x in w[k * index.longest : (k + 2) * index.longest] if x in index.vocabulary}
            for i, s in full_scores(index, passage).items():
                best[i] = max(s, best.get(i, 0))
        want = {i: round(s, 9) for i, s in best.items() if s >= threshold - 1e-9}
        assert {i: round(s, 9) for i, s, *_ in index.matches(text, threshold)} == want
        some += len(want)
    assert some > 20


def test_changed_answer_is_no_match(spark):
    benchmark = [(1, "what is the capital of the old northern kingdom of frost. the city of ice and rain.")]
    rows = [(1, "x " + benchmark[0][1] + " y"), (2, "what is the capital of the old northern kingdom of frost. nobody knows what it could be.")]
    got = decontaminate.matches(documents(spark, rows), frame(spark, benchmark)).collect()
    assert [r["doc_id"] for r in got] == [1]


def test_odd_rows_and_items(spark):
    benchmark = [(1, None), (2, ""), (3, "..."), (None, "the quick brown fox jumps over the lazy dog"), (4, "one"), (4, "one")]
    docs = odd_documents(spark)
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, frame(spark, benchmark)).collect()), key=str)
    assert got == sorted([(1, None), (2, None), (2, None), (None, None), (6, 4), (6, 4)], key=str)
    kept = decontaminate.without_matches(docs, frame(spark, benchmark))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 5


def test_empty_tables(spark):
    benchmark = frame(spark, items())
    assert decontaminate.matches(no_documents(spark), benchmark).collect() == []
    assert decontaminate.matches(odd_documents(spark), benchmark.limit(0)).collect() == []
    assert decontaminate.without_matches(odd_documents(spark), benchmark.limit(0)).count() == len(TEXTS)
