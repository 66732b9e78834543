import random
from collections import Counter

import pytest

from terrastrata.llm import line_dedup

from .cases import TEXTS, brute_words, documents, no_documents, odd_documents


def brute(rows, ratio, least):
    pages, lines = Counter(), Counter()
    for _, text, site in rows:
        pages[site] += 1
        lines.update((site, x) for x in set((text or "").split("\n")) if text is not None and brute_words(x))
    out = []
    for doc, text, site in rows:
        if text is None:
            out.append((doc, None))
            continue
        out.append((doc, "\n".join(x for x in text.split("\n") if not (brute_words(x) and lines[site, x] >= least and lines[site, x] > ratio * pages[site]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("listed", [0, 10**6])
def test_matches_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", listed)
    r = random.Random(3)
    rows = []
    for k in range(200):
        site = "hot" if k % 3 else r.choice(["a", "b", None, ""])
        rows.append((k, "\n".join(r.choice(["Menu", "menu", "Foot er", "", "  ", f"line {r.randint(0, 500)}", "rare"]) for _ in range(r.randint(0, 12))), site))
    docs = documents(spark, rows)
    for ratio, least in ((0.3, 5), (0.05, 2), (0.6, 1)):
        got = line_dedup.drop_boilerplate(docs, ratio, least)
        assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == brute(rows, ratio, least)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = line_dedup.drop_boilerplate(docs, 0.1, 2, dropped="n_dropped")
    assert got.columns == [*docs.columns, "n_dropped"]
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == brute([(row[0], row[1], row[3]) for row in TEXTS], 0.1, 2)


def test_empty_table(spark):
    assert line_dedup.drop_boilerplate(no_documents(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = line_dedup.drop_boilerplate(documents(spark, [(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_pages_are_grouped_by_host(spark):
    urls = ["http://A.example/x", "https://a.example/y?q=http://b.example", "https://a.example", "http://b.example#a.example", "ftp://b.example/1", "http://b.example:80/"]
    rows = [(k, f"shared\nown {k}" if k != 4 else "own 4", u) for k, u in enumerate(urls * 3)]
    hosts = ["a.example"] * 3 + ["b.example"] * 2 + ["b.example:80"]
    docs = documents(spark, rows)
    got = sorted(((x["doc_id"], x["text"]) for x in line_dedup.drop_boilerplate(docs, 0.4, 3).collect()), key=str)
    assert got == brute([(d, t, hosts[d % 6]) for d, t, _ in rows], 0.4, 3)
    assert {d for d, t in got if "shared" not in t} == {d for d, *_ in rows}


def test_small_hosts_lose_boilerplate_and_not_a_copy(spark):
    rows = [(k, f"footer\npage {k}", "small") for k in range(10)] + [(10 + k, "copied\ntwice", "small") for k in range(2)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.drop_boilerplate(documents(spark, rows)).collect()}
    assert got == {k: f"page {k}" for k in range(10)} | {10: "copied\ntwice", 11: "copied\ntwice"}
