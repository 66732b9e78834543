import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrastrata.llm import components, shingle_sets, simhash
from terrastrata.llm.components import connected_components

from .cases import TEXTS, brute_words, documents, no_documents, odd_documents


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = brute_words(lower)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    ids = [min((rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None), default=None) for i in range(len(rows))]
    return sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, ids)), key=str)


def near_copies(n, words, changes, seed):
    r = np.random.default_rng(seed)
    base = [f"w{k}" for k in r.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(r.integers(0, changes + 1))):
            w[int(r.integers(words))] = f"w{int(r.integers(5000))}"
        out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    texts = near_copies(40, 300, 3, 1) + near_copies(25, 300, 3, 2) + near_copies(20, 60, 5, 3) + ["A b C", "a B c", "", None, "solo"]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


@pytest.mark.parametrize("part_size", [3, 10])
def test_hot_tries_are_split_without_losing_links(spark, part_size):
    rows = [(k, t) for k, t in enumerate(near_copies(60, 400, 2, 5))]
    got = simhash.near_duplicates(documents(spark, rows), part_size=part_size).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd_documents(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components([(r[0], r[1]) for r in TEXTS])


def test_empty_table(spark):
    assert simhash.near_duplicates(no_documents(spark)).collect() == []
    assert simhash.first_of_group(no_documents(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = simhash.first_of_group(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and ids.count(4) == 1 and 7 in ids and 3 in ids


def test_repeated_rows_and_null_ids_leave_one_or_none(spark):
    text = near_copies(1, 200, 0, 9)[0]
    kept = simhash.first_of_group(documents(spark, [(5, text), (9, text), (None, text)]))
    assert [r["doc_id"] for r in kept.collect()] == [5]


def test_trie_join_against_all_pairs():
    r = np.random.default_rng(0)
    for trial in range(4):
        base = r.integers(0, 1 << 63, 150, dtype=np.uint64)
        flips = [base ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)) for _ in range(3)]
        values = np.unique(np.concatenate([base, *flips]))
        roots = simhash.trie_join(values, np.array([0, len(values)]), 0, 4)
        want = list(range(len(values)))
        for _ in range(5):
            for i in range(len(values)):
                near = [want[j] for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 4)]
                for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 4):
                    want[j] = min(near)
        assert roots.tolist() == want, trial


def test_long_chains_become_one_component(spark):
    edges = spark.range(0, 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(edges)
    assert got.count() == 401 and got.select("root").distinct().count() == 1
    assert connected_components(edges.limit(0)).count() == 0


def test_rows_not_ids_decide_who_stays(spark):
    a, b, c = near_copies(1, 200, 0, 9)[0], near_copies(1, 200, 0, 10)[0], near_copies(1, 200, 0, 11)[0]

    def kept(*rows):
        return sorted(((r["doc_id"], r["text"]) for r in simhash.first_of_group(documents(spark, rows)).collect()), key=str)

    assert kept((5, a), (None, a), (None, b), (None, " ")) == sorted([(5, a), (None, b), (None, " ")], key=str)
    assert kept((3, a), (7, a), (7, c)) == [(3, a), (7, c)]
    assert kept((5, a), (5, a), (None, b), (None, b), (None, b)) == sorted([(5, a), (None, b)], key=str)


def brute_sets(text):
    w = brute_words(text.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


@pytest.mark.parametrize("part_size", [256, 7])
def test_first_of_group_against_all_pairs_by_jaccard(spark, part_size):
    texts = [t for seed in range(6) for t in near_copies(12, 120, 5, 20 + seed)] + near_copies(40, 150, 3, 40) + ["A b C", "a B c", "solo"]
    base = near_copies(1, 300, 0, 50)[0].split()
    texts += [" ".join(base[k * 20 : k * 20 + 200]) for k in range(6)]  # a chain, the ends of which share little
    sets = [brute_sets(t) for t in texts]
    group, far = list(range(len(texts))), 0
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in near:
        far += (simhash.fingerprint_of(texts[i]) ^ simhash.fingerprint_of(texts[j])).bit_count() > 4
        low, high = sorted((group[i], group[j]))
        group = [low if g == high else g for g in group]
    assert far > 100 and len(set(group)) > 10
    got = simhash.first_of_group(documents(spark, list(enumerate(texts))).repartition(5), part_size=part_size).select("doc_id").collect()
    assert sorted(r[0] for r in got) == sorted(set(group))


@pytest.mark.parametrize("agreeing", [1, 2, 3])
def test_layouts_of_more_blocks_lose_no_link(spark, monkeypatch, agreeing):
    monkeypatch.setattr(simhash._Layout, "for_count", staticmethod(lambda count, budget, part_size: simhash._Layout.of(budget, agreeing)))
    rows = [(k, t) for k, t in enumerate(near_copies(40, 400, 2, 5) + near_copies(30, 60, 4, 6))]
    got = simhash.near_duplicates(documents(spark, rows), part_size=12).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_tries_stay_small_whatever_the_corpus():
    for count in (1, 10**6, 10**8, 10**10, 10**12):
        layout = simhash._Layout.for_count(count, 4, simhash.PART_SIZE)
        assert count >> layout.depth <= simhash.PART_SIZE // 4
        assert sum(w for _, w in layout.blocks) == 64 and len(layout.choices) <= 126
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 64, 500, dtype=np.uint64)
    for agreeing in (1, 2, 3):
        layout = simhash._Layout.of(4, agreeing)
        turn = r.integers(0, len(layout.choices), 500)
        dealt = layout.dealt(fp, turn)
        assert (np.bitwise_count(dealt) == np.bitwise_count(fp)).all()
        # any two within four bits of each other share a trie
        for x in fp[:50].tolist():
            y = x
            for b in r.choice(64, 4, replace=False).tolist():
                y ^= 1 << b
            agree = [all((x ^ y) >> s & ((1 << w) - 1) == 0 for s, w in (layout.blocks[k] for k in some)) for some in layout.choices]
            assert any(agree)


@pytest.mark.parametrize("small", [0, 30, 1 << 16])
def test_components_of_random_graphs(spark, monkeypatch, small):
    """By contraction to the end, by contraction and a last task, and by one task: the same sets of nodes."""
    monkeypatch.setattr(components, "SMALL", small)
    r = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in r.integers(-60, 60, (70, 2))] + [(5, 5), (500, 501), (501, 500), (1 << 62, -(1 << 62))]
    group = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in group:
        for a, b in pairs:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = connected_components(spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long")).collect()
    sets = lambda items: sorted(sorted(n for n, g in items if g == root) for root in {g for _, g in items})
    assert sets([(x["node"], x["root"]) for x in got]) == sets(list(group.items()))


def brute_long_fingerprint(hashes):
    """512 bits of the majority of each shingle's hashes, in a tie the bit of the smallest."""
    out = []
    for flip in shingle_sets._FLIPS:
        mixed = [int(x) for x in shingle_sets._mixed(hashes ^ flip)]
        for b in range(64):
            ones = sum(m >> b & 1 for m in mixed)
            out.append(2 * ones > len(mixed) or (2 * ones == len(mixed) and mixed[0] >> b & 1 == 1))
    return np.array(out, bool)


@pytest.mark.parametrize("count", [1, 2, 4, 9, 256, 300])
def test_long_fingerprints_are_majorities(count):
    hashes = np.unique(np.random.default_rng(count).integers(0, 1 << 64, count, dtype=np.uint64))
    words = shingle_sets.fingerprint_words(hashes)
    got = np.array([int(w) >> b & 1 for w in words for b in range(64)], bool)
    assert (got == brute_long_fingerprint(hashes)).all()


def stored_sets(spark, texts):
    words = [shingle_sets.fingerprint_words(shingle_sets.shingle_set(t, 5)).view(np.int64).tolist() for t in texts]
    return [w[0] for w in words], spark.createDataFrame([(w[0], w[1:]) for w in words], "print long, words array<long>")


@pytest.mark.parametrize("part_size", [simhash.PART_SIZE, 20])
def test_simhash_tries_give_the_candidates_of_jaccard(spark, monkeypatch, part_size):
    """All pairs of a similarity of 0.8 or more are connected by tries of SimHash fingerprints, and no texts without a shared shingle are."""
    monkeypatch.setattr(simhash, "MEAN_TRIE", 16)
    texts = [t for seed in range(8) for t in near_copies(15, 120, 5, 60 + seed)]
    sets = [brute_sets(t) for t in texts]
    prints, table = stored_sets(spark, texts)
    edges = simhash.linked_sets(table.repartition(3), part_size=part_size).collect()
    group = {p: p for p in prints}
    for a, b in edges:
        group = {p: group[b] if g == group[a] else g for p, g in group.items()}
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in near)
    assert simhash._Wide.of(len(texts), 0.8).agreeing == 3 and len(near) > 100 and far > 100
    assert all(group[prints[i]] == group[prints[j]] for i, j in near)
    of = dict(zip(prints, sets, strict=True))
    assert all(of[a] & of[b] for a, b in edges)


def test_first_of_group_has_no_candidates_but_those_of_the_tries(spark, monkeypatch):
    texts = near_copies(6, 200, 1, 70)
    docs = documents(spark, [*enumerate(texts), (9, texts[0])])
    assert [r["doc_id"] for r in simhash.first_of_group(docs).collect()] == [0]
    monkeypatch.setattr(simhash, "linked_sets", lambda *a, **k: spark.createDataFrame([], "a long, b long"))
    first = {}
    for k, t in [*enumerate(texts), (9, texts[0])]:
        first.setdefault(shingle_sets.fingerprint_words(shingle_sets.shingle_set(t, 5))[0], k)
    # left to themselves, only equal prints are compared
    assert sorted(r["doc_id"] for r in simhash.first_of_group(docs).collect()) == sorted(first.values())


def test_trie_join_counts_further_bits_and_splits_large_leaves(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 64)
    r = np.random.default_rng(3)
    values = np.sort(np.repeat(r.integers(0, 1 << 64, 12, dtype=np.uint64), 25))
    more = np.repeat(r.integers(0, 1 << 64, 100, dtype=np.uint64), 3) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    roots = simhash.trie_join(values, np.array([0, 300]), 0, 2, more)
    want = list(range(300))
    for i in range(300):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() + (int(more[i]) ^ int(more[j])).bit_count() <= 2:
                low, high = sorted((want[i], want[j]))
                want = [low if g == high else g for g in want]
    assert roots.tolist() == want and len(set(want)) < 250


def test_unrelated_sets_are_hardly_ever_candidates(spark):
    """One of ten had an unrelated candidate, and these joined groups of copies to groups that grew faster than the corpus."""
    words = np.random.default_rng(9).integers(-(1 << 63), (1 << 63) - 1, (20000, shingle_sets.WORDS))
    table = spark.createDataFrame([(int(w[0]), w[1:].tolist()) for w in words], "print long, words array<long>")
    assert simhash.linked_sets(table.repartition(4)).count() <= 60


@pytest.mark.parametrize("few", [1, 200, 1 << 18])
def test_trie_join_compares_nodes_as_a_whole(monkeypatch, few):
    monkeypatch.setattr(simhash, "DENSE", min(few, 1000))
    r = np.random.default_rng(12)
    base = r.integers(0, 1 << 64, (40, 3), dtype=np.uint64)
    rows = np.repeat(base, 6, axis=0) ^ (r.integers(0, 1 << 64, (240, 3), dtype=np.uint64) & r.integers(0, 1 << 64, (240, 3), dtype=np.uint64) & r.integers(0, 1 << 64, (240, 3), dtype=np.uint64))
    rows = rows[np.argsort(rows[:, 0])]
    bounds = np.array([0, 100, 240])
    roots = simhash.trie_join(np.ascontiguousarray(rows[:, 0]), bounds, 0, 40, rows[:, 1:], few)
    want = list(range(240))
    for i in range(240):
        for j in range(i):
            if (i < 100) == (j < 100) and np.bitwise_count(rows[i] ^ rows[j]).sum() <= 40:
                low, high = sorted((want[i], want[j]))
                want = [low if g == high else g for g in want]
    assert roots.tolist() == want and 20 < len(set(want)) < 220


def test_common_elements_and_components_of_many_sets(monkeypatch):
    monkeypatch.setattr(shingle_sets, "BITS_AT_ONCE", 64)
    sets = [shingle_sets.shingle_set(t, 5) for seed in range(4) for t in near_copies(12, 150, 6, 90 + seed)] + [shingle_sets.shingle_set("a b", 5)]
    both = shingle_sets.common(sets)
    as_sets = [set(s.tolist()) for s in sets]
    assert both.tolist() == [[len(a & b) for b in as_sets] for a in as_sets]
    at_once = shingle_sets.connected(sets, 0.8)
    monkeypatch.setattr(shingle_sets, "FEW", len(sets))
    assert sorted(map(sorted, at_once)) == sorted(map(sorted, shingle_sets.connected(sets, 0.8)))
    assert 4 < len(at_once) < len(sets)
