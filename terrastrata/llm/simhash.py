"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves by traversing a binary trie.

Fingerprints are first reduced to distinct ones. Of budget + k blocks of bits two that differ in at most ``budget`` bits agree in k;
so each fingerprint goes, its bits dealt so that these come first, to the trie under each choice of k of its blocks. k grows with the number of
fingerprints, so that the mean trie stays small whatever the corpus: five tries of 12 bits for each fingerprint up to some 10^7 of them, 15 of 20 bits up to
some 10^9, 35 of 27 bits up to some 10^11.
In a trie pairs of nodes go down together; the differing bits add up, and a pair of nodes is dropped once they exceed
the budget. What each trie finds leaves it as a spanning forest, never as all pairs of a group; the forests are then
joined to components.

A trie with more fingerprints than ``part_size`` (a hot group) is cut into parts, and each pair
of parts is a trie of its own, so that no link is lost and no task is large.

Sets of shingles are near by their Jaccard similarity, at which 64 bits are too few: at 0.8 some 10 of them differ, up to 19. Their fingerprints are longer
(see shingle_sets), and each goes to as many tries as make it nearly sure that similar ones agree in the first bits of one of them (see _Wide).

Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is never the smallest; a
component without any other doc_id has a null component_id. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import shingle_sets
from .components import Forest, connected_components
from .text import byte_words

#: Shingles hashed at once, so that a very long text needs no more memory.
SHINGLES_AT_ONCE = 1 << 16
#: Pairs of nodes expanded at once, and rows of a partition joined at once.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 19, 1 << 17
#: Fingerprints in one trie at most.
PART_SIZE = 1 << 14
#: Pairs of nodes with no more pairs of leaves than this are compared leaf by leaf.
FEW = 32
#: Highest bits of a long fingerprint's key, the number of its trie.
TURN_BITS = 12
#: Long fingerprints in the mean trie at most.
MEAN_TRIE = 512
#: Pairs of nodes of long fingerprints with no more pairs of leaves than this are compared as a whole.
DENSE = 1 << 18


def fingerprint_of(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed long."""
    import xxhash

    words, digest = byte_words(text.translate(_LOWER) if text else text), xxhash.xxh64_intdigest
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    whole, count, ones = b" ".join(words), len(words) - shingle + 1, np.zeros(64, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:count].tolist(), ends[shingle - 1 :].tolist()
    for k in range(0, count, SHINGLES_AT_ONCE):
        some = zip(starts[k : k + SHINGLES_AT_ONCE], ends[k : k + SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([digest(whole[a:b], seed) for a, b in some], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """Long: a bit is 1 if it is set in over half of the XXH64 hashes of the lower-cased text's word shingles."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return run(text)


def trie_join(values: np.ndarray, bounds: np.ndarray, depth: int, budget: int, more: np.ndarray | None = None, few: int | None = None) -> np.ndarray:
    """Roots of a spanning forest over all pairs within ``budget`` bits of each other.

    values: unsigned 64-bit, ascending within each group; group k is values[bounds[k]:bounds[k+1]], and its values agree in
    the first ``depth`` bits. more: 64 further bits of each, or a row of several such words, which count against the same budget. few: pairs of nodes with
    no more pairs of leaves are compared as a whole, FEW by default; with a large budget, under which nodes cannot be told apart from above, many are
    cheaper. Returns the index of each value's root.
    """
    forest, ones = Forest(len(values)), {}
    words = [values] if more is None else [values, *more.reshape(len(values), -1).T]
    words, few, compared = [np.ascontiguousarray(w) for w in words], few or FEW, _blocks if few else _leaves

    def ones_before(d: int) -> np.ndarray:
        if d not in ones:
            bit = (values >> np.uint64(63 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
        return ones[d]

    lo, hi = bounds[:-1], bounds[1:]
    # a frontier is a depth and the pairs of nodes there: from and to of either node, and the bits in which they differ
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, off = stack.pop()
        done = (ahi - alo) * (bhi - blo) <= few if d < 64 else np.ones(len(alo), bool)
        if done.any():
            compared(words, forest, alo[done], ahi[done], blo[done], bhi[done], budget)
            alo, ahi, blo, bhi, off = (x[~done] for x in (alo, ahi, blo, bhi, off))
        if not len(alo):
            continue
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            stack += [(d, *(x[part] for x in (alo, ahi, blo, bhi, off))) for part in (slice(half), slice(half, None))]
            continue
        before = ones_before(d)
        amid, bmid = ahi - (before[ahi] - before[alo]), bhi - (before[bhi] - before[blo])
        same = (alo == blo) & (ahi == bhi)
        below = [
            (alo, amid, blo, bmid, off, off <= budget),
            (amid, ahi, bmid, bhi, off, off <= budget),
            (alo, amid, bmid, bhi, off + 1, off < budget),
            (amid, ahi, blo, bmid, off + 1, (off < budget) & ~same),
        ]
        kept = [[x[ok & (n[0] < n[1]) & (n[2] < n[3])] for x in n] for *n, ok in below]
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    return forest.roots(np.arange(len(values)))


def _blocks(words, forest, alo, ahi, blo, bhi, budget) -> None:
    """As _leaves, one pair of nodes at a time; leaves that are known to be connected cost no more than finding that out."""
    for first, last, low, high in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist(), strict=True):
        step = max(DENSE // (high - low), 1)
        for start in range(first, last, step):
            end = min(start + step, last)
            own, theirs = forest.roots(np.arange(start, end)), forest.roots(np.arange(low, high))
            if (own == own[0]).all() and (theirs == own[0]).all():
                continue
            off = np.zeros((end - start, high - low), np.uint8 if len(words) < 4 else np.int16)
            for word in words[1:] or words:
                off += np.bitwise_count(word[start:end, None] ^ word[low:high])
            near = np.flatnonzero(off <= budget)
            a, b = near // (high - low) + start, near % (high - low) + low
            apart = forest.roots(a) != forest.roots(b)
            a, b = a[apart], b[apart]
            near = sum(np.bitwise_count(word[a] ^ word[b]).astype(np.int16) for word in words) <= budget
            forest.join(a[near], b[near])


def _leaves(words, forest, alo, ahi, blo, bhi, budget) -> None:
    """Compares each leaf of the first nodes with each of the second, some nodes at a time."""
    # of equal values a node has as many leaves as there are: large ones are compared piece by piece
    step = np.maximum(PAIRS_AT_ONCE // (bhi - blo), 1)
    pieces = -((alo - ahi) // step)
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    alo, ahi, blo, bhi, step = (np.repeat(x, pieces) for x in (alo, ahi, blo, bhi, step))
    alo = alo + piece * step
    ahi = np.minimum(alo + step, ahi)
    sizes = (ahi - alo) * (bhi - blo)
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + 1, PAIRS_AT_ONCE), "right")
    for start, end in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        part = slice(start, end)
        n = sizes[part]
        if not len(n):
            continue
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat((bhi - blo)[part], n)
        a, b = np.repeat(alo[part], n) + k // width, np.repeat(blo[part], n) + k % width
        off = np.bitwise_count(words[0][a] ^ words[0][b])
        for word in words[1:]:
            off = off + np.bitwise_count(word[a] ^ word[b])
        near = (a != b) & (off <= budget)
        forest.join(a[near], b[near])


@dataclass(frozen=True)
class _Layout:
    """Blocks of bits, from the highest on, as (shift, width), and the choices of blocks under which fingerprints go to tries."""

    blocks: tuple[tuple[int, int], ...]
    choices: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(budget: int, agreeing: int) -> _Layout:
        n = budget + agreeing
        ends = [64 - (64 * k) // n for k in range(n + 1)]
        return _Layout(tuple((ends[k + 1], ends[k] - ends[k + 1]) for k in range(n)), tuple(combinations(range(n), agreeing)))

    @staticmethod
    def for_count(count: int, budget: int, part_size: int) -> _Layout:
        """As few agreeing blocks as keep the mean trie within a quarter of part_size."""
        for agreeing in range(1, budget + 4):
            layout = _Layout.of(budget, agreeing)
            if count >> layout.depth <= part_size // 4:
                break
        return layout

    @property
    def depth(self) -> int:
        """Bits that the fingerprints of any trie have in common."""
        return min(sum(self.blocks[k][1] for k in some) for some in self.choices)

    def keys(self, fp: Column) -> Column:
        """Array of structs: the number of the choice, and the bits of its blocks as one long."""
        out = []
        for turn, some in enumerate(self.choices):
            key = F.lit(0).cast("long")
            for k in some:
                shift, width = self.blocks[k]
                key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1))
            out.append(F.struct(F.lit(turn).alias("turn"), key.alias("block")))
        return F.array(*out)

    def dealt(self, fp: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The fingerprints with the bits of their choice first; differing bits stay as many."""
        out = np.zeros_like(fp)
        for number, some in enumerate(self.choices):
            mine = turn == number
            if mine.any():
                own, got = fp[mine], np.zeros(int(mine.sum()), np.uint64)
                for k in (*some, *(k for k in range(len(self.blocks)) if k not in some)):
                    shift, width = self.blocks[k]
                    got = (got << np.uint64(width)) | ((own >> np.uint64(shift)) & np.uint64((1 << width) - 1))
                out[mine] = got
        return out


def _links(budget: int, layout: _Layout):
    """For mapInPandas over partitions sorted by trie: the spanning forest of each trie as edges."""

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        dealt = layout.dealt(fp, rows["turn"].to_numpy(np.int64))
        keys = rows[["turn", "block", "i", "j"]].to_numpy(np.int64)
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        order = np.lexsort((dealt, group))
        dealt, fp, group = dealt[order], fp[order], group[order]
        bounds = np.concatenate([np.searchsorted(group, np.arange(group[-1] + 1)), [len(group)]])
        roots = trie_join(dealt, bounds, layout.depth, budget)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return pd.DataFrame({"a": fp[linked].view(np.int64), "b": fp[roots[linked]].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= ROWS_AT_ONCE:
                last = held[["turn", "block", "i", "j"]].iloc[-1]
                open_ = (held[["turn", "block", "i", "j"]] == last).all(axis=1).to_numpy()
                if not open_.all():
                    yield joined(held[~open_])
                    held = held[open_]
        if held is not None and len(held):
            yield joined(held)

    return run


def linked_fingerprints(distinct: DataFrame, budget: int = 4, part_size: int = PART_SIZE) -> DataFrame:
    """Edges (a, b) that join the fingerprints (column fp, distinct, stored) within ``budget`` bits, as forests of the tries."""
    layout = _Layout.for_count(distinct.count(), budget, part_size)
    rows = distinct.select("fp", F.explode(layout.keys(F.col("fp"))).alias("t")).select("fp", "t.*")
    hot = rows.groupBy("turn", "block").agg(F.count("*").alias("n")).where(F.col("n") > part_size)
    hot = checkpointed(hot.select("turn", "block", F.ceil(F.col("n") / part_size).cast("int").alias("parts")))
    rows = rows.join(hot, ["turn", "block"], "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.withColumn("part", part).withColumn("pair", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(alone)))
    rows = rows.select("fp", "turn", "block", "pair.i", "pair.j").repartition("turn", "block", "i", "j")
    rows = rows.sortWithinPartitions("turn", "block", "i", "j")
    return rows.mapInPandas(_links(budget, layout), "a long, b long")


@dataclass(frozen=True)
class _Wide:
    """Tries of long fingerprints: in the first ``agreeing`` of the bits drawn for its trie a pair has to agree, and of the others, the print's
    and the next word's it may differ in ``budget``."""

    agreeing: int
    tries: int
    budget: int

    @staticmethod
    def of(count: int, similarity: float) -> _Wide:
        """The mean trie has no more than MEAN_TRIE fingerprints; a pair of that similarity is expected in 16 tries.

        A bit of such a pair differs with probability angle / pi, the cosine being at least 2 s / (1 + s). The budget is four and a half deviations above the
        differing bits, but so far below half the bits that one fingerprint of a thousand has an unrelated one within it: more such links
        would connect groups of copies to ever larger ones, all pairs of which are compared.
        """
        differ = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
        agreeing = 0
        while count >> agreeing > MEAN_TRIE and agreeing < 40 and 16 <= (1 << TURN_BITS) * (1 - differ) ** (agreeing + 1):
            agreeing += 1
        tries = ceil(16 / (1 - differ) ** agreeing)
        bits = 192 - TURN_BITS - agreeing
        most, budget, below = bits * differ + 4.5 * sqrt(bits * differ * (1 - differ)), -1, 0.0
        while budget < most:
            below += comb(bits, budget + 1) / 2**bits
            if budget >= bits * differ and below * count * tries > 0.001 * 2**agreeing:
                break
            budget += 1
        return _Wide(agreeing, tries, budget)

    @property
    def depth(self) -> int:
        return TURN_BITS + self.agreeing

    def keys(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """For each trie its number and the bits drawn for it, of words (unsigned, a row for each fingerprint); but for those in which a pair has to
        agree, none are of the first word, which is compared as a whole."""
        bits = np.ascontiguousarray(np.unpackbits(words.view(np.uint8), axis=1).T)
        rng = np.random.default_rng(20240301)
        own = np.zeros((64, bits.shape[1]), np.uint8)
        for turn in range(self.tries):
            drawn = rng.permutation(len(bits))
            drawn = np.concatenate([drawn[: self.agreeing], drawn[self.agreeing :][drawn[self.agreeing :] >= 64]])
            own[TURN_BITS:] = bits[drawn[: 64 - TURN_BITS]]
            key = np.ascontiguousarray(np.packbits(own, axis=0).T).view(">u8").ravel().astype(np.uint64)
            yield key | np.uint64(turn << (64 - TURN_BITS))


def linked_sets(sets: DataFrame, similarity: float = 0.8, part_size: int = PART_SIZE) -> DataFrame:
    """Edges (a, b) that join the prints of sets (columns print and words, stored) near each other, as forests of the tries."""
    layout = _Wide.of(sets.count(), similarity)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = batch["print"].to_numpy(np.int64)
            for start in range(0, len(batch), 1 << 12):
                own, words = prints[start : start + (1 << 12)], np.array(batch["words"].iloc[start : start + (1 << 12)].tolist(), np.int64).view(np.uint64)
                keys = (key.view(np.int64) for key in layout.keys(words))
                while held := list(islice(keys, 16)):
                    yield pd.DataFrame({"key": np.concatenate(held), "print": np.tile(own, len(held)), "next": np.tile(words[:, 0].view(np.int64), len(held))})

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        key, prints = rows["key"].to_numpy(np.int64).view(np.uint64), rows["print"].to_numpy(np.int64)
        starts = np.flatnonzero(_starts(rows, layout.depth))
        more = np.stack([prints, rows["next"].to_numpy(np.int64)], axis=1).view(np.uint64)
        roots = trie_join(key, np.append(starts, len(key)), layout.depth, layout.budget, more, DENSE)
        linked = np.flatnonzero(prints != prints[roots])
        return pd.DataFrame({"a": prints[linked], "b": prints[roots[linked]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= ROWS_AT_ONCE:
                all_ = pd.concat(held, ignore_index=True)
                last = int(np.flatnonzero(_starts(all_, layout.depth))[-1])
                if last:
                    yield joined(all_[:last])
                held, rows = [all_[last:]], len(all_) - last
        if rows:
            yield joined(pd.concat(held, ignore_index=True))

    fields = "key long, print long, next long"
    trie = F.shiftrightunsigned("key", 64 - layout.depth)
    # sizes are taken from a sample of the prints: what it gets wrong makes a task larger or smaller, but loses no link
    share = max(1, part_size // 64)
    some = sets.select("print", "words").where(F.pmod(F.xxhash64("print", F.lit(1)), F.lit(share)) == 0).mapInPandas(keyed, fields)
    hot = some.groupBy(trie.alias("trie")).agg((F.count("*") * share).alias("n")).where(F.col("n") > part_size)
    hot = checkpointed(hot.select("trie", F.ceil(F.col("n") / part_size).cast("int").alias("parts")))
    rows, count = sets.select("print", "words").mapInPandas(keyed, fields), hot.count()
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    if count:
        rows = rows.withColumn("trie", trie).join(F.broadcast(hot) if count <= 1 << 17 else hot, "trie", "left")
        part = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))
        pairs = F.transform(others, lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))
        rows = rows.withColumn("part", part).withColumn("pair", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(alone)))
        rows = rows.select("key", "print", "next", "pair.i", "pair.j")
    else:
        rows = rows.select("key", "print", "next", F.lit(0).alias("i"), F.lit(0).alias("j"))
    rows = rows.repartition(trie, "i", "j").sortWithinPartitions("i", "j", "key")
    return rows.mapInPandas(run, "a long, b long")


def _starts(rows: pd.DataFrame, depth: int) -> np.ndarray:
    """Whether a trie, or a pair of its parts, begins at each row."""
    trie = rows["key"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - depth)
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    out = np.ones(len(rows), bool)
    out[1:] = (trie[1:] != trie[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return out


def _components(prints: DataFrame, budget: int, part_size: int, by: str = "doc_id") -> DataFrame:
    """fp and component_id, the smallest ``by`` of its component, of each fingerprint in prints."""
    smallest = checkpointed(prints.groupBy("fp").agg(F.min(by).alias("first")))
    return _firsts(smallest, connected_components(linked_fingerprints(smallest.select("fp"), budget, part_size)))


def _firsts(smallest: DataFrame, roots: DataFrame) -> DataFrame:
    """fp and component_id of each row of smallest (fp, first): the least first among those with the same root in roots (node, root)."""
    roots = roots.withColumnRenamed("node", "fp")
    linked = checkpointed(smallest.select("fp", "first").join(roots, "fp"))
    of_root = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    component = linked.join(of_root, "root").select("fp", "component_id")
    # stored, so that a join with it has an exchange on either side, which adaptive execution can split at a fingerprint of very many rows
    return checkpointed(smallest.join(component, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, budget: int = 4, part_size: int = PART_SIZE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for each row."""
    prints = checkpointed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(F.col(f"`{text}`"), shingle, seed).alias("fp")))
    component = _components(prints, budget, part_size)
    out = prints.join(component, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, part_size: int = 512) -> DataFrame:
    """One row, with all its columns, of each component: of those with the smallest doc_id, one with the smallest hash of its text.

    Texts are linked if the Jaccard similarity of their sets of word shingles is at least ``similarity``: SimHash tries give the
    candidates (see linked_sets), all of which are compared exactly (see shingle_sets). A row
    without a doc_id stays only if no row of its component has one. Rows are told apart by doc_id and text, so a doc_id that
    other texts have too, or none, costs no other row its place; of rows with the same of both one stays. Texts without words
    say nothing of being copies, so all of them stay.
    """
    id_, text_ = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    prints = docs.select(id_.alias("doc_id"), F.xxhash64(text_).alias("key"), text_.alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    prints = checkpointed(prints.select("doc_id", "key", rank.alias("rank"), shingle_sets.sketch(F.col("text"), shingle).alias("s")).select("doc_id", "key", "rank", "s.*"))
    sets = checkpointed(prints.groupBy("fp").agg(F.min("rank").alias("first"), F.first("size").alias("size"), F.first("print").alias("print"), F.first("words").alias("words")))
    edges = linked_sets(sets, similarity)
    component = _firsts(sets, shingle_sets.components(docs, sets, edges, id_, text_, shingle, similarity, part_size))
    return _chosen(docs, prints, component, id_, text_)


def _chosen(docs: DataFrame, prints: DataFrame, component: DataFrame, id_: Column, text_: Column) -> DataFrame:
    """The rows of docs that are the first of their component, once, and those that are not in prints (doc_id, key, rank, fp)."""
    first = F.col("rank").eqNullSafe(F.col("component_id"))
    marks = prints.join(component, "fp").groupBy("doc_id", "key").agg(F.max(first).alias("first"), F.count("*").alias("n"))
    marks = checkpointed(marks.where("n > 1 OR NOT first").drop("n"))
    rows = docs.select(F.struct("*").alias("row__"), id_.alias("id__"), F.xxhash64(text_).alias("key__"))
    same = F.col("id__").eqNullSafe(F.col("doc_id")) & (F.col("key__") == F.col("key"))
    out = rows.join(marks, same, "left_anti").select("row__.*")
    again = marks.where("first")
    if again.isEmpty():
        return out
    once = rows.join(again, same).groupBy("id__", "key__").agg(F.min_by("row__", F.to_json("row__")).alias("row__"))
    return out.union(once.select("row__.*"))
