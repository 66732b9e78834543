"""Near-duplicates by the Jaccard similarity of texts' sets of word shingles.

Candidates come from SimHash (see simhash.linked_sets): ``WORDS`` words of fingerprint bits for each set, the first of which is its print.

Texts that candidates connect are one group, and in a group every pair is compared by its exact similarity (of sets of 64-bit
shingle hashes), in small groups but for pairs that are connected already. Groups of more than ``part_size`` texts, or very long ones, are cut into parts,
and each pair of parts is compared on its own, so that no pair is lost and no task is large. Equal sets are reduced to one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import Forest, connected_components

#: Words of 64 bits in a fingerprint.
WORDS = 8
#: Shingles whose bits are counted at once; a byte counts 255 of them.
AT_ONCE = 255 * 16
#: Sets that are compared one by one; of more than these all pairs are at once.
FEW = 8
#: Elements whose bits are compared at once; a multiple of 64.
BITS_AT_ONCE = 1 << 12
#: Shingles of the sets in one part of a group, on the average, at most.
PART_SHINGLES = 1 << 20
_FLIPS = np.random.default_rng(20240229).integers(0, 1 << 64, WORDS, dtype=np.uint64)
_LOW_BITS = np.uint64(0x0101010101010101)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Ascending distinct hashes of the runs of ``shingle`` words of the text in lower case (A to Z); all words if there are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < shingle:
        words, shingle = [b" ".join(words)] if words else [], 1
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = max(0, len(words) - shingle + 1)
    out = np.zeros(count, np.uint64)
    for k in range(shingle):
        out = _mixed(out * _STEP + own[k : k + count])
    return np.unique(out)


def fingerprint_words(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ascending distinct hashes: a bit is the one that most of them have there, in a tie that of the smallest."""
    ones = np.zeros((WORDS, 8, 8), np.int64)  # by word, byte and bit, each from the lowest on
    for k in range(0, len(hashes), AT_ONCE):
        mixed = _mixed(hashes[k : k + AT_ONCE, None] ^ _FLIPS)
        for bit in range(8):
            sums = np.add.reduceat((mixed >> np.uint64(bit)) & _LOW_BITS, np.arange(0, len(mixed), 255), axis=0)
            ones[:, :, bit] += sums.view(np.uint8).reshape(-1, WORDS, 8).sum(axis=0, dtype=np.int64)
    tie = np.unpackbits(_mixed(hashes[:1, None] ^ _FLIPS).view(np.uint8), bitorder="little").reshape(-1, WORDS, 8, 8)
    return np.packbits(2 * ones + tie.sum(axis=0) > len(hashes), bitorder="little").view(np.uint64)


def sketch(text: Column, shingle: int) -> Column:
    """Struct of fp, a hash of the whole set, its size, its print (the first word of the fingerprint) and the other words."""

    @F.pandas_udf("struct<fp:long,size:long,print:long,words:array<long>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        fps, sizes, each = np.empty(len(texts), np.uint64), np.empty(len(texts), np.int64), np.empty((len(texts), WORDS), np.uint64)
        for k, t in enumerate(texts):
            hashes = shingle_set(t, shingle)
            sizes[k] = len(hashes)
            fps[k] = xxhash.xxh64_intdigest(hashes.tobytes())
            each[k] = fingerprint_words(hashes)
        words = pd.Series(list(each[:, 1:].view(np.int64)), dtype=object)
        return pd.DataFrame({"fp": fps.view(np.int64), "size": sizes, "print": each[:, 0].view(np.int64), "words": words})

    return run(text)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    least, most = sorted((len(a), len(b)))
    if least < similarity * most - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (least + most - common) - 1e-9


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets has in common with each: those that only one set has are left out, of the others each set has a row of bits."""
    elements, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), at.ravel()
    shared = np.bincount(at, minlength=len(elements)) > 1
    owner, at = owner[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    out, order = np.zeros((len(sets), len(sets)), np.int64), np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(shared.sum()), BITS_AT_ONCE):
        part = slice(*np.searchsorted(at, [low, low + BITS_AT_ONCE]))
        bits = np.zeros((len(sets), BITS_AT_ONCE), bool)
        bits[owner[part], at[part] - low] = True
        rows = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(len(sets)):
            out[k, k:] += np.bitwise_count(rows[k:] & rows[k]).sum(axis=1, dtype=np.int64)
    out = np.maximum(out, out.T)
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def connected(sets: list[np.ndarray], similarity: float) -> list[list[int]]:
    """Components over all pairs of at least that similarity; of a few sets each is compared with those of other components only."""
    if len(sets) > FEW:
        sizes, both, forest = np.array([len(x) for x in sets]), common(sets), Forest(len(sets))
        forest.join(*np.nonzero(both >= similarity * (sizes[:, None] + sizes - both) - 1e-9))
        roots = forest.roots(np.arange(len(sets)))
        order = np.argsort(roots, kind="stable")
        return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)]
    trees: list[list[int]] = []
    for k, own in enumerate(sets):
        mine, others = [k], []
        for tree in trees:
            if any(similar(sets[m], own, similarity) for m in tree):
                mine = tree + mine
            else:
                others.append(tree)
        trees = [*others, mine]
    return trees


def _stars(shingle: int, similarity: float):
    """For mapInPandas over partitions sorted by group: the components in each, every member with the first."""

    def joined(fps: list[int], sets: list[np.ndarray], whole: bool) -> pd.DataFrame:
        found = [(fps[m], fps[tree[0]]) for tree in connected(sets, similarity) if len(tree) > 1 for m in tree]
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64").assign(whole=whole)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fps, sets = (0, 0, 0), [], []
        for batch in batches:
            for fp, root, i, j, text in zip(batch["fp"], batch["root"], batch["i"], batch["j"], batch["text"], strict=True):
                if (root, i, j) != group:
                    if len(fps) > 1:
                        yield joined(fps, sets, group[1] == group[2])
                    group, fps, sets = (root, i, j), [], []
                if not fps or fps[-1] != fp:
                    fps.append(fp)
                    sets.append(shingle_set(text, shingle))
        if len(fps) > 1:
            yield joined(fps, sets, group[1] == group[2])

    return run


def components(docs: DataFrame, sets: DataFrame, edges: DataFrame, id_: Column, text: Column, shingle: int, similarity: float, part_size: int) -> DataFrame:
    """(node, root) for each fp that is connected to another over sets of at least that similarity.

    sets: fp, size, print and first (with doc_id and key, the XXH64 of the text, of a row of docs that has the set), stored, one row for each fp.
    edges: (a, b) between prints; sets that these connect, or with the same print, are compared.
    """
    linked = checkpointed(connected_components(edges).withColumnRenamed("node", "print"))
    shared = sets.groupBy("print").count().where("count > 1").select("print", F.col("print").alias("root"))
    roots = linked.union(shared.join(linked, "print", "left_anti"))
    groups = checkpointed(sets.select("fp", "print", "size").join(roots, "print").select("fp", "root", "size"))
    parts = F.ceil(F.greatest(F.count("*") / part_size, F.least(F.count("*"), F.sum("size") / PART_SHINGLES))).cast("int")
    hot = groups.groupBy("root").agg(parts.alias("parts")).where("parts > 1")
    rows = groups.drop("size").join(hot, "root", "left").join(sets.select("fp", "first.doc_id", "first.key"), "fp")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.withColumn("part", part).withColumn("pairs", F.when(F.col("parts") > 1, pairs).otherwise(alone))
    texts = docs.select(id_.alias("id__"), F.xxhash64(text).alias("key__"), text.alias("text"))
    rows = texts.join(rows, F.col("id__").eqNullSafe(F.col("doc_id")) & (F.col("key__") == F.col("key")))
    rows = rows.select("fp", "root", "text", F.explode("pairs").alias("pair")).select("fp", "root", "pair.i", "pair.j", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "fp")
    stars = checkpointed(rows.mapInPandas(_stars(shingle, similarity), "a long, b long, whole boolean"))
    # only the parts of a group that was cut have still to be put together
    whole = stars.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return whole.union(connected_components(stars.where("NOT whole").select("a", "b")))
