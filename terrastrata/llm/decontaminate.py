"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage with block-max WAND.

Test items are documents of a small inverted index; impacts are BM25 scores divided by the score of the item against
itself, so that 1 means the whole item is there. Document frequencies and the mean length are those of the whole benchmark. The postings of
a term are in the order of items and cut into blocks, each with its last item and its largest impact. A passage's distinct terms each have a cursor.
WAND sorts the cursors by their items and adds up the terms' largest impacts until the threshold is reached: no item before that pivot can
reach it. If the maxima of the blocks that may hold the pivot reach it too, its score is formed, else all cursors skip the shortest of these
blocks. All items at or above the threshold are found, and most postings are never read.

Before that, all passages of a document go through one bound at once: an item can reach the threshold only if enough of the impact of its rarest
terms is in the passage (``Index.possible``), which no passage without a likely match passes. The bound is exact: it never loses an item.

A passage is a run of ``2 * stride`` words that starts at every multiple of ``stride``, the number of words of the longest
item; so every copy of an item lies in one passage whole. What is retrieved is verified on the document: the share of
the item's shingles of five words in the document, apart for its question and its answer. The question is all
sentences but the last, the answer is the last; an item of one sentence is both.

Words are lower-cased, without punctuation at their ends. Null and empty texts and items match nothing.
A null doc_id or item_id is carried along. Repeated items are found each; repeated documents too. The index is made of the whole benchmark and
broadcast; beyond ``MAX_INDEX_WORDS`` it is made in several parts, with the same statistics and passages and so the same scores, and each part is
searched in turn. The benchmark's vocabulary with its document frequencies is on the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import byte_words, remembering

K1, B = 1.2, 0.75
#: Words of all items in one index; some 100 bytes each.
MAX_INDEX_WORDS = 2_000_000
#: Postings in a block. Words and passages that a worker remembers before it starts afresh.
BLOCK, MEMORY, PASSAGES = 4, 1 << 17, 1 << 12
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»„“”‘’…–—¿¡"
_SPACES = " \t\n\v\f\r"


def terms(text: str | None) -> list[str]:
    """Words in lower case without punctuation at either end; words that are only punctuation are left out."""
    return [w for x in re.split(f"[{_SPACES}]+", (text or "").lower()) if (w := x.strip(_EDGE))]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    sentences = [t for s in re.split(r"(?<=[.!?])\s+", text or "") if (t := terms(s))]
    if len(sentences) < 2:
        return (sentences[0], sentences[0]) if sentences else ([], [])
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Runs of ``size`` words; all the words if there are fewer."""
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


@dataclass(frozen=True)
class Statistics:
    """Of the whole benchmark: items with words, their mean and largest number of words, and in how many of them each word is."""

    count: int
    mean: float
    longest: int
    df: dict[str, int]

    @staticmethod
    def of(texts: Iterator[str | None]) -> Statistics:
        count = total = longest = 0
        df: Counter[str] = Counter()
        for text in texts:
            if words := terms(text):
                count, total, longest = count + 1, total + len(words), max(longest, len(words))
                df.update(set(words))
        return Statistics(count, total / max(1, count), max(1, longest), dict(df))


class _Known(dict):
    """The term of each word as it stands in a text: -1 if no item has it, -2 if it is punctuation only."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        plain = word.decode("utf-8", "surrogatepass").lower().strip(_EDGE)
        got = self[word] = self.vocabulary.get(plain, -1) if plain else -2
        return got


class Index:
    """Inverted index of test items with block maxima.

    ``read`` counts the postings that have been looked at.
    """

    def __init__(self, items: list[tuple[object, str | None]], stats: Statistics | None = None, block: int = BLOCK, shingle: int = 5):
        self.shingle, self.block = shingle, block
        stats = stats or Statistics.of(t for _, t in items)
        kept = [(i, t, terms(t)) for i, t in items]
        # neighbours are alike, so that block maxima are close to what their items have
        kept = sorted((x for x in kept if x[2]), key=lambda x: (len(x[2]), " ".join(x[2])))
        self.ids = [i for i, _, _ in kept]
        self.parts = [tuple(shingles(p, shingle) for p in question_and_answer(t)) for _, t, _ in kept]
        self.longest = stats.longest
        self.vocabulary: dict[str, int] = {}
        triples = []
        for item, (*_, words) in enumerate(kept):
            norm = K1 * (1 - B + B * len(words) / stats.mean)
            scores = {}
            for w, n in Counter(words).items():
                df = stats.df[w]
                scores[self.vocabulary.setdefault(w, len(self.vocabulary))] = np.log1p((stats.count - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + norm)
            whole = sum(scores.values())
            triples += [(t, item, float(s / whole)) for t, s in scores.items()]
        triples.sort()
        self.rarity = [stats.df[w] for w in self.vocabulary]
        self.items, self.impacts = [x[1] for x in triples], [x[2] for x in triples]
        term = np.array([x[0] for x in triples], np.int64)
        self.starts = np.searchsorted(term, np.arange(len(self.vocabulary) + 1)).tolist()
        self.block_starts, self.block_last, self.block_max = [0], [], []
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            for k in range(a, b, block):
                self.block_last.append(self.items[min(k + block, b) - 1])
                self.block_max.append(max(self.impacts[k : min(k + block, b)]))
            self.block_starts.append(len(self.block_last))
        self.top = [max(self.block_max[a:b]) for a, b in zip(self.block_starts, self.block_starts[1:], strict=False)]
        self.__setstate__(self.__dict__)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "found", "rare", "read")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.known, self.found, self.rare, self.read = _Known(self.vocabulary), {}, {}, 0

    def search(self, term: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all scores from ``threshold`` up, of a passage's distinct terms."""
        items, impacts, last, most, top = self.items, self.impacts, self.block_last, self.block_max, self.top
        least, found = threshold - 1e-9, []
        cursors = [[items[self.starts[t]], self.starts[t], t] for t in term]
        self.read += len(cursors)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += top[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            head = cursors[: pivot + 1]
            bound, ahead = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for _, at, t in head:
                first = self.block_starts[t]
                b = bisect_left(last, item, first + (at - self.starts[t]) // self.block, self.block_starts[t + 1])
                if b < self.block_starts[t + 1]:
                    bound += most[b]
                    ahead = min(ahead, last[b] + 1)
            if bound < least:
                goal = ahead
            elif head[0][0] == item:
                score = sum(impacts[at] for _, at, _ in head)
                if score >= least:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for c in head:
                if c[0] < goal:
                    c[1] = bisect_left(items, goal, c[1] + 1, self.starts[c[2] + 1])
                    if c[1] < self.starts[c[2] + 1]:
                        c[0] = items[c[1]]
                        self.read += 1
                    else:
                        c[0] = -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _rare(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Postings of the rarest terms of each item, half a threshold more of its score than it may lack, and how much of these a passage needs."""
        if threshold not in self.rare:
            own: list[list[tuple[int, int, float]]] = [[] for _ in self.ids]
            for t in range(len(self.vocabulary)):
                for at in range(self.starts[t], self.starts[t + 1]):
                    own[self.items[at]].append((self.rarity[t], t, self.impacts[at]))
            chosen, need = [], np.empty(len(own))
            for item, some in enumerate(own):
                mass = 0.0
                for _, t, s in sorted(some):
                    if mass >= 1 - threshold / 2:
                        break
                    chosen.append((t, item, s))
                    mass += s
                need[item] = threshold - 1 + mass - 1e-9
            chosen.sort()
            starts = np.searchsorted(np.array([t for t, *_ in chosen], np.int64), np.arange(len(self.vocabulary) + 1))
            counts = np.append(np.diff(starts), [0, 0])  # none for the terms -2 and -1
            self.rare[threshold] = starts, counts, np.array([i for _, i, _ in chosen], np.int64), np.array([s for *_, s in chosen]), need
        return self.rare[threshold]

    def possible(self, term: np.ndarray, count: int, threshold: float) -> list[int]:
        """The passages that may hold an item's score from ``threshold`` up, of ``count`` passages of a text."""
        starts, counts, items, impacts, need = self._rare(threshold)
        at = np.flatnonzero(counts[term])
        if not len(at):
            return []
        # a word lies in the passage that starts in its stride and in the one before
        number = at // self.longest
        pairs = np.concatenate([number * len(self.vocabulary), (number - 1) * len(self.vocabulary)]) + np.tile(term[at], 2)
        pairs = np.unique(pairs[(pairs >= 0) & (pairs < count * len(self.vocabulary))])
        passage, t = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        n = counts[t]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[t], n)
        self.read += len(place)
        key, inverse = np.unique(np.repeat(passage, n) * len(self.ids) + items[place], return_inverse=True)
        enough = np.bincount(inverse, impacts[place], len(key)) >= need[key % len(self.ids)]
        return np.unique(key[enough] // len(self.ids)).tolist()

    def matches(self, text: str | None, threshold: float) -> Iterator[tuple[int, float, float, float]]:
        """(item, best score, question share, answer share) of the items that a passage of the text retrieves."""
        words = byte_words(text)
        if not words or not self.ids:
            return
        term = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        term = term[term > -2]
        stride = self.longest
        best: dict[int, float] = {}
        for number in self.possible(term, max(1, -(-(len(term) - stride) // stride)), threshold):
            passage = np.unique(term[number * stride : (number + 2) * stride])
            passage = tuple(passage[passage >= 0].tolist())
            if passage not in self.found:
                if len(self.found) >= PASSAGES:
                    self.found.clear()
                self.found[passage] = self.search(passage, threshold)
            for item, score in self.found[passage]:
                best[item] = max(score, best.get(item, 0.0))
        if best:
            there = shingles_in(terms(text), {len(s) for item in best for part in self.parts[item] for s in part})
            for item, score in sorted(best.items()):
                yield item, score, *(len(part & there) / len(part) for part in self.parts[item])


def shingles_in(words: list[str], sizes: set[int]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + n]) for n in sizes for k in range(len(words) - n + 1)}


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, max_words: int) -> Iterator[Index]:
    """Indexes of parts of the items, with the statistics of all."""
    stats = Statistics.of(row[0] for row in benchmark.select(F.col(f"`{item_text}`")).toLocalIterator())
    part, words = [], 0
    for row in benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).toLocalIterator():
        n = len((row[1] or "").split())
        if part and words + n > max_words:
            yield Index(part, stats)
            part, words = [], 0
        part.append((row[0], row[1]))
        words += n
    if part:
        yield Index(part, stats)


def _found(sent, threshold: float, overlap: float, kind: str):
    @F.pandas_udf(f"array<struct<item_id:{kind},score:double,question_overlap:double,answer_overlap:double>>")
    def run(texts: pd.Series) -> pd.Series:
        index = sent.value
        remembering("decontaminate", index.known, index.found)
        found = []
        for t in texts:
            some = [m for m in index.matches(t, threshold) if min(m[2], m[3]) >= overlap]
            found.append([{"item_id": index.ids[i], "score": s, "question_overlap": q, "answer_overlap": a} for i, s, q, a in some])
        return pd.Series(found)

    return run


def _clean(sent, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        index = sent.value
        remembering("decontaminate", index.known, index.found)
        return pd.Series([not any(min(m[2], m[3]) >= overlap for m in index.matches(t, threshold)) for t in texts], dtype=bool)

    return run


def matches(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_index_words: int = MAX_INDEX_WORDS,
) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of each document and test item found in it.

    score is the best passage's, from ``threshold`` up; both overlaps are at least ``overlap``.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    out = None
    for index in _indexes(benchmark, item_id, item_text, max_index_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        one = rows.select("doc_id", F.explode(_found(sent, threshold, overlap, kind)("text")).alias("m")).select("doc_id", "m.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {kind}, score double, question_overlap double, answer_overlap double"
        out = docs.sparkSession.createDataFrame([], schema)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, text: str = "text", item_text: str = "text", max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """The rows, with all their columns, in which no test item is found."""
    kept = docs
    for index in _indexes(benchmark, benchmark.columns[0], item_text, max_index_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        kept = kept.where(_clean(sent, threshold, overlap)(F.col(f"`{text}`")))
    return kept
