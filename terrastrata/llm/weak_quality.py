"""Quality classifier from weak labels.

Heuristic labellers, several for each kind of fault, each vote good, bad or nothing on a document. Expectation-maximisation over the
table of vote patterns, which has at most 3 ** (number of labellers) rows whatever the corpus, estimates the shares of good documents and
of those with each kind of fault, and how each labeller votes on all of these; documents' posterior probabilities of being good follow. They are the labels of a
linear scorer over hashed tokens, which is fitted on a bounded sample of ``sample_rows`` documents (those of the smallest hashed ids),
of whose whole texts the driver gets the features alone, and then scores every whole text. Votes, patterns and scores cover all documents.

A null or empty text gets no votes and the posterior of the empty pattern; its score is that of no tokens. Documents
with a score below ``threshold`` are rejected; a posterior of exactly 0.5 counts as good. Repeated rows are judged alike; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .text import byte_words, packed, remembering

#: Documents from which the scorer is fitted; each is read whole.
SAMPLE_ROWS = 8000
FEATURES = 1 << 12
#: A feature that is not 0 and its value, as the driver gets them.
_CELL = np.dtype([("at", "<u2"), ("x", "<f4")])
#: Added to the length by which features are scaled: a few words say little.
DAMPING = 4.0
GOOD, BAD, NONE = 1, 0, -1
LABELLERS = ("shouting", "marks", "ends", "capitals", "clean", "short", "symbols", "bare", "tails", "follows", "distinct", "top", "pairs")
#: The fault that each labeller looks for most: 0 loud, 1 marked up, 2 repetitive.
KINDS = np.array((0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2))
#: Words that a worker remembers before it starts afresh.
MEMORY = 1 << 18
_SYMBOL, _MARKS, _END = re.compile(r"[#*$%&|<>]"), re.compile(r"[!?]{2,}$"), re.compile(r"[.!?]$")
_CLEAN, _TAIL = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*[.,;:!?]?"), re.compile(r"[^\w.,;:!?'\"()\[\]\u2019\u201d\u00bb\u3002\uff0c-]$")


def _shape(word: str) -> str:
    kinds = ("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


def _code(word: bytes) -> int:
    """Tests of the labellers from bit 44 on, the bucket of the word's shape from bit 32 on, and the hash of the word in lower case."""
    w = word.decode("utf-8", "surrogatepass")
    low = w.lower()
    tests = (
        w.upper() == w and low != w and len(w) > 1,
        bool(_MARKS.search(w)),
        bool(_END.search(w)),
        w[0].isupper(),
        bool(_CLEAN.fullmatch(w)),
        len(w) <= 3 and w.isalpha() and low == w,
        bool(_SYMBOL.search(w)),
        not any(map(str.isalpha, w)),
        bool(_TAIL.search(w)),
    )
    flags = sum(t << k for k, t in enumerate(tests))
    shape = zlib.crc32(b"\0" + _shape(w).encode("utf-8", "replace")) % FEATURES
    return flags << 44 | shape << 32 | zlib.crc32(low.encode("utf-8", "replace"))


#: The codes, without the word's own hash, of plain words of Latin letters, by length, first letter and end.
_PLAIN = {(len(w), w.istitle(), end): _code((w + end).encode()) >> 32 for w in ("a", "aa", "aaa", "aaaa", "Aa", "Aaa", "Aaaa") for end in ("", *".,;:!?")}


#: Small letters without capital ones.
_ORDINAL = {"\u00aa", "\u00ba"}


class _Words(dict):
    """The code of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        w = word.decode("utf-8", "surrogatepass")
        core, end = (w, "") if w[-1].isalpha() else (w[:-1], w[-1])
        code = None
        if core.isalpha() and max(core) <= "\xff" and not _ORDINAL & set(core) and (core[1:] or core).islower() and (len(core) > 1 or core.islower()):
            code = _PLAIN.get((min(len(core), 4), core[0].isupper(), end))
        got = self[word] = _code(word) if code is None else code << 32 | zlib.crc32(w.lower().encode())
        return got


_words = _Words()
#: Which tests each of the numbers below 512 stands for.
_BITS = (np.arange(1 << 9)[:, None] >> np.arange(9)) & 1
_AGAIN = zlib.crc32(b"\1again") % FEATURES


def _codes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, w), np.int64, len(w))


def _own(codes: np.ndarray) -> np.ndarray:
    return codes & 0xFFFFFFFF


def _ends(values: np.ndarray) -> np.ndarray:
    """Where, in ascending order, one value ends and another begins."""
    some = np.sort(values)
    return np.flatnonzero(some[1:] != some[:-1])


def votes(text: str | None) -> tuple[int, ...]:
    """One vote of each of LABELLERS: 1 good, 0 bad, -1 none. Each has a least number of words below which it does not vote."""
    codes = _codes(byte_words(text))
    n = len(codes)
    if n < 10:
        return (NONE,) * len(LABELLERS)
    shouting, marks, ends, capitals, clean, short, symbols, bare, tails = (np.bincount(codes >> 44, minlength=1 << 9) @ _BITS / n).tolist()
    own = _own(codes)
    follows = float((own[1:] == own[:-1]).sum()) / n
    runs = np.diff(np.concatenate([[-1], _ends(own), [n - 1]]))
    distinct, top = len(runs) / n, int(runs.max()) / n
    pairs = (len(_ends(own[1:] << 31 ^ own[:-1])) + 1) / (n - 1)

    def vote(least: int, good: bool, bad: bool) -> int:
        return NONE if n < least else BAD if bad else GOOD if good else NONE

    return (
        vote(10, shouting < 0.1, shouting > 0.3),
        vote(10, marks < 0.02, marks > 0.2),
        vote(20, 0.01 <= ends <= 0.3, ends > 0.6),
        vote(10, capitals < 0.4, capitals > 0.7),
        vote(10, clean > 0.8, clean < 0.6),
        vote(30, short > 0.08, short < 0.02),
        vote(10, symbols < 0.05, symbols > 0.2),
        vote(10, bare < 0.1, bare > 0.25),
        vote(10, tails < 0.05, tails > 0.2),
        vote(10, follows < 0.1, follows > 0.3),
        vote(50, distinct > 0.4, distinct < 0.1),
        vote(20, top < 0.2, top > 0.35),
        vote(30, pairs > 0.6, pairs < 0.2),
    )


def packed_votes(text: str | None) -> int:
    """The votes as one number, two bits each."""
    return sum((v + 1) << (2 * k) for k, v in enumerate(votes(text)))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """(patterns, labellers) from packed votes."""
    return ((np.asarray(patterns, np.int64)[:, None] >> (2 * np.arange(len(LABELLERS)))) & 3) - 1


def _maximised(voted: np.ndarray, bad: np.ndarray, counts: np.ndarray, belongs: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, shares of the classes, P(bad vote) [class, labeller] and P(class) of each pattern, from a start of the latter."""
    total, share, alarm, good = -np.inf, None, None, voted & ~bad
    for _ in range(rounds):
        weight = (belongs * counts[:, None]).T
        share = (weight.sum(axis=1) + 1) / (counts.sum() + len(weight))
        alarm = (weight @ bad + 1) / (weight @ voted + 2)
        logs = np.log(share)[:, None] + np.log(alarm) @ bad.T + np.log1p(-alarm) @ good.T
        whole = np.logaddexp.reduce(logs, axis=0)
        total, new = float(counts @ whole), np.exp(logs - whole).T
        moved = np.abs(new - belongs).max(initial=0)
        belongs = new
        if moved < 1e-9:
            break
    return total, share, alarm, belongs


def estimate(patterns: np.ndarray, counts: np.ndarray, kinds: np.ndarray | None = None, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the classes, P(a labeller that votes says bad) [class, labeller], and P(good) of each pattern.

    The classes are the good documents, first, and one for each kind of fault; kinds: the kind of fault that each labeller looks for most. With a
    single bad class faults that exclude each other could not be bad together. No vote is no evidence; good votes and bad votes are. A
    Beta(2, 2) prior on every probability keeps it from 0 and 1, whatever the labellers' names. EM finds a local maximum, so it
    goes from three starts (a document has the fault of which most votes of that kind complain, if any, half or three quarters of them do),
    of which that with the highest likelihood counts. In the end the class of which labellers complain least is the good one.
    """
    patterns, counts = np.asarray(patterns), np.asarray(counts, float)
    kinds = KINDS if kinds is None else np.asarray(kinds)
    voted, bad = patterns != NONE, patterns == BAD
    member = np.equal.outer(np.arange(kinds.max() + 1), kinds).astype(float)
    part = (bad @ member.T) / np.maximum(1, voted @ member.T)
    found = []
    for least in (1e-9, 0.5, 0.75):
        at = np.where(part.max(axis=1) >= least, 1 + part.argmax(axis=1), 0)
        start = np.full((len(patterns), len(member) + 1), 0.05 / len(member))
        start[np.arange(len(at)), at] = 0.95
        found.append(_maximised(voted, bad, counts, start, rounds))
    _, share, alarm, belongs = max(found, key=lambda f: f[0])
    order = np.argsort(alarm.mean(axis=1), kind="stable")
    return share[order], alarm[order], belongs[:, order[0]]


def features(text: str | None) -> np.ndarray:
    """Counts of the hashed words, word shapes and repeats of the word before, scaled to unit length, or less for short texts."""
    codes = _codes(byte_words(text))
    own = _own(codes)
    x = np.bincount(own % FEATURES, minlength=FEATURES) + np.bincount((codes >> 32) % FEATURES, minlength=FEATURES).astype(float)
    x[_AGAIN] += (own[1:] == own[:-1]).sum()
    return x / (np.sqrt(x @ x) + DAMPING)


def _cells(text: str | None) -> bytes:
    """The features that are not 0."""
    x = features(text)
    out = np.empty(np.count_nonzero(x), _CELL)
    out["at"] = np.flatnonzero(x)
    out["x"] = x[out["at"]]
    return out.tobytes()


def fit(cells: list[np.ndarray], good: np.ndarray, rounds: int = 300, penalty: float = 1e-4, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, from the features that are not 0 of each text; both classes weigh the same."""
    weight, bias, good = np.zeros(FEATURES), 0.0, np.asarray(good, float)
    if not len(cells):
        return weight, bias
    flat = np.concatenate(cells)
    at, x, row = flat["at"].astype(np.int64), flat["x"].astype(float), np.repeat(np.arange(len(cells)), list(map(len, cells)))
    each = np.where(good >= 0.5, 1 / max(1.0, (good >= 0.5).sum()), 1 / max(1.0, (good < 0.5).sum())) / 2
    speed, speed_b = np.zeros(FEATURES), 0.0
    for _ in range(rounds):
        z = np.bincount(row, x * weight[at], len(cells)) + bias
        off = each * (1 / (1 + np.exp(-z)) - good)
        speed = 0.9 * speed + (np.bincount(at, x * off[row], FEATURES) + penalty * weight)
        speed_b = 0.9 * speed_b + off.sum()
        weight, bias = weight - rate * speed, bias - rate * speed_b
    return weight, float(bias)


def _voted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Two hashes that order the documents, and each one's packed votes."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        remembering("weak_quality", _words)
        return pd.Series([packed_votes(t) for t in texts], dtype="int64")

    text_ = F.col(f"`{text}`")
    return docs.select(F.xxhash64(F.col(f"`{doc_id}`")).alias("h"), F.xxhash64(text_).alias("h2"), run(text_).alias("v"))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, whose sigmoid is P(good)."""
    voted = checkpointed(_voted(docs, doc_id, text))
    table = voted.groupBy("v").count().orderBy("v").collect()
    if not table:
        return np.zeros(FEATURES), 0.0
    share, _, good = estimate(unpacked([r[0] for r in table]), np.array([r[1] for r in table], float))
    posterior = {r[0]: float(g) for r, g in zip(table, good, strict=True)}
    # half of the sample from either side, as far as it has documents
    chosen = None
    for side in (True, False):
        patterns = [p for p, g in posterior.items() if (g >= 0.5) == side]
        if patterns:
            some = voted.join(F.broadcast(docs.sparkSession.createDataFrame([(p,) for p in patterns], "v long")), "v")
            some = some.orderBy("h", "h2").limit(sample_rows // 2)
            chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.dropDuplicates(["h", "h2"])

    @F.pandas_udf("binary")
    def cells(texts: pd.Series) -> pd.Series:
        remembering("weak_quality", _words)
        return pd.Series([_cells(t) for t in texts], dtype=object)

    text_ = F.col(f"`{text}`")
    rows = docs.select(F.xxhash64(F.col(f"`{doc_id}`")).alias("h"), F.xxhash64(text_).alias("h2"), text_.alias("text"))
    rows = rows.join(F.broadcast(chosen), ["h", "h2"]).select("h", "h2", "v", cells("text").alias("cells")).dropDuplicates(["h", "h2"]).toArrow()
    rows = rows.sort_by([("h", "ascending"), ("h2", "ascending")])
    weight, bias = fit([np.frombuffer(c.as_buffer(), _CELL) for c in rows["cells"]], np.array([posterior[v] for v in rows["v"].to_pylist()]))
    # the classes weigh the same in the fit: the corpus's own odds come back, so that scores are probabilities and a few words decide nothing
    return weight, bias + float(np.log(share[0]) - np.log1p(-share[0]))


def scores(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> Column:
    """P(good) of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        weight, bias = sent.value
        remembering("weak_quality", _words)
        return pd.Series([1 / (1 + np.exp(-(features(t) @ weight + bias))) for t in texts], dtype="float64")

    return run(F.col(f"`{text}`"))


def classify(docs: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (probability of good quality) and kept (score at least ``threshold``) of each row."""
    model = train(docs, sample_rows, doc_id, text)
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), scores(docs, model, text).alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)


def accepted(docs: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the classifier keeps."""
    model = train(docs, sample_rows, doc_id, text)
    return packed(docs, text).withColumn("score__", scores(docs, model, text)).where(F.col("score__") >= threshold).select("row__.*")
