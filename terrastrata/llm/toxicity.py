"""Toxicity: a classifier regularised by counterfactuals.

For labelled texts that mention a group, the mention is swapped for every other term of its group and so for a neutral word, and the
training penalises the squared change of the score. So a mention as such gains no weight, even if the labelled toxic
texts have more of them, and neutral mentions are no false positives. ``Model.pairs`` is the number of swapped texts it was trained with: where
no labelled text mentions a group there are none, and the model is the plain one.

Features are a text's distinct words, in lower case without punctuation, and the words' first four and five letters,
by their hashes. Those whose share differs most between the classes, beyond chance, enter a logistic regression. It is fitted on a bounded
sample of ``sample_rows`` labelled documents (the smallest hashed ids; of rows that repeat an id one with the smallest hash of its text); every whole text is then scored.

A null or empty text has no features and the score of the bias. Of several labels of a document the largest counts;
null labels and ids teach nothing. Rows without an id are not held out. With labels of one class only, or none, all
scores equal the smoothed share of toxic labels.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import remembering

SAMPLE_ROWS = 8000
HASHES = 1 << 22
#: Groups of terms that can stand for each other; the last of each is neutral.
IDENTITY_TERMS = (
    ("women", "men", "gays", "lesbians", "muslims", "christians", "jews", "immigrants", "refugees", "blacks", "whites", "people"),
    ("woman", "man", "girl", "boy", "muslim", "christian", "jew", "immigrant", "refugee", "person"),
    ("gay", "straight", "lesbian", "black", "white", "asian", "african", "jewish", "islamic", "old", "some"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "gens"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "leute"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "gente"),
)
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»„“”‘’…–—¿¡"
_known: dict[str, tuple[int, ...]] = {}


def _features(word: str) -> tuple[int, ...]:
    got = _known.get(word)
    if got is None:
        if len(_known) > 1 << 19:
            _known.clear()
        plain = word.lower().strip(_EDGE)
        parts = ["=" + plain] + [f"{n}{plain[:n]}" for n in (4, 5) if len(plain) > n] if plain else []
        got = _known[word] = tuple(zlib.crc32(p.encode("utf-8", "replace")) % HASHES for p in parts)
    return got


def features(text: str | None) -> set[int]:
    out: set[int] = set()
    for word in set((text or "").split()):
        out.update(_features(word))
    return out


def swapped(text: str | None, groups=IDENTITY_TERMS) -> list[str]:
    """The text with its group mentions swapped, once for each step through the groups: each mention meets every other term of its own."""
    if not text:
        return []
    place = {term: (g, k) for g, group in enumerate(groups) for k, term in enumerate(group)}
    found = re.compile(r"\w+")
    sizes = [len(groups[place[w][0]]) for w in {w.lower() for w in found.findall(text)} if w in place]

    def swap(shift: int):
        def one(m: re.Match) -> str:
            at = place.get(m.group().lower())
            return m.group() if at is None else groups[at[0]][(at[1] + shift) % len(groups[at[0]])]

        return one

    return [found.sub(swap(shift), text) for shift in range(1, max(sizes, default=1))]


def changes(text: str | None, groups=IDENTITY_TERMS) -> list[tuple[list[int], list[int]]]:
    """Features that each swap adds, and those that it takes away."""
    swaps = swapped(text, groups)
    own = features(text) if swaps else set()
    return [(sorted(s - own), sorted(own - s)) for s in map(features, swaps)]


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0

    def score(self, found: set[int], table: dict[int, float]) -> float:
        z = self.bias + sum(table[f] for f in found if f in table)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[np.ndarray], toxic: np.ndarray, others: list[tuple[int, list[int], list[int]]], least: float = 5.0, most: int = 2000, balance: float = 5.0, rounds: int = 400, penalty: float = 1e-3) -> Model:
    """Logistic regression over chosen features. texts: distinct features of each text; others: a text's number, the features that a swap adds, and those it takes.

    balance: weight of the squared changes of the score before the logistic function; the swaps of a text share its weight.
    """
    toxic = np.asarray(toxic, float)
    n, p = len(texts), float(toxic.sum())
    if not 0 < p < n:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log((p + 1) / (n - p + 1))), len(others))
    ids, place = np.unique(np.concatenate(texts), return_inverse=True)
    all_ = np.bincount(place, minlength=len(ids))
    inside = np.bincount(place, np.repeat(toxic, [len(t) for t in texts]), len(ids))
    del place
    rate = all_ / n
    spread = np.sqrt(np.maximum(rate * (1 - rate) * (1 / p + 1 / (n - p)), 1e-12))
    z = np.where(all_ >= 5, np.abs(inside / p - (all_ - inside) / (n - p)) / spread, 0)
    strong = np.flatnonzero(z >= least)
    chosen = np.sort(ids[strong[np.argsort(-z[strong], kind="stable")[:most]]])

    def columns(some: np.ndarray) -> np.ndarray:
        at = np.searchsorted(chosen, some)
        at = at[at < len(chosen)] if len(chosen) else at[:0]
        return at[np.isin(chosen[at], some)]

    x = np.zeros((n, len(chosen)), np.float32)
    for k, s in enumerate(texts):
        x[k, columns(s)] = 1
    # changes of features by swaps: row, column and sign of those that are not 0
    cells = [(r, c, sign) for r, (_, more, less) in enumerate(others) for sign, some in ((1.0, more), (-1.0, less)) for c in columns(np.array(some, np.int64))]
    row, column, sign = (np.array(v) for v in zip(*cells, strict=True)) if cells else (np.empty(0, np.int64),) * 3
    swaps = np.bincount([k for k, *_ in others], minlength=n) if others else np.ones(n)
    share = np.array([1 / swaps[k] for k, *_ in others])
    w, b, rate_ = np.zeros(len(chosen)), 0.0, 1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        w32 = w.astype(np.float32)  # else the matrix would be cast in each round
        off = (1 / (1 + np.exp(-np.clip(x @ w32 + b, -40, 40))) - toxic) / n
        grad, grad_b = x.T @ off.astype(np.float32) + penalty * w / len(w) if len(w) else w, off.sum()
        if cells:
            change = np.bincount(row, sign * w[column], len(others)) * share
            grad = grad + balance * 2 * np.bincount(column, sign * change[row], len(w)) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b * grad_b
        lr = 0.1 * rate_ / (1 + step / 200)
        w = w - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        b = b - lr * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-10)
    return Model(chosen, w, float(b), len(others))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, groups=IDENTITY_TERMS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on labelled rows that are not held out."""
    marks = labels.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("i").agg(F.max("y").alias("y")).where(~held_out(F.col("i")))
    # the sample is drawn from the ids alone, so that only its texts are read along
    marks = marks.orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("text")).join(F.broadcast(marks), "i")
    # one row for each id, however many repeat it: what reaches the driver is bounded by sample_rows
    rows = rows.groupBy("i", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    @F.pandas_udf("own array<int>, swaps array<struct<more:array<int>,less:array<int>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        remembering("toxicity", _known)
        return pd.DataFrame([(sorted(features(t)), [{"more": m, "less": l} for m, l in changes(t, groups)]) for t in texts], columns=["own", "swaps"])

    got = rows.select("i", "y", run("text").alias("f")).select("i", "y", "f.*").toArrow().sort_by([("i", "ascending")])
    own = [x.values.to_numpy() for x in got["own"]]
    others = [(k, s["more"], s["less"]) for k, some in enumerate(got["swaps"].to_pylist()) for s in some or []]
    return fit(own, got["y"].to_numpy(), others)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        model = sent.value
        remembering("toxicity", _known)
        table = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
        return pd.Series([model.score(features(t), table) for t in texts], dtype="float64")

    return run(F.col(f"`{text}`"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, groups=IDENTITY_TERMS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` up) of each row."""
    model = train(docs, labels, sample_rows, groups, doc_id, text, label)
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), score(docs, model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
