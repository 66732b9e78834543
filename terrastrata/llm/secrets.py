"""Secret scans: candidates by patterns, false positives taken out by a random forest.

The forest judges each candidate by its length, by the transitions between its characters (how often the kind of
character changes, how likely its letter pairs are in plain words, its entropy), by how much of it a dictionary
covers, by the path it was found under, and by the words beside it. It is trained from labelled findings, which a
caller can pass; ``labelled_findings`` makes a set of known keys, random tokens and passwords against checksums,
identifiers, placeholders, plain words and numbers.

Whole texts are scanned, and a candidate is a value whole, however long it is; a candidate that an assignment and a bare pattern both find is reported once. Null and empty texts
have none. A null path counts as an empty one, a null doc_id is carried along, repeated rows are reported each.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import uuid
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of candidates, in the order in which overlapping ones are preferred.
PATTERNS = (
    ("access_key", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])")),
    ("assigned", re.compile(r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?[ \t]{0,2}[:=][ \t]{0,2}["']?([^\s"',;]{6,})""")),
    ("token", re.compile(r"(?<![A-Za-z0-9+/_\-])([A-Za-z0-9+/_\-]{20,}={0,2})(?![A-Za-z0-9+/_\-])")),
)
#: Words that speak for and against a secret when beside a candidate or in its path.
FOR = ("password", "passwd", "pwd", "secret", "token", "key", "api", "auth", "bearer", "credential", "access")
AGAINST = ("sha", "sha1", "sha256", "md5", "checksum", "commit", "hash", "uuid", "guid", "id", "digest", "etag", "example", "sample", "dummy", "placeholder", "test")
PATH_AGAINST = ("test", "tests", "example", "examples", "doc", "docs", "fixture", "fixtures", "sample", "vendor", "lock")
#: Plain words of names, placeholders and prose; the dictionary of the coverage feature and of the letter pairs.
DICTIONARY = tuple(
    "the and that with from this have not are was for you all can has had his her one our out day get use man new now old see him how its who did yes "
    "your here change changeme example password secret token value name user default none null true false test admin login local host server client "
    "service config setting settings manager factory handler controller request response message string number array object class method function index "
    "table column row field page file path folder directory image button window label title header footer content container element component module "
    "package version release build update create delete insert select remove append process thread worker queue cache memory buffer stream reader writer "
    "parser format encode decode public private static final abstract interface implementation application information international development "
    "environment production staging account customer order product invoice payment address street country language translation description category".split()
)
FEATURES = ("length", "digits", "upper", "lower", "other", "changes", "pairs", "entropy", "distinct", "covered", "hex", "words_for", "words_against", "path_against", "path_depth", "assigned", "known")


def _pair_table() -> dict[str, float]:
    seen = Counter(w[k : k + 2] for w in DICTIONARY for k in range(len(w) - 1))
    total = sum(seen.values())
    return {p: math.log((n + 0.5) / (total + 338)) for p, n in seen.items()}


_PAIRS = _pair_table()
_RARE = math.log(0.5 / (sum(1 for w in DICTIONARY for _ in w) + 338))
_LONG_WORDS = sorted({w for w in DICTIONARY if len(w) >= 3}, key=lambda w: (-len(w), w))
_WORD = re.compile("|".join(_LONG_WORDS))


def describe(kind: str, value: str, before: str, after: str, path: str) -> list[float]:
    """The features of a candidate, in the order of FEATURES."""
    n, low = len(value), value.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    count = Counter(kinds)
    pairs = [_PAIRS.get(low[k : k + 2], _RARE) for k in range(n - 1) if low[k : k + 2].isalpha()]
    letters = Counter(value)
    beside = re.findall(r"[a-z0-9]+", f"{before} {after}".lower())
    folders = re.findall(r"[a-z0-9]+", path.lower())
    return [
        n,
        count["d"] / n,
        count["u"] / n,
        count["l"] / n,
        count["o"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        sum(pairs) / len(pairs) if pairs else _RARE,
        -sum(c / n * math.log2(c / n) for c in letters.values()),
        len(letters) / n,
        sum(len(m) for m in _WORD.findall(low)) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))),
        sum(w in FOR for w in beside),
        sum(w in AGAINST for w in beside),
        sum(w in PATH_AGAINST for w in folders),
        path.count("/"),
        float(kind == "assigned"),
        float(kind == "access_key"),
    ]


def candidates(text: str | None, beside: int = 40) -> list[tuple[str, int, str, str, str]]:
    """(kind, start, value, text before, text after); later kinds don't repeat what an earlier one has found."""
    text, starts, ends, out = text or "", [], [], []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if kind == "token" and not (any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])):
                continue
            # what earlier kinds have found does not overlap: only the last that starts before the end can reach into this
            k = bisect_left(starts, b)
            if not k or ends[k - 1] <= a:
                out.append((kind, a, m[1], text[max(0, a - beside) : a], text[b : b + beside]))
        spans = sorted((s, s + len(v)) for _, s, v, *_ in out)
        starts, ends = [s for s, _ in spans], [e for _, e in spans]
    return sorted(out, key=lambda c: c[1])


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.share[at]
            rows = np.flatnonzero(inner)
            f = self.feature[at[rows]]
            at[rows] = np.where(x[rows, f] <= self.cut[at[rows]], self.left[at[rows]], self.right[at[rows]])


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Tree:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, deep: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if deep == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return me
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], np.cumsum(y[rows][order])
            n = np.arange(1, len(rows))
            p, q = t[:-1] / n, (t[-1] - t[:-1]) / (len(rows) - n)
            gini = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
            gini[(v[1:] == v[:-1]) | (n < least) | (len(rows) - n < least)] = np.inf
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (gini[k], int(f), v[k])
        if best[1] < 0:
            return me
        lower = x[rows, best[1]] <= best[2]
        a, b = grow(rows[lower], deep + 1), grow(rows[~lower], deep + 1)
        nodes[me][:4] = [best[1], best[2], a, b]
        return me

    grow(rng.integers(0, len(x), len(x)), 0)
    f, c, a, b, s = (np.array(column) for column in zip(*nodes, strict=True))
    return Tree(f.astype(np.int64), c, a.astype(np.int64), b.astype(np.int64), s)


def forest(findings: list[tuple[str, str, str, str, str, int]], trees: int = 40, depth: int = 10, least: int = 3, seed: int = 42) -> list[Tree]:
    """From labelled findings (kind, value, before, after, path, 1 for a secret)."""
    if not findings:
        raise ValueError("no labelled findings")
    x, y = np.array([describe(*f[:5]) for f in findings], float), np.array([f[5] for f in findings], float)
    return [_grow(x, y, np.random.default_rng(seed + k), depth, least) for k in range(trees)]


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean share of secrets in the leaves; a forest of one class gives that class."""
    return np.mean([t.predict(x) for t in trees], axis=0) if len(x) else np.empty(0)


def labelled_findings(count: int = 2400, seed: int = 7) -> list[tuple[str, str, str, str, str, int]]:
    """A deterministic labelled set, half of it secrets."""
    r = random.Random(seed)
    prose = [w for w in DICTIONARY if w not in FOR + AGAINST]
    words = lambda n: " ".join(r.choice(prose) for _ in range(n))
    code = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    hexes, capitals, every = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    paths = ["", "src", "src0", "src/app/config.py", "deploy/prod/settings.yaml", "web/pages"]
    tests = ["tests/unit/data.py", "docs/examples/setup.md", "vendor/lib/package.lock"]
    out = []
    for k in range(count // 2):
        name = r.choice(["password", "passwd", "secret", "token", "api_key"])
        sign = r.choice(["=", ": ", " = ", '="', ' = "'])
        secret = [
            ("access_key", "AKIA" + code(capitals, 16), words(3) + " ", " " + words(3)),
            ("assigned", code(hexes, r.choice([16, 18, 20, 24, 32, 40, 64])), f"{words(2)} {name}{sign}", '" ' + words(2)),
            ("assigned", code(every + "!@#%", r.randint(10, 24)), f"{words(2)} {name}{sign}", " " + words(2)),
            ("token", r.choice(["ghp_", "sk_live_", "xoxb-"]) + code(every, r.randint(24, 36)), f"{words(2)} {r.choice(['auth', 'bearer', 'token'])} ", " " + words(2)),
            ("token", code(every, r.randint(32, 44)), f"{r.choice(['api key', 'access token', 'auth bearer'])} ", " " + words(2)),
        ][k % 5]
        out.append((*secret, r.choice(paths), 1))
        word = r.choice(prose)
        harmless = [
            ("token", hashlib.sha1(str(k).encode()).hexdigest(), f"{r.choice(['commit', 'sha1', 'hash', 'checksum'])} ", " " + words(3)),
            ("token", str(uuid.UUID(int=r.getrandbits(128))), f"{r.choice(['uuid', 'id', 'guid'])} ", " " + words(2)),
            ("assigned", r.choice(["changeme", "your_token_here", "xxxxxxxx", "********", "<password>", "${PASSWORD}", "example_value", "undefined"]), f"{words(2)} {name}{sign}", " " + words(2)),
            ("assigned", f"{word}{r.choice(['.', '_', '()'])}{r.choice(prose)}", f"{words(2)} {name}{sign}", " " + words(2)),
            ("token", "_".join(r.choice(prose) for _ in range(4)) + str(r.randint(1, 99)), words(3) + " ", " " + words(3)),
            ("token", base64.b64encode(words(5).encode()).decode().rstrip("="), f"{r.choice(['example', 'digest', 'sample'])} ", " " + words(2)),
            ("token", "/".join(r.choice(prose) for _ in range(5)) + "/" + str(r.randint(1, 2030)), words(2) + " ", " " + words(2)),
            ("access_key", "AKIA" + r.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "0000000000000000"]), f"{words(2)} example ", " " + words(2)),
        ][k % 8]
        out.append((*harmless, r.choice(paths + tests), 0))
    for k in range(count // 20):  # keys, signatures and signed tokens of any length against encoded prose, listings and data
        n, name = round(math.exp(r.uniform(math.log(64), math.log(4000)))), r.choice(["secret", "token", "api_key"])
        secret = [
            ("token", "eyJhbGciOiJSUzI1NiJ9" + code(every + "-_", n), f"{r.choice(['auth', 'bearer', 'access token'])} ", " " + words(2)),
            ("token", "MII" + code(every + "+/", n) + r.choice(["", "=", "=="]), f"{words(2)} {r.choice(['key', 'secret key', 'api key'])} ", " " + words(2)),
            ("assigned", code(every + r.choice(["", "+/", "-_."]), n), f"{words(2)} {name}{r.choice(['=', ': ', ' = '])}", " " + words(2)),
        ][k % 3]
        out.append((*secret, r.choice(paths), 1))
        harmless = [
            ("token", base64.b64encode(words(1 + n // 5).encode()).decode().rstrip("="), f"{r.choice(['example', 'digest', 'sample'])} ", " " + words(2)),
            ("token", "/".join(r.choice(prose) for _ in range(2 + n // 7)) + "/" + str(r.randint(1, 2030)), words(2) + " ", " " + words(2)),
            ("token", code(hexes, n), f"{r.choice(['checksum', 'hash', 'digest', 'sha256'])} ", " " + words(2)),
            ("assigned", "_".join(r.choice(prose) for _ in range(2 + n // 7)), f"{words(2)} {name}{r.choice(['=', ': ', ' = '])}", " " + words(2)),
        ][k % 4]
        out.append((*harmless, r.choice(paths + tests), 0))
    return out


def scan(docs: DataFrame, trees: list[Tree] | None = None, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, kind, start (characters before it), length, value_sha256, score and secret of each candidate."""
    sent = docs.sparkSession.sparkContext.broadcast(trees if trees is not None else forest(labelled_findings()))

    @F.pandas_udf("array<struct<kind:string,start:long,length:long,value_sha256:string,score:double>>")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        found = [candidates(t) for t in texts]
        x = np.array([describe(k, v, b, a, p or "") for some, p in zip(found, paths, strict=True) for k, _, v, b, a in some], float)
        scores = iter(predict(sent.value, x).tolist())
        return pd.Series(
            [
                [{"kind": k, "start": s, "length": len(v), "value_sha256": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "score": next(scores)} for k, s, v, *_ in some]
                for some in found
            ]
        )

    where = F.col(f"`{path}`").cast("string") if path else F.lit("")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(run(F.col(f"`{text}`"), where)).alias("found")).select("doc_id", "found.*")
    return rows.withColumn("secret", F.col("score") >= threshold)
