"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a pre-token the table stores the one token that can end its encoding. That token is unique:
a token sequence is the BPE encoding of its bytes exactly if each token is reachable by merges and each adjacent pair
stays unmerged when the two are encoded together. So a prefix's entry needs only the entries of shorter prefixes,
appending bytes keeps every earlier entry, and an edit recomputes entries only until they fall into step again.

Null and empty texts have no tokens and decode to no bytes. Texts of any length are handled piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import remembering

#: Distinct pieces (some 250 bytes each) and pairs that a worker remembers before it starts afresh.
MEMORY, PAIRS = 400_000, 500_000
#: Pieces handled at once; bounds memory for very long texts.
CHUNK = 50_000
#: Largest vocabulary file that is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
NEVER = 1 << 60


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every end of every token; the rank where that end is a token too, else -1.
        self.tails = {token[k:]: -1 for token in ranks for k in range(len(token))} | ranks
        self._left: dict[int, list[tuple[bytes, int]]] = {}
        self._right: dict[int, list[tuple[bytes, int]]] = {}
        self._halves: dict[int, tuple[bytes, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._decimals = {rank: str(rank) for rank in self.bytes_of}

    @classmethod
    def load(cls, data: bytes) -> Vocabulary:
        """From lines of base64 token and rank."""
        ranks = {}
        for line in data.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks)

    def halves(self, token: int) -> tuple[bytes, ...]:
        """The two byte strings whose merge makes the token; one for a byte; more where merges never reach it."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = tuple(parts)
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.halves(token)) <= 2

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Parts that lie at one end of the token while it is built, each with the rank of the merge that ends it."""
        known = self._right if side else self._left
        if token not in known:
            edge, limit, part = [], NEVER, token
            while True:
                edge.append((self.bytes_of[part], limit))
                halves = self.halves(part)
                if len(halves) < 2:
                    break
                part, limit = self.ranks[halves[-1 if side else 0]], part
            known[token] = edge
        return known[token]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens, encoded together, stay as they are.

        They do not if parts facing each other at their border would merge before either is taken up in its own
        token; of equal ranks the left merge comes first.
        """
        key = first << 32 | second
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._stay(first, second)
        return known

    def _stay(self, first: int, second: int) -> bool:
        if not self.reachable(second):
            return False
        rank, right = self.ranks.get, self._edge(second, 0)
        for a, a_ends in self._edge(first, 1):
            for b, b_ends in right:
                merged = rank(a + b)
                if merged is not None and merged < a_ends and merged <= b_ends:
                    return False
        return True

    def last_token(self, piece: bytes, end: int, table: list[int]) -> int:
        """The token that ends the encoding of piece[:end], from the entries of shorter prefixes."""
        tails, pairs, found = self.tails, self._pairs, []
        for start in range(end - 1, -1, -1):
            token = tails.get(piece[start:end])
            if token is None:
                break
            if token >= 0:
                found.append((start, token))
        # unreachable tokens are not compatible with anything; see compatible()
        while found:
            start, token = found.pop()
            if start:
                before = table[start]
                stays = pairs.get(before << 32 | token)
                if stays or stays is None and self.compatible(before, token):
                    return token
            elif self.reachable(token):
                return token
        raise AssertionError("every prefix has an encoding")

    def table(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """Entry k: last token of the first k bytes (entry 0 is unused). ``known``: entries of a common prefix."""
        table, last = list(known) if known else [-1], self.last_token
        for end in range(len(table), len(piece) + 1):
            table.append(last(piece, end, table))
        return table

    def whole_table(self, piece: bytes) -> list[int]:
        """table() of a piece at once: an automaton names the tokens that end at each byte, the longest first."""
        table, pairs, sizes, halves = [-1] * (len(piece) + 1), self._pairs, self.sizes, self._halves
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            end = last + 1
            if table[end] >= 0:
                continue
            start = end - sizes[token]
            if start:
                stays = pairs.get(table[start] << 32 | token)
                if stays is None:
                    stays = self.compatible(table[start], token)
            else:
                known = halves.get(token)
                stays = self.reachable(token) if known is None else len(known) <= 2
            if stays:
                table[end] = token
        return table

    def read(self, table: list[int]) -> tuple[int, ...]:
        out, end = [], len(table) - 1
        while end:
            out.append(table[end])
            end -= len(self.bytes_of[table[end]])
        return tuple(out[::-1])

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """A piece that is itself a token stays whole, whether or not merges reach it."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self.read(self.whole_table(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Piece:
    """One pre-token that can be appended to and edited without encoding it from the start."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.table = vocabulary.table(data)

    @property
    def ids(self) -> tuple[int, ...]:
        whole = self.vocabulary.ranks.get(self.data)
        return (whole,) if whole is not None else self.vocabulary.read(self.table)

    def append(self, more: bytes) -> None:
        self.data += more
        self.table = self.vocabulary.table(self.data, self.table)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` for data[start:end]; returns how many entries were computed anew.

        Entries before ``start`` stay. After the new bytes, entries are computed until as many in a row as the longest
        token has bytes equal the old ones: from there on, all that an entry depends on is the same.
        """
        old, shift = self.table, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        table, same = old[: start + 1], 0
        for at in range(start + 1, len(self.data) + 1):
            table.append(self.vocabulary.last_token(self.data, at, table))
            same = same + 1 if at > start + len(new) and table[at] == old[at - shift] else 0
            if same >= self.vocabulary.longest:
                table.extend(old[at - shift + 1 :])
                break
        self.table, done = table, at - start if start < len(self.data) else 0
        return done


class _Pieces(dict):
    """Ids of pieces, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMORY:
            self.clear()
        got = self[piece] = self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return got


class Codec:
    """Whole texts: pre-tokens by a pattern, each encoded separately, with the results of frequent pieces kept."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known = _Pieces(vocabulary)

    def _chunks(self, text: str) -> Iterator[list[int]]:
        if len(text) <= CHUNK:
            yield list(chain.from_iterable(map(self.known.__getitem__, self.pattern.findall(text))))
            return
        found = self.pattern.finditer(text)
        while some := [m.group() for m in islice(found, CHUNK)]:
            yield list(chain.from_iterable(map(self.known.__getitem__, some)))

    def encode(self, text: str | None) -> list[int]:
        return [i for chunk in self._chunks(text or "") for i in chunk]

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of text + more from those of text: only the last four pieces can change, all before are kept."""
        starts = [m.start() for m in self.pattern.finditer(text)]
        cut = starts[-4] if len(starts) > 4 else 0
        kept = ids[: len(ids) - len(self.encode(text[cut:]))]
        return kept + self.encode(text[cut:] + more)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Token count, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
        count, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self._chunks(text or ""):
            if ids:
                ids_hash.update((("," if count else "") + ",".join(map(self.vocabulary._decimals.__getitem__, ids))).encode())
                bytes_hash.update(self.vocabulary.decode(ids))
                count += len(ids)
        return count, ids_hash.hexdigest(), bytes_hash.hexdigest()


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec for each worker process."""
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary.load(data), pattern)
    codec = _codecs[key]
    remembering("bpe", codec.known, codec.vocabulary._pairs)
    return codec


def _shipped(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; a vocabulary of at most {MAX_VOCABULARY_BYTES} is broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows with a further column of token ids (array of int); replaces a column of that name."""
    data = _shipped(docs, vocabulary)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        codec = _codec(data.value, pattern)
        return pd.Series([codec.encode(t) for t in texts])

    return docs.withColumn(ids, run(F.col(f"`{text}`")))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows with the bytes that the ids stand for (binary; null ids: no bytes)."""
    data = _shipped(encoded, vocabulary)

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        vocabulary = _codec(data.value, "").vocabulary
        return pd.Series([vocabulary.decode([] if x is None else x) for x in lists])

    return encoded.withColumn(out, run(F.col(f"`{ids}`")))


def digests(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encodes, then decodes the ids.

    Repeated rows stay repeated; a null doc_id stays null.
    """
    data = _shipped(docs, vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        codec = _codec(data.value, pattern)
        return pd.DataFrame([codec.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    def column(name: str) -> Column:
        return F.col(f"`{name}`")

    return docs.select(column(doc_id).alias("doc_id"), run(column(text)).alias("got")).select("doc_id", "got.*")
