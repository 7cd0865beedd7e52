"""Encoding of whole texts with a public byte-level BPE vocabulary, by vectorised merging.

Texts are cut by the vocabulary's pattern. The distinct pre-tokens of a batch, bucketed by length, form
padded matrices of token ids; in each round every row looks up its adjacent pairs in an open-addressing hash table,
merges its leftmost pair of minimum rank, and rows without a mergeable pair leave the matrix (compaction). Very long
pre-tokens, of which a matrix would take as many rounds as they have characters, merge in each round every occurrence of
their pair of minimum rank from left to right, which gives the same ids: a merged token has a later rank than its parts.

Defined cases: null and empty texts give an empty list; blank texts have the ids of their blanks; special tokens'
strings are ordinary text; texts are never cut short; repeated rows each come out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.session import map_rows

#: folder of the vocabulary files, a parameter of every function here; files are named NAME.tiktoken (base64 token and rank a line).
TOKENIZERS = "/opt/tokenizers"

# The pattern that cuts texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# end of fixed values

_NONE = np.int32(2**31 - 1)
#: pre-tokens with more bytes than this are merged by all occurrences a round.
LONG = 512
#: pre-tokens whose ids a worker remembers; at this many it forgets all and goes on.
REMEMBERED = 300_000


class PairTable:
    """Pairs of token ids to the id of their concatenation: open addressing in two arrays, looked up for whole matrices."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray):
        self.bits = max(4, int(len(a) * 2 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int32)
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = (self._hash(keys[left]) + step) & (size - 1)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several that want a slot, the last has it
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = c[left[won]]
            left, step = left[~won], step + 1
        self.probes = step

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair's concatenation, or the greatest int32."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        flat = keys.ravel()
        slot = self._hash(flat)
        found = self.keys[slot]
        out = np.where(found == flat, self.values[slot], _NONE)
        open_ = np.nonzero((found != flat) & (found != -1))[0]
        for step in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + step) & (len(self.keys) - 1)
            f = self.keys[s]
            hit = f == flat[open_]
            out[open_[hit]] = self.values[s[hit]]
            open_ = open_[~hit & (f != -1)]
        return out.reshape(keys.shape)


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.find = regex.compile(pattern).findall
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        a, b, c = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (x := ranks.get(token[:i])) is not None and (y := ranks.get(token[i:])) is not None:
                    a.append(x), b.append(y), c.append(rank)
        self.pairs = PairTable(np.array(a), np.array(b), np.array(c, np.int32))
        self.known: dict[str, np.ndarray] = {}

    def _long(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) != _NONE:
            at = np.nonzero(ranks == low)[0]
            run = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]  # of overlapping pairs, the leftmost, and so on
            ids = ids.copy()
            ids[at] = low
            ids = np.delete(ids, at + 1)
            new = at - np.arange(len(at))  # where the merged tokens are now
            ranks = np.delete(ranks, np.minimum(at + 1, len(ranks) - 1)) if at[-1] + 1 < len(ranks) else np.delete(ranks, np.append(at[:-1] + 1, at[-1]))
            near = np.unique(np.concatenate([new, new - 1]))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            ranks[near] = self.pairs.ranks(ids[near], ids[near + 1])
        return ids

    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of one length bucket."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        m = np.full((n, width), -1, np.int32)
        m[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        rows = np.arange(n)
        while True:
            if m.shape[1] > 1:
                # a pair with padding is in no table: the padding's key differs from all
                ranks = self.pairs.ranks(m[:, :-1], m[:, 1:])
                ranks[m[:, 1:] < 0] = _NONE
                at = ranks.argmin(axis=1)  # the leftmost of the least
                low = ranks[np.arange(len(m)), at]
                done = low == _NONE
            else:
                done = np.ones(len(m), bool)
            if done.any():
                for r, row in zip(rows[done], m[done]):
                    out[r] = row[: np.count_nonzero(row >= 0)]
                if done.all():
                    return out
                m, rows, at, low = m[~done], rows[~done], at[~done], low[~done]
            k = np.arange(len(m))
            m[k, at] = low
            keep = np.ones(m.shape, bool)
            keep[k, at + 1] = False
            m = m[keep].reshape(len(m), -1)
            longest = int((m >= 0).sum(axis=1).max())
            if longest < m.shape[1]:
                m = m[:, :longest]

    def words(self, words: list[str]) -> None:
        """Makes the ids of words known."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        buckets: dict[int, list[str]] = {}
        for w in words:
            n = len(w.encode())
            if n > LONG:
                self.known[w] = self._long(self.byte[np.frombuffer(w.encode(), np.uint8)])
            else:
                buckets.setdefault(n if n < 16 else 16 + (n - 16) // 8 if n < 128 else 30 + n // 64, []).append(w)
        for bucket in buckets.values():
            step = max(1, 2_000_000 // max(len(w.encode()) for w in bucket))
            for i in range(0, len(bucket), step):
                some = bucket[i : i + step]
                self.known.update(zip(some, self._matrix([w.encode() for w in some])))

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.find(t) if t else [] for t in texts]
        new = list({w for ws in cut for w in ws} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            new = list({w for ws in cut for w in ws})
        self.words(new)
        known = self.known
        return [np.concatenate([known[w] for w in ws]) if ws else np.zeros(0, np.int32) for ws in cut]


_encoders: dict[str, Encoder] = {}
_sent: set[tuple[str, str]] = set()


def encoder(name: str, folder: str | None = TOKENIZERS) -> Encoder:
    """The encoder of a vocabulary in a folder; without one, of a vocabulary that was sent to this worker."""
    path = os.path.join(folder, f"{name}.tiktoken") if folder else SparkFiles.get(f"{name}.tiktoken")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def send(spark: SparkSession, name: str, folder: str) -> None:
    """Sends a vocabulary (some megabytes) to the executors, once in an application, so that only the driver needs the folder."""
    key = (spark.sparkContext.applicationId, f"{folder.rstrip('/')}/{name}.tiktoken")
    if key not in _sent:
        spark.sparkContext.addFile(key[1])
        _sent.add(key)


def _batches(texts: pd.Series, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some four million characters, so that working memory doesn't grow with the batch."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(rows: DataFrame, key: str, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row."""
    send(rows.sparkSession, name, folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(name, None)
        for pdf in parts:
            for a, b in _batches(pdf["_t"]):
                yield pd.DataFrame({key: pdf[key].iloc[a:b], "ids": e.texts([t if isinstance(t, str) else None for t in pdf["_t"].iloc[a:b]])})

    return map_rows(rows, [key], [F.col(text).alias("_t")], run, "ids array<int>")


def lengths(rows: DataFrame, key: str, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) of every row; ids don't leave the workers."""
    send(rows.sparkSession, name, folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(name, None)
        for pdf in parts:
            for a, b in _batches(pdf["_t"]):
                yield pd.DataFrame({key: pdf[key].iloc[a:b], "n_tokens": [len(x) for x in e.texts([t if isinstance(t, str) else None for t in pdf["_t"].iloc[a:b]])]})

    return map_rows(rows, [key], [F.col(text).alias("_t")], run, "n_tokens long")
