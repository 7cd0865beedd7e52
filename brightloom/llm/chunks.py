"""Texts over a size limit cut into pieces at natural boundaries, with a fixed overlap between consecutive pieces.

Content-defined: a rolling hash of the last characters marks landmarks, and each cut is the natural boundary nearest to
the first landmark between the least and the greatest size. A cut depends on nearby characters only, so that
an edit alters the neighbouring pieces and no others. Boundaries are ranked: the end of a paragraph, of a line or
sentence, any white space or closing mark. Where none lies within the limit, the piece is cut hard at the limit.

Sizes count Unicode code points. Defined cases: null and empty texts give no piece; a text within the limit is one
piece (pieces) or no row (oversized); texts of any length are read in blocks, so that memory grows with the text and
not with the working arrays; repeated rows each come out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import map_rows

# Unicode white space and the marks that end a sentence.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDS = [ord(c) for c in ".!?。！？"]
# end of fixed values
_LINE = [10, 11, 12, 13, 0x85, 0x2028, 0x2029]
_WIDE_ENDS = [ord(c) for c in "。！？"]
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Rule:
    """most: the size limit; overlap: characters that consecutive pieces share; least: no cut before it where another is possible;
    window: characters that a landmark's hash covers; every: one landmark is expected in so many characters; reach: how far a cut may lie from its landmark."""

    most: int = 4000
    overlap: int = 200
    least: int = 2000
    window: int = 24
    every: int = 512
    reach: int = 400

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.most // 2 or not 0 < self.least <= self.most - self.overlap:
            raise ValueError("overlap must be under half the limit, and the least size within limit minus overlap")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def landmarks(codes: np.ndarray, rule: Rule) -> np.ndarray:
    """Positions after which a rolling polynomial hash of the last `window` characters is a multiple of `every`."""
    base, w, out = np.uint64(0x9E3779B97F4A7C15), rule.window, []
    powers = np.full(_BLOCK + w + 1, base, dtype=np.uint64)
    powers[0] = 1
    n = len(codes)
    size = min(n, _BLOCK + w)
    powers = np.multiply.accumulate(powers[: size + 1])
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    back = np.full(size + 1, inverse, dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    for lo in range(0, n, _BLOCK):
        start = max(0, lo - w)
        part = (codes[start : lo + _BLOCK].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[: len(part)], dtype=np.uint64)])
        h = (sums[w:] - sums[:-w]) * back[: len(sums) - w] if len(part) >= w else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        at = np.nonzero((h >> np.uint64(40)) % np.uint64(rule.every) == 0)[0] + start + w
        out.append(at[at > lo])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions at which a piece may end: after a paragraph, after a line or sentence, after any white space or mark."""
    soft, strong, top = [], [], []
    n = len(codes)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        part = codes[lo : min(n, hi + 1)]  # one more: what follows decides
        white, end = np.isin(part, WHITE), np.isin(part, ENDS)
        line, wide = np.isin(part, _LINE), np.isin(part, _WIDE_ENDS)
        after = np.append(white[1:], True)[: hi - lo]
        white, end, line, wide = white[: hi - lo], end[: hi - lo], line[: hi - lo], wide[: hi - lo]
        before = np.concatenate([[codes[lo - 1] in _LINE if lo else False], line[:-1]])
        soft.append(np.nonzero(white | end)[0] + lo + 1)
        strong.append(np.nonzero(line | wide | (end & after))[0] + lo + 1)
        top.append(np.nonzero(line & before)[0] + lo + 1)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(top), join(strong), join(soft)


def _nearest(at: np.ndarray, lo: int, hi: int, aim: int) -> int | None:
    """The position of at within [lo, hi] nearest to aim; the earlier of two."""
    i, j = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
    if i >= j:
        return None
    k = int(np.searchsorted(at[i:j], aim)) + i
    best = [int(at[x]) for x in (k - 1, k) if i <= x < j]
    return min(best, key=lambda p: abs(p - aim))


def cut(text: str, rule: Rule = Rule()) -> tuple[list[tuple[int, int]], list[bool], list[int]]:
    """(start, end) of each piece, whether it was cut hard, and for each hard cut the length of the run without white space or a closing mark that it falls in."""
    codes = _codes(text)
    n = len(codes)
    top, strong, soft = boundaries(codes)
    marks = landmarks(codes, rule) if n > rule.most else np.zeros(0, np.int64)
    spans, hard, runs, at = [], [], [], 0
    while n:
        start = max(0, at - rule.overlap)
        limit = start + rule.most
        if n <= limit:
            spans.append((start, n))
            hard.append(False)
            break
        lo = at + rule.least
        i = np.searchsorted(marks, lo)
        aim = int(marks[i]) if i < len(marks) and marks[i] <= limit else limit
        near = (max(lo, aim - rule.reach), min(limit, aim + rule.reach))
        end = None
        for found, (a, b) in ((top, near), (strong, near), (strong, (lo, limit)), (soft, (lo, limit)), (soft, (at + rule.overlap + 1, limit))):
            if (end := _nearest(found, a, b, aim)) is not None:
                break
        if end is None:
            end = _nearest(soft, at + 1, limit, limit)
        hard.append(end is None)
        at = limit if end is None else end
        if end is None:
            k = int(np.searchsorted(soft, at, side="right"))
            runs.append((int(soft[k]) - 1 if k < len(soft) else n) - (int(soft[k - 1]) if k else 0))
        spans.append((start, at))
    return spans, hard, runs


def oversized(rows: DataFrame, key: str, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, n_pieces, hard_pieces, hard_cut) of every row that is cut into two pieces or more, which are those over the limit.

    hard_cut is 1 if a hard cut falls in a run of more than the limit's characters without a boundary. Such a run always holds one: pieces end at its start at the
    latest, and the next one, of which the overlap is before it, ends within the run."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [(k, *cut(t, rule)) for k, t in zip(pdf[key], pdf["_t"])]
            got = [(k, len(s), sum(h), int(any(r > rule.most for r in runs))) for k, s, h, runs in got if len(s) > 1]
            yield pd.DataFrame(got, columns=[key, "n_pieces", "hard_pieces", "hard_cut"])

    return map_rows(rows.where(F.length(text) > rule.most), [key], [F.col(text).alias("_t")], run, "n_pieces int, hard_pieces int, hard_cut int")


def rebuilt(found: DataFrame, key: str, rule: Rule = Rule()) -> DataFrame:
    """(key, digest, chars, within, shared, natural) of each text put together again from its pieces: the text's SHA-256 and length, whether all pieces keep
    the limit and share the overlap, and whether all end at a boundary, or where none was possible."""
    mark = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？]"
    new = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", rule.overlap + 1, 2**30))
    one = found.select(key, "piece_no", "start_char", "end_char", "hard", new.alias("new"), F.length("piece").alias("n"))
    docs = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_char", "end_char", "hard", "new", "n"))).alias("p"))  # the pieces of one text
    body = F.array_join(F.transform("p", lambda x: x["new"]), "")
    last = F.size("p")
    joined = F.transform(F.slice("p", 2, last), lambda x, i: x["start_char"] == F.element_at("p", i + 1)["end_char"] - rule.overlap)
    ends = F.transform(F.slice("p", 1, last - 1), lambda x: F.when(x["hard"], ~x["new"].rlike(mark)).otherwise(F.substring(x["new"], -1, 1).rlike(mark)))
    return docs.select(key, F.sha2(body, 256).alias("digest"), F.length(body).alias("chars"), F.forall("p", lambda x: (x["n"] <= rule.most) & (x["n"] == x["end_char"] - x["start_char"])).alias("within"), F.forall(joined, lambda x: x).alias("shared"), F.forall(ends, lambda x: x).alias("natural"))


def pieces(rows: DataFrame, key: str, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, piece_no, start_char, end_char, hard, piece) of every text over the limit, piece_no from 1; piece is the text of code points [start_char, end_char)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k, t in zip(pdf[key], pdf["_t"]):  # a frame a text: the pieces of a batch of long texts are not held at once
                spans, hard, _ = cut(t, rule)
                yield pd.DataFrame({key: [k] * len(spans), "piece_no": range(1, len(spans) + 1), "start_char": [a for a, _ in spans], "end_char": [b for _, b in spans], "hard": hard, "piece": [t[a:b] for a, b in spans]})

    return map_rows(rows.where(F.length(text) > rule.most), [key], [F.col(text).alias("_t")], run, "piece_no int, start_char long, end_char long, hard boolean, piece string")
