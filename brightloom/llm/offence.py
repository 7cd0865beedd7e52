"""Abusive, hateful and sexual language: a factorization machine over hashed terms, scored on windows of each document.

Terms are words in an evened-out form (look-alike letters, digits for letters, drawn-out, spaced-out, masked and split
spellings) and pairs of neighbouring words; languages written without blanks give characters instead of words. For every
window of words the machine adds the terms' weights and the products of their factors, so that an
insult counts more beside a group or a person addressed than alone. A document's score is its highest window's.

Labels are of documents, windows are not labelled: training begins with the windows whose words tell a category's documents from
the others, and then alternates between fitting and choosing the windows of the labelled documents that the machine holds to be cases.

Labelled documents are a bounded sample, written to the shared folder as hashed terms; each category is fitted by a task of its own that
reads them there. Scoring goes through batches of texts as one array of words, with single precision sums of pairs of words.

Defined cases: null, empty and blank texts score 0; a category without labelled cases scores 0 everywhere; texts of any
length are scored whole; null sources have rates of their own; a label of a document that isn't there counts for nothing; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import map_rows, stored

CATEGORIES = ("abusive", "hateful", "sexual")
#: terms are hashed to so many weights, with so many factors each.
BITS, FACTORS = 16, 8
#: words of a window, and how far the next one is along.
WINDOW, STRIDE = 14, 4
#: the classifier is fitted on at most so many labelled documents of each category, and so many of none, taken in the order of a hash
#: of their ids up to so many words in all, and on at most so many windows of documents without the category at a time, taken at random.
MOST_LABELLED, MOST_CLEAN, MOST_WORDS, MOST_WINDOWS = 2000, 6000, 4_000_000, 120_000
#: words of texts that are scored at once.
BATCH_WORDS = 100_000
#: a score from here on is a case. Set on held-out labelled documents: precision is 1.0 from 0.3 up, recall falls above.
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
_LOOKALIKE = str.maketrans("аеорсхуіѕјкмтвнαεικνορτυ", "aeopcxyisjkmtbhaeiknoptu")
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
# end of fixed values


# chunks hold whole words: what is between them is in no word
_CHUNK = re.compile(r"[^\s.,;:?()\[\]{}<>\"/\\+=~^`&%–—…“”„«»、。！？「」・-]+(?:[.,]\d+)*")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f]")
#: distinct chunks whose words' hashes a worker remembers, and the longest of them; at this many it forgets all and goes on.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 40


def _hash(s: str) -> int:
    h = 1469598103934665603
    for b in s.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def word_form(w: str) -> str:
    """The evened-out form of one word."""
    if w[0].isdigit() and not any(c.isalpha() for c in w):
        return "0"
    if any("a" <= c <= "z" for c in w) and not w.isascii():
        w = w.translate(_LOOKALIKE)
    if not w.isalpha():
        for m in "*#@$!":
            if m + m in w:
                return w[0].translate(_LEET) + "*" + w[-1].translate(_LEET)
        if "*" in w or "#" in w:
            return w[0].translate(_LEET) + "*" + w[-1].translate(_LEET)
        w = w.replace("’", "'")
        w = w.translate(_LEET)
    out = w[0]
    for c in w[1:]:
        if c != out[-1]:
            out += c
    return out


def _together(m) -> str:
    """Spaced-out letters as a word; where they begin as the words "a" and "i" do, also without the first."""
    w = "".join(c for c in m[0] if c.isalpha())
    return f"{w[0]} {w[1:]} {w}" if m[1] == " " and w[0] in "ai" else w


class _Known(dict):
    """Chunks of text to the hashes of their words, 8 bytes each."""

    def __init__(self) -> None:
        import regex

        self.spaced = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}([ .\-_*·])(?=\p{L}(?:\1|(?![\p{L}\p{N}])))){2,}\p{L}(?![\p{L}\p{N}])")
        self.word = regex.compile(
            r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}][\p{L}\p{M}\p{N}@$€|!*#'’]*[\p{L}\p{N}$]|[\p{N}$@][\p{L}\p{N}@$*#]*\p{L}[\p{L}\p{N}@$*#]*|\p{L}|\p{N}[\p{N}.,]*"
        )

    def __missing__(self, chunk: str) -> bytes:
        joined = self.spaced.sub(_together, chunk) if any(c in chunk for c in "_*·") else chunk
        out = b"".join(_hash(word_form(w)).to_bytes(8, "little") for w in self.word.findall(joined))
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = out
        return out


_known: list[_Known] = []


def terms(text: str) -> np.ndarray:
    """64-bit hashes of a text's words in order."""
    if not _known:
        _known.append(_Known())
    known = _known[0]
    t = unicodedata.normalize("NFKC", text).casefold()
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    chunks = _CHUNK.findall(t)
    one = np.fromiter(map(len, chunks), np.int64, len(chunks)) == 1
    if (one[:-1] & one[1:]).any():  # single letters in a row may be a spaced-out word
        chunks = _CHUNK.findall(known.spaced.sub(_together, t))
    return np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.uint64)


def slots(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed term of each word, and of each word with the one before it (the first has none: -1)."""
    one = (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    two = ((words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return one.astype(np.int64), np.concatenate([np.full(min(1, len(words)), -1), two.astype(np.int64)])


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's windows of n words; they hold every word."""
    if n <= WINDOW:
        return np.zeros(min(1, n), np.int64), np.full(min(1, n), n, np.int64)
    start = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    return start, start + WINDOW


def _word_slots(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the words of several texts and of the pairs that end in them; a text's first word ends no pair and has the slot that stays zero."""
    one, two = slots(words)
    two[first] = 1 << BITS
    return one, two


@dataclass
class Machine:
    """A factorization machine for each category: bias[c], weight[slot, c], factor[slot, c, f]."""

    bias: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def __post_init__(self) -> None:
        # a window's products of pairs are half of (the sum of factors squared less the squares' sum), the latter of which is linear in its terms
        self.table = np.concatenate([self.weight - 0.5 * (self.factor * self.factor).sum(axis=2), self.factor.reshape(len(self.factor), -1)], axis=1).astype(np.float32)

    def _of_sums(self, total: np.ndarray) -> np.ndarray:
        c = len(self.bias)
        v = total[:, c:].reshape(len(total), c, FACTORS)
        return self.bias.astype(np.float32) + total[:, :c] + 0.5 * (v * v).sum(axis=2)

    def highest(self, texts: list[np.ndarray]) -> np.ndarray:
        """The highest logit of the windows of each of some texts, none of them empty. Each text begins at an even place, so that windows are sums of pairs of words."""
        n = np.array([len(w) for w in texts])
        even = n + n % 2
        at = np.cumsum(even) - even
        words = np.zeros(int(even.sum()) + WINDOW, np.uint64)
        for a, w in zip(at, texts):
            words[a : a + len(w)] = w
        one, two = _word_slots(words, at)
        gap = np.append(at[n % 2 == 1] + n[n % 2 == 1], np.arange(len(words) - WINDOW, len(words)))
        one[gap] = two[gap] = 1 << BITS
        x = self.table[one]
        x += self.table[two]
        pair = x[0::2] + x[1::2]
        full = np.maximum(0, -(-(n - WINDOW) // STRIDE))  # windows that begin at multiples of the stride, before the last one
        doc = np.repeat(np.arange(len(n)), full)
        start = at[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full))
        total = np.zeros((len(start), x.shape[1]), np.float32)
        for k in range(WINDOW // 2):
            total += pair[start // 2 + k]
        total -= self.table[two[start]]  # the pair that crosses the window's start
        begin = at + np.maximum(0, n - WINDOW)
        inside = np.arange(WINDOW) < np.minimum(n, WINDOW)[:, None]
        last = (x[begin[:, None] + np.arange(WINDOW)] * inside[:, :, None]).sum(axis=1) - self.table[two[begin]]
        best = self._of_sums(last)
        np.maximum.at(best, doc, self._of_sums(total))
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A row of scores for each text."""
        out = np.full((len(texts), len(self.bias)), -np.inf)
        some: list[np.ndarray] = []
        rows: list[int] = []
        size = 0

        def flush() -> None:
            if rows:
                np.maximum.at(out, np.array(rows), self.highest(some))
            some.clear(), rows.clear()

        for i, t in enumerate(texts):
            words = terms(t) if isinstance(t, str) else ()
            for lo in range(0, len(words), BATCH_WORDS):  # long texts in overlapping blocks
                part = words[lo : lo + BATCH_WORDS + WINDOW]
                some.append(part), rows.append(i)
                size += len(part)
                if size >= BATCH_WORDS:
                    flush()
                    size = 0
        flush()
        return np.where(np.isinf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -30, 30))))

    def score(self, text: str | None) -> np.ndarray:
        return self.scores([text])[0]


def _features(words: np.ndarray) -> np.ndarray:
    """A row of slots for each window, padded with the slot that stays zero."""
    one, two = slots(words)
    a, b = windows(len(words))
    at = a[:, None] + np.arange(WINDOW)
    inside = at < b[:, None]
    at = np.minimum(at, len(words) - 1)
    pair = inside & (np.arange(WINDOW) > 0)
    return np.concatenate([np.where(inside, one[at], 1 << BITS), np.where(pair, two[at], 1 << BITS)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """One machine by AdaGrad on the logistic loss with some shrinkage."""
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + 1
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.03, (size, FACTORS)).astype(np.float32)
    v[-1] = 0
    gw, gv, b, gb = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), -2.0, 1e-3
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 512):
            k = order[i : i + 512]
            f, t, m = x[k], y[k], weight[k]
            vs = v[f]
            s = np.einsum("ijk->ik", vs)
            z = b + w[f].sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - np.einsum("ijk,ijk->i", vs, vs))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * m
            places = np.sort(f.ravel().astype(np.int64) << 32 | np.arange(f.size))  # by term, then place
            at = places >> 32
            first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
            uniq = at[first]
            row = (places & 0xFFFFFFFF) // f.shape[1]
            gs = g[row]
            n = np.add.reduceat(gs, first)
            dw = n / len(k) + 2e-5 * w[uniq]
            # sum of g * (s - v) over a term's places: its own factors are the same at each of them
            dv = (np.add.reduceat((g[:, None] * s)[row], first, axis=0) - n[:, None] * v[uniq]) / len(k) + 2e-5 * v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            w[uniq] -= 0.15 * dw / np.sqrt(gw[uniq])
            v[uniq] -= 0.05 * dv / np.sqrt(gv[uniq])
            d = float(g.mean())
            gb += d * d
            b -= 0.1 * d / np.sqrt(gb)
            w[-1] = 0
            v[-1] = 0
    return b, w, v


def _logit(x: np.ndarray, fitted: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    b, w, v = fitted
    out = np.empty(len(x), np.float32)
    for i in range(0, len(x), 10_000):
        f = x[i : i + 10_000]
        vs = v[f]
        out[i : i + 10_000] = b + w[f].sum(axis=1) + 0.5 * ((vs.sum(axis=1) ** 2).sum(axis=1) - np.einsum("ijk,ijk->i", vs, vs))
    return out


def _telling(x: np.ndarray, doc: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """How much each term tells the documents in `mine` from all others: the log of their numbers' ratio, where more of its documents are in it."""
    here, there = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for rows, mine_too in zip(np.split(x, np.nonzero(np.diff(doc))[0] + 1), mine[doc[np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1])]] if len(doc) else []):
        (here if mine_too else there)[np.unique(rows)] += 1  # each term once a document
    told = np.clip(np.log((here + 0.5) / (there + 0.5)), 0, 5)
    told[here < (2 if mine.sum() >= 10 else 1)] = 0
    told[-1] = 0
    return told


def _machine(x: np.ndarray, doc: np.ndarray, mine: np.ndarray, rounds: int, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The machine of one category; mine: which documents have it."""
    rng = np.random.default_rng(seed)
    inside = np.nonzero(mine[doc])[0]
    outside = np.nonzero(~mine[doc])[0]
    base = rng.permutation(outside)[:MOST_WINDOWS]
    told = _telling(x, doc, mine)[x[inside]].sum(axis=1)
    top = np.zeros(len(mine))
    np.maximum.at(top, doc[inside], told)
    best = top[doc[inside]]
    chosen, rest, hard = inside[(told >= 0.6 * best) & (best > 0)], inside[told < 0.1 * best], outside[:0]
    for r in range(rounds + 1):
        none = np.concatenate([base, rest, np.repeat(hard, 3)])
        k = np.concatenate([chosen, none])
        y = np.repeat([1.0, 0.0], [len(chosen), len(none)])
        m = np.where(y == 1, min(20.0, max(1.0, 0.25 * len(none) / max(1, len(chosen)))), 1.0)
        fitted = _fit(x[k], y, m, epochs if r == rounds else 2, seed + r)  # while windows are still chosen, a rough fit does
        if r == rounds:
            return fitted
        z = _logit(x[inside], fitted)
        high = np.full(len(mine), -np.inf)
        np.maximum.at(high, doc[inside], z)
        best = high[doc[inside]]
        # the likely windows, and the likeliest of a document that has none, if its words told anything
        chosen = inside[((z > 0) & (z >= 0.3 * best)) | ((z == best) & (told > 0))]
        rest = inside[(z < -2) & (z < best)]
        hard = rng.permutation(outside[_logit(x[outside], fitted) > -2.5])[:MOST_WINDOWS]
    raise AssertionError


def train_one(words: list[np.ndarray], has: list[bool], rounds: int = 3, epochs: int = 5, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Bias, weights and factors of one category's machine, or None where all or none of the documents have it. words: the hashed words of each document."""
    docs = [i for i, w in enumerate(words) if len(w)]
    mine = np.array([has[i] for i in docs], bool)
    if not mine.any() or mine.all():
        return None
    rows = [_features(words[i]).astype(np.int32) for i in docs]
    return _machine(np.concatenate(rows), np.repeat(np.arange(len(docs)), [len(r) for r in rows]), mine, rounds, epochs, seed)


def _joined(parts: list[tuple[float, np.ndarray, np.ndarray] | None]) -> Machine:
    size = (1 << BITS) + 1
    bias, weight, factor = np.full(len(CATEGORIES), -30.0), np.zeros((size, len(CATEGORIES)), np.float32), np.zeros((size, len(CATEGORIES), FACTORS), np.float32)
    for c, p in enumerate(parts):
        if p is not None:
            bias[c], weight[:, c], factor[:, c] = p
    return Machine(bias, weight, factor)


def train(texts: list[str], labels: list[set[str]]) -> Machine:
    """The machine fitted on labelled documents in this process; labels holds each document's categories."""
    words = [terms(t) for t in texts]
    return _joined([train_one(words, [c in x for x in labels]) for c in CATEGORIES])


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, clean: int = MOST_CLEAN) -> DataFrame:
    """(doc_id, text, cats) of a bounded sample of labelled documents: at most `most` of each category and `clean` of none, in the order of a hash of their ids."""
    by_doc = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.when(F.col("category").isin(*CATEGORIES), F.col("category"))).alias("cats"))
    picked = None
    for c in (*CATEGORIES, None):
        mine = F.array_contains("cats", c) if c else F.size("cats") == 0
        some = by_doc.where(mine).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most if c else clean)
        picked = some if picked is None else picked.unionByName(some)
    picked = F.broadcast(picked.dropDuplicates(["doc_id"]))  # at most 3 * most + clean rows
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id")


def hashed(sample: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, cats, n, words) of a sample: its hashed words, 8 bytes each, in the shared folder; documents in the order of a hash of their ids up to so many words in all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            words = [terms(t) for t in pdf["_t"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "_cats": pdf["_cats"], "n": [len(w) for w in words], "words": [w.tobytes() for w in words]})

    asked = sample.select(F.col("doc_id"), F.array_join(F.array_sort("cats"), ",").alias("_cats"), F.col("text").alias("_t"))
    rows = stored(map_rows(asked, ["doc_id", "_cats"], [F.col("_t")], run, "n long, words binary"), "labelled_words")
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # ids and counts of a bounded sample
    kept = rows.select("doc_id", "n").withColumn("_sum", before).where(F.col("_sum") <= most_words).select("doc_id").distinct()
    return rows.join(F.broadcast(kept), "doc_id", "left_semi").select("doc_id", F.split("_cats", ",").alias("cats"), "n", "words")


def train_on(sample: DataFrame) -> Machine:
    """The same of a sample's hashed words, which stay in the shared folder: each category in a task of its own. Only the weights come to the driver."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(parts)
        rows = pd.concat(frames).sort_values("doc_id", kind="stable") if frames else pd.DataFrame({"category": [], "has": [], "words": []})
        for c, mine in rows.groupby("category"):
            got = train_one([np.frombuffer(w, np.uint64) for w in mine["words"]], [bool(x) for x in mine["has"]])
            if got is not None:
                yield pd.DataFrame({"category": [c], "bias": [float(got[0])], "weight": [got[1].astype(np.float32).tobytes()], "factor": [got[2].astype(np.float32).tobytes()]})

    jobs = sample.select("doc_id", F.posexplode(F.array(*map(F.lit, CATEGORIES))).alias("n", "category"), "cats", "words").withColumn("has", F.array_contains("cats", F.col("category"))).drop("cats")
    spread_out = jobs.repartitionById(len(CATEGORIES), "n").select("doc_id", "category", "has", "words")
    got = {r["category"]: r for r in spread_out.mapInPandas(run, "category string, bias double, weight binary, factor binary").collect()}  # a row a category
    return _joined([(got[c]["bias"], np.frombuffer(got[c]["weight"], np.float32), np.frombuffer(got[c]["factor"], np.float32).reshape(-1, FACTORS)) if c in got else None for c in CATEGORIES])


def score(documents: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """keep columns and a score from 0 to 1 for every category."""
    shared = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))  # 65,537 slots of 27 numbers, whatever the data

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Machine(*shared.value)
        for pdf in parts:
            s = m.scores(list(pdf["_t"]))
            out = pdf[keep].copy()
            for i, c in enumerate(CATEGORIES):
                out[c] = s[:, i]
            yield out

    return map_rows(documents, keep, [F.col("text").alias("_t")], run, ", ".join(f"{c} double" for c in CATEGORIES))


def cases(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for every document and category whose score reaches the threshold."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])).alias("p")
    return scored.select("doc_id", pairs).select("doc_id", "p.category", "p.score").where(F.col("score") >= threshold)


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each source and category, its documents, cases and share."""
    n = F.count(F.lit(1))
    counts = scored.groupBy("source").agg(n.alias("documents"), *[F.count_if(F.col(c) >= threshold).alias(c) for c in CATEGORIES])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("cases")) for c in CATEGORIES])).alias("p")
    return counts.select("source", "documents", pairs).select("source", "p.category", "documents", "p.cases", F.round(F.col("p.cases") / F.col("documents"), 6).alias("rate"))
