"""Transcripts into clean, ordered turns of resolved speakers.

A transcript's lines are units; some could open a block, as they carry what may be a speaker's label. A semi-Markov
conditional model scores whole segments, from one opening line to the next: how well its label
resolves, how it is laid out and how the document's other labels are, the time since the time mark before it, a blank line before it, whether the
words before it ended and come again after it, and how long the segment is. The best segmentation gives the blocks; time marks, notes on sounds, the transcriber's remarks
and fillers are taken out as the words are put together again.

The model is trained on transcripts whose time marks show where blocks open, and on the same transcripts with the marks
taken away, so that it also reads layouts without any.

Defined cases: null, empty and blank texts, and texts without a speaker, give no turn; text before the first speaker is no turn;
a speaker who is on no roster has a null speaker_id, and its blocks are one speaker's if their labels are equal; without a
trained model the default weights hold; texts, labels and notes of any length are read whole; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.roster import MOST_PEOPLE, Roster, fold
from brightloom.session import map_rows, small, spread, stored

#: the model is fitted on at most so many whole transcripts of at most so many characters, in the order of a hash of their ids.
MOST_TRAINING, LONGEST_TRAINING = 60, 200_000
#: keys of evidence with their company up to which they are broadcast; beyond, the join shuffles.
BROADCAST_KEYS = 500_000
#: distinct labels of companies up to which their dictionary is broadcast; beyond, the join shuffles.
BROADCAST_LABELS = 500_000
#: the catalogue of fillers may have so many terms, which become one pattern.
MOST_FILLERS = 10_000

# Words of notes on sounds and by the transcriber; the marks that set a filler off.
NOTE_WORDS = (
    "inaudible indiscernible unintelligible crosstalk laughter laughs laughing laugh chuckles chuckling applause clapping music noise pause silence technical "
    "difficulty difficulties phone rings ringing clears throat cough coughs coughing sigh sighs sneeze sneezes foreign language call ended end ends phonetic ph audio gap "
    "background cross talk overlapping speakers speaking speaker simultaneously multiple off mic microphone beep static feedback break recess dropped line no response verbatim operator instructions"
).split()
SURE_NOTES = set("inaudible indiscernible unintelligible crosstalk laughter laughs chuckles applause music pause silence coughs cough sighs sneezes phonetic ph noise clears rings ringing technical foreign ended beep static end".split())
# end of fixed values
_NOTE = set(NOTE_WORDS)
_MARK = r"[,.;:!?…—–-]"

_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_CUE = re.compile(rf"^\s*({_TIME})\s*-->\s*{_TIME}")
_ONLY_TIME = re.compile(rf"^\s*[\[(]?\s*({_TIME})\s*[\])]?\s*$")
_VOICE = re.compile(r"^\s*<v(?:\.[^\s>]+)?\s+([^>]+)>(.*?)(?:</v>)?\s*$", re.S)
_STAMPED = re.compile(rf"^\s*[\[(]?({_TIME})[\])]?\s+(?=\S)")  # before a label with an arrow
_BRACKETED = re.compile(rf"^\s*[\[(]\s*({_TIME})\s*[\])]\s*")  # before a label with a colon
_NO_LABEL = re.compile(r"[\[\]{}<>]")
#: a line of no more characters and words than these may be a heading whatever it says; a longer one if it names someone on the roster.
SHORT_HEADING = (120, 12)
LAYOUTS = ["voice", "arrow", "colon", "head"]


def seconds(mark: str) -> float:
    out = 0.0
    for p in mark.replace(",", ".").split(":"):
        out = out * 60 + float(p)
    return out


def labelled_line(line: str) -> tuple[str, float | None, str, str] | None:
    """(layout, time, label, text) of a line that begins with what may be a label: a voice tag, a label before an arrow, or one before a colon."""
    if "<v" in line and (m := _VOICE.match(line)):
        return "voice", None, m[1], m[2]
    if (i := line.find(">>")) > 0:
        t = _STAMPED.match(line[:i])
        label = line[t.end() if t else 0 : i].strip()
        if label and (t or not ("<" in label or ">" in label)):
            return "arrow", seconds(t[1]) if t else None, label, line[i + 2 :].strip()
    t = _BRACKETED.match(line)
    start = t.end() if t else 0
    i = line.find(":", start)
    if i > 0 and (i + 1 == len(line) or line[i + 1].isspace()):
        label = line[start:i].strip()
        if label and not _NO_LABEL.search(label):
            return "colon", seconds(t[1]) if t else None, label, line[i + 1 :].strip()
    return None


@dataclass
class Unit:
    """A line: what might be its label, and what it says without it."""

    text: str
    layout: str | None = None
    label: str = ""
    rest: str = ""
    time: float | None = None
    blank: bool = False  # a blank line is before it


def units(text: str) -> list[Unit]:
    """The lines of a transcript without cue numbers and time lines, whose times are given to the lines they stand for."""
    lines = [ln.replace("\xa0", " ") for ln in _LINES.split(text.replace("\ufeff", ""))]
    out: list[Unit] = []
    blank, cue = True, None
    for i, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        if line.strip() == "WEBVTT" and not out:
            continue
        if m := _CUE.match(line):
            cue = seconds(m[1])
            continue
        if line.strip().isdigit() and i + 1 < len(lines) and _CUE.match(lines[i + 1]):
            continue
        if m := _ONLY_TIME.match(line):
            if out and not blank and out[-1].time is None and out[-1].layout in (None, "head"):
                out[-1].time = seconds(m[1])  # below a heading
            else:
                cue = seconds(m[1])
            continue
        u = Unit(line, time=cue, blank=blank)
        if found := labelled_line(line):
            u.layout, at, u.label, u.rest = found
            u.time = u.time if at is None else at
        elif len(line) <= SHORT_HEADING[0] and len(line.split()) <= SHORT_HEADING[1]:
            u.layout, u.label, u.rest = "head", line, ""
        out.append(u)
        blank, cue = False, None
    return out


HOW = ["name", "near", "role", "firm", "operator", "none"]
FEATURES = [*[f"layout_{x}" for x in LAYOUTS], *[f"how_{x}" for x in HOW], "timed", "blank", "support", "words", "long", "stop", "ended", "again", "gap", "shared", "bias"]
SEGMENT = ["no_words", "log_words", "log_lines"]
#: default weights, in the order of FEATURES and SEGMENT.
DEFAULT = np.array([1.0, 1.0, 0.0, -1.0, 4.0, 2.5, 3.0, 3.0, 4.0, -4.0, 2.0, 0.3, 2.0, -0.2, -1.0, -1.5, 0.5, 0.5, 0.0, 0.0, -0.5, -0.3, 0.0, 0.0])


_LONG_WORD = re.compile(r"\w{4,}")


def content(text: str) -> set[str]:
    """The words of four letters or more, which tell what a line is about."""
    return set(_LONG_WORD.findall(text.lower()))


def shared_words(before: str, after: str) -> float:
    """How many of the fewer content words of two lines are in both, as a share."""
    a, b = content(before), content(after)
    return len(a & b) / max(1, min(len(a), len(b)))


def gaps(doc: list[Unit]) -> list[float]:
    """Log seconds from the last time known before each unit to its own; 0 where either is unknown or time runs back."""
    out, last = [], None
    for u in doc:
        out.append(0.0 if u.time is None or last is None else float(np.log1p(max(0.0, u.time - last))))
        last = last if u.time is None else u.time
    return out


def features(doc: list[Unit], ticker: str | None, roster: Roster) -> tuple[np.ndarray, np.ndarray, list[tuple[int | None, str]]]:
    """Indices of the units that may open a segment, their features, and how their labels resolve."""
    for u in doc:
        if u.layout is None and roster.may_name(u.text) and roster.resolve(ticker, u.text)[1] != "none":
            u.layout, u.label, u.rest = "head", u.text, ""
    at = [i for i, u in enumerate(doc) if u.layout]
    who = [roster.resolve(ticker, doc[i].label) for i in at]
    hits = {x: 0 for x in LAYOUTS}
    labels: dict[str, int] = {}
    for i, (_, how) in zip(at, who):
        hits[doc[i].layout] += how != "none"
        k = fold(doc[i].label)
        labels[k] = labels.get(k, 0) + 1
    total = max(1, sum(hits.values()))
    x, gap = np.zeros((len(at), len(FEATURES))), gaps(doc)
    for r, (i, (_, how)) in enumerate(zip(at, who)):
        u = doc[i]
        x[r, LAYOUTS.index(u.layout)] = 1
        x[r, 4 + HOW.index(how)] = 1
        n = len(u.label.split())
        before = doc[i - 1].text.rstrip() if i else "."
        after = u.rest or (doc[i + 1].text if i + 1 < len(doc) else "")
        x[r, 10:] = [u.time is not None, u.blank, hits[u.layout] / total, min(n, 24) / 4, n > 7, u.label.rstrip()[-1:] in ".!?,;", before[-1:] in ".!?\"”)]", labels[fold(u.label)] > 1, gap[i], shared_words(before, after), 1]
    return np.array(at, int), x, who


class SemiMarkov:
    """A semi-Markov conditional model: the log score of a segmentation is the sum over its segments of w * start features + v * segment features."""

    #: openings are gone through in blocks of so many. Decoding has segments of any length; fitting sums over those of at most so many openings, and over longer ones from true openings.
    BAND = 256

    def __init__(self, weights: np.ndarray = DEFAULT):
        self.weights = weights

    @staticmethod
    def segments(words: np.ndarray, i: np.ndarray, j: int) -> np.ndarray:
        """Segment features of segments from openings i to before opening j; words: running count of words up to each opening."""
        n = words[j] - words[i]
        return np.stack([n == 0, np.log1p(n), np.log1p(j - i - 1)], axis=1)

    def spans(self, words: np.ndarray, truth: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(j, openings i before it, features of the segments from i to j), which don't depend on the weights; i: the last BAND, and the true ones before."""
        far = np.array(truth, int)
        for j in range(1, len(words)):
            lo = max(0, j - self.BAND)
            i = np.append(far[far < lo], np.arange(lo, j))
            yield j, i, self.segments(words, i, j)

    def lattice(self, x: np.ndarray, spans):
        w, v = self.weights[: len(FEATURES)], self.weights[len(FEATURES) :]
        start = x @ w
        for j, i, f in spans:
            yield j, i, start[i] + f @ v

    def decode(self, x: np.ndarray, words: np.ndarray) -> list[int]:
        """The openings of the best segmentation, whose segments have any length. Openings before the first chosen one are of no speaker and cost nothing.

        The nearest one or two blocks are tried opening by opening. Each segment feature falls or rises with i, so that its values at a block's ends
        bound it: of the blocks before, only those are tried whose best start, with these bounds, could do better than what was found."""
        n, size = len(x), self.BAND
        v = self.weights[len(FEATURES) :]
        start = x @ self.weights[: len(FEATURES)]
        best = np.zeros(n + 1)  # best[i]: of the first i openings; all skipped at first
        back = np.full(n + 1, -1)
        heads = np.arange(0, n, size)
        top = np.zeros(len(heads))  # the best start of each block that is whole
        for j in range(1, n + 1):
            if j % size == 0:
                top[j // size - 1] = (best[j - size : j] + start[j - size : j]).max()
            whole = max(0, j - size) // size  # blocks before the nearest
            i = np.arange(whole * size, j)
            t = best[i] + (start[i] + self.segments(words, i, j) @ v)
            k = int(t.argmax())
            score, at = t[k], int(i[k])
            if whole:
                ends = heads[:whole]
                most = top[:whole] + np.maximum(self.segments(words, ends, j) * v, self.segments(words, ends + size - 1, j) * v).sum(axis=1)
                for b in np.argsort(-most):
                    if most[b] + 1e-9 < max(score, 0.0):
                        break
                    i = np.arange(b * size, (b + 1) * size)
                    t = best[i] + (start[i] + self.segments(words, i, j) @ v)
                    k = int(t.argmax())
                    if t[k] > score or t[k] == score and i[k] < at:
                        score, at = t[k], int(i[k])
            if score > 0:
                best[j], back[j] = score, at
        out, j = [], n
        while j > 0 and back[j] >= 0:
            out.append(int(back[j]))
            j = int(back[j])
        return out[::-1]

    def prepared(self, words: np.ndarray, truth: list[int]) -> list | np.ndarray:
        """What gradient needs of a transcript whatever the weights are: the features of all segments as one array [i, j - 1] where openings are no more than BAND, else those of spans."""
        n = len(words) - 1
        if n > self.BAND:
            return list(self.spans(words, truth))
        i, j = np.arange(n)[:, None], np.arange(1, n + 1)[None, :]
        d = np.maximum(words[j] - words[i], 0)
        return np.stack([d == 0, np.log1p(d), np.log1p(np.maximum(j - i - 1, 0))], axis=2).astype(float)

    def _whole(self, x: np.ndarray, segs: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log sums over all segmentations of some transcripts, and their gradient by shares, negated. x[d, i]: start features, segs[d, i, j - 1]: segment features, n[d]: openings; rows beyond n are padding."""
        f, most = len(FEATURES), segs.shape[1]
        at = np.arange(most)
        real = (at[:, None] <= at[None, :]) & (at[None, :] < n[:, None])[:, None, :]  # a segment from i ends before an opening j > i
        s = np.where(real, (x @ self.weights[:f])[:, :, None] + segs @ self.weights[f:], -np.inf)
        docs = np.arange(len(n))
        alpha, beta = np.zeros((len(n), most + 1)), np.full((len(n), most + 1), -np.inf)  # alpha[:, i] includes the way that skips all
        for j in range(1, most + 1):
            t = alpha[:, :j] + s[:, :j, j - 1]
            m = np.maximum(t.max(axis=1), 0.0)
            alpha[:, j] = m + np.log(np.exp(t - m[:, None]).sum(axis=1) + np.exp(-m))
        beta[docs, n] = 0.0
        for i in range(most - 1, -1, -1):
            inside = i < n
            t = s[inside, i, i:] + beta[inside, i + 1 :]
            m = t.max(axis=1)
            beta[inside, i] = m + np.log(np.exp(t - m[:, None]).sum(axis=1))
        z = alpha[docs, n]
        p = np.where(real, np.exp(np.clip(alpha[:, :most, None] + s + beta[:, None, 1:] - z[:, None, None], -50, 0)), 0.0) * share[:, None, None]
        return z, np.concatenate([-np.tensordot(p.sum(axis=2), x, 2), -np.tensordot(p, segs, 3)])

    def gradient(self, x: np.ndarray, words: np.ndarray, truth: list[int], spans: list | np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Log likelihood of a segmentation and its gradient, by forward and backward sums."""
        n, f = len(x), len(FEATURES)
        spans = self.prepared(words, truth) if spans is None else spans
        if isinstance(spans, np.ndarray):
            zs, g = self._whole(x[None], spans[None], np.array([n]), np.ones(1))
            z = float(zs[0])
        else:
            z, g = self._banded(x, spans)
        score = 0.0
        w, v = self.weights[:f], self.weights[f:]
        for a, b in zip(truth, [*truth[1:], n]):
            s = self.segments(words, np.array([a]), b)[0]
            score += x[a] @ w + s @ v
            g[:f] += x[a]
            g[f:] += s
        return score - z, g

    def _banded(self, x: np.ndarray, spans: list) -> tuple[float, np.ndarray]:
        """The same as _whole over the segments in spans."""
        n, f = len(x), len(FEATURES)
        rows = list(self.lattice(x, spans))
        alpha = np.zeros(n + 1)  # alpha[i] includes the way that skips all
        for j, i, s in rows:
            t = np.append(alpha[i] + s, 0.0)
            m = t.max()
            alpha[j] = m + np.log(np.exp(t - m).sum())
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0.0
        for j, i, s in reversed(rows):
            if beta[j] > -np.inf:
                beta[i] = np.logaddexp(beta[i], s + beta[j])
        z = alpha[n]
        g = np.zeros(f + len(SEGMENT))
        opened = np.zeros(n)  # the chance that a segment opens at each
        for (j, i, s), (_, _, seg) in zip(rows, spans):
            p = np.exp(np.clip(alpha[i] + s + beta[j] - z, -50, 0))
            opened[i] += p
            g[f:] -= p @ seg
        g[:f] -= opened @ x
        return z, g

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, list[int]]], rounds: int = 40, prior: float = 0.02) -> SemiMarkov:
        """Gradient steps with momentum, drawn to the default weights. Transcripts with a like number of openings go together."""
        m, s = np.zeros_like(self.weights), np.zeros_like(self.weights)
        w, f = self.weights.copy(), len(FEATURES)
        told = np.zeros_like(w)  # features of the true segmentations, whatever the weights are
        buckets: dict[int, list] = {}
        far = []
        for x, words, truth in data:
            share = 1 / max(1, len(truth)) / len(data)
            for a, b in zip(truth, [*truth[1:], len(x)]):
                told += share * np.concatenate([x[a], self.segments(words, np.array([a]), b)[0]])
            if len(x) > self.BAND:
                far.append((x, self.prepared(words, truth), share))
            elif len(x):
                buckets.setdefault(-(-len(x) // 16), []).append((x, self.prepared(words, truth), share))
        padded = []
        for k, docs in buckets.items():
            xs, segs = np.zeros((len(docs), 16 * k, f)), np.zeros((len(docs), 16 * k, 16 * k, len(SEGMENT)))
            for d, (x, seg, _) in enumerate(docs):
                xs[d, : len(x)], segs[d, : len(x), : len(x)] = x, seg
            padded.append((xs, segs, np.array([len(x) for x, _, _ in docs]), np.array([c for _, _, c in docs])))
        for r in range(1, rounds + 1):
            self.weights = w
            g = told - prior * (w - DEFAULT)
            for batch in padded:
                g = g + self._whole(*batch)[1]
            for x, spans, share in far:
                g = g + share * self._banded(x, spans)[1]
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w + 0.08 * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-6)
        self.weights = w
        return self


def opening_words(doc: list[Unit], at: np.ndarray) -> np.ndarray:
    """Running count of words before each opening, and in all."""
    n = np.array([len((u.rest if u.layout else u.text).split()) for u in doc] or [0])
    run = np.concatenate([[0], np.cumsum(n)])
    return np.append(run[at], run[len(doc)]) if len(at) else np.array([run[-1]])


def training_rows(texts: list[tuple[str, str | None]], roster: Roster) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Segmentations known from time marks and voice tags, as they are and with the marks taken away."""
    data = []
    for text, ticker in texts:
        doc = units(text)
        at, x, _ = features(doc, ticker, roster)
        sure = [r for r, i in enumerate(at) if doc[i].layout in ("voice", "arrow") and doc[i].time is not None or (doc[i].layout in ("colon", "head") and doc[i].time is not None and x[r, 9] == 0)]
        if len(sure) < 5:
            continue
        words = opening_words(doc, at)
        data.append((x, words, sure))
        bare = x.copy()
        bare[:, [FEATURES.index("timed"), FEATURES.index("gap")]] = 0
        for layout in ("voice", "arrow"):  # as if they were headings or labels with a colon
            k = bare[:, LAYOUTS.index(layout)] == 1
            bare[k, LAYOUTS.index(layout)] = 0
            bare[k, LAYOUTS.index("colon" if len(data) % 4 < 2 else "head")] = 1
        data.append((bare, words, sure))
    return data


_IN = r"([^()\[\]{}<>*]*)"
_BRACKET = re.compile(rf"\(\({_IN}\)\)|\({_IN}\)|\[{_IN}\]|\{{{_IN}\}}|<{_IN}>|\*([^*\n()\[\]{{}}<>]+)\*")
_TIME_MARK = re.compile(rf"[\[(<]\s*{_TIME}\s*[\])>]")


def _note(m: re.Match) -> str:
    inside = next(g for g in m.groups() if g is not None)
    words = re.findall(r"[^\W\d_]+", re.sub(_TIME, " ", inside.lower()))
    if not words:
        return " " if re.search(r"\d:\d", inside) or not re.search(r"\w", inside) else m[0]
    known = sum(w in _NOTE for w in words)
    return " " if known == len(words) or (any(w in SURE_NOTES for w in words) and known * 2 >= len(words)) else m[0]


@dataclass
class Cleaner:
    """Fillers by the catalogue: sounds in any drawn-out spelling, phrases only when set off."""

    sounds: list[str]
    phrases: list[str]

    def __post_init__(self) -> None:
        drawn = "|".join("".join(f"{re.escape(c)}+" for c, _ in _runs(s.lower())) for s in sorted(self.sounds, key=len, reverse=True)) or r"(?!)"
        self.sound = re.compile(rf"^[^\w]*(?:{drawn})[^\w]*$", re.I)
        some = "|".join(r"\s+".join(map(re.escape, p.split())) for p in sorted(self.phrases, key=len, reverse=True)) or r"(?!)"
        self.phrase = re.compile(rf"(^\W*|{_MARK}[\"”’')\]]*\s*)(?:{some})\s*,", re.I)

    def clean(self, text: str) -> str:
        """The words of a block without notes, marks of time and fillers."""
        if any(c in text for c in "([{<*♪"):
            text = _TIME_MARK.sub(" ", text)
            while (new := _BRACKET.sub(_note, text)) != text:  # a note may stand within brackets
                text = new
            text = text.replace("♪", " ").replace("♫", " ")
        text = text.strip()
        while (new := self.phrase.sub(lambda m: m[1], text)) != text:
            text = new.strip()
        return " ".join(w for w in text.split() if not self.sound.match(w))


def _runs(s: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in s:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def count_words(text: str) -> int:
    return sum(any(c.isalnum() for c in w) for w in text.split())


def turns(text: str | None, ticker: str | None, roster: Roster, cleaner: Cleaner, model: SemiMarkov) -> list[tuple[int | None, str, str, float | None]]:
    """(speaker_id, label, clean text, start) of each turn in order."""
    if not isinstance(text, str) or not text.strip():
        return []
    doc = units(text)
    at, x, who = features(doc, ticker, roster)
    chosen = model.decode(x, opening_words(doc, at)) if len(at) else []
    blocks = []
    for r, after in zip(chosen, [*[int(at[c]) for c in chosen[1:]], len(doc)]):
        i = int(at[r])
        said = " ".join([doc[i].rest, *[u.text for u in doc[i + 1 : after]]])
        blocks.append((who[r][0], fold(doc[i].label), cleaner.clean(said), doc[i].time))
    if blocks and all(b[3] is not None for b in blocks):
        blocks.sort(key=lambda b: b[3])
    out: list[tuple[int | None, str, str, float | None]] = []
    for speaker, label, said, time in blocks:
        if not count_words(said):
            continue
        if out and (out[-1][0] == speaker and speaker is not None or speaker is None and out[-1][0] is None and out[-1][1] == label):
            out[-1] = (*out[-1][:2], f"{out[-1][2]} {said}", out[-1][3])
        else:
            out.append((speaker, label, said, time))
    return out


def roster_of(participants: DataFrame) -> Roster:
    rows = participants.select("speaker_id", "ticker", "full_name", "role", "firm").limit(MOST_PEOPLE + 1).collect()
    if len(rows) > MOST_PEOPLE:
        raise ValueError(f"the roster has more than {MOST_PEOPLE} people; resolve speakers by a join on company instead")
    return Roster([tuple(r) for r in sorted(rows, key=lambda r: r[0])])


def cleaner_of(fillers: DataFrame) -> Cleaner:
    rows = fillers.where("term IS NOT NULL").select("term", "kind").limit(MOST_FILLERS + 1).collect()
    if len(rows) > MOST_FILLERS:
        raise ValueError(f"the catalogue has more than {MOST_FILLERS} fillers")
    return Cleaner([r[0] for r in rows if r[1] == "sound"], [r[0] for r in rows if r[1] == "phrase"])


def with_company(evidence: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Transcripts with the ticker of the disclosure that their document_key names; texts don't travel."""
    scripts = evidence.where(F.col("metadata.document_kind") == "transcript").where(F.col("text").isNotNull())
    keys = scripts.select(F.col("document_key").alias("_k")).where("_k IS NOT NULL").distinct()
    named = disclosures.where("ticker IS NOT NULL").select(F.concat_ws(":", "source", "source_id").alias("_k"), F.col("ticker").alias("_ticker"))
    company = stored(named.join(keys, "_k", "left_semi").groupBy("_k").agg(F.min("_ticker").alias("_ticker")), "companies_of_evidence")
    key = F.coalesce("document_key", F.concat(F.lit("\u0000"), F.col("evidence_id").cast("string")))  # texts without a key meet no company, and not in one task
    return spread(scripts.select("evidence_id", "document_key", "text")).withColumn("_k", key).join(small(company, BROADCAST_KEYS), "_k", "left").select("evidence_id", "text", F.col("_ticker").alias("ticker"))


def trained(scripts: DataFrame, roster: Roster) -> SemiMarkov:
    """The model fitted on a bounded sample of transcripts."""
    fit = scripts.where(F.length("text") <= LONGEST_TRAINING)
    picked = fit.select("evidence_id").distinct().orderBy(F.xxhash64("evidence_id"), "evidence_id").limit(MOST_TRAINING)
    rows = fit.join(F.broadcast(picked), "evidence_id").groupBy("evidence_id").agg(F.min(F.struct("text", "ticker")).alias("r")).select("evidence_id", "r.*").collect()  # at most MOST_TRAINING
    data = training_rows([(r["text"], r["ticker"]) for r in sorted(rows, key=lambda r: r["evidence_id"])], roster)
    return SemiMarkov().fit(data) if data else SemiMarkov()


def speaker_turns(scripts: DataFrame, roster: Roster, cleaner: Cleaner, model: SemiMarkov) -> DataFrame:
    """(evidence_id, turn_no, speaker_id, n_words, label, start_s, said) of every turn of every transcript."""
    shared = scripts.sparkSession.sparkContext.broadcast((roster, cleaner, model.weights))  # the roster's size is checked

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        people, tidy, weights = shared.value
        m = SemiMarkov(weights)
        for pdf in parts:
            out = []
            for k, text, ticker in zip(pdf["evidence_id"], pdf["text"], pdf["ticker"]):
                for n, (speaker, label, said, start) in enumerate(turns(text, ticker, people, tidy, m), 1):
                    out.append((k, n, speaker, count_words(said), label, start, said))
            frame = pd.DataFrame(out, columns=["evidence_id", "turn_no", "speaker_id", "n_words", "label", "start_s", "said"])
            frame["speaker_id"] = frame["speaker_id"].astype("Int64")
            frame["start_s"] = frame["start_s"].astype("float64")
            yield frame

    return map_rows(scripts, ["evidence_id"], [F.col("text"), F.col("ticker")], run, "turn_no int, speaker_id long, n_words int, label string, start_s double, said string")


def card_speakers(cards: DataFrame, roster: Roster) -> DataFrame:
    """(record_kind, record_id, speaker_id) of every non-null label in the cards' speaker and management_speaker.

    Distinct labels of a company are resolved once, and the dictionary is joined to the cards."""
    shared = cards.sparkSession.sparkContext.broadcast(roster)  # its size is checked
    pair = lambda c: F.struct(F.lit(c).alias("record_kind"), F.col(c).alias("label"))
    rows = cards.select(F.col("card_seq").alias("record_id"), "ticker", F.explode(F.array(pair("speaker"), pair("management_speaker"))).alias("p")).select("record_id", F.coalesce("ticker", F.lit("")).alias("_t"), "p.*").where("label IS NOT NULL")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        people = shared.value
        for pdf in parts:
            ids = [people.resolve(t, x)[0] for t, x in zip(pdf["_t"], pdf["label"])]
            yield pd.DataFrame({"_t": pdf["_t"], "label": pdf["label"], "speaker_id": pd.array(ids, dtype="Int64")})

    distinct = rows.select("_t", "label").distinct()
    known = stored(distinct.mapInPandas(run, "_t string, label string, speaker_id long"), "labels")
    return rows.join(small(known, BROADCAST_LABELS), ["_t", "label"], "left").select("record_kind", "record_id", "speaker_id")
