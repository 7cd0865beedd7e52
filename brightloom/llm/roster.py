"""Speaker labels of any kind resolved to a roster: names in any order, case and spelling, initials, roles, firms and the operator.

Candidates are the people of the record's company, the analysts and the operator. A name that fits several people
equally well, or none closely enough, is not resolved; nor is a role held by several people of the company.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# Role names and the words for whoever runs a call.
ROLES = {
    "chief executive officer": ["ceo", "chief executive", "chief executive officer", "president and ceo"],
    "chief financial officer": ["cfo", "chief financial officer", "finance chief"],
    "chief operating officer": ["coo", "chief operating officer"],
    "vice president, investor relations": ["vp ir", "ir", "investor relations", "vp investor relations", "vice president investor relations", "head of investor relations", "vp, ir"],
}
OPERATORS = ["operator", "moderator", "conference operator", "call operator", "coordinator", "conference coordinator"]
ANALYST = ["analyst", "research analyst", "unidentified analyst"]
# end of fixed values

#: people on a roster, which is sent to every executor; beyond, the operators refuse to run.
MOST_PEOPLE = 200_000
_ROLE_OF = {re.sub(r"[\W_]+", " ", a).strip(): r for r, names in ROLES.items() for a in [r, *names]}
_SPLIT = re.compile(r"\s+[–—-]{1,2}\s+|\s*[()\[\]]\s*")


#: labels longer than this are resolved anew each time.
LONGEST_REMEMBERED = 200


def fold(label: str) -> str:
    s = label.casefold() if label.isascii() else unicodedata.normalize("NFKC", label).casefold()
    if not s.isascii():
        s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", s).strip(" :;")


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words (a swap of neighbours is one), or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


@dataclass
class Roster:
    """people: (speaker_id, ticker, full_name, role, firm)."""

    people: list[tuple[int, str | None, str, str, str | None]]
    memory: dict[tuple[str | None, str], tuple[int | None, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_ticker: dict[str, list[tuple[int, list[str], str]]] = {}
        self.outside: list[tuple[int, list[str], str]] = []
        self.firms: dict[str, list[int]] = {}
        self.operators: list[int] = []
        for speaker, ticker, name, role, firm in self.people:
            role = fold(role or "")
            if role in OPERATORS:
                self.operators.append(speaker)
                continue
            entry = (speaker, re.sub(r"[^\w'-]+", " ", fold(name or "")).split(), _ROLE_OF.get(re.sub(r"[\W_]+", " ", role).strip(), role))
            if ticker:
                self.by_ticker.setdefault(ticker, []).append(entry)
            else:
                self.outside.append(entry)
                if firm:
                    self.firms.setdefault(re.sub(r"[\W_]+", " ", fold(firm)).strip(), []).append(speaker)
        self.last_outside: dict[str, list[tuple[int, list[str], str]]] = {}
        for e in self.outside:
            if e[1]:
                self.last_outside.setdefault(e[1][-1], []).append(e)
        self.near_outside: dict[str, list[tuple[int, list[tuple[int, list[str], str]]]]] = {}
        known = [len(e[1]) for es in (*self.by_ticker.values(), self.outside) for e in es] + [len(x.split()) for x in (*self.firms, *_ROLE_OF, *OPERATORS)]
        self.longest = max(known) + 3  # a role of up to three words may stand before a name

    def may_name(self, line: str) -> bool:
        """Whether what stands before a line's first separator is no longer than any name, firm or role, so that the line could be a label."""
        first = _SPLIT.split(line.strip(), maxsplit=1)[0] if len(line) > 60 else line
        return len(first.split(None, self.longest)) <= self.longest

    def resolve(self, ticker: str | None, label: str | None) -> tuple[int | None, str]:
        """(speaker_id or None, how: name, near, role, firm, operator or none)."""
        if not isinstance(label, str):
            return None, "none"
        ticker = ticker if isinstance(ticker, str) else None
        key = (ticker, label)
        if len(label) > LONGEST_REMEMBERED:
            return self._resolve(ticker, fold(label))
        if key not in self.memory:
            if len(self.memory) > 500_000:
                self.memory.clear()
            self.memory[key] = self._resolve(ticker, fold(label))
        return self.memory[key]

    def _resolve(self, ticker: str | None, label: str) -> tuple[int | None, str]:
        if not label:
            return None, "none"
        plain = re.sub(r"[\W_]+", " ", label).strip()
        if plain in OPERATORS:
            return (self.operators[0], "operator") if len(self.operators) == 1 else (None, "none")
        company = self.by_ticker.get(ticker, []) if ticker else []
        if plain in self.firms and len(self.firms[plain]) == 1:
            return self.firms[plain][0], "firm"
        found: dict[str, set[int]] = {"name": set(), "near": set(), "firm": set(), "role": set()}
        first = True
        for part in filter(None, _SPLIT.split(label)):
            opening, first = first, False
            word = re.sub(r"[\W_]+", " ", part).strip()
            if word in OPERATORS and self.operators:
                return self.operators[0], "operator"
            if word in self.firms:
                found["firm"].update(self.firms[word])
                continue
            if word in _ROLE_OF:
                found["role"].update(s for s, _, r in company if r == _ROLE_OF[word])
                continue
            if word in ANALYST:
                continue
            words = word.split()
            for n in (3, 2, 1):  # a role before the name, as in "ceo halavquist"
                if len(words) > n and " ".join(words[:n]) in _ROLE_OF:
                    part = " ".join(words[n:])
                    break
            got, how = self._name(company, part)
            if opening and not got and len(part.split()) > 4:
                return None, "none"  # it begins as a sentence does
            found[how].update(got)
        for how in ("name", "near", "firm", "role"):
            if len(found[how]) == 1:
                return next(iter(found[how])), how
        return None, "none"

    def _name(self, company: list, part: str) -> tuple[set[int], str]:
        if "," in part:
            last, _, first = part.partition(",")
            part = f"{first} {last}"
        words = re.sub(r"[^\w'-]+", " ", part).split()
        if not words or any(c.isdigit() for c in part):
            return set(), "near"
        if len(words) > 4:  # all of a long name's words must be there
            return {e[0] for e in [*company, *self.last_outside.get(words[-1], [])] if e[1] == words}, "name"
        first, last = (words[0] if len(words) > 1 else ""), words[-1]
        fits = lambda e: not first or (e[1][0] == first if len(first) > 1 else e[1][0][:1] == first)
        exact = {e[0] for e in company if e[1] and e[1][-1] == last and fits(e)} or {e[0] for e in self.last_outside.get(last, []) if fits(e)}
        if exact:
            return exact, "name"
        # the closest of all candidates, if it is clearly closer than the next one
        scores = []
        for d, e in [*self._close(last, company), *((d, e) for d, es in self._outside_close(last) for e in es)]:
            most = max(1, min(3, len(e[1][-1]) // 3))
            if len(first) > 1:
                f = distance(first, e[1][0], 2)
                if f > 2 or d + f > most + 1:
                    continue
                d += f
            elif first and e[1][0][:1] != first:
                continue
            scores.append((d, e[0]))
        scores.sort()
        if scores and (len(scores) == 1 or scores[1][0] > scores[0][0]):
            return {scores[0][1]}, "near"
        return set(), "near"

    @staticmethod
    def _close(last: str, entries: list) -> list:
        """(distance, entry) of the entries whose last name is near enough."""
        out = []
        for e in entries:
            if e[1]:
                most = max(1, min(3, len(e[1][-1]) // 3))
                if (d := distance(last, e[1][-1], most)) <= most:
                    out.append((d, e))
        return out

    def _outside_close(self, last: str) -> list:
        """The same of those who may speak on any company's call, once for each distinct last name, and remembered."""
        if last not in self.near_outside:
            if len(self.near_outside) > 100_000:
                self.near_outside.clear()
            close = self._close(last, [es[0] for es in self.last_outside.values()])
            self.near_outside[last] = [(d, self.last_outside[e[1][-1]]) for d, e in close]
        return self.near_outside[last]
