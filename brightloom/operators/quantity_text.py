"""Finding one current quantity in free text: its number and the spelling of its unit."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

from brightloom.functions.numerals import DIGITS, MINUS, WORD_VALUE, WORDS, digits_value, words_value

_EARLIER = r"(?:a|one) (?:year|quarter|month) (?:earlier|ago|before)|(?:in|for|of) the (?:prior|previous|preceding|year-ago) (?:period|year|quarter)|last (?:year|quarter)"
#: clauses that give the figure of an earlier period; they are taken out before the current figure is sought.
PRIOR = re.compile(
    rf"^\s*(?:after|against|from|versus|vs\.?)\s+(?:(?!{_EARLIER}).)*?(?:{_EARLIER})\s*,?"
    rf"|,?\s*\(?(?:compared (?:with|to)|versus|vs\.?|against|up from|down from|from|after)\s+(?:(?!{_EARLIER}).)*?(?:{_EARLIER})\)?",
    re.I | re.S,
)
_CURRENCY = r"(?:US\$|USD|\$|US dollars?|dollars?)"
_SIGN = rf"(?:negative|minus|[{MINUS}])"
QUANTITY = re.compile(
    rf"(?P<s1>{_SIGN})?\s*(?P<cur>{_CURRENCY})?\s*(?P<s2>{_SIGN})?\s*(?P<open>\()?\s*(?P<cur2>{_CURRENCY})?\s*(?P<s3>{_SIGN})?\s*"
    rf"(?:(?P<dig>{DIGITS})|(?P<word>{WORDS}))(?:\s*(?P<close>\)))?",
    re.I,
)
#: Java pattern of texts that may hold a quantity at all: a digit or the beginning of a number word.
SOME_NUMBER = r"(?iU)\d|\b(?:" + "|".join(WORD_VALUE) + ")"
#: where a unit that follows its number ends.
_UNIT_END = re.compile(
    r"\s*(?:[,;:!?()\"“”]|\.(?=\s*(?:$|[A-Z]))|\s[—–-]\s|\s+(?:in|for|at|on|from|to|with|as|and|or|by|of|over|during|after|against|than|"
    r"reflects?|reflected|was|were|is|are|compared|versus|vs|helped|driven|due|while|that|which)\b|$)"
)
_RATIO = re.compile(r"\b(?:a\s+)?(fraction|ratio|share|proportion) of\s*$", re.I)
_ABOUT = re.compile(r"^\s*(?:c\.|ca\.?|approx\.?|approximately|about|around|roughly|some|~|≈)\s*", re.I)
#: a table heading before the figure: "(dollars in thousands) Net revenue 9" or "USD, amounts in millions: Net revenue 9".
HEADING = re.compile(r"^\s*(?:\(([^()]*)\)|([^:]+):)\s*(.*)$", re.S)


def fold(text: str) -> str:
    """The form in which unit spellings are compared: compatibility forms, case and blanks are evened out."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text.replace("²", "2")).casefold()).strip(" .:,;")


def metric_key(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.casefold()).strip()


def _number(m: re.Match) -> Decimal | None:
    value = digits_value(m["dig"]) if m["dig"] else words_value(m["word"])
    if value is None:
        return None
    negative = bool(m["s1"] or m["s2"] or m["s3"]) or bool(m["open"] and m["close"])
    return -value if negative else value


def read(text: str | None) -> tuple[Decimal, str] | None:
    """The first quantity of a text as (number, unit spelling); the spelling is empty where there is none."""
    if not text or not text.strip():
        return None
    for m in QUANTITY.finditer(text):
        before = text[: m.start()]
        if before and (before[-1].isalnum() or before[-1] == ".") and text[m.start()].isalnum():
            continue  # inside a name, such as Q4 or FY2026
        value = _number(m)
        if value is None:
            continue
        rest = text[m.end() :]
        end = _UNIT_END.search(rest)
        suffix = rest[: end.start()] if end else rest
        prefix = m["cur"] or m["cur2"] or ""
        if not prefix and not suffix.strip() and (r := _RATIO.search(before)):
            suffix = f"{r[1]} of"
        return value, fold(f"{prefix} {suffix}")
    return None


def read_quote(quote: str | None, metric: str) -> tuple[Decimal, str] | None:
    """The current quantity of a metric in a quote. The quote must name the metric; figures of an earlier period are passed over.

    A table heading gives the unit where the figure itself has none."""
    if not quote or metric_key(metric) not in metric_key(quote):
        return None
    heading = HEADING.match(quote)
    if heading and metric_key(heading[3]).startswith(metric_key(metric)):
        got = read(PRIOR.sub(" ", heading[3]))
        if got is None:
            return None
        return got if got[1] else (got[0], fold(heading[1] or heading[2]))
    return read(PRIOR.sub(" ", quote))
