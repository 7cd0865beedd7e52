"""Reading of written numbers: digits with group marks, signs, brackets for negatives, and English number words."""

from __future__ import annotations

import re
from decimal import Decimal

# English number words.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
# end of fixed values

WORD_VALUE = {w: i for i, w in enumerate(ONES)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
_WORD = "(?:" + "|".join(sorted(WORD_VALUE, key=len, reverse=True)) + ")"
#: cardinal words: "twelve", "forty-five point two six", "one hundred and five"; a scale word is left to the unit.
WORDS = rf"\b{_WORD}(?:[ -](?:{_WORD}|hundred|and(?= {_WORD})))*(?: point(?: {_WORD})+)?\b"
#: digits with commas, blanks of any width or apostrophes between groups of three, or plain digits; then a decimal part.
DIGITS = r"(?:\d{1,3}(?:[,\u00a0\u202f\u2009 '’]\d{3})+(?!\d)|\d+)(?:\.\d+)?|\.\d+"
MINUS = "-−‒–﹣－"


def words_value(text: str) -> Decimal | None:
    """The value of number words, or None if they are none ("two three" and the like have none)."""
    whole, _, part = text.lower().partition(" point ")
    total, last = 0, 1000
    for w in re.split(r"[ -]+", whole):
        if w == "and":
            continue
        if w == "hundred":
            if not 0 < total < 10:
                return None
            total, last = total * 100, 100
            continue
        v = WORD_VALUE.get(w)
        if v is None or (v >= last and total):
            return None
        total, last = total + v, (10 if v >= 20 else 1)
    digits = ""
    for w in part.split():
        v = WORD_VALUE.get(w)
        if v is None or v > 9:
            return None
        digits += str(v)
    return Decimal(f"{total}.{digits or 0}")


def digits_value(text: str) -> Decimal:
    return Decimal(re.sub(r"[^\d.]", "", text))
