"""Text and answer normal forms (plain Python, for use on Arrow batches)."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕһӏԁԛԝвнкмтгοαερυικνχβ", "aeopcyxijshldqwbhkmtroaepuiknxb")
# English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
MONTHS = "january february march april may june july august september october november december".split()
# Units of measure and their symbols.
MEASURES = {"m": "m", "metre": "m", "metres": "m", "meter": "m", "meters": "m", "s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s", "km": "km", "kilometre": "km", "kilometres": "km", "kilometer": "km", "kilometers": "km", "kg": "kg", "kilogram": "kg", "kilograms": "kg", "min": "min", "mins": "min", "minute": "min", "minutes": "min", "percent": "%", "%": "%"}

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
_NUMBER_WORD = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS) if i > 1}


def fold(text: str) -> str:
    """Case, accents, look-alike letters, invisible characters and compatibility forms folded."""
    if text.isascii():
        return text.lower()
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(LOOKALIKES)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Folded runs of letters or digits, markup left out."""
    return _WORD.findall(fold(_TAG.sub(" ", text)))


# What stands between the items of a list (words in English, German, French, Spanish).
_BETWEEN = re.compile(r"\s*(?:[,;&]|(?<!\w)(?:and|und|et|y)(?!\w))\s*")


def answer_key(text: str) -> str:
    """One form for the notations of an answer: numbers, dates, measures; else its folded words. The items of a list come
    in one order."""
    t = fold(text).strip()
    t = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", t)
    if m := _date(_tokens(t)):
        return m
    items = [x for x in _BETWEEN.split(t) if re.search(r"\w", x)]
    return " & ".join(sorted(_item(x) for x in items)) if len(items) > 1 else _item(t)


def _tokens(t: str) -> list[str]:
    return re.findall(r"\d+(?:\.\d+)?|[^\W\d_]+|%", t)


def _item(t: str) -> str:
    w = _tokens(t)
    if w and w[0] in ("the", "a", "an") and len(w) > 1:
        w = w[1:]
    out: list[str] = []
    for x in w:
        if x in _NUMBER_WORD:
            n = _NUMBER_WORD[x]
            if out and n < 10 and out[-1] in _TENS_TEXT:
                out[-1] = str(int(out[-1]) + n)
            else:
                out.append(str(n))
        else:
            out.append(x)
    if out and re.fullmatch(r"\d+(\.\d+)?", out[0]):
        rest = [MEASURES.get(x, x) for x in out[1:]]
        number = out[0].lstrip("0") or "0"
        # A bare number and one with its measure are notations of the same answer to the same question.
        return number if len(rest) <= 1 and all(x in MEASURES.values() for x in rest) else " ".join([number, *rest])
    return " ".join(out)


_TENS_TEXT = {str(10 * i) for i in range(2, 10)}


def _date(w: list[str]) -> str | None:
    if len(w) != 3:
        return None
    month = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    a, b, c = (re.sub(r"^(\d+)(st|nd|rd|th)$", r"\1", x) for x in w)
    if b in month and a.isdigit() and c.isdigit():
        y, d, m = (c, a, month[b]) if len(c) == 4 else (a, c, month[b])
    elif a in month and b.isdigit() and c.isdigit():
        y, d, m = c, b, month[a]
    elif all(x.isdigit() for x in (a, b, c)) and len(a) == 4:
        y, m, d = a, int(b), c
    else:
        return None
    return f"{int(y):04d}-{int(m):02d}-{int(d):02d}"


def within(a: str, b: str, limit: int) -> bool:
    """Whether a becomes b by at most ``limit`` insertions, deletions, substitutions or swaps of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > limit:
        return False
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row[j] = d
        if min(row) > limit:
            return False
        prev2, prev = prev, row
    return prev[-1] <= limit
