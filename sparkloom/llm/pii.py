"""Personal information in free text: places of emails, phones, ids, addresses and names, and their replacement.

Numbers and dates are replaced by format-preserving pseudonyms: a keyed Feistel permutation moves the digits and
letters that are free in the number's format, and walks on along its cycle until the result is valid in that format; check
digits and letters are computed anew. So a valid number becomes another valid one, a value keeps its notation, and equal
values stay linked across documents and notations, while different values never fall together:

* phones are permuted in their subscriber digits, under the national number: ``+44 20 ...``, ``0044 20 ...`` and
  ``020 ...`` of one phone get the same new digits, and so does a number spelt in words;
* national id, tax, insurance and social security numbers, bank account and card numbers are told apart by their check digits
  and ranges. A number that passes no check is permuted freely within its format: invented and mistyped numbers are personal too,
  so validity decides how a number is replaced, not whether;
* dates of birth (with ``dates="all"`` every calendar date) are permuted as days, in their notation.

Emails, addresses and names get a keyed digest of their folded form. Every replacement stands in a typed placeholder,
``[PHONE +44 71 5520 1834]``. The key is an argument without default.

Defined results: null texts give no place and stay null; empty texts stay empty; overlapping candidates are
resolved by kind (email, account, id, date, phone, address, name) and then by position; repeated rows are each treated; an empty
table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.common import parallelism

ROUNDS = 8


# --- Keyed permutations --------------------------------------------------------------------------------------
def _round(key: bytes, i: int, half: int, modulus: int, tweak: str) -> int:
    d = hmac.new(key, f"{tweak}:{i}:{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(d[:16], "big") % modulus


def permute(symbols: list[int], radices: list[int], key: bytes, tweak: str = "", back: bool = False) -> list[int]:
    """A keyed Feistel permutation of all symbol lists with these radices (its inverse with ``back``)."""
    tweak = f"{tweak}:{radices}"
    if len(symbols) < 2:
        return [(s + (-1 if back else 1) * _round(key, 0, 0, r, tweak)) % r for s, r in zip(symbols, radices)]
    cut = len(symbols) // 2
    sizes = math.prod(radices[:cut]), math.prod(radices[cut:])
    half = [0, 0]
    for i, (s, r) in enumerate(zip(symbols, radices)):
        half[i >= cut] = half[i >= cut] * r + s
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = i % 2  # each half is moved by the other in turn
        f = _round(key, i, half[1 - side], sizes[side], tweak)
        half[side] = (half[side] + (-f if back else f)) % sizes[side]
    out = []
    for i in reversed(range(len(symbols))):
        half[i >= cut], s = divmod(half[i >= cut], radices[i])
        out.append(s)
    return out[::-1]


def permute_text(text: str, key: bytes, tweak: str = "", back: bool = False) -> str:
    """Digits permuted among digits and capital letters among letters, all at once."""
    radix = [10 if c.isdigit() else 26 for c in text]
    low = [48 if c.isdigit() else 65 for c in text]
    return "".join(chr(s + o) for s, o in zip(permute([ord(c) - o for c, o in zip(text, low)], radix, key, tweak, back), low))


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


#: Fixed value: check letters of Spanish identity numbers, by the number's remainder.
DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


@dataclass(frozen=True)
class Scheme:
    """A number format: which characters are free, how the others follow from them, and which numbers are valid."""

    name: str
    form: re.Pattern
    free: Callable[[str], list[int]]
    close: Callable[[str], str]
    valid: Callable[[str], bool]

    def fits(self, s: str) -> bool:
        return bool(self.form.fullmatch(s)) and self.valid(s)

    def move(self, s: str, key: bytes, back: bool = False) -> str:
        at = self.free(s)
        while True:  # ends: the walk along a cycle comes back to s, which is valid
            new = permute_text("".join(s[i] for i in at), key, self.name, back)
            chars = list(s)
            for i, c in zip(at, new):
                chars[i] = c
            s = self.close("".join(chars))
            if self.valid(s):
                return s


def _scheme(name: str, form: str, free: Callable[[str], list[int]], check: Callable[[str], str] | None = None, rest: Callable[[str], bool] = lambda s: True) -> Scheme:
    """With ``check``, which gives the whole number with its check characters right."""
    close = check or (lambda s: s)
    return Scheme(name, re.compile(form), free, close, lambda s: close(s) == s and rest(s))


def _all_but(*out: int) -> Callable[[str], list[int]]:
    return lambda s: [i for i in range(len(s)) if i not in out and i - len(s) not in out]


def _iban(s: str) -> str:
    return f"{s[:2]}{98 - _mod97(s[4:] + s[:2] + '00'):02d}{s[4:]}"


ACCOUNTS = (
    _scheme("iban", r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", _all_but(0, 1, 2, 3), _iban),
    _scheme("card", r"[3-6]\d{12,18}", _all_but(0, -1), lambda s: f"{s[:-1]}{-_luhn(s[:-1] + '0') % 10}"),
)
SCHEMES = (
    _scheme("dni", r"\d{8}[A-Z]", _all_but(-1), lambda s: s[:-1] + DNI[int(s[:8]) % 23]),
    _scheme("nie", r"[XYZ]\d{7}[A-Z]", _all_but(0, -1), lambda s: s[:-1] + DNI[int(f"{'XYZ'.index(s[0])}{s[1:8]}") % 23]),
    _scheme("nir", r"[12]\d{14}", _all_but(0, -1, -2), lambda s: f"{s[:13]}{97 - int(s[:13]) % 97:02d}", lambda s: 1 <= int(s[3:5]) <= 12 and s[5:7] != "00"),
    _scheme("nino", r"[A-Z]{2}\d{6}[A-D]", _all_but(-1), rest=lambda s: not (set(s[:2]) & set("DFIQUV") or s[1] == "O" or s[:2] in ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ"))),
    _scheme("ssn", r"\d{9}", _all_but(), rest=lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"),
    *ACCOUNTS,
)
#: Country codes that are read, and the form of subscriber numbers of the North American plan.
COUNTRIES = ("1", "33", "34", "44", "49")


def _written(value: str, new: str) -> str:
    """The characters of ``new`` in place of the letters and digits of ``value``, from the right, in its case and layout."""
    out, rest = list(value), list(new)
    for i in reversed(range(len(value))):
        if value[i].isascii() and value[i].isalnum() and rest:
            c = rest.pop()
            out[i] = c.lower() if value[i].islower() else c
    return "".join(out)


def spoken_digits(value: str) -> str:
    """The digits of a number spelt in words."""
    out, times = "", 1
    for w in re.findall(r"[^\W\d_]+", value.lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out += SPOKEN[w] * times
            times = 1
    return out


def national(value: str) -> tuple[str, bool]:
    """The national number of a phone in any notation, without trunk digits, and whether it is of the North American plan."""
    value = value.strip()
    if not any(c.isdigit() for c in value):
        value = spoken_digits(value)
    abroad = value.startswith("+") or value.startswith("00")
    if abroad:
        value = re.sub(r"\(0\)", "", value)
    d = re.sub(r"\D", "", value)
    if abroad:
        d = d[2:] if value.startswith("00") else d
        code = next((c for c in COUNTRIES if d.startswith(c)), d[:2])
        return d[len(code) :], code == "1"
    if d.startswith("0"):
        return d[1:], False
    d = d[1:] if len(d) == 11 and d[0] == "1" else d
    return d, len(d) == 10 and d[0] in "23456789"


def phone_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """The phone with other subscriber digits, at most the last seven; the codes before them stay."""
    number, american = national(value)
    if not any(c.isdigit() for c in value):
        value = spoken_digits(value)
    n = max(1, min(7, len(number) - 2))
    head, tail = number[:-n], number[-n:]
    while True:  # American subscriber numbers begin with 2 to 9
        tail = permute_text(tail, key, f"phone:{head}", back)
        if not american or n < 7 or tail[0] in "23456789" or number[-n] in "01":
            return _written(value, tail)


def id_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """A number of the same format, valid if this one is."""
    s = "".join(c for c in value if c.isascii() and c.isalnum()).upper()
    for scheme in SCHEMES:
        if scheme.fits(s):
            return _written(value, scheme.move(s, key, back))
    new = s
    while True:  # one that passes no check gets one that passes none: valid and other numbers never fall together
        new = permute_text(new, key, "id", back)
        if not any(scheme.fits(new) for scheme in SCHEMES):
            return _written(value, new)


# Names of months by language, short forms behind the long ones, and words before a date of birth.
MONTHS = [
    "january february march april may june july august september october november december".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
]
_MONTH = {w: i for names in reversed(MONTHS) for i, w in enumerate(names, 1)}
_BORN = r"(?:born|date\s+of\s+birth|birth\s*date|birthday|d\.?o\.?b\.?|n[ée]e?\s+le|date\s+de\s+naissance|geboren|geb\.|geburtsdatum|nacid[oa]|fecha\s+de\s+nacimiento)"
_MONTHS = "|".join(sorted(_MONTH, key=len, reverse=True))
DATE = re.compile(rf"(?<![\w.,/-])(?:(?P<y1>\d{{4}})(?P<s>[-/.])(?P<m1>\d\d?)(?P=s)(?P<d1>\d\d?)|(?P<a>\d\d?)(?P<t>[-/.])(?P<b>\d\d?)(?P=t)(?P<y2>\d{{4}})|(?P<d3>\d\d?)(?P<o3>st|nd|rd|th)?\.?\s(?:de\s)?(?P<m3>{_MONTHS})\.?,?\s(?:de\s)?(?P<y3>\d{{4}})|(?P<m4>{_MONTHS})\.?\s(?P<d4>\d\d?)(?P<o4>st|nd|rd|th)?,?\s(?P<y4>\d{{4}}))(?![\w/-]|[.,]\d)", re.I)
BORN = re.compile(rf"(?<!\w){_BORN}[^\d\n]{{0,16}}?(?=\d|(?<!\w)(?:{_MONTHS})\.?\s\d)", re.I)
DAY_ONE, DAYS, SIDE = datetime.date(1900, 1, 1).toordinal(), 73049, 271


def read_date(m: re.Match) -> datetime.date | None:
    """The day a match of DATE names; days come before months, unless that gives none."""
    g = m.groupdict()
    if g["y1"]:
        y, mo, d = g["y1"], int(g["m1"]), g["d1"]
    elif g["y2"]:
        y, mo, d = g["y2"], int(g["b"]), g["a"]
        if mo > 12:
            mo, d = int(d), str(mo)
    elif g["y3"]:
        y, mo, d = g["y3"], _MONTH[g["m3"].lower()], g["d3"]
    else:
        y, mo, d = g["y4"], _MONTH[g["m4"].lower()], g["d4"]
    try:
        return datetime.date(int(y), mo, int(d))
    except ValueError:
        return None


def date_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Another day between 1900 and 2099 in the same notation; a date that is none, or of another time, stays."""
    m = DATE.fullmatch(value)
    day = read_date(m) if m else None
    if day is None or not 0 <= (n := day.toordinal() - DAY_ONE) < DAYS:
        return value
    while True:
        a, b = permute(list(divmod(n, SIDE)), [SIDE, SIDE], key, "date", back)
        n = a * SIDE + b
        if n < DAYS:
            break
    new, g = datetime.date.fromordinal(DAY_ONE + n), m.groupdict()
    turned = bool(g["y2"]) and int(g["b"]) > 12
    parts = {"y1": new.year, "m1": new.month, "d1": new.day, "a": new.month if turned else new.day, "b": new.day if turned else new.month, "y2": new.year, "d3": new.day, "y3": new.year, "d4": new.day, "y4": new.year}
    for name in ("m3", "m4"):
        if g[name]:
            word = next(names for names in MONTHS if g[name].lower() in names)[new.month - 1]
            parts[name] = word.upper() if g[name].isupper() else word.capitalize() if g[name][0].isupper() else word
    parts["o3"] = parts["o4"] = "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    out = value
    for name in sorted((k for k in parts if g[k]), key=lambda k: -m.start(k)):
        text = parts[name]
        if isinstance(text, int):
            text = f"{text:02d}" if len(g[name]) == 2 and name not in ("d3", "d4") else str(text)
        out = out[: m.start(name)] + text + out[m.end(name) :]
    return out


# --- Patterns ------------------------------------------------------------------------------------------------
# Endings of file names, which are no top-level domains.
_FILES = r"(?!(?:png|jpe?g|gif|webp|svg|mp4|webm|mkv|srt|vtt|json|txt|pdf)\b)"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?\[\.\]\s?|\s?\((?:dot|\.)\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\s(?:dot|punkt|punto|point)\s)"
_HARD_DOT = r"(?:\s?\[\.\]\s?|\s?\((?:dot|\.)\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\s(?:dot|punkt|punto|point)\s)"
EMAIL = re.compile(
    rf"(?<![\w%+/])(?:{_LOCAL}\s?[@＠]\s?(?!\d+x)|{_LOCAL}\s?(?:\(at\)|\[at\]|\{{at\}})\s?){_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}{_FILES}[A-Za-z]{{2,24}}(?![\w])"
    rf"|(?<![\w%+/]){_LOCAL}\s(?:at|arroba|chez)\s{_LABEL}(?:{_HARD_DOT}{_LABEL}){{0,3}}{_HARD_DOT}{_FILES}[A-Za-z]{{2,24}}(?![\w])",
    re.I,
)

#: What every email has, in one form or another.
_MAIL = re.compile(r"[@＠]|[(\[{](?:at|dot|\.)[)\]}]|\s(?:dot|punkt|punto|point)\s", re.I)

# Spoken digits (English, German, French, Spanish).
_DIGITS = "zero oh null zéro cero|one eins un uno|two zwei deux dos|three drei trois tres|four vier quatre cuatro|five fünf cinq cinco|six sechs seis|seven sieben sept siete|eight acht huit ocho|nine neun neuf nueve"
SPOKEN = {w: str(i) for i, names in enumerate(_DIGITS.split("|")) for w in names.split()}
_SPOKEN = [*SPOKEN, "double", "triple"]
_SPOKEN_ALT = "(?:" + "|".join(sorted(_SPOKEN, key=len, reverse=True)) + ")"
_SEP = r"[\s.\-/\u2013]"
PHONE = re.compile(
    rf"""(?<![\w+.,/=-])(?:
      (?:\+|(?<!\d)00)\d{{1,3}}(?:{_SEP}?\(?\d{{1,5}}\)?){{2,6}}(?!\d)
    | \(\d{{2,5}}\)(?:{_SEP}?\d{{2,8}}){{1,4}}
    | 0\d{{1,4}}(?:{_SEP}\d{{2,8}}){{1,5}}
    | 0\d{{9,10}}
    | (?:1{_SEP})?[2-9]\d{{2}}{_SEP}[2-9]\d{{2}}{_SEP}\d{{4}}
    | [2-9]\d{{2}}[2-9]\d{{6}}
    )(?![\w/]|[.,-]\d)""",
    re.X,
)
SPELT = re.compile(rf"(?<!\w){_SPOKEN_ALT}(?:[\s,-]{{1,3}}{_SPOKEN_ALT}){{6,15}}(?!\w)", re.I)
# Words before numbers that are neither phones nor ids.
_OTHER = re.compile(r"(?:call\s*sign|channel|episode|video\s*id|batch|score|sha|recorded|frame|views?|likes?|route|version|isbn|invoice|receipt|order|ticket|doi|part|item|scene)\W{0,3}$", re.I)

# Words that announce an identity number.
_ID_CUE = (
    r"(?:passport|identity|national\s+id|id\s*card|id\s*number|identification|insurance|social\s+security|ssn|nif|nie|dni|nir|nino|ausweis\w*|personalausweis\w*|reisepass\w*|"
    r"carte\s+d['’]identit[ée]|pi[èe]ce\s+d['’]identit[ée]|passeport|pasaporte|documento(?:\s+de\s+identidad)?|cédula|steuer\w*)"
)
ID_CUED = re.compile(rf"(?<![\w-]){_ID_CUE}(?:\s+(?:card|number|no|nr|num[ée]ro|número|n[°º]))?\.?\s*[:=#]?\s*(?P<v>[A-Z]{{0,3}}(?:[\s-]?[A-Z]?\d[A-Z]?){{5,16}}(?:[\s-]?[A-Z])?)(?![\w])", re.I)
ID_FORMAT = re.compile(
    r"""(?<![\w+./-])(?:
      [A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]
    | \d{3}-\d{2}-\d{4}
    | \d{3}\s\d{2}\s\d{4}
    | \d\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}\s\d{2}
    | [XYZ]-?\d{7}-?[A-Z]
    | \d{8}-?[A-Z]
    | [A-Z]\d{8}
    | [A-Z]{2}-\d{6,9}
    | [A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}
    )(?![\w-])""",
    re.X,
)
#: Bank account and card numbers, if their check digits are right.
ACCOUNT = re.compile(r"(?<![\w.,/-])(?:[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{1,4}){3,8}|[3-6]\d{3}(?:[\s-]?\d{4}){2}[\s-]?\d{1,7}|3\d{3}[\s-]?\d{6}[\s-]?\d{5})(?![\w-])")
# 9 bare digits count as an id only beside one of these words.
ID_NEAR = re.compile(r"(?<![\w.,/-])\d{9}(?!\w|[.,]\d)(?=\W{1,3}(?:as\s+my|comme|como|als)\s)", re.I)

# Kinds of streets.
_EN = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|drive|dr\.?|court|ct\.?|close|boulevard|blvd\.?|way|terrace|square|sq\.?|crescent|place|row|hill|grove|gardens|mews|parade|alley|walk)"
_FR = r"(?:rue|avenue|av\.|place|boulevard|bd\.?|chemin|allée|impasse|quai|cours|route)"
_ES = r"(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|carrera|ronda)"
_DE = r"(?:-allee|-straße|-strasse|-platz|-weg|-ring|straße|strasse|str\.|weg|platz|allee|gasse|ufer|ring|damm)"
_UNITS = r"(?:minutes?|seconds?|hours?|days?|weeks?|months?|years?|miles?|km|metres?|meters?|feet|mm|cm|kg|frames?|views?|likes?|times|parts?|points?|lane|lanes)"
_NAME = r"[^\W\d_][^\W\d_'’-]*(?:[-'’][^\W\d_]+)*"
_TOWN = rf"(?:\d{{4,5}}\s+)?{_NAME}(?:\s+\d{{5}})?"
ADDRESSES = (
    re.compile(
        rf"""(?<![\w.,:/-])\d{{1,4}}\s?[A-Z]?\s(?!{_UNITS}\s)(?:{_NAME}\s){{1,2}}{_EN}(?![\w])(?:,\s(?:flat|apt\.?|apartment|unit|suite)\s\w{{1,4}})?(?:,\s{_NAME}(?:\s\d{{5}}\b)?|\s*\n\s*{_NAME}\s\d{{5}}\b)?
        |(?<![\w.,:/-])\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s{_FR}\s(?:(?:de\s+la|de\s+l['’]|du|des|de|d['’])\s?)?{_NAME}(?:,\s\d{{5}}\s{_NAME}|\s[àa]\s{_NAME})?""",
        re.X | re.I,
    ),
    re.compile(rf"(?<![\w]){_ES}\s?(?:de\s(?:la\s|los\s|las\s)?|del\s)?{_NAME},?\s\d{{1,4}}(?![\d])(?:,\s\d{{1,2}}\s?[ºª°]\s?[A-Z]?\b)?(?:,\s\d{{5}}\s{_NAME})?", re.I),
    re.compile(
        rf"(?<![\w-])(?:(?:am|an\sder|an\sden|im|auf\sder|auf\sdem|zum|zur)\s[^\W\d_]{{4,}}|[^\W\d_][^\W\d_-]{{2,}}(?:-[^\W\d_]+)*{_DE})\s\d{{1,4}}\s?[a-z]?(?![\w:.,]\d|\w)(?:,\s\d{{5}}\s{_NAME}|\sin\s{_NAME})?",
        re.I,
    ),
)
_STREET_ENDS = ("allee", "straße", "strasse", "platz", "weg", "ring", "str.", "gasse", "ufer", "damm")
_ON_STREET = re.compile(r"(?<!\w)(?:am|an\sde[rn]|im|auf\sde[rm]|zu[mr])\s[^\W\d_]{4,}$", re.I)
_HOUSE = re.compile(r"\s\d")


def _german(text: str) -> bool:
    """Whether the third pattern can match in the text: a number stands behind the end of a street's name."""
    return any(text[max(0, m.start() - 8) : m.start()].lower().endswith(_STREET_ENDS) or _ON_STREET.search(text[max(0, m.start() - 60) : m.start()]) for m in _HOUSE.finditer(text))


_NOT_STREET = re.compile(r"\s(?:trip|show|movie|closed|ahead|works?)\b", re.I)

# What stands before a person's name, and titles, which are not part of it.
TITLES = r"(?:(?:mr|mrs|ms|miss|dr|prof|sir|madam|mme|mlle|monsieur|madame|m\.|frau|herrn?|señora?|srta?|sra?|don|doña|docteur|doctor|doctora)\.?\s+)"
CUES = (
    r"my\s+name\s+is|i\s+am\s+called|name\s*[:=]|full\s*name\s*[:=]|me\s+llamo|mi\s+nombre\s+es|je\s+m['’]appelle|mon\s+nom\s+est|ich\s+hei(?:ß|ss)e|mein\s+name\s+ist|"
    r"belongs?\s+to|issued\s+to|issued\s+for|au\s+nom\s+de|ausgestellt\s+(?:für|auf)|a\s+nombre\s+de|uploaded\s+by|filmed\s+by|recorded\s+by|edited\s+by|gefilmt\s+von|hochgeladen\s+von|"
    r"filmé\s+par|grabado\s+por|subido\s+por|(?:envoyé|publié)\s+par|interview\s+with|interview\s+mit|entrevista\s+(?:a|con)|disc\s+to|send\s+it\s+to|thanks\s+to|contact|kontakt\s*:|contacto\s*:?|"
    r"escribe\s+a|écrivez\s+à|schreib(?:t|en\s+sie)?\s+an|owner\s*[=:]|uploader\"?\s*[=:]\s*\"?|author\"?\s*[=:]\s*\"?|speaker\"?\s*[=:]\s*\"?|laut|selon|según|merci\s+à|gracias\s+a(?:\s+la|l)?|dank\s+an|danke\s+an"
)
_W = r"[^\W\d_]{2,}"
_FAMILY = rf"{_W}(?:-{_W})?"
PERSON = rf"(?:(?:[^\W\d_]\.\s?){{1,2}}{_FAMILY}|{_FAMILY},\s{_W}(?![\w'’])|{_W}\s(?:[^\W\d_]\.\s){{0,2}}{_FAMILY})"
CUED = re.compile(rf"(?<![\w])(?:(?:{CUES})\s*{TITLES}?|{TITLES})(?P<n>{PERSON})(?![\w@'’])", re.I)
# What people are said to do, behind their name.
SAYS = re.compile(r"\s(?:says|said|explains|explained|lives|dit|explique|habite|sagt|erklärt|wohnt|dice|explica|vive|stimmt)\b", re.I)
_ENDS = re.compile(rf"(?<![\w@.'’-])(?P<n>{PERSON})$", re.I)
#: A cell of a table, followed by one with a number.
CELL = re.compile(rf"\|\s(?P<n>{PERSON})\s\|(?=\s*[+(\d]|\s*{_SPOKEN_ALT}\b)", re.I)
#: The holder behind an identity number.
HOLDER = re.compile(rf"\s(?:de|of|von|für|pour|for)\s{TITLES}?(?P<n>{PERSON})(?![\w@])", re.I)
#: Names around a word of the lexicon: given name first, family name first, and initials before it.
GIVEN_FIRST = re.compile(rf"{_W}\s(?:[^\W\d_]\.\s){{0,2}}(?P<f>{_FAMILY})(?![\w@])")
FAMILY_FIRST = re.compile(rf"{_FAMILY},\s(?P<g>{_W})(?![\w@'’])")
INITIALS = re.compile(r"(?<![\w@.'’-])(?:[^\W\d_]\.\s?){1,2}$")
_TOKEN = re.compile(rf"(?<![\w@'’-]){_FAMILY}(?![\w@-])", re.I)
_WORD = re.compile(r"[^\W\d_]+")
# Words that can follow a cue but begin no name.
NOT_NAMES = frozenset(
    "the a an this that these those my our your his her its their la le les el los las der die das den dem ein eine un une una and or for from with of to in on at by us me you we they it "
    "team support page link all everyone more info form about dans et de du des que y en am im zum zur bitte please not".split()
)


# Characters without width, and characters that stand for a plain one.
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_PLAIN = str.maketrans(
    "\u00a0\u2007\u202f\u2009\u2010\u2011\u2012\u2013\u2014\u2212\uff0b\uff0d\uff0e\uff20" + "".join(chr(0xFF10 + i) for i in range(10)), "    ------+-.@0123456789"
)


class Finder:
    """Places of personal information in a text, given the lexicon of given and family names."""

    def __init__(self, given: frozenset[str], family: frozenset[str], common: frozenset[str] = frozenset(), dates: str = "birth"):
        if dates not in ("birth", "all"):
            raise ValueError("dates: birth or all")
        self.given, self.family, self.common, self.dates = given, family, common, dates
        self.lexicon = given | family
        # Endings that several family names of the lexicon share, learned from it: unlisted names end alike.
        tails = Counter(x[-4:] for x in family if len(x) > 5)
        self.tails = frozenset(t for t, n in tails.items() if n >= 5)

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end), 0-based, in order, never overlapping. Invisible characters are looked through."""
        if text.isascii():
            return self._find(text)
        text = text.translate(_PLAIN)
        if not _INVISIBLE.search(text):
            return self._find(text)
        at = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
        return [(k, at[a], at[b - 1] + 1) for k, a, b in self._find("".join(text[i] for i in at))]

    def _find(self, text: str) -> list[tuple[str, int, int]]:
        starts: list[int] = []  # of the places taken, in order, and their ends
        ends: list[int] = []
        out: list[tuple[str, int, int]] = []

        def put(kind: str, a: int, b: int) -> None:
            while b > a and text[b - 1].isspace():
                b -= 1
            at = bisect.bisect_left(starts, b)
            if a < b and not (at and ends[at - 1] > a):  # places do not overlap, so the last that starts before b ends last
                at = bisect.bisect_left(starts, a)
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((kind, a, b))

        digits = any(c in text for c in "0123456789")
        if _MAIL.search(text):
            for m in EMAIL.finditer(text):
                put("email", *m.span())
        if digits:
            self._numbers(text, put)
        for m in SPELT.finditer(text):
            put("phone", *m.span())
        if digits:
            found = [m for p in ADDRESSES[: 2 + _german(text)] for m in p.finditer(text)]
            for m in sorted(found, key=lambda m: (m.start(), -m.end())):
                if not _NOT_STREET.match(text, m.end()) and not _OTHER.search(text, max(0, m.start() - 20), m.start()):
                    put("address", *m.span())
        for m in CUED.finditer(text):
            if self._plausible(m.group("n")):
                put("name", *m.span("n"))
        for kind, _, b in list(out):
            if kind == "id" and (m := HOLDER.match(text, b)) and self._plausible(m.group("n")):
                put("name", *m.span("n"))
        for m in CELL.finditer(text) if "|" in text else ():
            if self._plausible(m.group("n")):
                put("name", *m.span("n"))
        for m in SAYS.finditer(text):
            low = max(0, m.start() - 80)
            if (n := _ENDS.search(text[low : m.start()])) and self._plausible(n.group("n")):
                put("name", low + n.start("n"), low + n.end("n"))
        for a, b in self._free(text):
            put("name", a, b)
        return sorted(out, key=lambda x: x[1])

    def _numbers(self, text: str, put: Callable[[str, int, int], None]) -> None:
        for m in ACCOUNT.finditer(text):
            s = re.sub(r"[^A-Z0-9]", "", m.group())
            if any(x.fits(s) for x in ACCOUNTS):
                put("account", *m.span())
        for m in ID_CUED.finditer(text):
            v = m.group("v")
            if sum(c.isdigit() for c in v) >= 6 or re.fullmatch(r"(?=.*\d)[A-Z0-9]{8,12}", v):
                a, b = m.span("v")
                put("id", a + len(v) - len(v.lstrip()), b)
        for m in ID_FORMAT.finditer(text):
            # A group or a serial of zeros is in no number series.
            if not re.fullmatch(r"\d{3}[-\s](?:00[-\s]\d{4}|\d\d[-\s]0000)", m.group()) and not _OTHER.search(text, max(0, m.start() - 20), m.start()):
                put("id", *m.span())
        for m in ID_NEAR.finditer(text):
            put("id", *m.span())
        if self.dates == "all":
            for m in DATE.finditer(text):
                if read_date(m):
                    put("date", *m.span())
        else:
            for c in BORN.finditer(text):
                if (m := DATE.match(text, c.end())) and read_date(m):
                    put("date", *m.span())
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 7 <= n <= 15 and len({c for c in m.group() if c.isdigit()}) > 1 and not _OTHER.search(text, max(0, m.start() - 20), m.start()):
                put("phone", *m.span())

    def _free(self, text: str) -> Iterator[tuple[int, int]]:
        """Names without a cue, grown from the words of the lexicon, at whatever place in the sentence."""
        sure = lambda w, kind: w in kind and w not in self.common
        held = self.lexicon.intersection(_WORD.findall(text.lower()))
        if not held:
            return
        for t in self._tokens(text, held):
            parts = t.group().lower().split("-")
            if len(parts) == 1 and parts[0] in self.given and (m := GIVEN_FIRST.match(text, t.start())):
                f = m.group("f").lower().split("-")
                if any(x in self.family for x in f) and not NOT_NAMES & {*parts, *f} and (sure(parts[0], self.given) or any(sure(x, self.family) for x in f)):
                    yield m.span()
            if not any(x in self.family for x in parts) or NOT_NAMES & {*parts}:
                continue
            known = any(sure(x, self.family) for x in parts)
            if (m := FAMILY_FIRST.match(text, t.start())) and (g := m.group("g").lower()) in self.given and g not in NOT_NAMES and (known or sure(g, self.given)):
                yield m.span()
            low = max(0, t.start() - 8)
            if known and (m := INITIALS.search(text[low : t.start()])):
                yield low + m.start(), t.end()

    @staticmethod
    def _tokens(text: str, held: set[str]) -> Iterator[re.Match]:
        """The words of the text that are, or have as half of a double name, one of ``held``, in order."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals get longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at = set()
        for w in held:
            i = low.find(w)
            while i >= 0:
                j = i
                if j and low[j - 1] == "-":
                    j -= 1
                    while j and low[j - 1].isalpha():
                        j -= 1
                    j += low[j] == "-"
                at |= {i, j}
                i = low.find(w, i + len(w))
        for i in sorted(at):
            if m := _TOKEN.match(text, i):
                yield m

    def _plausible(self, name: str) -> bool:
        """Whether what stands behind a cue can be a name."""
        w = [x.lower() for x in _WORD.findall(name) if len(x) > 1]
        if not w or any(x in NOT_NAMES for x in w):
            return False
        known = any(x in self.given or x in self.family for x in w) or any(len(x) > 5 and x[-4:] in self.tails for x in w)
        return known or (name[0].isupper() and all(x[0].isupper() for x in _WORD.findall(name)))


PSEUDONYMS = {"phone": phone_pseudonym, "id": id_pseudonym, "account": id_pseudonym, "date": date_pseudonym}


def redact(text: str, places: list[tuple[str, int, int]], key: bytes) -> str:
    """The text with every place replaced by its typed placeholder."""
    out, at = [], 0
    for kind, a, b in places:
        v = text[a:b]
        if kind in PSEUDONYMS:
            mark = PSEUDONYMS[kind](v.translate(_PLAIN) if v.isascii() or not _INVISIBLE.search(v) else _INVISIBLE.sub("", v.translate(_PLAIN)), key)
        else:
            folded = " ".join(re.findall(r"\w+", v.lower()))
            mark = hmac.new(key, f"{kind}:{folded}".encode(), hashlib.sha256).hexdigest()[:10]
        out += [text[at:a], f"[{kind.upper()} {mark}]"]
        at = b
    return "".join(out) + text[at:]


def lexicon(parts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Given and family names of a table (name_part, kind); a reference list of fixed size, read whole."""
    rows = parts.where("name_part is not null").select(F.lower("name_part").alias("p"), "kind").distinct().collect()
    return frozenset(r["p"] for r in rows if r["kind"] == "given"), frozenset(r["p"] for r in rows if r["kind"] == "family")


def common_words(docs: DataFrame, text: str, words: frozenset[str]) -> frozenset[str]:
    """Those of ``words`` (lexicon entries) that the corpus also writes in lower case inside other phrases, more
    often than capitalised behind another lexicon entry: words that are not only names."""
    if not words:
        return frozenset()
    token = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"(?<![\p{L}@.\-_])(\p{Ll}{2,})(?![\p{L}@\-_])"), 1))
    wanted = docs.sparkSession.createDataFrame([(w,) for w in sorted(words)], "w string")
    # Words of the lexicon only, before anything is shuffled.
    lower = docs.select(token.alias("w")).join(F.broadcast(wanted), "w").groupBy("w").count()
    n = docs.count()
    # More often than in one of 500 documents: too often for a stray lower-cased name.
    rows = lower.where(F.col("count") > max(3, n / 500)).collect()
    return frozenset(r["w"] for r in rows)


def places(df: DataFrame, key: str, text: str, finder: Finder) -> DataFrame:
    """doc_id, kind, start_pos (from 1), end_pos, of every place."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, a + 1, b) for i, t in zip(f["doc_id"], f["body"]) for k, a, b in finder.find(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos"]).astype({"doc_id": "Int64"})

    src = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("body")).where("body <> ''")
    return src.repartition(parallelism(df.sparkSession)).mapInPandas(scan, "doc_id bigint, kind string, start_pos bigint, end_pos bigint")


def redacted(df: DataFrame, key: str, text: str, finder: Finder, secret: bytes) -> DataFrame:
    """doc_id and its text with placeholders, for every row."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["body"] = [redact(t, finder.find(t), secret) if isinstance(t, str) else None for t in f["body"]]
            yield f.rename(columns={"body": "text"}).astype({"doc_id": "Int64"})

    src = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    return src.repartition(parallelism(df.sparkSession)).mapInPandas(scan, "doc_id bigint, text string")
