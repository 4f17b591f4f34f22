"""Final answers as mathematics: a small reader of plain and TeX notations, and equality of what they say.

An answer is read into a value: a rational function with exact rational coefficients (numbers, symbols, roots), a tuple, an
interval, a set, a matrix, or, where nothing of this fits, its text without layout. Values are compared exactly, so
``\\frac{2}{4}``, ``0.5`` and ``1/2`` are one number, ``(x+1)^2`` is ``x^2+2x+1``, and ``\\sqrt{8}`` is ``2\\sqrt2``.

Defined results: a null is equal to nothing; an empty answer reads as empty text; what is too deep or too large to work out
(powers above LIMIT, more than LIMIT terms) is compared as text.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache

#: Largest power, and most terms of a polynomial, that are worked out; longer answers than TEXT characters are text.
LIMIT, TEXT = 24, 400

_TOKEN = re.compile(r"\s+|\\left|\\right|\\[,;:!> ]|(?P<number>\d{1,3}(?:,\d{3})+(?![\d,])(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)|(?P<command>\\[a-zA-Z]+)|(?P<word>[a-zA-Z]+)|(?P<mark>\\[{}%$&|\\]|.)", re.S)
# Commands that stand for an operator or a bracket, and those that only change how their argument looks.
_SAME = {"\\cdot": "*", "\\times": "*", "\\div": "/", "\\{": "{", "\\}": "}", "\\lbrace": "{", "\\rbrace": "}", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "−": "-", "·": "*", "×": "*", "÷": "/", "π": "\\pi", "∞": "\\infty"}
_LOOKS = {"\\text", "\\textbf", "\\textit", "\\mathrm", "\\mathbf", "\\mbox", "\\overline", "\\boxed", "\\displaystyle", "\\operatorname"}


class Unread(ValueError):
    """The answer is no expression."""


# --- Rational functions: (numerator, denominator), each {monomial: coefficient}, a monomial being ((symbol, power), ...) ---
Poly = dict[tuple[tuple[str, int], ...], Fraction]
ONE: Poly = {(): Fraction(1)}


def _sum(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return {m: c for m, c in out.items() if c}


def _times(a: Poly, b: Poly) -> Poly:
    out: Poly = {}
    for m, c in a.items():
        for n, d in b.items():
            powers, k = dict(m), c * d
            for s, e in n:
                powers[s] = powers.get(s, 0) + e
            for s in [s for s in powers if s.startswith("√") and s[1:].isdigit()]:  # two roots of a number are the number
                k *= Fraction(int(s[1:])) ** (powers[s] // 2)
                powers[s] %= 2
            key = tuple(sorted((s, e) for s, e in powers.items() if e))
            out[key] = out.get(key, Fraction(0)) + k
    if len(out) > LIMIT * LIMIT:
        raise Unread("too many terms")
    return {m: c for m, c in out.items() if c}


class Ratio:
    """A rational function."""

    def __init__(self, num: Poly, den: Poly = ONE):
        if not den:
            raise Unread("division by zero")
        if set(den) == {()}:  # a number below: divided out
            num, den = {m: c / den[()] for m, c in num.items()}, ONE
        self.num, self.den = num, den

    @classmethod
    def of(cls, value: Fraction | int | str) -> Ratio:
        return cls({((value, 1),): Fraction(1)}) if isinstance(value, str) else cls({(): Fraction(value)} if value else {})

    def number(self) -> Fraction | None:
        return self.num.get((), Fraction(0)) if self.den == ONE and set(self.num) <= {()} else None

    def plus(self, o: Ratio, sign: int = 1) -> Ratio:
        return Ratio(_sum(_times(self.num, o.den), _times(o.num, self.den), sign), _times(self.den, o.den))

    def times(self, o: Ratio) -> Ratio:
        return Ratio(_times(self.num, o.num), _times(self.den, o.den))

    def over(self, o: Ratio) -> Ratio:
        return self.times(Ratio(o.den, o.num))

    def power(self, o: Ratio) -> Ratio:
        e = o.number()
        if e is not None and e.denominator == 1 and abs(e) <= LIMIT:
            out, base = Ratio.of(1), self if e >= 0 else Ratio.of(1).over(self)
            for _ in range(abs(int(e))):
                out = out.times(base)
            return out
        if e == Fraction(1, 2):
            return self.root(2)
        return Ratio.of(f"({self})^({o})")

    def root(self, n: int) -> Ratio:
        k = self.number()
        if k is not None and n == 2 and k >= 0 and k.numerator * k.denominator < 10**12:
            inside, outside = k.numerator * k.denominator, 1  # √(p/q) = √(pq) / q
            f = 2
            while f * f <= inside:
                while inside % (f * f) == 0:
                    inside //= f * f
                    outside *= f
                f += 1
            root = Ratio.of(Fraction(outside, k.denominator))
            return root if inside == 1 else root.times(Ratio.of(f"√{inside}")) if inside else Ratio.of(0)
        return Ratio.of(f"√[{n}]({self})")

    def same(self, o: Ratio) -> bool:
        return not _sum(_times(self.num, o.den), _times(o.num, self.den), -1)

    def value(self) -> float | None:
        """The number it is, with π and square roots worked out; None with symbols."""

        def of(p: Poly) -> float | None:
            total = 0.0
            for m, c in p.items():
                x = float(c)
                for s, e in m:
                    if s == "π":
                        x *= math.pi**e
                    elif s.startswith("√") and s[1:].isdigit():
                        x *= math.sqrt(int(s[1:])) ** e
                    else:
                        return None
                total += x
            return total

        try:
            a, b = of(self.num), of(self.den)
        except OverflowError:
            return None
        return None if a is None or b is None or not b else a / b

    def __str__(self) -> str:
        def text(p: Poly) -> str:
            terms = []
            for m, c in sorted(p.items()):
                k = "" if abs(c) == 1 and m else str(abs(c))
                terms.append(("-" if c < 0 else "+") + "*".join([x for x in [k, *(s if e == 1 else f"{s}^{e}" for s, e in m)] if x]))
            return "".join(terms).removeprefix("+") or "0"

        return text(self.num) if self.den == ONE else f"({text(self.num)})/({text(self.den)})"


class _Reader:
    """Recursive descent over the tokens of an answer."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind and m.group() not in ("\\left", "\\right", "$"):
                raw = _SAME.get(m.group(), m.group())
                grouping = kind == "mark" and m.group() in "{}"  # bare braces hold an argument, escaped ones a set
                self.tokens.append(("group" if grouping else "command" if raw.startswith("\\") and raw[1:].isalpha() else kind, raw))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def take(self, text: str) -> bool:
        if self.peek()[1] == text and self.peek()[0] != "end":
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise Unread(f"no {text}")

    def answer(self) -> object:
        out = self.items("")
        if self.peek()[0] != "end":
            raise Unread("rest")
        return out[0] if len(out) == 1 else ("list", tuple(out))

    def items(self, close: str) -> list[object]:
        out = [self.item()]
        while self.take(",") or self.take(";"):
            out.append(self.item())
        return out

    def item(self) -> object:
        kind, raw = self.peek()
        start = self.at
        if (raw in "([" and raw) or (raw == "{" and kind == "mark"):  # a tuple, an interval or a set, if more than one item stands in it
            self.next()
            inner = self.items("")
            close = self.next()[1]
            if len(inner) > 1 and close in (")", "]", "}") and self.peek()[1] in ("", ",", ";", ")", "]", "}"):
                return ("set", frozenset(map(_key, inner))) if raw == "{" else (raw + close, tuple(inner))
            self.at = start
        return self.sum()

    def sum(self) -> Ratio:
        out = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "mark":
            sign = 1 if self.next()[1] == "+" else -1
            out = out.plus(self.product(), sign)
        return out

    def product(self) -> Ratio:
        out = self.signed()
        while True:
            kind, raw = self.peek()
            if raw == "*":
                self.next()
                out = out.times(self.signed())
            elif raw == "/" and kind != "end":
                self.next()
                out = out.over(self.signed())
            elif raw in ("%", "\\%") and kind == "mark":
                self.next()
                out = out.over(Ratio.of(100))
            elif kind in ("number", "word", "command", "group") and raw not in ("}",) or raw == "(":
                out = out.times(self.power())
            else:
                return out

    def signed(self) -> Ratio:
        if self.take("-"):
            return Ratio.of(0).plus(self.signed(), -1)
        if self.take("+"):
            return self.signed()
        return self.power()

    def power(self) -> Ratio:
        base = self.base()
        if self.take("^"):
            if self.peek()[1] == "\\circ" or [t[1] for t in self.tokens[self.at : self.at + 3]] == ["{", "\\circ", "}"]:  # degrees
                self.at += 1 if self.peek()[1] == "\\circ" else 3
                return base
            return base.power(self.argument())
        return base

    def argument(self) -> Ratio:
        """A group, or one token: ``\\frac12`` holds 1 and 2."""
        kind, raw = self.peek()
        if kind == "group" and raw == "{":
            self.next()
            out = self.sum()
            self.need("}")
            return out
        if kind == "number" and len(raw) > 1:
            self.tokens[self.at] = (kind, raw[1:])
            return Ratio.of(int(raw[0])) if raw[0].isdigit() else self.base()
        if self.take("-"):
            return Ratio.of(0).plus(self.argument(), -1)
        return self.base()

    def base(self) -> Ratio:
        kind, raw = self.next()
        if kind == "number":
            return Ratio.of(Fraction(raw.replace(",", "")))
        if kind == "word":
            if len(raw) > 2 and not set(raw) <= set("abcmnxyz"):
                return Ratio.of(raw.lower())  # a word
            out = Ratio.of(raw[0])
            for c in raw[1:]:  # letters side by side are factors
                out = out.times(Ratio.of(c))
            return out
        if raw == "(" or raw == "[" or (kind == "group" and raw == "{"):
            out = self.sum()
            self.need({"(": ")", "[": "]", "{": "}"}[raw])
            return out
        if raw == "\\frac":
            top = self.argument()
            return top.over(self.argument())
        if raw == "\\sqrt":
            n = 2
            if self.take("["):
                k = self.sum().number()
                self.need("]")
                if k is None or k.denominator != 1 or k < 1:
                    raise Unread("root")
                n = int(k)
            return self.argument().root(n)
        if raw == "\\pi":
            return Ratio.of("π")
        if raw in _LOOKS:
            return self.argument()
        if kind == "command":
            return Ratio.of(raw)
        raise Unread(raw)


def _key(value: object) -> object:
    """A hashable form in which equal simple values agree."""
    return str(value) if isinstance(value, Ratio) else (value[0], tuple(map(_key, value[1]))) if isinstance(value, tuple) and isinstance(value[1], tuple) else value


_MATRIX = re.compile(r"\\begin\{([pbv]?matrix|array)\}(?:\{[clr|]*\})?(.*?)\\end\{\1\}", re.S)


@lru_cache(maxsize=65536)
def read(text: str) -> object:
    """The value of an answer: Ratio, ("(]", items), ("set", items), ("list", items), ("matrix", rows), or its text."""
    plain = text.strip().strip("$").strip().removesuffix(".")
    if len(plain) <= TEXT:
        try:
            if m := _MATRIX.fullmatch(plain):
                return ("matrix", tuple(tuple(read(c) for c in row.split("&")) for row in m[2].strip().removesuffix("\\\\").split("\\\\")))
            # A short name before an equals sign only says what the answer is of.
            left, equals, right = plain.partition("=")
            if equals and len(left.strip()) <= 2 and "=" not in right:
                plain = right
            return _Reader(plain).answer()
        except (Unread, RecursionError, ZeroDivisionError):
            pass
    return re.sub(r"\\(?:text|textbf|mathrm|mbox)\{([^{}]*)\}|\\left|\\right|\\[,;:! ]|\s+|\$", lambda m: m[1] or "", text).lower()


def same(a: object, b: object, tolerance: float = 0.0) -> bool:
    """Whether two values are equal; numbers within a relative tolerance."""
    if isinstance(a, Ratio) and isinstance(b, Ratio):
        if a.same(b):
            return True
        x, y = a.value(), b.value()
        return bool(tolerance) and x is not None and y is not None and abs(x - y) <= tolerance * max(abs(y), 1e-12)
    if isinstance(a, tuple) and isinstance(b, tuple):
        if a[0] != b[0] or len(a[1]) != len(b[1]):
            return False
        if a[0] == "set":
            return a[1] == b[1]
        if a[0] == "matrix":
            return all(len(r) == len(s) and all(same(x, y, tolerance) for x, y in zip(r, s)) for r, s in zip(a[1], b[1]))
        return all(same(x, y, tolerance) for x, y in zip(a[1], b[1]))
    return type(a) is type(b) and a == b


def equal(a: str | None, b: str | None, tolerance: float = 0.0, percent: bool = False) -> bool:
    """Whether two answers say the same; with ``percent`` also where one is the other in hundredths."""
    if a is None or b is None:
        return False
    try:
        x, y = read(a), read(b)
        if same(x, y, tolerance):
            return True
        if percent and isinstance(x, Ratio) and isinstance(y, Ratio):
            return any(same(x, y.times(Ratio.of(k)), tolerance) for k in (Fraction(100), Fraction(1, 100)))
    except (Unread, OverflowError):
        return a.strip() == b.strip()
    return False


def canonical(text: str) -> str:
    """One writing of an answer's value."""

    def write(v: object) -> str:
        if isinstance(v, tuple) and v[0] == "matrix":
            return "matrix(" + ";".join(",".join(map(write, row)) for row in v[1]) + ")"
        if isinstance(v, tuple):
            items = sorted(map(str, v[1])) if v[0] == "set" else [write(x) for x in v[1]]
            return f"{v[0][:1] if len(v[0]) == 2 else v[0] + '('}{','.join(items)}{v[0][-1] if len(v[0]) == 2 else ')'}"
        return str(v)

    return write(read(text))
