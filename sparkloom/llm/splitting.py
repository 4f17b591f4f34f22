"""Recursive-bisection splitting of oversized texts at natural boundaries.

A text longer than ``max_size`` characters is bisected: the cut goes to the strongest boundary near the
midpoint (paragraph, line, sentence end, clause mark, white space), else to the nearest boundary further out, and only
where there is none to a bare character position;
every half longer than ``max_size - overlap`` is bisected again. Then each piece but the first is extended
to the left by exactly ``overlap`` characters, so that consecutive pieces share them and none exceeds
``max_size``. Dropping the first ``overlap`` characters of each later piece and concatenating restores the text.

Defined results: null and empty texts give no piece; a text within the limit is one piece (piece_no 0);
repeated rows are split each on its own; rows with a null key are kept with that key; an empty table gives
no rows; columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.common import parallelism

#: Marks that, besides white space, break a stretch of text (fixed values).
BREAKS = ".,;:!?…、。！？"

_SENTENCE = ".!?…。！？"
_BOUNDARY = re.compile(
    r"(?P<para>\n\s*\n)|(?P<line>[\r\n\u2028\u2029])|(?P<sent>[.!?…。！？]+[\"'”’)\]]*(?=\s|$)|[。！？])|(?P<clause>[,;:、])|(?P<space>\s)"
)
_STRENGTH = {"para": 5, "line": 4, "sent": 3, "clause": 2, "space": 1}

PIECES = "item_key bigint, piece_no int, start_pos bigint, end_pos bigint, piece string, cut_strength int, longest_stretch bigint, n_chars bigint"


def boundaries(text: str) -> list[list[int]]:
    """Cut positions by strength 1..5; a cut lies behind the boundary's last character."""
    found: list[list[int]] = [[] for _ in range(6)]
    for m in _BOUNDARY.finditer(text):
        found[_STRENGTH[m.lastgroup]].append(m.end())
    return found


def bisect_spans(text: str, limit: int, shortest: int = 1) -> list[tuple[int, int, int]]:
    """Consecutive (start, end, strength of the cut at start) covering text, each at most ``limit`` long.

    No span is shorter than ``shortest`` (as far as the limit allows), so that an overlap always fits.
    """
    from bisect import bisect_left, bisect_right

    if limit < 1:
        raise ValueError("the limit must exceed the overlap")
    marks = boundaries(text)

    def nearest(xs: list[int], lo: int, hi: int, mid: int) -> list[int]:
        """The one of xs within lo .. hi that is nearest to mid, if any."""
        i, j = bisect_left(xs, lo), bisect_right(xs, hi)
        k = bisect_left(xs, mid, i, j) if i < j else 0
        return [min(xs[max(i, k - 1) : min(j, k + 1)], key=lambda x: (abs(x - mid), x))] if i < j else []

    out, todo = [], [(0, len(text), 0)]
    while todo:
        a, b, strength = todo.pop()
        n = b - a
        if n <= limit:
            out.append((a, b, strength))
            continue
        mid = a + n // 2
        # The window keeps both halves useful and, when one more cut suffices, within the limit.
        reach = max(0, min(n // 4, n // 2 - min(shortest, n // 2)))
        lo, hi = mid - reach, mid + reach
        if n <= 2 * limit:
            lo, hi = max(lo, b - limit), min(hi, a + limit)
        cut, force = mid, 0
        for s in (5, 4, 3, 2, 1):
            if near := nearest(marks[s], lo, hi, mid):
                cut, force = near[0], s
                break
        else:  # no boundary there: the one nearest the middle that leaves both sides long enough, before a bare cut
            least = max(1, shortest)
            far = [(abs(x - mid), -s, x) for s in (5, 4, 3, 2, 1) for x in nearest(marks[s], a + least, b - least, mid)]
            if far:
                _, force, cut = min(far)
                force = -force
        cut = min(max(cut, a + 1), b - 1)
        todo.append((cut, b, force))
        todo.append((a, cut, strength))
    return out


def longest_stretch(text: str) -> int:
    """Length of the longest stretch without white space and without any of BREAKS."""
    return max((m.end() - m.start() for m in re.finditer(r"[^\s" + re.escape(BREAKS) + "]+", text)), default=0)


def split_texts(df: DataFrame, key: str, text: str, max_size: int, overlap: int) -> DataFrame:
    """Pieces of every text: item_key, piece_no, start_pos and end_pos (0-based, end exclusive, the overlap
    included), piece, cut_strength (5 paragraph .. 1 space, 0 bare cut or first piece), longest_stretch, n_chars.

    Short texts never leave the JVM; only oversized ones are bisected in Python.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("0 <= overlap < max_size must hold")
    src = df.select(F.col(f"`{key}`").cast("bigint").alias("item_key"), F.col(f"`{text}`").alias("body"))
    src = src.where(F.col("body").isNotNull() & (F.col("body") != ""))
    n = F.length("body").cast("bigint")
    short = src.where(n <= max_size).select(
        "item_key", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_pos"), n.alias("end_pos"),
        F.col("body").alias("piece"), F.lit(0).alias("cut_strength"), F.lit(None).cast("bigint").alias("longest_stretch"), n.alias("n_chars"),
    )

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key_, body in zip(frame["item_key"], frame["body"]):
                spans, stretch = bisect_spans(body, max_size - overlap, overlap), longest_stretch(body)
                for no, (a, b, strength) in enumerate(spans):
                    a = max(0, a - overlap) if no else 0
                    rows.append((key_, no, a, b, body[a:b], strength, stretch, len(body)))
            yield pd.DataFrame(rows, columns=["item_key", "piece_no", "start_pos", "end_pos", "piece", "cut_strength", "longest_stretch", "n_chars"]).astype({"item_key": "Int64"})

    # Long texts sit together in few files; spreading the few long rows evens the Python work out.
    long = src.where(n > max_size).repartition(parallelism(df.sparkSession)).mapInPandas(cut, PIECES)
    return short.unionByName(long)


def findings(pieces: DataFrame, target: str, max_size: int) -> DataFrame:
    """Kinds oversized and unbroken of the texts that were split, from the pieces of :func:`split_texts`."""
    first = pieces.where((F.col("piece_no") == 0) & (F.col("n_chars") > max_size))
    kinds = F.when(F.col("longest_stretch") > max_size, F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized")))
    return first.select(F.lit(target).alias("target"), "item_key", F.explode(kinds).alias("kind"))
