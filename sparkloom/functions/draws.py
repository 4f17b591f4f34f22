"""Reproducible draws: uniform numbers from a digest of keys, the same on every engine, partitioning and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
SPAN = 1 << 32


def drawn(*parts: Column | str | int) -> Column:
    """A whole number in [0, SPAN) from the parts, written out and joined by bars; strings are column names."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1)."""
    return (drawn(*parts) + 0.5) / float(SPAN)


def chosen(u: Column, weights: dict[str, float]) -> Column:
    """The name whose stretch of the cumulated weights holds ``u``; the first one if no weight is positive."""
    total, cum, out = sum(max(w, 0.0) for w in weights.values()), 0.0, None
    names = list(weights)
    if total <= 0:
        return F.lit(names[0])
    for name in names:
        cum += max(weights[name], 0.0) / total
        out = F.when(u < cum, name) if out is None else out.when(u < cum, name)
    return out.otherwise(names[-1])
