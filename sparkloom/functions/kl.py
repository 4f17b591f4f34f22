"""Divergences, losses and masked statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(F.least(x, high), low)


def kl_penalty(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """Estimators of KL(p | ref) per token: k1 (kl), abs, k2 (mse), k3 (low_var_kl). A trailing + names the
    straight-through form, whose value is that of the plain one."""
    kind = kind.rstrip("+")
    d = logp - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return d * d / 2
    if kind in ("k3", "low_var_kl"):
        r = clamp(ref - logp, -20.0, 20.0)
        return clamp(F.exp(r) - r - 1, -10.0, 10.0)
    raise ValueError(f"no estimator {kind}")


def masked_sum(v: Column, mask: Column) -> Column:
    return F.sum(F.when(mask != 0, v * mask).otherwise(0.0))


def masked_mean(v: Column, mask: Column) -> Column:
    return masked_sum(v, mask) / (F.sum(mask) + 1e-8)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def entropy(logits: Column) -> Column:
    z = log_sum_exp(logits)
    return z - F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - z) * x)


def sum_pi_squared(logits: Column) -> Column:
    z = log_sum_exp(logits)
    return F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(2 * (x - z)))


def log_prob(logits: Column, label: Column) -> Column:
    """Log-probability of the label (0-based)."""
    return F.element_at(logits, label + 1) - log_sum_exp(logits)


def divergence(log_q: Column, log_p: Column) -> Column:
    """Sum p (log p - log q) over arrays of log-probabilities."""
    return F.aggregate(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda a, x: a + x)


def tier_weights(progress: Column, start: list[float], end: list[float]) -> Column:
    """Linear way from start to end, progress clamped to 0..1, renormalised."""
    t = clamp(progress, 0.0, 1.0)
    raw = [F.lit(a) + t * (b - a) for a, b in zip(start, end)]
    total = sum(raw[1:], raw[0])
    return F.array(*[x / total for x in raw])


def normalised(v: Column) -> Column:
    """Unit length, with a floor of 1e-12 on the norm."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))
