"""Group-relative advantages as window expressions, with a registry of estimators.

Each estimator takes the frame of rollouts (uid, score, optionally more) and adds ``advantage``. All are windows over
``uid`` or whole-frame aggregates joined back as one row, so a frame is shuffled once, on uid.

A null score or uid follows SQL: null scores are left out of the statistics and get a null advantage; a null uid is a
group of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.scans import scan

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Register an estimator under a name; a taken name is an error."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in ESTIMATORS and ESTIMATORS[name] is not f:
            raise ValueError(f"estimator {name} exists")
        ESTIMATORS[name] = f
        return f

    return keep


def advantage(df: DataFrame, estimator: str, **options) -> DataFrame:
    """Dispatch by name."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"no estimator {estimator}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, **options)


def _group(uid: str = "uid") -> tuple[Column, Column, Column]:
    w = Window.partitionBy(uid)
    return F.avg("score").over(w), F.stddev_samp("score").over(w), F.count("score").over(w)


@register("grpo")
def grpo(df: DataFrame, by_std: bool = True) -> DataFrame:
    mean, std, n = _group()
    centred = F.col("score") - F.when(n == 1, 0.0).otherwise(mean)
    return df.withColumn("advantage", centred / (F.when(n == 1, 1.0).otherwise(std) + EPS) if by_std else centred)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, by_std: bool = True) -> DataFrame:
    mean, std, n = _group()
    centred = F.col("score") - F.when(n == 1, 0.0).otherwise(mean)
    floor = F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(std * std, F.lit(EPS))))
    return df.withColumn("advantage", centred / (floor + EPS) if by_std else centred)


@register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    mean, _, n = _group()
    return df.withColumn("advantage", F.when(n > 1, (F.col("score") - mean) * n / (n - 1)).otherwise(F.col("score")))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("uid")
    n, total = F.count("score").over(w), F.sum("score").over(w)
    return df.withColumn("advantage", F.when(n > 1, (n * F.col("score") - total) / (n - 1)).otherwise(F.col("score") * 0))


@register("grpo_passk")
def grpo_passk(df: DataFrame, by_std: bool = True) -> DataFrame:
    """Only the best of a group gets its lead over the second; the lowest idx wins a tie."""
    w = Window.partitionBy("uid")
    ranked = w.orderBy(F.col("score").desc(), "idx")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.col("score") - F.nth_value("score", 2).over(whole)
    value = lead / (F.stddev_samp("score").over(w) + EPS) if by_std else lead
    return df.withColumn("advantage", F.when(F.row_number().over(ranked) == 1, value).otherwise(0.0))


@register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Length-weighted baseline; needs a column ``length``."""
    w = Window.partitionBy("uid")
    base = F.sum(F.col("length") * F.col("score")).over(w) / F.sum("length").over(w)
    return df.withColumn("advantage", F.col("score") - F.when(F.count("score").over(w) == 1, 0.0).otherwise(base))


@register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    mean, _, n = _group()
    scale = df.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("scale"))
    centred = F.col("score") - F.when(n == 1, 0.0).otherwise(mean)
    return df.withColumn("advantage", centred).crossJoin(F.broadcast(scale)).withColumn("advantage", F.col("scale") * F.col("advantage") / f_norm).drop("scale")  # scale is one row


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame) -> DataFrame:
    """Centred by group, then whitened over all tokens; needs ``length``, the tokens a row's value stands for."""
    mean, _, n = _group()
    c = df.withColumn("advantage", F.col("score") - F.when(n == 1, 0.0).otherwise(mean))
    return whiten(c, "advantage", "length")


def whiten(df: DataFrame, column: str, weight: str | None = None, shift_mean: bool = True) -> DataFrame:
    """(v - mean) / sqrt(var + 1e-8) with the unbiased variance, rows weighted by ``weight``; statistics are one row."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.col(column)
    stats = df.agg(F.sum(w).alias("__n"), F.sum(w * v).alias("__s"), F.sum(w * v * v).alias("__q"))
    stats = stats.select((F.col("__s") / F.col("__n")).alias("__mean"), ((F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n")) / (F.col("__n") - 1)).alias("__var"))
    out = (v - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)
    return df.crossJoin(F.broadcast(stats)).withColumn(column, out if shift_mean else out + F.col("__mean")).drop("__mean", "__var")


def last_of_session(df: DataFrame, order: str, estimator: str = "grpo") -> DataFrame:
    """Advantage of each session's last row among its uid, given to all rows of the session."""
    last = df.groupBy("uid", "session").agg(F.max_by("score", order).alias("score"), F.max(order).alias("idx"))
    adv = advantage(last, estimator).select("uid", "session", "advantage")
    return df.join(adv, ["uid", "session"])


def _backwards(df: DataFrame, out: str, start: tuple[float, ...], step: Callable[..., tuple[float, tuple[float, ...]]], columns: list[str]) -> DataFrame:
    """Adds ``out`` by a scan from the last token of each sequence (seq, pos) to the first."""

    def one(state: tuple[float, ...], *x: float) -> tuple[tuple[float], tuple[float, ...]]:
        value, state = step(state, *x)
        return (value,), state

    return scan(df, "seq", [F.col("pos").desc()], columns, {out: "double"}, start, one)


def discounted_returns(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Per sequence (seq, pos, reward, mask) the return at each token: r + gamma * next, reset where mask is 0."""
    if gamma == 1.0:
        w = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return df.withColumn("return", F.sum("reward").over(w))

    def step(state: tuple[float, ...], reward: float, mask: int) -> tuple[float, tuple[float, ...]]:
        value = reward + gamma * state[0]
        return value, (value * mask,)

    return _backwards(df, "return", (0.0,), step, ["reward", "mask"])


def gae(df: DataFrame, gamma: float, lam: float) -> DataFrame:
    """Generalised advantages per token (seq, pos, reward, val, mask): masked tokens are skipped in the recursion."""

    def step(state: tuple[float, ...], reward: float, val: float, mask: int) -> tuple[float, tuple[float, ...]]:
        run, following = state
        if mask != 1:
            return run, state
        run = reward + gamma * following - val + gamma * lam * run
        return run, (run, val)

    return _backwards(df, "gae", (0.0, 0.0), step, ["reward", "val", "mask"]).withColumn("return", F.col("gae") + F.col("val"))


@register("gae")
def gae_advantage(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """``gae``, whitened over the tokens that count."""
    out = gae(df, gamma, lam)
    return whiten(out.withColumn("advantage", F.col("gae")), "advantage", "mask").withColumn("advantage", F.col("advantage") * F.col("mask"))


@register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted returns per token, whitened over the tokens that count."""
    out = discounted_returns(df, gamma)
    return whiten(out.withColumn("advantage", F.col("return")), "advantage", "mask").withColumn("advantage", F.col("advantage") * F.col("mask"))


@register("remax")
def remax(df: DataFrame, baseline: str = "val") -> DataFrame:
    """Undiscounted returns less the reward of a greedy answer, ``baseline`` at the first token."""
    first = F.first(baseline).over(Window.partitionBy("seq").orderBy("pos"))
    return discounted_returns(df).withColumn("advantage", F.col("return") - first)


@register("gdpo")
def gdpo(df: DataFrame, weights: dict[str, float], by_std: bool = True) -> DataFrame:
    """Several reward columns: each normalised in its group, summed by weight, whitened over the frame."""
    out = df
    for i, name in enumerate(weights):
        one = grpo(out.withColumn("score", F.col(name).cast("double")), by_std)
        out = one.withColumn(f"__a{i}", F.col("advantage")).drop("advantage")
    total = sum((F.col(f"__a{i}") * w for i, w in enumerate(weights.values())), F.lit(0.0))
    return whiten(out.withColumn("advantage", total), "advantage").drop(*[f"__a{i}" for i in range(len(weights))])


@register("optimal_token_baseline")
def token_baseline(df: DataFrame) -> DataFrame:
    """Optimal token baseline per (uid, pos): sum(G W) / sum(W), W the running weight 1 - 2 pi + sum pi^2 of a sequence."""
    ahead = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pi = F.exp("logp")
    t = df.withColumn("g", F.sum(F.col("reward") * F.col("mask")).over(ahead)).withColumn("w", F.sum((1 - 2 * pi + pi * pi) * F.col("mask")).over(so_far))
    at = Window.partitionBy("uid", "pos")
    base = F.sum(F.col("g") * F.col("w")).over(at) / (F.sum("w").over(at) + 1e-8)
    return t.withColumn("advantage", (F.col("g") - base) * F.col("mask"))


@register("optimal_token_baseline_turns")
def token_baseline_of_turns(df: DataFrame) -> DataFrame:
    """Several turns: tokens that count are numbered anew before the baseline; the others are left out."""
    t = df.where("mask = 1").withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("pos")))
    return token_baseline(t)
