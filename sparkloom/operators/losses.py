"""Token-level losses: a token expression, then one of four reductions. Forward values only.

Frames hold seq, pos, logp, old_logp, adv, mask. A null in a factor makes the token's loss null and leaves it out of
sums; fully masked sequences are left out of sequence means; an empty frame gives one row with a null loss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.draws import uniform
from sparkloom.functions.kl import clamp, entropy, kl_penalty

MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")
LOSSES: dict[str, Callable[..., tuple[DataFrame, Column]]] = {}


def register(name: str) -> Callable:
    def keep(f: Callable) -> Callable:
        if name in LOSSES and LOSSES[name] is not f:
            raise ValueError(f"loss {name} exists")
        LOSSES[name] = f
        return f

    return keep


def aggregate_loss(df: DataFrame, loss: Column, mode: str = "token-mean", horizon: int = 1) -> DataFrame:
    """One row, ``loss``."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    x, m = loss * F.col("mask"), F.col("mask")
    if mode == "token-mean":
        return df.agg((F.sum(x) / F.sum(m)).alias("loss"))
    seq = df.groupBy("seq").agg(F.sum(x).alias("s"), F.sum(m).alias("n")).where("n > 0")
    if mode == "seq-mean-token-mean":
        return seq.agg(F.avg(F.col("s") / (F.col("n") + 1e-8)).alias("loss"))
    out = F.avg("s") / horizon if mode.endswith("norm") else F.avg("s")
    return seq.agg(out.alias("loss"))


def ratio(df: DataFrame) -> tuple[Column, Column]:
    """Clamped log-ratio and ratio of new to old policy."""
    d = clamp(F.col("logp") - F.col("old_logp"), -20.0, 20.0)
    return d, F.exp(d)


@register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> tuple[DataFrame, Column]:
    """Dual-clip PPO."""
    _, r = ratio(df)
    a = F.col("adv")
    top = F.greatest(-a * r, -a * clamp(r, 1 - low, 1 + high))
    return df, F.when(a < 0, F.least(-a * dual, top)).otherwise(top)


@register("gspo")
def gspo(df: DataFrame, low: float = 0.2, high: float = 0.2) -> tuple[DataFrame, Column]:
    """Sequence-level ratio."""
    w = Window.partitionBy("seq")
    d = F.sum((F.col("logp") - F.col("old_logp")) * F.col("mask")).over(w) / F.greatest(F.sum("mask").over(w), F.lit(1))
    t = df.withColumn("r", F.exp(F.least(d, F.lit(10.0))))
    a = F.col("adv")
    return t, F.greatest(-a * F.col("r"), -a * clamp(F.col("r"), 1 - low, 1 + high))


@register("sapo")
def sapo(df: DataFrame, pos: float = 1.0, neg: float = 1.05) -> tuple[DataFrame, Column]:
    """Soft gate 4 / tau * sigmoid(tau (r - 1))."""
    _, r = ratio(df)
    tau = F.when(F.col("adv") > 0, pos).otherwise(neg)
    gate = (4.0 / tau) / (1 + F.exp(-tau * (r - 1)))
    return df, -gate * F.col("adv")


@register("gpg")
def gpg(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, -F.col("logp") * F.col("adv")


@register("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2) -> tuple[DataFrame, Column]:
    _, r = ratio(df)
    return df, -clamp(r, 1 - low, 1 + high) * F.col("adv") * F.col("logp")


@register("reinforce")
def reinforce(df: DataFrame, weight: str | None = None) -> tuple[DataFrame, Column]:
    x = -F.col("adv") * F.col("logp")
    return df, x * F.col(weight) if weight else x


def binary_tv(p: Column, q: Column) -> Column:
    return F.abs(F.exp(p) - F.exp(q))


def binary_kl(p: Column, q: Column) -> Column:
    """KL of the two-outcome distributions (this token or another), q the old one."""
    a, b = clamp(F.exp(q), 1e-8, 1 - 1e-8), clamp(F.exp(p), 1e-8, 1 - 1e-8)
    return a * F.ln(a / b) + (1 - a) * F.ln((1 - a) / (1 - b))


def _trusted(df: DataFrame, measure: Column, low: float, high: float, cap: float) -> tuple[DataFrame, Column]:
    _, r = ratio(df)
    rising, a = F.col("logp") > F.col("old_logp"), F.col("adv")
    out = ((a > 0) & rising & (measure > high)) | ((a < 0) & ~rising & (measure > low))
    return df, -a * F.least(r, F.lit(cap)) * F.when(out, 0.0).otherwise(1.0)


@register("dppo_tv")
def dppo_tv(df: DataFrame, low: float = 0.2, high: float = 0.2, cap: float = 20.0) -> tuple[DataFrame, Column]:
    return _trusted(df, binary_tv(F.col("logp"), F.col("old_logp")), low, high, cap)


@register("dppo_kl")
def dppo_kl(df: DataFrame, low: float = 0.05, high: float = 0.05, cap: float = 20.0) -> tuple[DataFrame, Column]:
    return _trusted(df, binary_kl(F.col("logp"), F.col("old_logp")), low, high, cap)


@register("kl_cov")
def kl_cov(df: DataFrame, share: float = 0.02, coef: float = 1.0) -> tuple[DataFrame, Column]:
    """The share of tokens with the largest covariance of advantage and log-probability pays an absolute KL."""
    stats = df.where("mask = 1").agg(F.avg("adv").alias("ma"), F.avg("logp").alias("ml"), F.count("*").alias("nt"))
    c = df.crossJoin(F.broadcast(stats)).withColumn("cov", F.when(F.col("mask") == 1, (F.col("adv") - F.col("ma")) * (F.col("logp") - F.col("ml"))))
    cut = c.where("cov is not null").agg(F.percentile("cov", 1 - share).alias("cut"))
    t = c.crossJoin(F.broadcast(cut))
    d, r = ratio(t)
    plain = -F.col("adv") * r
    return t, F.when(F.col("cov") >= F.col("cut"), plain + coef * F.abs(d)).otherwise(plain)


@register("clip_cov")
def clip_cov(df: DataFrame, share: float = 0.0002, low: float = 1.0, high: float = 5.0, seed: int = 3, clip: float = 0.2) -> tuple[DataFrame, Column]:
    """Clipped loss without a drawn ``share`` of the tokens, taken from those whose covariance of advantage and log-probability lies
    between ``low`` and ``high``."""
    stats = df.where("mask = 1").agg(F.avg("adv").alias("__ma"), F.avg("logp").alias("__ml"))
    cov = (F.col("adv") - F.col("__ma")) * (F.col("logp") - F.col("__ml"))
    off = F.coalesce(cov.between(low, high) & (uniform("seq", "pos", seed) < share), F.lit(False))
    frame, x = vanilla(df.crossJoin(F.broadcast(stats)).withColumn("__off", off).drop("__ma", "__ml"), clip, clip)  # stats is one row
    return frame, F.when(F.col("__off"), 0.0).otherwise(x)


#: Losses between a teacher's and a student's log-probabilities (columns), by name.
DISTILLATION: dict[str, Callable[[Column, Column], Column]] = {}


def register_distillation(name: str) -> Callable:
    """Register a distillation loss under a name; a taken name is an error."""

    def keep(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        if DISTILLATION.get(name, f) is not f:
            raise ValueError(f"distillation loss {name} exists")
        DISTILLATION[name] = f
        return f

    return keep


for _kind in ("k1", "k2", "k3", "abs"):
    register_distillation(f"reverse_{_kind}")(lambda student, teacher, kind=_kind: kl_penalty(student, teacher, kind))


@register_distillation("forward_topk")
def forward_topk(student: Column, teacher: Column) -> Column:
    """Forward divergence over the teacher's leading tokens: both are arrays of log-probabilities of the same tokens."""
    return F.aggregate(F.zip_with(teacher, student, lambda t, s: F.exp(t) * (t - s)), F.lit(0.0), lambda a, x: a + x)


def distillation_loss(df: DataFrame, name: str, student: str = "logp", teacher: str = "old_logp", mode: str = "token-mean") -> DataFrame:
    """One row, ``loss``, by the distillation loss of that name."""
    if name not in DISTILLATION:
        raise ValueError(f"no distillation loss {name}; there are {sorted(DISTILLATION)}")
    return aggregate_loss(df, DISTILLATION[name](F.col(student), F.col(teacher)), mode)


def entropy_loss(df: DataFrame, logits: str, mode: str = "token-mean") -> DataFrame:
    """One row, ``loss``: the entropy of the logits, reduced."""
    return aggregate_loss(df, entropy(F.col(logits)), mode)


def geo_mean(df: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """Per sequence the geometric mean of the clipped ratios, plain mean over sequences: one row, loss."""
    d, _ = ratio(df)
    sgn = F.signum("adv")
    clipped = sgn * F.least(sgn * d, sgn * clamp(d, -low, high))
    seq = df.groupBy("seq").agg((F.sum(clipped * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("g"), (F.sum(F.col("adv") * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("a"))
    return seq.agg(F.avg(-F.col("a") * F.exp("g")).alias("loss"))


def value_loss(df: DataFrame, clip: float = 0.2, mode: str = "token-mean") -> DataFrame:
    """Frames with vpred, val, ret."""
    v = clamp(F.col("vpred"), F.col("val") - clip, F.col("val") + clip)
    x = F.greatest((F.col("vpred") - F.col("ret")) ** 2, (v - F.col("ret")) ** 2)
    return aggregate_loss(df, 0.5 * x, mode)


def loss(df: DataFrame, name: str, mode: str = "token-mean", **options) -> DataFrame:
    """One row, the loss of that name."""
    if name not in LOSSES:
        raise ValueError(f"no loss {name}")
    t, x = LOSSES[name](df, **options)
    return aggregate_loss(t, x, mode)


# --- Off-policy correction -----------------------------------------------------------------------------------
def parse_band(text: str | float) -> tuple[float | None, float]:
    """``u`` or ``l_u``: (lower or None, upper), positive, lower <= upper."""
    part = [float(x) for x in str(text).split("_")]
    if len(part) not in (1, 2) or any(x <= 0 for x in part) or part != sorted(part):
        raise ValueError(f"not a threshold: {text}")
    return (part[0], part[1]) if len(part) == 2 else (None, part[0])


def importance_weights(df: DataFrame, level: str = "token", threshold: str | float = 2.0, normalise: bool = False) -> DataFrame:
    """Adds raw_w and w: truncated at the upper bound, or, with a lower bound too, zero outside the band."""
    low, high = parse_band(threshold)
    d = F.col("logp") - F.col("old_logp")
    if level == "sequence":
        d = F.sum(d * F.col("mask")).over(Window.partitionBy("seq"))
    elif level != "token":
        raise ValueError(f"no level {level}")
    raw = F.exp(clamp(d, -20.0, 20.0)) * F.col("mask")
    t = df.withColumn("raw_w", raw)
    w = F.least("raw_w", F.lit(high)) if low is None else F.when(F.col("raw_w").between(low, high), F.col("raw_w")).otherwise(0.0)
    t = t.withColumn("w", w)
    if normalise:
        mean = t.where("mask = 1").agg(F.avg("w").alias("__m"))
        t = t.crossJoin(F.broadcast(mean)).withColumn("w", F.col("w") / F.greatest("__m", F.lit(1e-8))).drop("__m")
    return t


def rejection_mask(df: DataFrame, options: dict[str, str | float]) -> DataFrame:
    """Adds ``kept``: the mask, zero where any option's statistic is out of its band.

    Options are level_kind: token, seq_sum, seq_mean or seq_max, and k1, k2 or k3. k1 is compared as a log-ratio, with
    1 / upper as its lower bound if only one is given; the others need to stay below their bound.
    """
    w = Window.partitionBy("seq")
    keep = F.col("mask") == 1
    t = df
    for n, (option, bound) in enumerate(sorted(options.items())):
        level, _, kind = option.rpartition("_")
        low, high = parse_band(bound)
        x = {"k1": F.col("logp") - F.col("old_logp"), "k2": kl_penalty(F.col("old_logp"), F.col("logp"), "k2"), "k3": F.exp(F.col("logp") - F.col("old_logp")) - 1 - (F.col("logp") - F.col("old_logp"))}[kind]
        x = x * F.col("mask")
        if level == "seq_sum":
            x = F.sum(x).over(w)
        elif level == "seq_mean":
            x = F.sum(x).over(w) / (F.sum("mask").over(w) + 1e-8)
        elif level == "seq_max":
            x = F.max(F.abs(x) if kind == "k1" else x).over(w)
        elif level != "token":
            raise ValueError(f"no option {option}")
        t = t.withColumn(f"__x{n}", x)
        c = F.col(f"__x{n}")
        keep = keep & ((c >= F.ln(F.lit(low or 1 / high))) & (c <= F.ln(F.lit(high))) if kind == "k1" else c <= high)
    return t.withColumn("kept", F.when(keep, 1).otherwise(0)).drop(*[f"__x{n}" for n in range(len(options))])


def offpolicy_metrics(df: DataFrame) -> DataFrame:
    """One row: kl, k3_kl, perplexities of both policies, chi2 per token and per sequence."""
    on = df.where("mask = 1").withColumn("d", F.col("logp") - F.col("old_logp"))
    seq = on.groupBy("seq").agg(F.avg("logp").alias("l"), F.avg("old_logp").alias("o"), F.sum("d").alias("sd"))
    a = on.agg(F.avg(-F.col("d")).alias("kl"), F.avg(F.exp("d") - F.col("d") - 1).alias("k3_kl"), (F.avg(F.exp(2 * clamp(F.col("d"), -20.0, 20.0))) - 1).alias("chi2_token"))
    b = seq.agg(F.avg(F.exp(-F.col("l"))).alias("ppl"), F.avg(F.exp(-F.col("o"))).alias("rollout_ppl"), F.avg(F.abs(F.col("l") - F.col("o"))).alias("log_ppl_abs_diff"), (F.avg(F.exp(2 * clamp(F.col("sd"), -20.0, 20.0))) - 1).alias("chi2_seq"))
    return a.crossJoin(b)  # one row each


def weight_metrics(df: DataFrame, high: float = 2.0) -> DataFrame:
    """One row over tokens with mask: mean, std, effective sample share, share above the bound and below its inverse."""
    x = F.col("raw_w")
    return df.where("mask = 1").agg(
        F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), (F.sum("w") ** 2 / (F.count("*") * F.sum(F.col("w") ** 2))).alias("ess"),
        F.avg((x > high).cast("double")).alias("high_share"), F.avg((x < 1 / high).cast("double")).alias("low_share"), F.max(x).alias("max"), F.min(x).alias("min"),
    )
