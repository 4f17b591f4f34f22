"""Evaluation and training metrics as aggregates. Null scores are left out unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.draws import uniform


def judged(status: Column, correct: Column) -> Column:
    """A row counts as judged if its status is no evaluation error and its verdict is known."""
    return (F.coalesce(status, F.lit("")) != "evaluation_error") & correct.isNotNull()


def accuracy_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per grouping: count, judged, errors, accuracy in percent over the judged, coverage. Frames: status, correct, keys."""
    on = judged(F.col("status"), F.col("correct"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("count"), F.count_if(on).alias("judged"), F.count_if(~on).alias("errors"),
        (100 * F.count_if(on & F.col("correct")) / F.nullif(F.count_if(on), F.lit(0))).alias("accuracy"), (100 * F.count_if(on) / F.count("*")).alias("coverage"),
    )


def calibration_error(df: DataFrame, bins: int = 5) -> DataFrame:
    """One row, ece: half-open bins, so a confidence of exactly 1 falls in no bin but counts in the total.
    Confidence is text: 0.8, 80%, else 0."""
    text = F.col("confidence").cast("string")
    plain = F.regexp_replace(text, "%", "").try_cast("double")
    c = F.coalesce(F.when(text.contains("%"), plain / 100).otherwise(plain), F.lit(0.0))
    t = df.select(c.alias("c"), F.col("correct").cast("double").alias("ok"))
    b = t.groupBy(F.when((F.col("c") >= 0) & (F.col("c") < 1), F.floor(F.col("c") * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg("ok").alias("acc"), F.avg("c").alias("conf"))
    total = F.sum("n")
    return b.agg((F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)) / total).alias("ece"))


def reducer_of(name: str) -> str:
    """By substring of the metric's name: max, else min, else mean; min also hides in timing."""
    return "max" if "max" in name else "min" if "min" in name else "mean"


def reduce_metrics(df: DataFrame) -> DataFrame:
    """Frames (name, value): one value per name, reduced by its name."""
    n = F.col("name")
    value = F.when(n.contains("max"), F.max("value")).when(n.contains("min"), F.min("value")).otherwise(F.avg("value"))
    return df.groupBy("name").agg(value.alias("value"))


def majority(df: DataFrame, group: str, vote: str, value: str, order: str) -> DataFrame:
    """Per group the value of the first row that gave the most frequent vote; ties go to the vote seen first."""
    votes = df.groupBy(group, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    return votes.groupBy(group).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"), F.max_by(vote, F.struct("n", -F.col("first"))).alias("vote"))


def best_worst_of(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Expected best and worst of n draws with replacement from each group, in closed form from the ranks."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    r = F.row_number().over(w.orderBy(value))
    t = df.select(group, F.col(value).cast("double").alias("v"), r.alias("r"), F.count("*").over(w).alias("k"))
    top = F.pow(F.col("r") / F.col("k"), n) - F.pow((F.col("r") - 1) / F.col("k"), n)
    low = F.pow((F.col("k") - F.col("r") + 1) / F.col("k"), n) - F.pow((F.col("k") - F.col("r")) / F.col("k"), n)
    return t.groupBy(group).agg(F.sum(F.col("v") * top).alias("best"), F.sum(F.col("v") * low).alias("worst"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def bootstrap(df: DataFrame, group: str, value: str, order: str, size: int, rounds: int = 1000, seed: int = 42, reducers: dict | None = None) -> DataFrame:
    """Per group the mean and the population deviation, over ``rounds`` resamples of ``size`` values with replacement, of each reducer
    (name: column -> aggregate; mean, best and worst if none are given): ``<name>_mean``, ``<name>_std``.

    Only the draws are made: groups times rounds times ``size`` rows, whatever the number of values, joined with the values by their place in the
    group. Null values are left out.
    """
    from pyspark.sql import Window

    reducers = reducers or {"mean": F.avg, "best": F.max, "worst": F.min}
    w = Window.partitionBy(group)
    v = df.where(F.col(value).isNotNull()).select(F.col(group), F.col(value).cast("double").alias("v"), (F.row_number().over(w.orderBy(order)) - 1).alias("at"))
    draws = v.groupBy(group).agg(F.count("*").alias("k")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(size))))
    draws = draws.withColumn("at", F.floor(uniform(group, "round", "i", seed) * F.col("k")).cast("int"))
    each = draws.join(v, [group, "at"]).groupBy(group, "round").agg(*[f(F.col("v")).alias(name) for name, f in reducers.items()])
    return each.groupBy(group).agg(*[x for name in reducers for x in (F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std"))])
