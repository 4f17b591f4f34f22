"""Columnar batch protocol: frames with an explicit position column.

Spark rows have no order, so every operation that depends on one names its position column. Dense positions come from
:func:`with_positions`, which numbers range partitions from their sizes instead of sorting all rows into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.common import checkpoint, parallelism
from sparkloom.functions.draws import drawn, uniform


def with_positions(df: DataFrame, *order: str | Column, name: str = "row_pos") -> DataFrame:
    """Dense 0-based positions in the global order. One range partitioning; only partition sizes reach the driver."""
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = checkpoint(df.repartitionByRange(parallelism(spark), *cols).sortWithinPartitions(*cols)).withColumn("__p", F.spark_partition_id())
    sizes = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    local = ranged.withColumn("__m", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    begin = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("__p")] if starts else F.lit(0)
    return local.withColumn(name, (begin + F.col("__m")).cast("bigint")).drop("__p", "__m")


def take(df: DataFrame, indices: DataFrame, pos: str = "row_pos") -> DataFrame:
    """Rows at the positions of ``indices`` (out, row_pos), repeats kept; ``out`` is the new position."""
    return df.join(indices.select(F.col(pos), F.col("out")), pos).drop(pos).withColumnRenamed("out", pos)


def python_slice(df: DataFrame, n: int, start: int | None = None, stop: int | None = None, step: int | None = None, pos: str = "row_pos") -> DataFrame:
    """Rows start:stop:step of n, negative bounds counted from the end, as a Python slice."""
    a, b, s = slice(start, stop, step).indices(n)
    p = F.col(pos)
    if s > 0:
        return df.where((p >= a) & (p < b) & ((p - a) % s == 0))
    return df.where((p <= a) & (p > b) & ((F.lit(a) - p) % -s == 0))


def repeat(df: DataFrame, times: int, interleave: bool = True, n: int | None = None, pos: str = "row_pos") -> DataFrame:
    """Every row ``times`` times: aabb, or abab (then ``n``, the number of rows, is needed)."""
    if not interleave and n is None:
        raise ValueError("tiling needs the number of rows")
    out = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    new = F.col(pos) * times + F.col("__r") if interleave else F.col("__r") * n + F.col(pos)
    return out.withColumn(pos, new.cast("bigint")).drop("__r")


def repeat_by(df: DataFrame, count: str) -> DataFrame:
    """Every row as often as its count says; rows with a count below 1 or null vanish."""
    return df.where(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))


def pad_to_divisor(df: DataFrame, n: int, divisor: int, pos: str = "row_pos") -> DataFrame:
    """Cycle rows from the start until the number of rows is a multiple; ``is_padding`` marks them."""
    missing = -n % divisor
    whole = df.withColumn("is_padding", F.lit(False))
    if not missing or not n:
        return whole
    extra = F.explode(F.filter(F.sequence(F.lit(n), F.lit(n + missing - 1)), lambda x: x % n == F.col(pos)))
    return whole.unionByName(df.where(F.col(pos) < missing).withColumn("__x", extra).withColumn(pos, F.col("__x").cast("bigint")).drop("__x").withColumn("is_padding", F.lit(True)))


def chunk(df: DataFrame, n: int, chunks: int, pos: str = "row_pos") -> DataFrame:
    """Adds ``chunk``; n must divide evenly."""
    if n % chunks:
        raise ValueError(f"{n} rows do not make {chunks} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(pos) / (n // chunks)).cast("int"))


def split(df: DataFrame, size: int, pos: str = "row_pos") -> DataFrame:
    """Adds ``part``: pieces of ``size`` rows, the last may be short."""
    return df.withColumn("part", F.floor(F.col(pos) / size).cast("bigint"))


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both; shared ones must be equal (null and NaN equal themselves), else the row raises."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    both = left.join(right.select(key, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns if c != key]), key)
    for c in shared:
        ok = F.col(c).eqNullSafe(F.col(f"__{c}"))
        both = both.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType))).drop(f"__{c}")
    return both


def first_per_key(df: DataFrame, key: str, order: str, keep_empty: bool = False, last: bool = False) -> DataFrame:
    """First (or last) row per key; with ``keep_empty`` rows with an empty key are all kept. Ranking is cut to one row per
    key before the shuffle ends (min_by keeps one row per key and map task), so a hot key costs no sort."""
    cols = [c for c in df.columns]
    pick = (F.max_by if last else F.min_by)(F.struct(*cols), F.col(order))
    body = df.where(F.col(key) != "") if keep_empty else df
    out = body.groupBy(F.col(key).alias("__k")).agg(pick.alias("__r")).select("__r.*")
    return out.unionByName(df.where((F.col(key) == "") | F.col(key).isNull())) if keep_empty else out


def fold_rows(df: DataFrame, size: int, columns: list[str], pos: str = "row_pos") -> DataFrame:
    """size rows to one: arrays in order of position."""
    g = df.groupBy(F.floor(F.col(pos) / size).alias("fold")).agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("__l"))
    return g.select("fold", *[F.col(f"__l.{c}").alias(c) for c in columns])


def unfold_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Inverse of :func:`fold_rows`."""
    z = df.select("fold", F.posexplode(F.arrays_zip(*columns)).alias("at", "__z"))
    return z.select("fold", "at", *[F.col(f"__z.{c}").alias(c) for c in columns])


# --- Array columns ---
def pad(a: Column, length: int, value: Column | int, left: bool = False) -> Column:
    """Arrays padded to a length; longer ones stay."""
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def fit(a: Column, length: int, value: int, left_pad: bool = True, truncation: str = "error") -> Column:
    """Padded, or truncated left, right, middle, or an error."""
    n = F.size(a)
    half = length // 2
    cut = {
        "left": F.slice(a, F.greatest(n - length + 1, F.lit(1)), F.lit(length)),
        "right": F.slice(a, 1, length),
        "middle": F.concat(F.slice(a, 1, half), F.slice(a, F.greatest(n - (length - half) + 1, F.lit(1)), F.lit(length - half))),
        "error": F.raise_error(F.lit("sequence too long")).cast("array<bigint>"),
    }[truncation]
    return F.when(n > length, cut).otherwise(pad(a, length, value, left_pad))


def response_mask(a: Column, eos: Column | int) -> Column:
    """1 up to and with the first end mark, else 0."""
    at = F.array_position(a, eos if isinstance(eos, Column) else F.lit(eos))
    return F.transform(a, lambda x, i: F.when((at == 0) | (i + 1 <= at), 1).otherwise(0))


def last_masked(ids: Column, mask: Column) -> Column:
    """The last sum(mask) ids (left padding)."""
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(n > 0, F.slice(ids, F.size(ids) - n + 1, n)).otherwise(F.slice(ids, 1, 0))


# --- Balanced partitioning ---
def karmarkar_karp(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Indices of k partitions of near-equal sums by largest differencing; ties go to the lower index.

    A set is its sum, its lowest index, and the two sets it was merged from; members are gathered once, at the end.
    """
    import heapq

    if k < 1 or len(lengths) < k:
        raise ValueError("needs at least one item per partition")
    if equal_size and len(lengths) % k:
        raise ValueError("the items do not divide evenly")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    none = len(lengths)  # lowest index of an empty set
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap = []
    for n, g in enumerate(groups):
        sets = sorted((-lengths[i], i, None) for i in g) + [(0, none, None)] * (k - len(g))
        heap.append((sets[0][0] - sets[-1][0], n, sets))
    heapq.heapify(heap)
    n = len(groups)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [(x[0] + y[0], min(x[1], y[1]), (x, y)) for x, y in zip(a, reversed(b))]
        merged.sort(key=lambda s: s[:2])
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], n, merged))
        n += 1
    out = []
    for top in heap[0][2]:
        members, todo = [], [top]
        while todo:
            _, low, parts = todo.pop()
            if parts:
                todo += parts
            elif low < none:
                members.append(low)
        out.append(sorted(members))
    return out


def balanced(df: DataFrame, key: str, length: str, k: int, equal_size: bool = False, within: str | None = None) -> DataFrame:
    """Adds ``partition`` 0..k-1 with near-equal sums of ``length``, per group of ``within`` (a batch that fits a task)."""
    group = F.lit(0) if within is None else F.col(within)
    out = df.select(F.col(key).alias("k"), F.col(length).cast("bigint").alias("len"), group.cast("bigint").alias("g"))

    def part(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k").reset_index(drop=True)
        f["partition"] = 0
        for p, members in enumerate(karmarkar_karp(f["len"].tolist(), min(k, len(f)), equal_size)):
            f.loc[members, "partition"] = p
        return f

    return out.groupBy("g").applyInPandas(part, "k bigint, len bigint, g bigint, partition int")


def seeded_order(key: str, seed: int) -> Column:
    """A reproducible random order: a digest of key and seed; ties go by the key."""
    return F.struct(drawn(key, seed).alias("draw"), F.col(key).alias("key"))


def resample(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """draw (0 to n - 1) and the key it hits: n draws with replacement, in proportion to ``weight`` (null and negative ones are 0).

    Rows lie on a line in the order of the key, each as long as its weight. Range partitions hold stretches of the line, whose lengths are
    one number per partition; a draw goes to the partition its point falls in and is looked up there. So nothing is sorted in one place, and
    a heavy row is simply hit often. Weights that sum up to nothing give no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    rows = checkpoint(rows.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["w"] for r in rows.groupBy("part").agg(F.sum("w").alias("w")).collect()}  # one row per partition
    starts, at = [], 0.0
    for p in range(parts):
        starts.append(at)
        at += sums.get(p, 0.0)
    if at <= 0:
        return spark.createDataFrame([], f"draw bigint, key {kind}")
    points = spark.range(n).select(F.col("id").alias("draw"), (uniform("id", seed) * at).alias("x"))
    ends = F.array(*[F.lit(s + sums.get(p, 0.0)) for p, s in enumerate(starts)])
    points = points.withColumn("part", F.least(F.size(F.filter(ends, lambda e: e <= F.col("x"))), F.lit(max(p for p, w in sums.items() if w > 0))))

    def look_up(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        if not len(rows) or not len(points):
            return pd.DataFrame({"draw": pd.Series(dtype="int64"), "key": rows["key"][:0]})
        line = starts[int(points["part"].iloc[0])] + np.cumsum(rows["w"].to_numpy())
        held = np.flatnonzero(rows["w"].to_numpy() > 0)  # rounding must not end at a row of no weight
        at = np.minimum(np.searchsorted(line, points["x"].to_numpy(), side="right"), held[-1])
        return pd.DataFrame({"draw": points["draw"].to_numpy(), "key": rows["key"].to_numpy()[at]})

    return rows.groupBy("part").cogroup(points.groupBy("part")).applyInPandas(look_up, f"draw bigint, key {kind}")


def dispatch(df: DataFrame, ranks: int, f, schema: str) -> DataFrame:
    """Rows spread over ranks, ``f`` over each rank's batches, results put together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return df.repartition(ranks).mapInPandas(run, schema)
