"""Micro-batches under a token budget, per batch: a batch fits one task, batches run in parallel."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.batches import karmarkar_karp


def workload(n: int) -> int:
    """Cost of a sequence: linear and attention part."""
    return 24576 * n + n * n


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item, in order, to the partition with the least so far (of those with the fewest items, if sizes are to be equal)."""
    sums, parts = [0] * k, [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        at = min(range(k), key=lambda j: ((len(parts[j]),) if equal_size else ()) + (sums[j], j))
        parts[at].append(i)
        sums[at] += n
    return parts


def both_ends(parts: list[list[int]], load: list[int]) -> list[list[int]]:
    """Partitions in the order of their load, the largest in the middle and the smaller ones at both ends."""
    parts = sorted(parts, key=lambda p: (-sum(load[i] for i in p), p[0]))
    return parts[::2][::-1] + parts[1::2]


def micro_batches(lengths: list[int], budget: int, multiple: int = 1) -> list[list[int]]:
    """Micro-batches that each keep to the budget, as few as balancing by workload finds, in a multiple of ``multiple``,
    the largest in the middle and the smaller ones at both ends."""
    if not lengths:
        return []
    if max(lengths) > budget:
        raise ValueError("a sequence exceeds the budget")
    load = [workload(n) for n in lengths]
    k = -(-min(len(lengths), -(-sum(lengths) // budget)) // multiple) * multiple
    while True:
        if k > len(lengths):
            raise ValueError("more micro-batches than sequences")
        parts = karmarkar_karp(load, k)
        if all(sum(lengths[i] for i in p) <= budget for p in parts):
            return both_ends(parts, load)
        k += multiple


def required_multiple(sizes: list[int]) -> int:
    """The number that a batch's rows must divide by to be split evenly at every level: data-parallel size, mini-batch, micro-batch."""
    if not sizes or min(sizes) < 1:
        raise ValueError("sizes must be positive")
    return math.lcm(*sizes)


def assign(df: DataFrame, batch: str, key: str, length: str, budget: int) -> DataFrame:
    """batch, key, micro_batch of every row."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key").reset_index(drop=True)
        f["micro_batch"] = 0
        for n, members in enumerate(micro_batches(f["len"].tolist(), budget)):
            f.loc[members, "micro_batch"] = n
        return f[["batch", "key", "micro_batch"]]

    src = df.select(F.col(batch).cast("bigint").alias("batch"), F.col(key).cast("bigint").alias("key"), F.col(length).cast("bigint").alias("len"))
    return src.groupBy("batch").applyInPandas(one, "batch bigint, key bigint, micro_batch int")


def group_balanced(df: DataFrame, batch: str, uid: str, length: str, k: int) -> DataFrame:
    """batch, uid, partition: all rows of a uid stay together, partitions balanced by workload. Rows are summed per uid first."""
    n = F.col(length).cast("bigint")
    sums = df.groupBy(F.col(batch).cast("bigint").alias("batch"), F.col(uid).cast("bigint").alias("uid")).agg(F.sum(24576 * n + n * n).alias("load"))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("uid").reset_index(drop=True)
        f["partition"] = 0
        for p, members in enumerate(karmarkar_karp(f["load"].tolist(), min(k, len(f)))):
            f.loc[members, "partition"] = p
        return f[["batch", "uid", "partition"]]

    return sums.groupBy("batch").applyInPandas(one, "batch bigint, uid bigint, partition int")


def _by_batch(df: DataFrame, batch: str, key: str, length: str, place) -> DataFrame:
    """batch, key, rank, place by ``place(lengths) -> [[index, ...], ...]`` over each batch's rows in the order of the key."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key").reset_index(drop=True)
        rows = [(i, r, p) for r, members in enumerate(place(f["len"].tolist())) for p, i in enumerate(members)]
        i, r, p = zip(*rows)
        return pd.DataFrame({"batch": f["batch"], "key": f["key"].iloc[list(i)].reset_index(drop=True), "rank": r, "place": p})

    src = df.select(F.col(batch).cast("bigint").alias("batch"), F.col(key).cast("bigint").alias("key"), F.col(length).cast("bigint").alias("len"))
    return src.groupBy("batch").applyInPandas(one, "batch bigint, key bigint, rank int, place int")


def balance_ranks(df: DataFrame, batch: str, key: str, length: str, ranks: int) -> DataFrame:
    """batch, key, rank, place: as many rows for each rank, near-equal workloads, and inside a rank the loads rising and falling again, so that
    neighbours are alike. The rows of a batch must divide by ``ranks``."""

    def place(lengths: list[int]) -> list[list[int]]:
        load = [workload(n) for n in lengths]
        out = []
        for members in karmarkar_karp(load, ranks, equal_size=True):
            members.sort(key=lambda i: (load[i], i))
            out.append(members[::2] + members[1::2][::-1])
        return out

    return _by_batch(df, batch, key, length, place)


def greedy_assign(df: DataFrame, batch: str, key: str, length: str, k: int, equal_size: bool = False) -> DataFrame:
    """batch, key, rank, place: each row, in the order of the key, to the rank with the least so far."""
    return _by_batch(df, batch, key, length, lambda lengths: greedy(lengths, k, equal_size))
