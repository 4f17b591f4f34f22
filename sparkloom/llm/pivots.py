"""Permutation index for nearest vectors.

Every unit vector is represented by its nearest pivots in order. It is posted in the inverted files of
its ``post`` nearest pivots and looked up in those of its ``probe`` nearest ones. All entries of a file are ranked by the exact
cosine, by one matrix product for many queries: that takes less time than the footrule distances of their orders. With ``keep`` below 1,
entries are ranked by the footrule distance of orders of ``length`` pivots, and only the best ``keep`` of them (a share of the file, alike for
short and long files) by the exact cosine.

Pivots are a sample of the vectors; every vector is indexed. Their number grows with
the square root of the collection, so a file holds about ``post * sqrt(n)`` entries; the pivots (32,768 of them, 8 MB, for a billion
vectors) are sent to the tasks. Nearby pivots form groups
of GROUP; a vector is sent once to each group it is posted or looked up in. A group of more than HOT vectors is cut into
slices that meet pairwise, two of which are at most that, so no task holds an unbounded group and nothing is left out.

Measured recall of the 10 nearest against exhaustive search: see README.

Defined results: vectors that are null, of another dimension, all zero or hold a null, NaN or infinite number
take no part. Exact copies (equal stored numbers) are indexed once and put back at the end. Ties go to the lower
id. Rows that repeat an id must hold the same vector and count once. An empty table gives no rows; columns other
than the id and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.common import parallelism, written
from sparkloom.functions.vectors import unit_vectors

MIN_PIVOTS, GROUP = 16, 8
#: Entries of a file looked up at a time, and cosines held at a time.
BLOCK, CELLS = 16384, 1 << 21
#: Vectors of a group in one task; a larger group is cut into slices, each slice of it looked up in each other.
HOT = 262144
#: Cosines of 4-byte numbers differ from exact ones by less.
SLACK = np.float32(2e-6)


def maxima(s: np.ndarray, k: int) -> np.ndarray:
    """The largest entries of each row by column modulo the width of the result: of any k largest entries of a row, none is in a
    column whose largest one is not among the k largest here."""
    n = s.shape[1]
    r = max(1, int((n / max(k, 1)) ** 0.5))
    wide = -(-n // r)
    out = s[:, :wide].copy()
    for a in range(wide, n, wide):
        part = s[:, a : a + wide]
        np.maximum(out[:, : part.shape[1]], part, out=out[:, : part.shape[1]])
    return out


def nearest_order(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest ``length`` pivots of each row, in order."""
    out = np.empty((len(x), length), np.int64)
    n = len(pivots)
    step = max(1, CELLS // n)
    for a in range(0, len(x), step):
        d = x[a : a + step] @ pivots.T
        m = maxima(d, length)
        wide = m.shape[1]
        o = np.argpartition(m, wide - length, axis=1)[:, wide - length :]
        if wide < n:
            o = (o[:, None, :] + np.arange(0, n, wide)[None, :, None]).reshape(len(d), -1)
            v = np.where(o < n, np.take_along_axis(d, np.minimum(o, n - 1), 1), np.float32(-3))
            o = np.take_along_axis(o, np.argpartition(v, v.shape[1] - length, axis=1)[:, v.shape[1] - length :], 1)
        out[a : a + step] = np.take_along_axis(o, np.argsort(-np.take_along_axis(d, o, 1), axis=1, kind="stable"), 1)
    return out


def group_pivots(pivots: np.ndarray, size: int = GROUP) -> np.ndarray:
    """Group number per pivot: balanced halving along the widest direction."""
    out, todo, nxt = np.zeros(len(pivots), np.int32), [np.arange(len(pivots))], 0
    while todo:
        i = todo.pop()
        if len(i) <= size:
            out[i], nxt = nxt, nxt + 1
            continue
        c = pivots[i] - pivots[i].mean(0)
        axis = np.linalg.svd(c, full_matrices=False)[2][0]
        o = np.argsort(c @ axis, kind="stable")
        todo += [i[o[: len(i) // 2]], i[o[len(i) // 2 :]]]
    return out


def search_file(order: np.ndarray, x: np.ndarray, members: np.ndarray, queries: np.ndarray, k: int, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query row its best ``k`` member rows of one inverted file and their cosines (-2: none); the share ``keep`` of the
    members with the least footrule distance is reranked.

    The footrule distance of two truncated orders is a constant less twice the sum of the smaller of the two
    position weights, so the largest such sum is the smallest distance.
    """
    length, n, mx = order.shape[1], len(members), x[members]
    kept = min(n, max(k + 1, math.ceil(keep * n)))
    mine = np.arange(length, 0, -1, dtype=np.uint8)
    # Weights of the members by pivot; a row of zeros stands for the pivots that no member has near.
    near, at = np.unique(order[members], return_inverse=True)
    w = np.zeros((len(near) + 1, n), np.uint8)
    w[at.reshape(n, length).T, np.arange(n)[None, :]] = mine[:, None]
    asked = np.searchsorted(near, order[queries])
    asked[near[np.minimum(asked, len(near) - 1)] != order[queries]] = len(near)
    best, cos = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2, np.float32)
    for j, q in enumerate(queries):
        sums = np.minimum(w[asked[j]], mine[:, None]).sum(0, dtype=np.uint16)
        c = np.argpartition(sums, n - kept)[n - kept :] if kept < n else np.arange(n)
        rows = members[c]
        s = np.where(rows == q, np.float32(-2), mx[c] @ x[q])
        top = np.argpartition(s, len(s) - k)[len(s) - k :] if len(s) > k else np.arange(len(s))
        top = top[s[top] > -2][np.argsort(-s[top][s[top] > -2], kind="stable")][:k]
        best[j, : len(top)], cos[j, : len(top)] = rows[top], s[top]
    return best, cos


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors that are 1 but for the rounding to 4-byte numbers; by them two of one direction have the cosine 1."""
    return np.concatenate([np.linalg.norm(x[a : a + BLOCK].astype(np.float64), axis=1) for a in range(0, len(x), BLOCK)] or [np.zeros(0)])


def search_whole_file(x: np.ndarray, members: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (query, member): all pairs of a query row and a member row but itself whose cosine is not below the k-th best of
    the query by more than rounding, so its k best are among them; rows ascend. No cosine is left out."""
    mx, out = x[members], []
    step = max(1, CELLS // max(1, len(members)))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        s = x[q] @ mx.T
        at = np.searchsorted(members, q)
        me = np.flatnonzero(members[np.minimum(at, len(members) - 1)] == q)
        s[me, at[me]] = -2
        m = maxima(s, k)
        least = np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k] - SLACK if m.shape[1] > k else np.full(len(q), -2, np.float32)
        i = np.flatnonzero(s >= np.maximum(least, np.float32(-1.5))[:, None])
        if len(i) > 8 * k * len(q):  # many vectors of one direction: k of each row at once, so that no list of all pairs is made
            place = np.arange(len(members))
            exact = x[q].astype(np.float64) @ mx.T.astype(np.float64) / (norms(x[q])[:, None] * norms(mx))
            worst = np.rint((2 - exact) * 1e9).astype(np.int64) << 20 | place
            worst[me, at[me]] = 1 << 62
            row, col = np.divmod(np.flatnonzero(worst <= np.partition(worst, k - 1, axis=1)[:, k - 1 : k]), len(members))
            i = (row * len(members) + col)[worst[row, col] < 1 << 62]
        out.append((q[i // len(members)], members[i % len(members)]))
    return np.concatenate([z[0] for z in out]), np.concatenate([z[1] for z in out])


def ranked(x: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different members of each query row (query, member, cosine to 9 decimals), best first; ties go to the lower row."""
    key = np.concatenate([q.astype(np.int64) * len(x) + c for q, c in pairs]) if pairs else np.zeros(0, np.int64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    q, c = key // len(x), key % len(x)
    cos, norm = np.empty(len(key)), norms(x)
    for a in range(0, len(key), BLOCK):
        i, j = q[a : a + BLOCK], c[a : a + BLOCK]
        cos[a : a + BLOCK] = np.einsum("ij,ij->i", x[i].astype(np.float64), x[j].astype(np.float64)) / (norm[i] * norm[j])
    worst = np.rint((2 - cos) * 1e9).astype(np.int64)
    o = np.argsort(q << 32 | worst, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    o = o[np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]
    return q[o], c[o], (2 * 10**9 - worst[o]) / 1e9


def rows_of(column: pa.ChunkedArray, kind: np.dtype, width: int) -> np.ndarray:
    """A column of binary values of ``width`` numbers each as a matrix."""
    out, at = np.empty((len(column), width), kind), 0
    for c in column.chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            out[at : at + len(c)] = np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(c), width)
            at += len(c)
    return out


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, dim: int = 64, post: int = 3, probe: int = 8, length: int = 32, keep: float = 1.0) -> DataFrame:
    """The ``k`` most similar other vectors of each: id, neighbour, cosine (double), rank (1..k)."""
    spark = df.sparkSession
    src = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = src.where(F.col("id").isNotNull() & (F.size("v") == dim) & ~bad & F.exists("v", lambda x: x != 0))

    # Exact copies: only digests are shuffled; the list of surplus copies is joined out (Spark picks broadcast by size).
    digest = src.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    groups = written(digest.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("id").alias("rows")).where("rows > 1"))
    copies = digest.join(groups.where("last > rep"), ["h1", "h2"]).where("id <> rep").select("id", "rep").distinct()
    has = groups.where("last > rep").limit(1).count() > 0
    repeated = digest.join(groups.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        src = src.dropDuplicates(["id"])
    if has:
        copies = written(copies)
        src = src.join(copies.select("id"), "id", "left_anti")

    n = src.count()
    m = max(MIN_PIVOTS, 2 ** round(math.log2(max(1.0, math.sqrt(n)))))
    sample = src.orderBy(F.xxhash64("id"), "id").limit(2 * m).toArrow()  # 2 * sqrt(n) vectors, or a little more
    pivots = unit_vectors(sample["v"], dim)[1][:m]
    if len(pivots) == 0:
        return spark.createDataFrame([], "id bigint, neighbour bigint, cosine double, rank int")
    m, length = len(pivots), min(length, len(pivots))
    post, probe = min(post, m), min(probe, m)
    held = length if keep < 1 else max(post, probe)  # pivots of an order that are sent along
    group_of = group_pivots(pivots)
    code = np.dtype(np.uint16 if m <= 1 << 16 else np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(group_of.max()) + 1, np.int64)
        for b in batches:
            x = unit_vectors(b.column("v"), dim)[1]
            if len(x):
                at = np.sort(group_of[nearest_order(x, pivots, probe)], axis=1)
                new = np.ones(at.shape, bool)
                new[:, 1:] = at[:, 1:] != at[:, :-1]
                total += np.bincount(at[new], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["grp", "n"])

    # One row per group of pivots.
    sizes = {r["grp"]: r["n"] for r in src.mapInArrow(count, "grp int, n bigint").groupBy("grp").agg(F.sum("n").alias("n")).collect()}
    slices = np.array([1 if sizes.get(g, 0) <= HOT else -(-2 * sizes[g] // HOT) for g in range(int(group_of.max()) + 1)], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = unit_vectors(b.column("v"), dim)
            if not len(x):
                continue
            ids = b.column("id").to_numpy()[ok]
            o = nearest_order(x, pivots, held).astype(code)
            at = group_of[o[:, :probe]]
            at.sort(axis=1)
            new = np.ones(at.shape, bool)
            new[:, 1:] = at[:, 1:] != at[:, :-1]
            row, col = np.nonzero(new)
            grp = at[row, col]
            # A slice of a hot group meets every slice, itself once: as entries (own, other), as queries (other, own).
            s = slices[grp]
            own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % s
            times = 2 * s - 1
            k_ = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, grp, own, s = (np.repeat(z, times) for z in (row, grp, own, s))
            other = np.where(k_ < s, k_, k_ - s)
            other = np.where((k_ >= s) & (other >= own), other + 1, other)
            entry, query = np.where(k_ < s, own, other), np.where(k_ < s, other, own)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grp, pa.int32()), pa.array(entry, pa.int32()), pa.array(query, pa.int32()), pa.array(own, pa.int32()), pa.array(ids[row], pa.int64()),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(x.tobytes())]).take(take).cast(pa.binary()),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.itemsize * held), len(x), [None, pa.py_buffer(o.tobytes())]).take(take).cast(pa.binary()),
                ],
                names=["grp", "entry", "query", "own", "id", "x", "o"],
            )

    posted = src.mapInArrow(send, "grp int, entry int, query int, own int, id bigint, x binary, o binary")

    def scan(t: pa.Table) -> pa.Table:
        grp, entry, query = (t[c][0].as_py() for c in ("grp", "entry", "query"))
        t = t.select(["id", "own", "x", "o"])
        ids = t["id"].to_numpy()
        by_id = np.argsort(ids)  # so ties between rows go to the lower id
        ids, own, x, o = ids[by_id], t["own"].to_numpy()[by_id], rows_of(t["x"], np.float32, dim)[by_id], rows_of(t["o"], code, held)[by_id]
        pairs = []
        for p in np.flatnonzero(group_of == grp):
            members, queries = np.flatnonzero((o[:, :post] == p).any(1) & (own == entry)), np.flatnonzero((o[:, :probe] == p).any(1) & (own == query))
            if not len(queries):
                continue
            for a in range(0, len(members), BLOCK):
                if keep < 1:
                    r, _ = search_file(o.astype(np.int64), x, members[a : a + BLOCK], queries, k, keep)
                    row, col = np.nonzero(r >= 0)
                    pairs.append((queries[row], r[row, col]))
                else:
                    pairs.append(search_whole_file(x, members[a : a + BLOCK], queries, k))
        q, c, cos = ranked(x, pairs, k)
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array(-cos, pa.float64()), pa.array(ids[c], pa.int64())], names=["d", "neighbour"])
        return pa.table({"id": pa.array(ids[q[start]], pa.int64()), "l": pa.ListArray.from_arrays(pa.array(np.append(start, len(q)), pa.int32()), entries)})

    # A set number of partitions: the work of a group goes by its pairs, not by its bytes.
    on = ["grp", "entry", "query"]
    posted = posted.repartition(max(int((slices * slices).sum()), parallelism(spark)), *on)
    near = best(posted.groupBy(*on).applyInArrow(scan, f"id bigint, l {ENTRIES}"), k)
    if not has:
        return numbered(near)
    # Put the copies back: a copy stands beside its representative wherever that one is a neighbour, and a
    # class shares its neighbours. A class lists its lowest k + 1 ids; no vector needs more of them.
    near = written(near)
    groups_ = copies.select("id", "rep").unionByName(copies.select(F.col("rep").alias("id"), "rep").distinct())
    lists = written(groups_.groupBy("rep").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("rep", F.slice("ids", 1, k + 1).alias("ids")))
    # Beside k or more copies of its own a class has room only for ties with them. So a list grows by k at each entry at most, and it is
    # made once for a class, not for each copy.
    mine = near.join(lists.select(F.col("rep").alias("id"), "ids"), "id", "left")
    room = F.when(F.size("ids") > k, F.filter("l", lambda e: e["d"] <= -1.0)).otherwise(F.col("l"))
    wide = mine.select("id", F.explode(room).alias("e")).select("id", F.col("e.d").alias("d"), F.col("e.neighbour").alias("rep")).join(lists, "rep", "left")
    wide = wide.select("id", F.transform(F.coalesce("ids", F.array("rep")), lambda i: F.struct(F.col("d"), i.alias("neighbour"))).alias("l"))
    wide = written(best(wide, k))
    rest = F.coalesce("l", F.array().cast(ENTRIES))
    classes = lists.join(wide.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("rep", F.sort_array(F.concat(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("neighbour"))), rest)).alias("l"))
    members = groups_.join(classes, "rep").select("id", "l")
    members = members.select("id", F.slice(F.filter("l", lambda e: e["neighbour"] != F.col("id")), 1, k).alias("l"))
    return numbered(members.unionByName(wide.join(lists.select(F.col("rep").alias("id")), "id", "left_anti")))


#: A list of neighbours, best first: the cosine with its sign turned, so that ties go to the lower id.
ENTRIES = "array<struct<d: double, neighbour: bigint>>"


def best(lists: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each id (id, l) of all its lists. An id has a few short lists; entries of the same pair
    stand side by side once sorted, as cosines are cut to 9 decimals."""
    l = F.col("l")
    whole = lists.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("l"))).alias("l"))
    once = F.filter(l, lambda x, i: (i == 0) | (F.get(l, i - 1)["neighbour"] != x["neighbour"]))
    return whole.select("id", F.slice(once, 1, k).alias("l"))


def numbered(lists: DataFrame) -> DataFrame:
    """id, neighbour, cosine, rank (1..k) of the lists."""
    out = lists.select("id", F.posexplode("l").alias("rank", "e"))
    return out.select("id", F.col("e.neighbour").alias("neighbour"), (-F.col("e.d")).alias("cosine"), (F.col("rank") + 1).cast("int").alias("rank"))
