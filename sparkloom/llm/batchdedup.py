"""Records of new batches that repeat what earlier batches brought, without reading the history again.

The accepted history lives in an ``Index``, a folder that outlasts the session:

* ``shards``: small-world graphs over hashed word-pair vectors of title, description and subtitle. The batches added so
  far are covered by the blocks of a binary counter; adding a batch makes a new shard, and where the counter carries,
  the shards below it are merged into one. Merging reads the vectors of the shards, not the texts.
* ``keys``: video ids and content digests of the accepted records with their lowest record.
* ``texts``: the normal fields of the accepted contents, one folder per addition; of them only those folders are read in which a
  candidate lies, for the exact rerank.
* ``skips``: skipped video ids.
* ``meta``: one row per published state. What is written before its row is there counts for nothing, so an addition
  that was cut off is simply made again.

``Index.check`` finds the records to refuse among one or more new batches: ids and digests are joined with the keys; the
contents are searched in the shards of the history and, where there are several new batches, in shards over the blocks of
those that precede each. Large blocks are split into cells around centroids of a bounded sample, a query visits the
nearest few. The beam of a graph is widened against exhaustive search when it is built. Candidates are compared field by
field. A list that is full may end before its matches do: then the search goes on through the shard in the order of the records,
page by page, until a record alike is found or the shard ends, so no match is lost to the length of a list.

Which record is accepted depends on which earlier ones were: within one call records are decided in rounds, each as soon as all
earlier records it may repeat are decided. Adding batches one by one or many at once gives the same result.

Exact copies of a content form one class and are indexed once; video ids form groups. So no list of pairs within
a group of copies is ever made.

Defined results: a record of a batch that was never committed, or with a null batch or record id, counts on
neither side; a null field counts as empty; records whose three fields are all empty are compared by id alone;
repeated record ids count once; among several accepted records that match, the lowest record_id is named; an
empty history refuses nothing; batches up to the last one of the index are an error; other columns are ignored whatever
their names. ``check`` and ``commit`` run Spark jobs while they are called.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import parallelism, shared_dir, written
from sparkloom.llm import smallworld
from sparkloom.llm.normalise import words

#: Numbers of a vector, most nodes of a graph, queries of a graph in one task.
DIM, SEGMENT, QUERIES_PER_TASK = 96, 16384, 2048
#: Cells a query visits; vectors a centroid is fitted on, and most vectors of that sample.
VISITS, FIT, SAMPLE = 3, 32, 1 << 16
#: Least cosine of a match worth reading, matches read per graph, first page of a search in record order, least similarity of each field.
NEAR, MATCHES, PAGE, SAME = 0.65, 8, 16, 0.8

_ID = r"^[A-Za-z0-9_-]{11}$"
_IN_URL = r"(?:[?&]v=|/(?:shorts|embed|live|v)/|^(?:https?://)?[^/?#]+/)([A-Za-z0-9_-]{11})(?:[?&#/]|$)"


def video_id(plain: Column, url: Column) -> Column:
    """The 11-character id: from ``plain`` (an id or an address, padding cut), else from ``url``; else null."""
    def read(c: Column) -> Column:
        c = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
        return F.when(c.rlike(_ID), c).otherwise(F.nullif(F.regexp_extract(c, _IN_URL, 1), F.lit("")))

    return F.coalesce(read(plain), read(url))


def vectors(texts: list[list[str]]) -> np.ndarray:
    """Unit vectors of hashed neighbouring word pairs."""
    x = np.zeros((len(texts), DIM), np.float32)
    for i, w in enumerate(texts):
        h = np.fromiter((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(["", *w], [*w, ""])), np.int64, len(w) + 1)
        x[i] = np.bincount(h % DIM, weights=1.0 - 2 * ((h >> 20) & 1), minlength=DIM)
    norm = np.linalg.norm(x, axis=1)
    return x / np.maximum(norm, 1e-9)[:, None]


def common(x: str | list[str], y: str | list[str]) -> int:
    """Length of the longest common subsequence, all rows of a column at once as the bits of one number."""
    a, end = 0, min(len(x), len(y))
    while a < end and x[a] == y[a]:
        a += 1
    b = 0
    while b < end - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = sorted((x[a : len(x) - b], y[a : len(y) - b]), key=len)
    at: dict[str, list[int]] = {}
    for i, w in enumerate(y):
        at.setdefault(w, []).append(i)
    bits: dict[str, int] = {}
    full = open_ = (1 << len(y)) - 1
    for w in x:
        if w in at:
            if w not in bits:
                row = bytearray(len(y) // 8 + 1)
                for i in at[w]:
                    row[i >> 3] |= 1 << (i & 7)
                bits[w] = int.from_bytes(row, "little")
            hit = open_ & bits[w]
            open_ = ((open_ + hit) | (open_ - hit)) & full
    return a + b + len(y) - open_.bit_count()


def alike(a: str, b: str, by_letter: bool = False) -> bool:
    """Whether two normalised fields are the same up to small edits: their longest common subsequence of words (or letters) holds SAME of
    both. One measure for texts of any length, whichever of the two comes first."""
    if a == b:
        return True
    x, y = (a.replace(" ", ""), b.replace(" ", "")) if by_letter else (a.split(), b.split())
    n = len(x) + len(y)
    if not x or not y or 2 * min(len(x), len(y)) / n < SAME or 2 * (Counter(x) & Counter(y)).total() / n < SAME:
        return False
    return 2 * common(x, y) / n >= SAME


def _same(x: list[str], y: list[str]) -> bool:
    """Whether title, description and subtitle are all alike."""
    return alike(x[0], y[0], True) and alike(x[1], y[1]) and alike(x[2], y[2])

FIELDS = ["title", "description", "subtitle"]
GRAPH = ["shard", "cell", "slice"]


def _classes(records: DataFrame) -> DataFrame:
    """Per record (rid, ord, vid) its normal fields and the digest of them, its content class (null: all are empty)."""

    def normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["rid", "ord", "vid"]].assign(**{c: [" ".join(words(x)) if isinstance(x, str) else "" for x in f[c]] for c in FIELDS})

    rows = records.select("rid", "ord", "vid", *FIELDS).mapInPandas(normal, "rid bigint, ord int, vid string, title string, description string, subtitle string")
    cls = F.concat_ws("-", F.hex(F.xxhash64(*FIELDS)), F.hex(F.hash("subtitle", "title", "description")))
    return rows.withColumn("cls", F.when(F.concat(*FIELDS) != "", cls))


def _embedded(reps: DataFrame) -> DataFrame:
    """reps (cls, fields) with v, the vector in 8-bit numbers."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors([" ".join(t).split() for t in zip(*(b.column(c).to_pylist() for c in FIELDS))])
            v = np.rint(x * (127 / np.maximum(np.abs(x).max(1, initial=1e-9), 1e-9))[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in v], pa.binary())], names=[*b.schema.names, "v"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    return reps.mapInArrow(embed, f"{kinds}, v binary")


def _units(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.int8).reshape(-1, DIM).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]


# --- Cells ---------------------------------------------------------------------------------------------------
def centroids(entries: DataFrame, n: int, seed: int = 7) -> np.ndarray:
    """A centroid for each SEGMENT of n entries (cls, v), by k-means on a sample of at most SAMPLE vectors; one zero vector, if
    one cell will do."""
    cells = min(-(-n // SEGMENT), SAMPLE // FIT)
    if cells <= 1:
        return np.zeros((1, DIM), np.float32)
    rows = entries.select("v", F.xxhash64("cls").alias("h")).orderBy("h").limit(cells * FIT).collect()  # at most SAMPLE rows
    x = _units([r["v"] for r in rows])
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(6):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        held = np.linalg.norm(total, axis=1) > 1e-6
        c[held] = total[held] / np.linalg.norm(total[held], axis=1)[:, None]
    return c


def _near_cells(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each vector, best first."""
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k]


@dataclass
class Cells:
    """Graphs of one or more shards: for each shard its centroids and the number of slices of each cell (0: empty)."""

    shards: dict[str, tuple[np.ndarray, np.ndarray]]
    #: For shards over blocks of batches: which a query of a batch reads. None: all.
    base: int | None = None

    def read_by(self, ord_: int) -> list[str]:
        if self.base is None:
            return list(self.shards)
        t = ord_ - self.base
        return [name for j in range(t.bit_length()) if t >> j & 1 and (name := f"{j}:{(t >> j) - 1}") in self.shards]

    def asked(self, queries: DataFrame) -> DataFrame:
        """A row (shard, cell, slice, role, cls, v) for each graph that each query (cls, v, last) visits."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cls, last, v = (b.column(c).to_pylist() for c in ("cls", "last", "v"))
                x = _units(v)
                out: list[tuple] = []
                places: dict[int, np.ndarray] = {}  # by the centroids, which shards may share
                for n, (c, t) in enumerate(zip(cls, last)):
                    role = zlib.crc32(c.encode()) % 1009
                    for name in self.read_by(t):
                        centre, slices = self.shards[name]
                        if id(centre) not in places:
                            places[id(centre)] = _near_cells(x, centre, VISITS)
                        out += [(name, int(k), s, role, n) for k in places[id(centre)][n] for s in range(int(slices[k]))]
                at = pa.array([r[4] for r in out], pa.int64())
                cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, b.column("cls").take(at), b.column("v").take(at)], names=[*GRAPH, "role", "cls", "v"])

        return queries.select("cls", "last", "v").mapInArrow(spread, "shard string, cell int, slice int, role int, cls string, v binary")


def _placed(entries: DataFrame, centre: dict[str, np.ndarray]) -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Entries (shard, cls, rid, part, v) with their cell and slice, and the shards for ``Cells``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, shard = _units(b.column("v").to_pylist()), np.array(b.column("shard").to_pylist(), object)
            cell = np.zeros(len(x), np.int32)
            for name in set(shard):
                cell[shard == name] = _near_cells(x[shard == name], centre[name], 1)[:, 0]
            spot = [zlib.crc32(c.encode()) for c in b.column("cls").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(spot, pa.int64())], names=[*b.schema.names, "cell", "spot"])

    out = written(entries.select("shard", "cls", "rid", "part", "v").mapInArrow(place, "shard string, cls string, rid bigint, part int, v binary, cell int, spot bigint"))
    shards = {name: (c, np.zeros(len(c), np.int32)) for name, c in centre.items()}
    sizes = out.groupBy("shard", "cell").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("slices"))
    for r in sizes.collect():  # one row per cell
        shards[r["shard"]][1][r["cell"]] = r["slices"]
    # A cell of more than SEGMENT entries is cut into slices, all of which its visitors read.
    return out.join(F.broadcast(sizes), ["shard", "cell"]).withColumn("slice", (F.col("spot") % F.col("slices")).cast("int")).drop("slices", "spot"), shards


# --- Graphs --------------------------------------------------------------------------------------------------
STORED = "shard string, cell int, slice int, ids array<string>, rids array<bigint>, parts array<int>, x binary, links binary, entries binary, beam int"


def _graphs(placed: DataFrame) -> DataFrame:
    """One row (STORED) per graph."""

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        g = smallworld.build(_units(t["v"].to_pylist()))
        one = {c: t[c][:1] for c in GRAPH}
        lists = {n: pa.array([t[c].to_pylist()], pa.list_(kind)) for n, c, kind in (("ids", "cls", pa.string()), ("rids", "rid", pa.int64()), ("parts", "part", pa.int32()))}
        blobs = {"x": b"".join(t["v"].to_pylist()), "links": g.links.astype(np.int16).tobytes(), "entries": g.entries.astype(np.int16).tobytes()}
        return pa.table(one | lists | {k: pa.array([v], pa.binary()) for k, v in blobs.items()} | {"beam": pa.array([g.beam], pa.int32())})

    # Few bytes, much work: a set number of partitions, which adaptive execution does not merge.
    return placed.repartition(2 * parallelism(placed.sparkSession), *GRAPH).groupBy(*GRAPH).applyInArrow(make, STORED)


def _entries(graphs: DataFrame) -> DataFrame:
    """The entries (shard, cell, slice, cls, rid, part, v) of stored graphs."""
    zipped = F.posexplode(F.arrays_zip("ids", "rids", "parts")).alias("i", "e")
    rows = graphs.select(*GRAPH, "x", zipped)
    return rows.select(*GRAPH, F.col("e.ids").alias("cls"), F.col("e.rids").alias("rid"), F.col("e.parts").alias("part"), F.expr(f"substring(x, i * {DIM} + 1, {DIM})").alias("v"))


def _shared_out(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asked rows with a task number, and the number of tasks per graph: a graph visited by many is searched in several tasks."""
    load = asked.groupBy(*GRAPH).agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("tasks"))
    return asked.join(load, GRAPH).withColumn("task", F.col("role") % F.col("tasks")).drop("tasks"), load


FOUND = "a string, b string, rid bigint, part int, shard string, cell int, slice int, full boolean"


def _found(pairs: list[tuple], graph: pa.Table) -> pa.Table:
    kinds = (("a", pa.string()), ("b", pa.string()), ("rid", pa.int64()), ("part", pa.int32()), ("full", pa.bool_()))
    out = {name: pa.array([p[i] for p in pairs], kind) for i, (name, kind) in enumerate(kinds)}
    key = {c: pa.array([graph[c][0].as_py()] * len(pairs), kind) for c, kind in zip(GRAPH, (pa.string(), pa.int32(), pa.int32()))} if graph.num_rows else {c: pa.array([], kind) for c, kind in zip(GRAPH, (pa.string(), pa.int32(), pa.int32()))}
    return pa.table({c: (out | key)[c] for c in ("a", "b", "rid", "part", *GRAPH, "full")})


def _nearest(graphs: DataFrame, asked: DataFrame) -> DataFrame:
    """The MATCHES most similar entries of every visited graph with a cosine of NEAR; ``full`` marks lists that may end early."""

    def find(graph: pa.Table, asked: pa.Table) -> pa.Table:
        if not graph.num_rows or not asked.num_rows:
            return _found([], graph)
        ids, rids, parts = (graph[c][0].as_py() for c in ("ids", "rids", "parts"))
        x = _units([graph["x"][0].as_py()])
        links = np.frombuffer(graph["links"][0].as_py(), np.int16).reshape(-1, smallworld.MOST)
        g = smallworld.Graph(links, np.frombuffer(graph["entries"][0].as_py(), np.int16).astype(np.int64), graph["beam"][0].as_py())
        node, sim = smallworld.search(x, g, _units(asked["v"].to_pylist()), MATCHES + 1)
        ok = (node >= 0) & (sim >= NEAR)
        full = ok.all(1)
        who = asked["cls"].to_pylist()
        return _found([(who[r], ids[node[r, c]], rids[node[r, c]], parts[node[r, c]], bool(full[r])) for r, c in zip(*np.nonzero(ok)) if ids[node[r, c]] != who[r]], graph)

    parts = 2 * parallelism(graphs.sparkSession)
    on = [*GRAPH, "task"]
    asked, load = _shared_out(asked)
    copies = graphs.join(load, GRAPH).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return copies.repartition(parts, *on).groupBy(*on).cogroup(asked.repartition(parts, *on).groupBy(*on)).applyInArrow(find, FOUND)


def _page(entries: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """For each asked row (shard, cell, slice, cls, v, after, below, role) the first ``size`` entries of the graph in the order of their
    records, behind ``after`` and before ``below``, with a cosine of NEAR; ``full`` marks pages that may go on."""

    def find(known: pa.Table, asked: pa.Table) -> pa.Table:
        if not known.num_rows or not asked.num_rows:
            return _found([], known)
        known = known.sort_by([("rid", "ascending"), ("cls", "ascending")])
        x, q = _units(known["v"].to_pylist()), _units(asked["v"].to_pylist())
        ids, rids, parts, who = known["cls"].to_pylist(), known["rid"].to_numpy(), known["part"].to_pylist(), asked["cls"].to_pylist()
        after, below = asked["after"].to_numpy(), asked["below"].to_numpy()
        pages: list[list[int]] = [[] for _ in who]
        for a in range(0, len(q), 512):
            live = np.arange(a, min(a + 512, len(q)))
            for b in range(0, len(x), 1024):  # up to the block in which the last page gets full
                live = live[[len(pages[r]) < size and rids[b] < below[r] for r in live]]
                if not len(live):
                    break
                r = rids[b : b + 1024]
                near = (q[live] @ x[b : b + 1024].T >= NEAR) & (r[None, :] > after[live, None]) & (r[None, :] < below[live, None])
                for i, row in zip(live, near):
                    pages[i] += [b + int(c) for c in np.flatnonzero(row) if ids[b + c] != who[i]]
        return _found([(who[i], ids[c], int(rids[c]), parts[c], len(p) >= size) for i, p in enumerate(pages) for c in p[:size]], known)

    parts = 2 * parallelism(entries.sparkSession)
    on = [*GRAPH, "task"]
    asked, load = _shared_out(asked)
    copies = entries.join(load, GRAPH).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return copies.repartition(parts, *on).groupBy(*on).cogroup(asked.repartition(parts, *on).groupBy(*on)).applyInArrow(find, FOUND)


def _verified(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Those pairs (a, b, ...) of classes whose fields are all alike; a is looked up in ``new``, b in ``old`` (cls, fields)."""
    for side, texts in (("a", new), ("b", old)):
        pairs = pairs.join(texts.select(F.col("cls").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in FIELDS]), side)
    kept = ["a", "b", "rid"]

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[_same([r.a_title, r.a_description, r.a_subtitle], [r.b_title, r.b_description, r.b_subtitle]) for r in f.itertuples()]][kept]

    return pairs.select(*kept, *[f"{s}_{c}" for s in "ab" for c in FIELDS]).repartition(parallelism(new.sparkSession)).mapInPandas(exact, "a string, b string, rid bigint")


def _lowest(asking: DataFrame, entries: DataFrame, new: DataFrame, texts) -> DataFrame:
    """(a, b, rid): for each class a of ``asking`` (a, shard, cell, slice, below) the entry with the lowest record that is alike, if any.

    Page by page in the order of the records, each page longer than the last, until every list has one alike or ends.
    """
    size = PAGE
    asking = asking.withColumn("after", F.lit(-(1 << 62)))
    out: DataFrame | None = None
    while asking.limit(1).count():
        asked = asking.join(new.select(F.col("cls").alias("a"), "v"), "a").select(*GRAPH, (F.abs(F.xxhash64("a")) % 1009).cast("int").alias("role"), F.col("a").alias("cls"), "v", "after", "below")
        page = written(_page(entries.join(asked.select(*GRAPH).distinct(), GRAPH, "left_semi"), asked, size))
        alike_ = written(_verified(page.select("a", "b", "rid", "part"), new, texts(page)).groupBy("a").agg(F.min(F.struct("rid", "b")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.rid").alias("rid")))
        out = alike_ if out is None else out.unionByName(alike_)
        more = page.where("full").groupBy("a", *GRAPH).agg(F.max("rid").alias("after"))
        best = alike_.select("a", F.col("rid").alias("now"))
        asking = more.join(asking.select("a", *GRAPH, "below"), ["a", *GRAPH]).join(best, "a", "left").withColumn("below", F.least("below", F.coalesce("now", "below"))).where(F.col("after") < F.col("below")).drop("now")
        asking, size = written(asking), 4 * size
    if out is None:
        return new.sparkSession.createDataFrame([], "a string, b string, rid bigint")
    return out.groupBy("a").agg(F.min(F.struct("rid", "b")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.rid").alias("rid"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*").distinct()


def _decide(base: DataFrame, reach: DataFrame) -> DataFrame:
    """rid, cls, state (1 accepted, 2 refused), by (the record that refuses it) of the records that have to do with one another, given which
    classes reach which (a, b). base: rid, ord, cls, vid of the records the history has nothing against. All others are accepted."""
    by_cls = base.where("cls is not null").select("rid", "ord", F.concat(F.lit("c"), "cls").alias("own"), "cls")
    # Groups in which one record can refuse another: video ids, content classes and their near classes.
    asks = base.where("vid is not null").select("rid", F.concat(F.lit("v"), "vid").alias("grp"))
    asks = asks.unionByName(by_cls.select("rid", F.col("own").alias("grp")))
    asks = asks.unionByName(by_cls.join(reach, F.col("cls") == F.col("a")).select("rid", F.concat(F.lit("c"), "b").alias("grp")))
    owns = base.where("vid is not null").select("rid", "ord", F.concat(F.lit("v"), "vid").alias("grp")).unionByName(by_cls.select("rid", "ord", F.col("own").alias("grp")))
    # Groups with a member before the asking record's batch; all other records have no relation and are accepted.
    first = owns.groupBy("grp").agg(F.min("ord").alias("first"))
    asks = written(asks.join(first, "grp").join(base.select("rid", "ord"), "rid").where("first < ord").select("rid", "ord", "grp").distinct())
    owns = written(owns.join(asks.select("grp").distinct(), "grp", "left_semi"))
    related = asks.select("rid").unionByName(owns.select("rid")).distinct()
    state = related.join(asks.select("rid").distinct().withColumn("asks", F.lit(True)), "rid", "left")
    # 0 open, 1 accepted, 2 refused
    state = written(state.select("rid", F.when(F.col("asks"), 0).otherwise(1).alias("state"), F.lit(None).cast("bigint").alias("by")))
    while state.where("state = 0").limit(1).count():
        seen = owns.join(state, "rid")
        best = F.min(F.when(F.col("state") == 1, F.struct("ord", "rid")))
        groups = seen.groupBy("grp").agg(best["ord"].alias("acc"), best["rid"].alias("lead"), F.min(F.when(F.col("state") == 0, F.col("ord"))).alias("open"))
        asked = asks.join(state.where("state = 0").select("rid"), "rid").join(groups, "grp")
        verdict = asked.groupBy("rid").agg(F.min(F.when(F.col("acc") < F.col("ord"), F.col("lead"))).alias("lead"), F.max(F.coalesce(F.col("open") < F.col("ord"), F.lit(False))).alias("wait"))
        new = F.when(F.col("state") != 0, F.col("state")).when(F.col("wait"), 0).when(F.col("lead").isNotNull(), 2).otherwise(1)
        state = written(state.join(verdict, "rid", "left").select("rid", new.alias("state"), F.when(new == 2, F.coalesce("by", "lead")).alias("by")))
    return state.join(base.select("rid", "cls"), "rid")


# --- The index -----------------------------------------------------------------------------------------------
@dataclass
class Verdict:
    """What ``check`` found. rows: rid, ord, vid, cls, refused (boolean), by (null: skipped); reps: cls, fields, v of all new contents."""

    batches: list[int]
    rows: DataFrame
    reps: DataFrame
    skips: DataFrame

    def refused(self) -> DataFrame:
        """first_record_id (0: skipped), record_id of the records to refuse."""
        return self.rows.where("refused").select(F.coalesce("by", F.lit(0)).cast("bigint").alias("first_record_id"), F.col("rid").alias("record_id"))


KEYS, TEXTS, SKIPS = "key string, rid bigint", "cls string, title string, description string, subtitle string", "vid string, ord int"
CELLS = "shard string, cell int, slices int, centroid binary"


class Index:
    """The accepted history in a folder that all executors can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.batches, self.live = 0, [], []  # live: [shard, version, first, end] of the shards that cover the batches
        if self._there("meta"):
            row = spark.read.parquet(f"{self.path}/meta").orderBy(F.col("version").desc()).limit(1).collect()[0]
            self.version, self.batches, self.live = row["version"], json.loads(row["batches"]), json.loads(row["live"])

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str, versions: list[int] | None = None) -> DataFrame:
        """A table of the index as published; of ``versions`` only, where given."""
        if versions == [] or not self.version:
            return self.spark.createDataFrame([], schema)
        kept = F.col("version").isin(versions) if versions is not None else F.col("version") <= self.version
        return self.spark.read.schema(f"{schema}, version int").parquet(f"{self.path}/{name}").where(kept).drop("version")

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def _graphs(self) -> DataFrame:
        names = [s[0] for s in self.live]
        return self._read("shards", STORED, sorted({s[1] for s in self.live})).where(F.col("shard").isin(names))

    def _cells(self) -> Cells:
        held: dict[str, list] = {s[0]: [] for s in self.live}
        for r in self._read("cells", CELLS, sorted({s[1] for s in self.live})).collect():  # one row per cell
            if r["shard"] in held:
                held[r["shard"]].append((r["cell"], r["slices"], np.frombuffer(r["centroid"], np.float32)))
        return Cells({n: (np.stack([c[2] for c in sorted(rows, key=lambda c: c[0])]), np.array([c[1] for c in sorted(rows, key=lambda c: c[0])])) for n, rows in held.items() if rows})

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """The texts of the additions in which candidates (part) lie: one number for each addition is read to the driver."""
        return self._read("texts", TEXTS, sorted(r[0] for r in pairs.select("part").distinct().collect()))

    def check(self, records: DataFrame, committed: DataFrame) -> Verdict:
        """Which records of new batches repeat an accepted one. records: record_id, batch_id, video_id, fake_url, title,
        description, subtitle. committed: batch_id, skipped_video_ids."""
        spark = self.spark
        done = committed.where(F.col("batch_id").isNotNull()).select(F.col("batch_id").cast("bigint").alias("batch"), "skipped_video_ids")
        batches = [r[0] for r in done.select("batch").distinct().orderBy("batch").collect()]  # one row per batch
        if batches and self.batches and batches[0] <= self.batches[-1]:
            raise ValueError(f"batch {batches[0]} is not behind batch {self.batches[-1]}, the last one of the index")
        base = len(self.batches)
        orders = spark.createDataFrame([(b, base + i) for i, b in enumerate(batches)], "batch bigint, ord int")
        recs = records.select(F.col("record_id").cast("bigint").alias("rid"), F.col("batch_id").cast("bigint").alias("batch"), video_id(F.col("video_id"), F.col("fake_url")).alias("vid"), *FIELDS)
        recs = recs.where(F.col("rid").isNotNull()).join(F.broadcast(orders), "batch").dropDuplicates(["rid"])
        skips = done.join(F.broadcast(orders), "batch").select("ord", F.explode("skipped_video_ids").alias("s"))
        skips = written(skips.select(video_id(F.col("s"), F.col("s")).alias("vid"), "ord").where(F.col("vid").isNotNull()).groupBy("vid").agg(F.min("ord").alias("ord")))

        texts = written(_classes(recs))
        rows = texts.select("rid", "ord", "vid", "cls")
        # Against the keys of the history: skipped videos, video ids, contents.
        skipped = self._read("skips", SKIPS).unionByName(skips).groupBy("vid").agg(F.min("ord").alias("skip"))
        own = F.array(F.concat(F.lit("v"), "vid"), F.concat(F.lit("c"), "cls"))
        lead = rows.select("rid", F.explode(own).alias("key")).where("key is not null").join(self._read("keys", KEYS).withColumnRenamed("rid", "old"), "key").groupBy("rid").agg(F.min("old").alias("lead"))
        state = rows.join(skipped, "vid", "left").join(lead, "rid", "left")
        state = written(state.select("rid", "ord", "vid", "cls", F.coalesce(F.col("skip") < F.col("ord"), F.lit(False)).alias("skipped"), "lead"))

        # Contents that nothing speaks against yet.
        free = state.where("not skipped and lead is null")
        asking = free.where("cls is not null").groupBy("cls").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.min("rid").alias("rid"))
        fields = texts.where("cls is not null").groupBy("cls").agg(*[F.first(c).alias(c) for c in FIELDS])
        reps = written(_embedded(asking.join(fields, "cls").repartition(parallelism(spark))))
        near = self._near(reps) if self.live else None
        if near is not None:
            free = free.join(near.select(F.col("a").alias("cls")), "cls", "left_anti")
            state = state.join(near.select(F.col("a").alias("cls"), F.col("rid").alias("near")), "cls", "left").withColumn("lead", F.coalesce("lead", "near")).drop("near")
            reps = written(reps.join(near.select(F.col("a").alias("cls")), "cls", "left_anti"))
        state = state.select("rid", "ord", "vid", "cls", (F.col("skipped") | F.col("lead").isNotNull()).alias("refused"), F.when(~F.col("skipped"), F.col("lead")).alias("by"))
        if len(batches) > 1:
            inner = self._among(free.select("rid", "ord", "vid", "cls"), reps, base, len(batches)).where("state = 2").select("rid", F.col("by").alias("inner"))
            state = state.join(inner, "rid", "left").select("rid", "ord", "vid", "cls", (F.col("refused") | F.col("inner").isNotNull()).alias("refused"), F.coalesce("by", "inner").alias("by"))
        return Verdict(batches, written(state), reps, skips)

    def _near(self, reps: DataFrame) -> DataFrame:
        """(a, b, rid): new contents and the lowest accepted record of the history that is alike."""
        graphs = self._graphs()
        found = written(_nearest(graphs, self._cells().asked(reps)))
        alike_ = written(_verified(found.select("a", "b", "rid", "part"), reps, self._texts(found)).groupBy("a").agg(F.min(F.struct("rid", "b")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.rid").alias("rid")))
        full = found.where("full").select("a", *GRAPH).distinct().join(alike_.select("a", "rid"), "a", "left").select("a", *GRAPH, F.coalesce("rid", F.lit(1 << 62)).alias("below"))
        lower = _lowest(written(full), _entries(graphs), reps, self._texts)
        return written(alike_.unionByName(lower).groupBy("a").agg(F.min(F.struct("rid", "b")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.rid").alias("rid")))

    def _among(self, base: DataFrame, reps: DataFrame, start: int, n: int) -> DataFrame:
        """Verdicts among several new batches: each searches the shards of the blocks before it."""
        spark = self.spark
        levels = n.bit_length()
        # The blocks of a binary counter that get full and are read by a later batch: level j, block i holds batches i << j and on.
        blocks = [(F.shiftright(F.col("first") - start, j), j) for j in range(levels)]
        wanted = [F.when((i % 2 == 0) & ((i + 1) * (1 << j) < n), F.concat(F.lit(f"{j}:"), i.cast("string"))) for i, j in blocks]
        count = reps.count()
        centre = centroids(reps, count)
        names = {f"{j}:{i}": centre for j in range(levels) for i in range(0, (n >> j) + 1, 2) if (i + 1) << j < n}
        entries = reps.select(F.explode(F.array_compact(F.array(*wanted))).alias("shard"), "cls", "rid", F.lit(0).alias("part"), "v")
        placed, shards = _placed(entries, names)
        graphs = written(_graphs(placed))
        found = written(_nearest(graphs, Cells(shards, start).asked(reps)))
        once = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("rid")).distinct()
        reach = written(_both(_verified(once, reps, reps)))
        full = written(found.where("full").select("a", *GRAPH).distinct().withColumn("below", F.lit(1 << 62)))
        state = _decide(base, reach)
        # A family of more edited copies than a list holds: whoever has a full list, accepted or refused, asks for the lowest
        # accepted record alike to it, until that is known of all under the verdicts at hand. What a batch gets depends on
        # earlier batches only, so the verdicts are then those of deciding batch by batch.
        while full.limit(1).count():
            taken = base.where("cls is not null").join(state.where("state = 2").select("rid"), "rid", "left_anti").groupBy("cls").agg(F.min("rid").alias("rid"))
            known = written(placed.drop("rid").join(taken, "cls").join(full.select(*GRAPH).distinct(), GRAPH, "left_semi"))
            more = written(_lowest(full, known, reps, lambda _: reps).select("a", "b").join(reach, ["a", "b"], "left_anti"))
            if more.limit(1).count() == 0:
                break
            reach = written(reach.unionByName(_both(more)).distinct())
            state = _decide(base, reach)
        return written(state)

    def commit(self, verdict: Verdict) -> None:
        """Take the accepted records of a verdict into the history: a new shard, merged with those it completes a block with."""
        version, spark = self.version + 1, self.spark
        taken = verdict.rows.where("not refused")
        own = F.array(F.concat(F.lit("v"), "vid"), F.concat(F.lit("c"), "cls"))
        self._write(taken.select(F.explode(own).alias("key"), "rid").where("key is not null").groupBy("key").agg(F.min("rid").alias("rid")).sortWithinPartitions("key"), "keys", version)
        self._write(verdict.skips, "skips", version)
        leads = taken.where("cls is not null").groupBy("cls").agg(F.min(F.struct("ord", "rid")).alias("s")).select("cls", "s.*")
        fresh = written(leads.join(verdict.reps.drop("rid", "first", "last"), "cls"))
        self._write(fresh.select("cls", *FIELDS).sortWithinPartitions("cls"), "texts", version)

        total = len(self.batches) + len(verdict.batches)
        cover, at = [], 0
        for j in reversed(range(total.bit_length())):
            if total >> j & 1:
                cover.append((at, at + (1 << j)))
                at += 1 << j
        kept = [s for s in self.live if (s[2], s[3]) in cover]
        live, parts = list(kept), []
        old = _entries(self._graphs())
        for a, b in cover:
            if any((s[2], s[3]) == (a, b) for s in kept):
                continue
            name = f"{version}:{a}-{b}"
            merged = [s[0] for s in self.live if a <= s[2] and s[3] <= b]
            part = fresh.where((F.col("ord") >= a) & (F.col("ord") < b)).select("cls", "rid", F.lit(version).alias("part"), "v")
            if merged:  # vectors of the shards below; their texts stay where they are
                part = part.unionByName(old.where(F.col("shard").isin(merged)).select("cls", "rid", "part", "v"))
            parts.append((name, part))
            live.append([name, version, a, b])
        if parts:
            counts = [(name, part, part.count()) for name, part in parts]
            entries = [part.select(F.lit(name).alias("shard"), "cls", "rid", "part", "v") for name, part, _ in counts]
            for e in entries[1:]:
                entries[0] = entries[0].unionByName(e)
            placed, shards = _placed(entries[0], {name: centroids(part, n) for name, part, n in counts})
            self._write(_graphs(placed), "shards", version)
            rows = [(name, i, int(slices[i]), c[i].astype(np.float32).tobytes()) for name, (c, slices) in shards.items() for i in range(len(c))]
            self._write(spark.createDataFrame(rows, CELLS), "cells", version)
        batches = [*self.batches, *verdict.batches]
        # Published by its row: until then the folders above count for nothing.
        self._write(spark.createDataFrame([(json.dumps(batches), json.dumps(live))], "batches string, live string").coalesce(1), "meta", version)
        self.version, self.batches, self.live = version, batches, live

    def add(self, records: DataFrame, committed: DataFrame) -> DataFrame:
        """``check`` and ``commit``: first_record_id, record_id of the records refused."""
        verdict = self.check(records, committed)
        self.commit(verdict)
        return verdict.refused()

    def vacuum(self) -> None:
        """Delete shards that are no part of the published state (merged ones, and those of additions cut off)."""
        used = {s[1] for s in self.live}
        for name in ("shards", "cells"):
            for v in range(1, self.version + 1):
                if v not in used and self._there(f"{name}/version={v}"):
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/version={v}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def refused(records: DataFrame, committed: DataFrame) -> DataFrame:
    """first_record_id, record_id of the records to refuse, of a whole history: its first batch opens an index, the others are
    checked against it."""
    spark = records.sparkSession
    index = Index(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    first = committed.agg(F.min("batch_id")).collect()[0][0]
    if first is None:
        return spark.createDataFrame([], "first_record_id bigint, record_id bigint")
    opened = index.add(records.where(F.col("batch_id") == first), committed.where(F.col("batch_id") == first))
    return opened.unionByName(index.check(records.where(F.col("batch_id") > first), committed.where(F.col("batch_id") > first)).refused())
