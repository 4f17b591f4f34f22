"""Same or near-same records across splits, by content-defined chunks.

Records are normalised and cut where a rolling hash of the last WINDOW characters says so, so that chunks
realign behind any edit and survive a change of clause order. Records of different splits with the same key (here: the
normalised answer) that share chunk digests are joined. A chunk weighs its length times the logarithm of its rarity in the corpus;
the weight of the shared chunks over the mean weight of both records is the overlap fraction of the pair.

A pair of at least ``fraction`` is the same unless a slot differs: the words of one that have no partner in the other within a typo
are its rest, and words that stand in a large share of all records are left out of it, as they are the frame. If both sides keep a rest, something
was put in place of something else: another title, place or thing. If only one does, something was added, such as a way of asking. Which
words are such additions is learned from the pairs at hand: a word that is more often the rest of one side alone
than of both is wording, and pairs that differ by wording only on one of their sides are the same too.

The join is prefix-filtered: a record posts its rarest chunks only, as many as any partner at the fraction must
hit, in the order of how often a chunk occurs with the record's key. Counts come from 2**16 hash buckets: at any size of the corpus they tell apart
what occurs in more than about one of 5,000 records. Exact copies (same normal form, same key) are joined as one.

Defined results: records with a null or wordless text or a null key take no part; repeated rows of one id count
once; all ties are kept; an empty table gives no rows; other columns are ignored whatever their names. Jobs run while the plan is built.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.common import written
from sparkloom.llm.normalise import answer_key, within, words

WINDOW, DIVISOR, BUCKETS = 3, 8, 1 << 16
#: Least share of the records that hold a word of the frame.
FRAME = 0.05


def chunk_ends(texts: list[str]) -> list[np.ndarray]:
    """Ends of the content-defined chunks of each text (the last is its length)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        roll = h.copy()
        for i in range(1, WINDOW):
            roll[i:] += h[:-i] * np.uint64(0xBF58476D1CE4E5B9 ** i % (1 << 64)) if len(h) > i else np.uint64(0)
        cut = ((roll ^ (roll >> np.uint64(29))) >> np.uint64(7)) % np.uint64(DIVISOR) == 0
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        ends = np.flatnonzero(cut[a:b]) + 1
        ends = ends[ends >= WINDOW]
        out.append(ends if len(ends) and ends[-1] == b - a else np.append(ends, b - a))
    return out


def chunks(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(digest, length) of the chunks of each text, repeats kept."""
    out = []
    for t, ends in zip(texts, chunk_ends(texts)):
        a, own = 0, []
        for b in ends.tolist():
            if b > a:
                own.append((xxhash.xxh3_64_intdigest(t[a:b]) - (1 << 63), b - a))
            a = b
        out.append(own)
    return out


class Rarity:
    """Counts of chunks, and of chunks with a key, in hash buckets."""

    def __init__(self, chunks_: np.ndarray, keyed: np.ndarray, records: int):
        self.weight = np.log((records + 1) / np.maximum(chunks_, 1)).clip(0.01)
        self.keyed = keyed

    def weights(self, own: list[tuple[int, int]]) -> Counter:
        """The weight of each distinct digest of a record, repeats added up."""
        out: Counter = Counter()
        for d, n in own:
            out[d] += n * float(self.weight[d % BUCKETS])
        return out


def overlap(a: list[tuple[int, int]], b: list[tuple[int, int]], rarity: Rarity) -> float:
    """Weight of the shared chunks over the mean weight."""
    p, q = rarity.weights(a), rarity.weights(b)
    total = sum(p.values()) + sum(q.values())
    return 2 * sum(min(w, q[d]) for d, w in p.items() if d in q) / total if total else 0.0


def prefix(own: list[tuple[int, int]], key: str, rarity: Rarity, fraction: float) -> tuple[dict[int, float], float, float]:
    """The digests a record posts with their weights, the weight of the rest, and of all: the digests that are rarest with its
    key, until what remains is too light to reach the fraction alone."""
    size = rarity.weights(own)
    total = rest = sum(size.values())
    need, out = total * fraction / (2 - fraction), {}
    for d, w in sorted(size.items(), key=lambda x: (rarity.keyed[keyed(key, x[0])], x[0])):
        if rest < need - 1e-9:
            break
        out[d] = w
        rest -= w
    return out, max(rest, 0.0), total


def keyed(key: str, digest: int) -> int:
    """The bucket of a chunk with a key."""
    return xxhash.xxh3_64_intdigest(f"{key}\x00{digest}") % BUCKETS


def rests(a: str, b: str, frame: frozenset[str]) -> tuple[list[str], list[str]]:
    """The words of each text without a partner in the other, the frame left out. A partner may differ by a typo; a single word on either side
    by two, or by a typo on a space."""
    x, y = Counter(a.split()), Counter(b.split())
    p, q = list((x - y).elements()), list((y - x).elements())
    for w in list(p):
        if w.isdigit() or len(w) < 3:
            continue
        # Of three letters only a swap or a doubling counts as a typo.
        hit = next((v for v in q if not v.isdigit() and within(w, v, 1) and (len(w) > 3 or set(w) == set(v))), None)
        if hit is not None:
            p.remove(w)
            q.remove(hit)
    if 1 <= len(p) <= 3 and 1 <= len(q) <= 3 and not any(w.isdigit() for w in p + q):
        u, v = "".join(w for w in a.split() if w in p), "".join(w for w in b.split() if w in q)
        if within(u, v, 1) or (len(p) == len(q) == 1 and min(len(u), len(v)) > 5 and within(u, v, 2)):
            return [], []
    return [w for w in p if w not in frame], [w for w in q if w not in frame]


def _classes(df: DataFrame, key: str, side: str, text: str, answer: str) -> DataFrame:
    """id, side, t (normal form), a (key) of the records that take part."""
    raw = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{side}`").cast("boolean").alias("side"), F.col(f"`{text}`").alias("t"), F.col(f"`{answer}`").alias("a")).dropna()

    def normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "side": f["side"], "t": [" ".join(words(x)) for x in f["t"]], "a": [answer_key(x) for x in f["a"]]})

    return written(raw.mapInPandas(normal, "id bigint, side boolean, t string, a string").where("t <> ''"))


def _rarity(reps: DataFrame) -> Rarity:
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(2 * BUCKETS, np.int64), 0
        for f in frames:
            n += len(f)
            for a, own in zip(f["a"], chunks(f["t"].tolist())):
                for d in {d for d, _ in own}:
                    total[d % BUCKETS] += 1
                    total[BUCKETS + keyed(a, d)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    counts, records = np.zeros(2 * BUCKETS, np.int64), 0
    for r in reps.mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 * BUCKETS + 1 rows
        if r["bucket"] < 0:
            records = r["n"]
        else:
            counts[r["bucket"]] = r["n"]
    return Rarity(counts[:BUCKETS], counts[BUCKETS:], records)


def class_pairs(df: DataFrame, key: str, side: str, text: str, answer: str, fraction: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of exact copies (l, r, overlap), and the members (side, rep, id) of the classes; l and r are reps, the lowest ids."""
    spark = df.sparkSession
    rows = _classes(df, key, side, text, answer)
    # One record per copy class and side.
    reps = written(rows.groupBy("side", "t", "a").agg(F.min("id").alias("rep")))
    rarity = spark.sparkContext.broadcast(_rarity(reps))
    # Words that stand in FRAME of all records: no more than the words of a mean record over FRAME.
    held = reps.select(F.explode(F.array_distinct(F.split("t", " "))).alias("w")).groupBy("w").count()
    frame = frozenset(r["w"] for r in held.crossJoin(F.broadcast(reps.agg(F.count("*").alias("n")))).where(F.col("count") >= FRAME * F.col("n")).collect())  # n is one row

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r, a, own in zip(f["rep"], f["a"], chunks(f["t"].tolist())):
                posts, rest, total = prefix(own, a, rarity.value, fraction)
                out += [(r, a, d, w, rest, total) for d, w in posts.items()]
            yield pd.DataFrame(out, columns=["rep", "a", "digest", "w", "rest", "total"])

    def posted(which: DataFrame, side_: str) -> DataFrame:
        p = which.mapInPandas(post, "rep bigint, a string, digest bigint, w double, rest double, total double")
        return p.select(F.xxhash64("a", "digest").alias("k"), F.col("rep").alias(side_), *[F.col(c).alias(f"{side_}_{c}") for c in ("w", "rest", "total")])

    left, right = reps.where("side"), reps.where("not side")
    pairs = posted(left, "l").join(posted(right, "r"), "k").groupBy("l", "r")
    # Of the two, take the record whose posts end first in the common order: chunks shared before that end are posts of
    # both, chunks shared behind it lie in its rest. Pairs that cannot reach the fraction so are not read.
    shared = F.sum(F.least("l_w", "r_w")) + F.greatest(F.first("l_rest"), F.first("r_rest"))
    pairs = pairs.agg(shared.alias("most"), (F.first("l_total") + F.first("r_total")).alias("both")).where(2 * F.col("most") >= fraction * F.col("both") - 1e-6).select("l", "r")
    pairs = pairs.join(right.select(F.col("rep").alias("r"), F.col("t").alias("rt"), F.col("a").alias("ra")), "r")
    pairs = pairs.join(left.select(F.col("rep").alias("l"), F.col("t").alias("lt"), F.col("a").alias("la")), "l").where("la = ra")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lt, rt = f["lt"].tolist(), f["rt"].tolist()
            x = [overlap(p, q, rarity.value) for p, q in zip(chunks(lt), chunks(rt))]
            out = [(i, j, v, *rests(p, q, frame)) for i, j, v, p, q in zip(f["l"], f["r"], x, lt, rt) if v >= fraction]
            yield pd.DataFrame(out, columns=["l", "r", "overlap", "lw", "rw"])

    near = written(pairs.select("l", "r", "lt", "rt").mapInPandas(verify, "l bigint, r bigint, overlap double, lw array<string>, rw array<string>"))
    return _decided(near), reps.join(rows, ["side", "t", "a"]).select("side", "rep", "id").distinct()


def _decided(near: DataFrame) -> DataFrame:
    """Those pairs (l, r, overlap) of which at most one side keeps a rest other than wording."""
    one = (F.size("lw") == 0) | (F.size("rw") == 0)
    used = near.select(one.alias("one"), F.explode(F.array_union("lw", "rw")).alias("w"))
    wording = used.groupBy("w").agg(F.count_if("one").alias("alone"), F.count_if(~F.col("one")).alias("both")).where("alone > both").select("w", F.lit(True).alias("wording"))
    open_ = near.where(~one)
    parts = open_.select("l", "r", F.explode(F.concat(F.transform("lw", lambda w: F.struct(F.lit(True).alias("left"), w.alias("w"))), F.transform("rw", lambda w: F.struct(F.lit(False).alias("left"), w.alias("w"))))).alias("e")).select("l", "r", "e.*")
    rest = parts.join(wording, "w", "left").groupBy("l", "r").agg(F.count_if(F.col("left") & F.col("wording").isNull()).alias("in_l"), F.count_if(~F.col("left") & F.col("wording").isNull()).alias("in_r"))
    more = open_.join(rest.where("in_l = 0 or in_r = 0").select("l", "r"), ["l", "r"])
    return written(near.where(one).unionByName(more).select("l", "r", "overlap"))


def cross_split_pairs(df: DataFrame, key: str, side: str, text: str, answer: str, fraction: float) -> DataFrame:
    """Pairs (left_id, right_id, overlap): left where ``side`` is true, right where it is false, of equal answers,
    with an overlap of at least ``fraction``, that differ in no slot."""
    found, members = class_pairs(df, key, side, text, answer, fraction)
    out = found.join(members.where("side").select(F.col("rep").alias("l"), F.col("id").alias("left_id")), "l")
    out = out.join(members.where("not side").select(F.col("rep").alias("r"), F.col("id").alias("right_id")), "r")
    return out.select("left_id", "right_id", "overlap")


def cross_split_counts(df: DataFrame, key: str, side: str, text: str, answer: str, fraction: float) -> DataFrame:
    """right_id and the number of its partners, from the sizes of the classes: copies are not put into pairs."""
    found, members = class_pairs(df, key, side, text, answer, fraction)
    sizes = members.where("side").groupBy(F.col("rep").alias("l")).agg(F.count("*").alias("n"))
    per = found.join(sizes, "l").groupBy("r").agg(F.sum("n").alias("partners"))
    return members.where("not side").select(F.col("rep").alias("r"), F.col("id").alias("right_id")).join(per, "r").select("right_id", "partners")
