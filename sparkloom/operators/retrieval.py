"""Lexical, dense and fused retrieval.

Queries are a stated set: frames of (q, ...). Null or tokenless documents and queries match nothing; vectors that are
null or of another dimension take no part; ties go to the lower document id; empty sides give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.draws import chosen, uniform
from sparkloom.functions.text import tokens
from sparkloom.functions.vectors import unit_vectors

K1, B = 1.5, 0.75
#: Queries shipped to the executors at a time by the dense search; more are searched in further passes.
QUERY_BLOCK = 8192


def postings(docs: DataFrame, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(token, doc, tf, dl) and one row (n, avgdl). Counting is combined before the shuffle."""
    t = docs.select(F.col(key).alias("doc"), tokens(text).alias("t")).where(F.size("t") > 0).withColumn("dl", F.size("t"))
    tf = t.select("doc", "dl", F.explode("t").alias("token")).groupBy("token", "doc", "dl").agg(F.count("*").alias("tf"))
    return tf, t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, key: str, text: Column, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """q, doc, score, rank of the k best documents of each query (q, text)."""
    tf, stats = postings(docs, key, text)
    asked = queries.select("q", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    tf = tf.join(asked.select("token").distinct(), "token", "left_semi")  # postings of other words are not needed
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    part = tf.join(df, "token").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = part.select("token", "doc", weight.alias("w")).join(asked, "token").groupBy("q", "doc").agg(F.sum("w").alias("score"))
    return top(scored, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query with rank from 1; scores are cut to 9 decimals so that equal ones tie."""
    s = F.round("score", 9)
    w = Window.partitionBy("q").orderBy(s.desc(), "doc")
    return scored.withColumn("score", s).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """q, doc, score, rank by exact inner product of unit vectors. queries: (q, vector). Vectors are scanned once per
    block of queries; every partition keeps the k best of each query, so only those are shuffled."""
    src = vectors.select(F.col(key).cast("bigint").alias("doc"), F.col(vector).cast("array<float>").alias("v"))
    asked = queries.select(F.col("q").cast("bigint").alias("q"), F.col("vector").cast("array<float>").alias("v")).where(F.size("v") == dim)
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()
        ok, x = unit_vectors(part["v"], dim)
        ids = part["q"].to_numpy()[ok]
        found = src.where(F.size("v") == dim).mapInArrow(_scan(ids, x, k, dim), "q bigint, doc bigint, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def _scan(ids: np.ndarray, x: np.ndarray, k: int, dim: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_d = np.full((len(ids), 0), -2.0, np.float32), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            ok, v = unit_vectors(b.column("v"), dim)
            if not len(v) or not len(ids):
                continue
            doc = b.column("doc").to_numpy()[ok]
            wide = min(k, best_s.shape[1] + len(doc))
            new_s, new_d = np.empty((len(ids), wide), np.float32), np.empty((len(ids), wide), np.int64)
            for a in range(0, len(ids), 512):  # scores of 512 queries at a time
                s = np.concatenate([best_s[a : a + 512], x[a : a + 512] @ v.T], 1)
                d = np.concatenate([best_d[a : a + 512], np.broadcast_to(doc, (len(s), len(doc)))], 1)
                keep = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                new_s[a : a + 512], new_d[a : a + 512] = np.take_along_axis(s, keep, 1), np.take_along_axis(d, keep, 1)
            best_s, best_d = new_s, new_d
        m = best_s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m), pa.int64()), pa.array(best_d.ravel(), pa.int64()), pa.array(best_s.ravel().astype(float), pa.float64())], names=["q", "doc", "score"])

    return scan


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (q, doc, rank): q, doc, score; ties keep the order first seen."""
    if k < 1:
        raise ValueError("k must be at least 1")
    all_ = None
    for i, x in enumerate(lists):
        x = x.select("q", "doc", "rank", F.lit(i).alias("src"))
        all_ = x if all_ is None else all_.unionByName(x)
    return all_.groupBy("q", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("src", "rank")).alias("seen"))


def fused_top(fused: DataFrame, k: int) -> DataFrame:
    s = F.round("score", 12)
    w = Window.partitionBy("q").orderBy(s.desc(), "seen")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "doc", "score", "rank")


#: Tiers of the perturbation of search results, and how often each is drawn.
TIERS = {
    "easy": {"gold_actions": {"keep": 1.0}, "n_hard_neg": (0, 0), "p_title_jitter": 0.0, "p_snippet_jitter": 0.0, "p_empty": 0.0, "k_jitter": (0, 0)},
    "medium": {"gold_actions": {"keep": 0.50, "sink_mid": 0.35, "sink_bottom": 0.13, "drop": 0.02}, "n_hard_neg": (2, 4), "p_title_jitter": 0.4, "p_snippet_jitter": 0.4, "p_empty": 0.01, "k_jitter": (-1, 2)},
    "hard": {"gold_actions": {"keep": 0.25, "sink_mid": 0.30, "sink_bottom": 0.33, "drop": 0.12}, "n_hard_neg": (4, 8), "p_title_jitter": 0.8, "p_snippet_jitter": 0.8, "p_empty": 0.03, "k_jitter": (-2, 3)},
}
TIER_PROBS = {"easy": 0.55, "medium": 0.35, "hard": 0.10}
# What is put before a title, and behind it.
PREFIXES = ["MUST WATCH: ", "You won't believe ", "[VIRAL] ", "SHOCKING - ", "Top 10 ", "(2024) ", "*NEW* ", "INSANE!! "]
SUFFIXES = [" !!", " ??", " \U0001f525", " | FULL VIDEO"]


def _one_of(u: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def _between(u: Column, low: Column | int, high: Column | int) -> Column:
    """A whole number from low to high, both included."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def mangled_title(title: Column, *keys: Column | str | int) -> Column:
    """A title in another dress: prefixed, in capitals, cut, or with an exclamation; which, by draws over the keys."""
    u = lambda what: uniform(*keys, F.lit(what))
    cut = F.greatest(F.lit(8), F.floor(F.length(title) * (0.4 + 0.4 * u("title cut"))).cast("int"))
    dressed = [F.concat(_one_of(u("title prefix"), PREFIXES), title), F.upper(title), F.concat(F.rtrim(F.substring(title, F.lit(1), cut)), F.lit("...")), F.concat(F.regexp_replace(title, r"\.+$", ""), _one_of(u("title suffix"), SUFFIXES))]
    at = F.floor(u("title how") * 4)
    return F.when(F.coalesce(title, F.lit("")) == "", title).when(at == 0, dressed[0]).when(at == 1, dressed[1]).when(at == 2, dressed[2]).otherwise(dressed[3])


def mangled_snippet(snippet: Column, *keys: Column | str | int) -> Column:
    """A snippet cut to a share of it, in small letters, or cut to a few words."""
    u = lambda what: uniform(*keys, F.lit(what))
    cut = F.greatest(F.lit(10), F.floor(F.length(snippet) * (0.3 + 0.4 * u("snippet cut"))).cast("int"))
    short = lambda n: F.concat(F.rtrim(F.substring(snippet, F.lit(1), n)), F.lit("..."))
    at = F.floor(u("snippet how") * 3)
    return F.when(F.coalesce(snippet, F.lit("")) == "", snippet).when(at == 0, short(cut)).when(at == 1, F.lower(snippet)).otherwise(short(_between(u("snippet few"), 15, 40)))


def perturbation_draws(queries: DataFrame, pool: Column | int, k: int, seed: int = 0, tiers: dict = TIERS, probs: dict[str, float] = TIER_PROBS) -> DataFrame:
    """queries (q, ...) with what is drawn for each: tier, empty, k (1 to the pool's size), action (for gold), n_hard."""
    u = lambda what: uniform("q", seed, F.lit(what))
    t = queries.withColumn("tier", chosen(u("tier"), probs))

    def of(pick) -> Column:
        out = None
        for name, tier in tiers.items():
            v = pick(tier)
            v = v if isinstance(v, Column) else F.lit(v)
            out = F.when(F.col("tier") == name, v) if out is None else out.when(F.col("tier") == name, v)
        return out

    pool = pool if isinstance(pool, Column) else F.lit(pool)
    size = F.lit(k) + of(lambda c: _between(u("k"), *c["k_jitter"]))
    return t.select("*", (u("empty") < of(lambda c: float(c["p_empty"]))).alias("empty"), F.greatest(F.lit(1), F.least(size, pool)).cast("int").alias("k"), of(lambda c: chosen(u("gold"), c["gold_actions"])).alias("action"), of(lambda c: _between(u("hard"), *c["n_hard_neg"])).alias("n_hard"))


def perturb(hits: DataFrame, gold: DataFrame, k: int, seed: int = 0, tiers: dict = TIERS, probs: dict[str, float] = TIER_PROBS) -> tuple[DataFrame, DataFrame]:
    """Perturbed result lists and their metrics. hits: q, rank, url, title, snippet; gold: q, url.

    Lists (q, url, title, snippet, rank, gold): for each query a tier is drawn, and by it an empty result, the length, what becomes of
    the gold hits (kept on top, sunk, dropped, a place more or less), how many results from behind the first screen are put into its first
    half, and whose texts are dressed up. Rows come from the hits only, no url twice. Metrics (q, tier, k, action, empty, injected,
    displayed, gold_ranks, from 0). A list is a screen's pool, so it is ordered in one task; queries are spread.
    """
    own = lambda what: uniform("q", "url", seed, F.lit(what))
    queries = hits.groupBy("q").agg(F.count("*").cast("int").alias("pool"))
    drawn_ = perturbation_draws(queries, F.col("pool"), k, seed, tiers, probs)
    known = gold.select("q", "url").distinct().withColumn("gold", F.lit(True))
    t = hits.join(known, ["q", "url"], "left").withColumn("gold", F.coalesce("gold", F.lit(False))).join(drawn_, "q").where("not empty")
    by_q = Window.partitionBy("q", "gold").orderBy("rank")
    t = t.withColumn("n", F.row_number().over(by_q) - 1)  # place among the gold hits, or among the others
    tail = ~F.col("gold") & (F.col("n") >= F.col("k"))
    t = t.withColumn("lot", F.when(tail, F.row_number().over(Window.partitionBy("q", tail).orderBy(own("lot"), "rank"))))
    injected = F.col("lot") <= F.col("n_hard")
    t = t.where(F.when(F.col("gold"), F.col("action") != "drop").otherwise(F.coalesce(injected, F.lit(False)) | (F.col("n") < F.col("k"))))
    # What fills the screen: first hits at their place, injected ones before a place of the first half.
    fill = F.when(F.coalesce(injected, F.lit(False)), _between(own("place"), F.lit(0), F.floor(F.col("k") / 2)) - 0.5).otherwise(F.col("n").cast("double"))
    t = t.withColumn("at", F.row_number().over(Window.partitionBy("q", "gold").orderBy(fill, "rank")) - 1).where(F.col("gold") | (F.col("at") < F.col("k")))
    top = F.when(F.col("action") == "sink_mid", F.greatest(F.lit(1), F.floor(F.col("k") / 2))).when(F.col("action") == "sink_bottom", F.greatest(F.lit(0), F.col("k") - 1)).otherwise(0)
    target = F.greatest(F.lit(0), top + F.col("n") + _between(own("noise"), -1, 1))
    t = t.withColumn("at", F.when(F.col("gold"), target - 0.5).otherwise(F.col("at").cast("double")))
    first = F.row_number().over(Window.partitionBy("q", "url").orderBy("at", "rank"))
    t = t.withColumn("first", first).where("first = 1")
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("at", "rank"))).where(F.col("place") <= F.col("k"))

    def often(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("tier") == n, F.lit(float(c[name]))) for n, c in tiers.items()])

    title = F.when(own("title") < often("p_title_jitter"), mangled_title(F.col("title"), "q", "url", seed)).otherwise(F.col("title"))
    snippet = F.when(own("snippet") < often("p_snippet_jitter"), mangled_snippet(F.col("snippet"), "q", "url", seed)).otherwise(F.col("snippet"))
    lists = t.select("q", "url", title.alias("title"), snippet.alias("snippet"), F.col("place").alias("rank"), "gold", F.coalesce(injected, F.lit(False)).alias("injected"))
    shown = lists.groupBy("q").agg(F.count("*").alias("displayed"), F.count_if("injected").alias("injected"), F.sort_array(F.collect_list(F.when(F.col("gold"), F.col("rank") - 1))).alias("gold_ranks"))
    none = F.array().cast("array<int>")
    metrics = drawn_.join(shown, "q", "left").select("q", "tier", "k", "action", "empty", F.coalesce("injected", F.lit(0)).alias("injected"), F.coalesce("displayed", F.lit(0)).alias("displayed"), F.coalesce("gold_ranks", none).alias("gold_ranks"))
    return lists.drop("injected"), metrics


def result_text(snippet: Column, limit: int = 400) -> Column:
    """A snippet for a result list: whole, or its first ``limit`` characters and a mark that it was cut."""
    return F.when(F.length(snippet) > limit, F.concat(F.substring(snippet, 1, limit), F.lit("... [truncated]"))).otherwise(snippet)
