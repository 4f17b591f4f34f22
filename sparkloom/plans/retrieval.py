"""Retrieval queries. Asked are the videos and vectors whose id is divisible by 100, against all."""

from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.functions.text import document_text, snippet, thumbnail
from sparkloom.operators import retrieval as R
from sparkloom.plans.base import Book, rnd, uniform

q = Book()
_BODY = "concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(subtitle, ''), nullif(array_to_string(tags, ' '), ''))"
_BM25 = f"""t AS (SELECT video_idx AS doc, regexp_extract_all(lower({_BODY}), '[A-Za-z0-9]+') AS t FROM videos), d AS (SELECT doc, t, len(t) AS dl FROM t WHERE len(t) > 0), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
 tf AS (SELECT token, doc, dl, count(*) AS tf FROM (SELECT doc, dl, unnest(t) AS token FROM d) GROUP BY 1, 2, 3), dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
 ask AS (SELECT DISTINCT video_idx AS q, unnest(regexp_extract_all(lower(title), '[A-Za-z0-9]+')) AS token FROM videos WHERE video_idx % 100 = 0),
 sc AS (SELECT q, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN dfs USING (token) JOIN ask USING (token), s GROUP BY q, doc),
 lex AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM sc)"""
_DENSE = """u AS (SELECT vec_id AS doc, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), n AS (SELECT doc, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u),
 ds AS (SELECT a.doc AS q, b.doc AS doc, list_dot_product(a.e, b.e) AS score FROM n a, n b WHERE a.doc % 100 = 0), den AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM ds)"""


def _asked(spark, d):
    return table(spark, d, "videos").where("video_idx % 100 = 0").select(F.col("video_idx").alias("q"), F.col("title").alias("text"))


def _body():
    return document_text(F.col("title"), F.col("description"), F.col("subtitle"), F.array_join("tags", " "))


def _lexical(spark, d, k):
    return R.bm25(table(spark, d, "videos"), "video_idx", _body(), _asked(spark, d), k)


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    return R.dense(e, "vec_id", "embedding", e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")), k)


q("search_bm25", f"WITH {_BM25} SELECT q, doc, rnd(score, 5) AS score FROM lex WHERE rank <= 10")(lambda s, d: _lexical(s, d, 10).select("q", "doc", rnd("score", 5).alias("score")))
q("search_postings", f"WITH {_BM25} SELECT token, doc, tf, dl FROM tf")(lambda s, d: R.postings(table(s, d, "videos"), "video_idx", _body())[0].select("token", "doc", "tf", F.col("dl").cast("bigint").alias("dl")))
q("search_dense", f"WITH {_DENSE} SELECT q, doc, rnd(score, 3) AS score FROM den WHERE rank <= 10")(lambda s, d: _dense(s, d, 10).select("q", "doc", rnd("score", 3).alias("score")))


q("search_rank_fusion", f"""WITH {_BM25}, title AS (SELECT video_idx AS q, video_idx AS doc, 1 AS rank FROM videos WHERE video_idx % 100 = 0), al AS (SELECT q, doc, rank, 0 AS src FROM lex WHERE rank <= 100 UNION ALL SELECT q, doc, rank, 1 FROM title),
 f AS (SELECT q, doc, round(sum(1.0 / (60 + rank)), 12) AS score, min((src, rank)) AS seen FROM al GROUP BY q, doc), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen) AS rank FROM f) SELECT q, doc, rnd(score, 8) AS score, CAST(rank AS INT) AS rank FROM o WHERE rank <= 50""")(
    lambda s, d: R.fused_top(R.fuse([_lexical(s, d, 100), _asked(s, d).select("q", F.col("q").alias("doc"), F.lit(1).alias("rank"))]), 50).select("q", "doc", rnd("score", 8).alias("score"), "rank")
)


@q("hybrid_search")
def hybrid_search(spark, d):
    """Lexical and dense lists of each asked video, fused, with title, snippet, duration and thumbnail."""
    videos, meta, vec = table(spark, d, "videos"), table(spark, d, "keyframe_meta"), table(spark, d, "keyframe_vectors")
    first = meta.where("video_idx % 100 = 0").groupBy(F.col("video_idx").alias("q")).agg(F.min("vector_row").alias("vector_row"))
    asked = first.join(vec.select("vector_row", F.col("embedding").alias("vector")), "vector_row").select("q", "vector")
    near = R.dense(vec, "vector_row", "embedding", asked, 300)
    by_video = near.join(meta.select(F.col("vector_row").alias("doc"), "video_idx").distinct(), "doc").groupBy("q", F.col("video_idx").alias("doc")).agg(F.max("score").alias("score"))
    fused = R.fused_top(R.fuse([_lexical(spark, d, 100), R.top(by_video, 100)]), 10)
    hits = fused.join(videos.select(F.col("video_idx").alias("doc"), "title", "description", "subtitle", "duration", "video_id"), "doc")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Untitled ("), "video_id", F.lit(")")))
    text = snippet([F.col("description"), F.col("subtitle"), F.col("title")], F.array().cast("array<string>"))
    return hits.select("q", "doc", "rank", "score", title.alias("title"), F.when(F.length(text) > 512, F.concat(F.substring(text, 1, 509), F.lit("..."))).otherwise(text).alias("snippet"), "duration", thumbnail(F.col("video_id")).alias("thumbnail"))


q("search_hit_projection", "SELECT video_idx, coalesce(nullif(title, ''), concat('Untitled (', video_id, ')')) AS title, CASE WHEN duration <= 0 THEN NULL ELSE duration END AS duration, right(fake_url, 11) AS id FROM videos")(
    lambda s, d: table(s, d, "videos").select("video_idx", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Untitled ("), "video_id", F.lit(")"))).alias("title"), F.when(F.col("duration") <= 0, None).otherwise(F.col("duration")).alias("duration"), F.right("fake_url", F.lit(11)).alias("id"))
)
q("search_request_check", "SELECT o_orderkey, CAST(greatest(least(o_custkey % 90 - 10, 50), 1) AS BIGINT) AS topk FROM orders WHERE length(o_orderpriority) BETWEEN 1 AND 2048")(
    lambda s, d: table(s, d, "orders").where(F.length("o_orderpriority").between(1, 2048)).select("o_orderkey", F.greatest(F.least(F.col("o_custkey") % 90 - 10, F.lit(50)), F.lit(1)).alias("topk"))
)
q("search_duration_filter", "WITH k AS (SELECT video_idx, duration FROM videos WHERE duration IS NULL OR duration <= 0 OR duration BETWEEN 60 AND 600) SELECT video_idx FROM k UNION ALL SELECT video_idx FROM videos WHERE NOT EXISTS (SELECT 1 FROM k)")(
    lambda s, d: _duration_filter(table(s, d, "videos"), 60, 600).select("video_idx")
)


def _duration_filter(df, low, high):
    """Rows of fitting or unknown duration; all rows if none fits."""
    on = F.col("duration").isNull() | (F.col("duration") <= 0) | F.col("duration").between(low, high)
    some = df.agg(F.count_if(on).alias("__n"))
    return df.crossJoin(F.broadcast(some)).where(on | (F.col("__n") == 0)).drop("__n")


q("search_passages_block", f"WITH {_BM25}, h AS (SELECT q, rank, title FROM lex JOIN videos ON video_idx = doc WHERE rank <= 3) SELECT q, string_agg(concat('Doc ', CAST(rank AS VARCHAR), '(Title: ', title, ')'), chr(10) || '---' || chr(10) ORDER BY rank) AS block FROM h GROUP BY q")(
    lambda s, d: _lexical(s, d, 3).join(table(s, d, "videos").select(F.col("video_idx").alias("doc"), "title"), "doc").where("title is not null").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "title"))).alias("l"))
    .select("q", F.array_join(F.transform("l", lambda x: F.concat(F.lit("Doc "), x["rank"].cast("string"), F.lit("(Title: "), x["title"], F.lit(")"))), "\n---\n").alias("block"))
)
q("search_tool_envelope", f"WITH {_BM25} SELECT q, count(*) AS n FROM lex WHERE rank <= 5 GROUP BY q")(
    lambda s, d: _lexical(s, d, 5).groupBy("q").agg(F.to_json(F.struct(F.first("q").alias("query"), F.sort_array(F.collect_list(F.struct("rank", "doc"))).alias("results"))).alias("j")).select("q", F.size(F.from_json("j", "results array<struct<rank:int,doc:bigint>>")["results"]).cast("bigint").alias("n"))
)

_PIECES = {n: f"CASE tier " + " ".join(f"WHEN '{t}' THEN {c[n][0]}" for t, c in R.TIERS.items()) + " END, CASE tier " + " ".join(f"WHEN '{t}' THEN {c[n][1]}" for t, c in R.TIERS.items()) + " END" for n in ("k_jitter", "n_hard_neg")}


def _whole(u: str, low: str, high: str) -> str:
    return f"CAST(floor({u} * ({high} - ({low}) + 1)) + ({low}) AS INT)"


def _drawn_sql() -> str:
    """What is drawn for each query, over asked(q)."""
    jitter, hard = (_PIECES[n].split(", CASE") for n in ("k_jitter", "n_hard_neg"))
    actions = []
    for t, c in R.TIERS.items():
        cum, arms = 0.0, []
        for name, w in c["gold_actions"].items():
            cum += w / sum(c["gold_actions"].values())
            arms.append(f"WHEN {uniform('q', '0', chr(39) + 'gold' + chr(39))} < {cum!r} THEN '{name}'")
        actions.append(f"WHEN tier = '{t}' THEN CASE {' '.join(arms)} ELSE '{name}' END")
    u = lambda what: uniform("q", "0", f"'{what}'")
    return f"""ti AS (SELECT q, pool, CASE WHEN {u('tier')} < 0.55 THEN 'easy' WHEN {u('tier')} < 0.55 + 0.35 THEN 'medium' ELSE 'hard' END AS tier FROM asked),
 dr AS (SELECT q, tier, {u('empty')} < CASE tier WHEN 'medium' THEN 0.01 WHEN 'hard' THEN 0.03 ELSE 0 END AS empty, greatest(1, least(10 + {_whole(u('k'), jitter[0], 'CASE' + jitter[1])}, pool)) AS k,
 CASE {' '.join(actions)} END AS action, {_whole(u('hard'), hard[0], 'CASE' + hard[1])} AS n_hard FROM ti)"""


q("search_perturbed_draws", f"WITH asked AS (SELECT video_idx AS q, CAST(video_idx % 37 + 1 AS INT) AS pool FROM videos), {_drawn_sql()} SELECT q, tier, empty, CAST(k AS INT) AS k, action, n_hard FROM dr")(
    lambda s, d: R.perturbation_draws(table(s, d, "videos").select(F.col("video_idx").alias("q"), (F.col("video_idx") % 37 + 1).cast("int").alias("pool")), F.col("pool"), 10).drop("pool")
)


def _perturbed(spark, d):
    v = table(spark, d, "videos").select(F.col("video_idx").alias("doc"), F.col("fake_url").alias("url"), "title", F.col("description").alias("snippet"))
    hits = _lexical(spark, d, 50).join(v, "doc")
    return R.perturb(hits, _asked(spark, d).join(v, F.col("q") == F.col("doc")).select("q", "url"), 10)


q("search_perturbed")(lambda s, d: _perturbed(s, d)[0])
q("search_perturbed_metrics")(lambda s, d: _perturbed(s, d)[1])
q("search_perturbed_subset", f"WITH {_BM25}, n AS (SELECT q, count(*) AS n FROM lex WHERE rank <= 50 GROUP BY 1), asked AS (SELECT q, CAST(n AS INT) AS pool FROM n), {_drawn_sql()} SELECT q, 0 AS invented, true AS once, true AS fits FROM dr WHERE NOT empty")(lambda s, d: _subset(s, d))


def _subset(spark, d):
    """No result is invented or shown twice, ranks are dense, and a list is as long as was drawn or as its results allow."""
    lists, metrics = _perturbed(spark, d)
    known = table(spark, d, "videos").select(F.col("fake_url").alias("url")).distinct().withColumn("known", F.lit(True))
    n = lists.join(known, "url", "left").groupBy("q").agg(F.count_if(F.col("known").isNull()).cast("int").alias("invented"), (F.countDistinct("url") == F.count("*")).alias("once"), (F.max("rank") == F.count("*")).alias("dense"), F.count("*").alias("n"))
    return n.join(metrics.select("q", "k", "displayed"), "q").select("q", "invented", "once", (F.col("dense") & (F.col("n") <= F.col("k")) & (F.col("n") == F.col("displayed"))).alias("fits"))


q("search_result_text", "SELECT doc_id, CASE WHEN length(text) > 400 THEN concat(left(text, 400), '... [truncated]') ELSE text END AS snippet FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", R.result_text(F.col("text")).alias("snippet"))
)

_KEYS = """uk AS (SELECT vector_row AS doc, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM keyframe_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 nk AS (SELECT doc, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM uk), mk AS (SELECT DISTINCT vector_row AS doc, video_idx FROM keyframe_meta)"""
@q("search_keyframes_to_videos", f"""WITH {_KEYS}, sk AS (SELECT a.doc AS q, b.doc, list_dot_product(a.e, b.e) AS score, row_number() OVER (PARTITION BY a.doc ORDER BY list_dot_product(a.e, b.e) DESC, b.doc) AS rank FROM nk a, nk b WHERE a.doc % 100 = 0)
 SELECT q, video_idx AS doc, rnd(max(score), 3) AS score FROM sk JOIN mk USING (doc) WHERE rank <= 100 GROUP BY 1, 2""")
def search_keyframes_to_videos(spark, d):
    """Videos by the best of their key frames for each asked vector."""
    v = table(spark, d, "keyframe_vectors")
    hits = R.dense(v, "vector_row", "embedding", v.where("vector_row % 100 = 0").select(F.col("vector_row").alias("q"), F.col("embedding").alias("vector")), 100)
    m = table(spark, d, "keyframe_meta").select(F.col("vector_row").alias("doc"), "video_idx").distinct()
    return hits.join(m, "doc").groupBy("q", F.col("video_idx").alias("doc")).agg(rnd(F.max("score"), 3).alias("score"))


q("hybrid_search_ranks", f"""WITH {_BM25}, {_KEYS}, fk AS (SELECT video_idx AS q, min(vector_row) AS doc FROM keyframe_meta WHERE video_idx % 100 = 0 GROUP BY 1), ak AS (SELECT q, e FROM fk JOIN nk USING (doc)),
 sk AS (SELECT q, doc, round(CAST(list_dot_product(ak.e, nk.e) AS FLOAT), 6) AS score, row_number() OVER (PARTITION BY q ORDER BY list_dot_product(ak.e, nk.e) DESC, doc) AS rank FROM ak, nk), vk AS (SELECT q, video_idx AS doc, max(score) AS score FROM sk JOIN mk USING (doc) WHERE rank <= 300 GROUP BY 1, 2),
 dk AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM vk), al AS (SELECT q, doc, rank, 0 AS src FROM lex WHERE rank <= 100 UNION ALL SELECT q, doc, rank, 1 FROM dk WHERE rank <= 100),
 f AS (SELECT q, doc, round(sum(1.0 / (60 + rank)), 12) AS score, min((src, rank)) AS seen FROM al GROUP BY q, doc), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen) AS rank FROM f)
 SELECT q, doc, CAST(rank AS INT) AS rank, rnd(score, 8) AS score, CASE WHEN title = '' OR title IS NULL THEN concat('Untitled (', video_id, ')') ELSE title END AS title FROM o JOIN videos ON video_idx = doc WHERE rank <= 10""")(
    lambda s, d: hybrid_search(s, d).select("q", "doc", "rank", rnd("score", 8).alias("score"), "title")
)

QUERIES, SQL = q.queries, q.sql
