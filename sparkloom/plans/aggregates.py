"""Metric and report queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.operators import metrics as M
from sparkloom.plans.base import ROLL, TOK, Book, rnd, rollouts, tokens, uniform

q = Book()
_EVAL = """ev AS (SELECT event_id, event_type AS category, CAST(user_id % 3 AS INT) AS level, CASE WHEN event_id % 17 = 0 THEN 'evaluation_error' WHEN event_id % 5 = 0 THEN NULL ELSE 'ok' END AS status,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE value > 50 END AS correct, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN concat(CAST(event_id % 101 AS VARCHAR), '%') ELSE CAST((event_id % 10) / 10 AS VARCHAR) END AS confidence FROM events)"""


def _evals(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(
        "event_id", F.col("event_type").alias("category"), (F.col("user_id") % 3).cast("int").alias("level"), F.when(i % 17 == 0, "evaluation_error").when(i % 5 == 0, None).otherwise("ok").alias("status"),
        F.when(i % 11 == 0, None).otherwise(F.col("value") > 50).alias("correct"), F.when(i % 7 == 0, "unknown").when(i % 3 == 0, F.concat((i % 101).cast("string"), F.lit("%"))).otherwise((i % 10 / 10).cast("string")).alias("confidence"),
    )


_J = "coalesce(status, '') <> 'evaluation_error' AND correct IS NOT NULL"
_REPORT = f"count(*) AS count, count(*) FILTER ({_J}) AS judged, count(*) FILTER (NOT ({_J})) AS errors, rnd(100.0 * count(*) FILTER ({_J} AND correct) / nullif(count(*) FILTER ({_J}), 0), 4) AS accuracy, rnd(100.0 * count(*) FILTER ({_J}) / count(*), 4) AS coverage"


def _report(spark, d, keys):
    r = M.accuracy_report(_evals(spark, d), keys)
    return r.withColumns({"accuracy": rnd("accuracy", 4), "coverage": rnd("coverage", 4)})


q("eval_overall", f"WITH {_EVAL} SELECT {_REPORT} FROM ev")(lambda s, d: _report(s, d, []))
q("eval_by_level", f"WITH {_EVAL} SELECT level, {_REPORT} FROM ev GROUP BY level")(lambda s, d: _report(s, d, ["level"]))
q("eval_by_category", f"WITH {_EVAL} SELECT category, {_REPORT} FROM ev GROUP BY category")(lambda s, d: _report(s, d, ["category"]))
q("eval_is_judged", f"WITH {_EVAL} SELECT event_id, ({_J}) AS judged FROM ev")(lambda s, d: _evals(s, d).select("event_id", M.judged(F.col("status"), F.col("correct")).alias("judged")))
q("eval_calibration", f"""WITH {_EVAL}, c AS (SELECT CAST(correct AS INT) AS ok, coalesce(CASE WHEN confidence LIKE '%\\%%' ESCAPE '\\' THEN TRY_CAST(replace(confidence, '%', '') AS DOUBLE) / 100 ELSE TRY_CAST(confidence AS DOUBLE) END, 0) AS c FROM ev WHERE {_J}),
 b AS (SELECT CASE WHEN c >= 0 AND c < 1 THEN floor(c * 5) END AS bin, count(*) AS n, avg(ok) AS acc, avg(c) AS conf FROM c GROUP BY 1) SELECT rnd(sum(CASE WHEN bin IS NOT NULL THEN n * abs(acc - conf) ELSE 0 END) / sum(n), 6) AS ece FROM b""")(
    lambda s, d: M.calibration_error(_evals(s, d).where(M.judged(F.col("status"), F.col("correct")))).select(rnd("ece", 6).alias("ece"))
)
q("eval_judge_summary", "SELECT coalesce(event_type, 'unknown') AS reason, count(*) AS n FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n")))


@q("metric_sequence", f"""WITH {TOK}, s AS (SELECT seq, sum(mask) AS len, sum(reward * mask) AS score FROM tok GROUP BY seq) SELECT min(len) AS min_len, max(len) AS max_len, rnd(avg(len), 5) AS mean_len,
 rnd(min(score) FILTER (len > 0), 5) AS min_score, rnd(max(score) FILTER (len > 0), 5) AS max_score, rnd(avg(score) FILTER (len > 0), 5) AS mean_score, rnd(avg(CASE WHEN len = (SELECT max(len) FROM s) THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio, rnd(avg(CASE WHEN len = 0 THEN 1.0 ELSE 0.0 END), 6) AS aborted FROM s""")
def metric_sequence(spark, d):
    s = tokens(spark, d).groupBy("seq").agg(F.sum("mask").alias("len"), F.sum(F.col("reward") * F.col("mask")).alias("score"))
    s = s.crossJoin(F.broadcast(s.agg(F.max("len").alias("top"))))
    on = F.when(F.col("len") > 0, F.col("score"))
    return s.agg(
        F.min("len").alias("min_len"), F.max("len").alias("max_len"), rnd(F.avg("len"), 5).alias("mean_len"), rnd(F.min(on), 5).alias("min_score"), rnd(F.max(on), 5).alias("max_score"), rnd(F.avg(on), 5).alias("mean_score"),
        rnd(F.avg((F.col("len") == F.col("top")).cast("double")), 6).alias("clip_ratio"), rnd(F.avg((F.col("len") == 0).cast("double")), 6).alias("aborted"),
    )


q("metric_explained_variance", f"WITH {TOK} SELECT rnd(1 - var_samp(reward - val) / (var_samp(reward) + 1e-5), 6) AS explained FROM tok WHERE mask = 1")(
    lambda s, d: tokens(s, d).where("mask = 1").agg(rnd(1 - F.var_samp(F.col("reward") - F.col("val")) / (F.var_samp("reward") + 1e-5), 6).alias("explained"))
)
q("metric_timing", f"WITH {TOK}, t AS (SELECT count(*) AS n, sum(mask) AS resp, sum(val) AS sec FROM tok) SELECT n, resp, rnd(sec, 3) AS seconds, rnd(sec * 1000 / n, 5) AS ms_per_token, rnd(sec * 1000 / resp, 5) AS ms_per_response_token, rnd(n / (sec * 8), 5) AS tokens_per_gpu_second FROM t")(
    lambda s, d: tokens(s, d).agg(F.count("*").alias("n"), F.sum("mask").alias("resp"), F.sum("val").alias("sec")).select("n", "resp", rnd("sec", 3).alias("seconds"), rnd(F.col("sec") * 1000 / F.col("n"), 5).alias("ms_per_token"), rnd(F.col("sec") * 1000 / F.col("resp"), 5).alias("ms_per_response_token"), rnd(F.col("n") / (F.col("sec") * 8), 5).alias("tokens_per_gpu_second"))
)
_NAMES = "SELECT unnest(['timing/step', 'score/max', 'score/mean', 'len/min']) AS prefix"
q("metric_reduce_by_name", "WITH n AS (SELECT unnest(['timing/step', 'score/max', 'score/mean', 'len/min']) AS name), e AS (SELECT name, value FROM n, events) SELECT name, rnd(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 5) AS value FROM e GROUP BY name")(
    lambda s, d: M.reduce_metrics(table(s, d, "events").select(F.explode(F.array(*map(F.lit, ("timing/step", "score/max", "score/mean", "len/min")))).alias("name"), "value")).select("name", rnd("value", 5).alias("value"))
)
q("metric_two_stage", f"WITH {ROLL}, r AS (SELECT kind, sum(score) AS s, avg(score) AS m, min(score) AS lo, max(score) AS hi FROM roll GROUP BY kind) SELECT rnd(sum(s), 2) AS total, rnd(avg(m), 5) AS mean, min(lo) AS lo, max(hi) AS hi FROM r")(
    lambda s, d: rollouts(s, d).groupBy("kind").agg(F.sum("score").alias("s"), F.avg("score").alias("m"), F.min("score").alias("lo"), F.max("score").alias("hi")).agg(rnd(F.sum("s"), 2).alias("total"), rnd(F.avg("m"), 5).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
)
q("metric_last_by_step", f"WITH {ROLL} SELECT kind, arg_max(score, idx) AS last, rnd(sum(score * idx) / sum(idx), 5) AS weighted, rnd(sum(score), 3) AS total FROM roll GROUP BY kind")(
    lambda s, d: rollouts(s, d).groupBy("kind").agg(F.max_by("score", "idx").alias("last"), rnd(F.sum(F.col("score") * F.col("idx")) / F.sum("idx"), 5).alias("weighted"), rnd(F.sum("score"), 3).alias("total"))
)
q("metric_sample_assembly", f"WITH {ROLL} SELECT kind, rnd(avg(score), 5) AS mean, rnd(quantile_cont(score, 0.5), 5) AS p50, rnd(quantile_cont(score, 0.95), 5) AS p95, rnd(quantile_cont(score, 0.99), 5) AS p99, count(DISTINCT uid) AS versions, max(uid) - min(uid) AS span FROM roll GROUP BY kind")(
    lambda s, d: rollouts(s, d).groupBy("kind").agg(rnd(F.avg("score"), 5).alias("mean"), *[rnd(F.percentile("score", p / 100), 5).alias(f"p{p}") for p in (50, 95, 99)], F.countDistinct("uid").alias("versions"), (F.max("uid") - F.min("uid")).alias("span"))
)
q("metric_slowest", f"WITH {ROLL} SELECT kind, min(score) AS lo, max(score) AS hi, rnd(avg(score), 5) AS mean, arg_max(idx, (score, -idx)) AS slowest FROM roll GROUP BY kind")(
    lambda s, d: rollouts(s, d).groupBy("kind").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), rnd(F.avg("score"), 5).alias("mean"), F.max_by("idx", F.struct("score", -F.col("idx"))).alias("slowest"))
)
q("metric_majority_vote", f"""WITH {ROLL}, v AS (SELECT uid, kind, count(*) AS n, min(idx) AS first, arg_min(score, idx) AS value FROM roll GROUP BY uid, kind), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS k FROM v) SELECT uid, value, kind AS vote FROM r WHERE k = 1""")(
    lambda s, d: M.majority(rollouts(s, d), "uid", "kind", "score", "idx")
)
q("metric_best_worst", f"""WITH {ROLL}, t AS (SELECT uid, score AS v, row_number() OVER (PARTITION BY uid ORDER BY score) AS r, count(*) OVER (PARTITION BY uid) AS k FROM roll)
 SELECT uid, rnd(sum(v * (pow(r / k, 4) - pow((r - 1) / k, 4))), 4) AS best, rnd(sum(v * (pow((k - r + 1) / k, 4) - pow((k - r) / k, 4))), 4) AS worst, rnd(avg(v), 5) AS mean, rnd(stddev_pop(v), 5) AS std FROM t GROUP BY uid""")(
    lambda s, d: M.best_worst_of(rollouts(s, d), "uid", "score", 4).select("uid", rnd("best", 4).alias("best"), rnd("worst", 4).alias("worst"), rnd("mean", 5).alias("mean"), rnd("std", 5).alias("std"))
)
q("metric_validation", f"WITH {ROLL}, u AS (SELECT kind, uid, avg(score) AS m, stddev_pop(score) AS s, max(score) AS b FROM roll GROUP BY kind, uid) SELECT kind, concat('val-core/', kind, '/reward/mean') AS label, rnd(avg(m), 5) AS mean, rnd(avg(s), 5) AS std, rnd(avg(b), 5) AS best FROM u GROUP BY kind")(
    lambda s, d: rollouts(s, d).groupBy("kind", "uid").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.max("score").alias("b")).groupBy("kind").agg(rnd(F.avg("m"), 5).alias("mean"), rnd(F.avg("s"), 5).alias("std"), rnd(F.avg("b"), 5).alias("best")).withColumn("label", F.concat(F.lit("val-core/"), "kind", F.lit("/reward/mean")))
)
q("metric_merge_validation", f"WITH {ROLL}, m AS (SELECT * FROM roll WHERE uid % 2 = 0 UNION ALL SELECT * FROM roll WHERE uid % 2 = 1) SELECT kind, count(*) AS n, rnd(avg(score), 5) AS mean FROM m GROUP BY kind")(
    lambda s, d: rollouts(s, d).where("uid % 2 = 0").unionByName(rollouts(s, d).where("uid % 2 = 1")).groupBy("kind").agg(F.count("*").alias("n"), rnd(F.avg("score"), 5).alias("mean"))
)
q("metric_group_mean_std", f"WITH {ROLL}, g AS (SELECT uid, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM roll GROUP BY uid) SELECT uid, n, rnd(CASE WHEN n = 1 THEN 0 ELSE m END, 5) AS mean, rnd(CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(v, 1e-6)) END, 5) AS std FROM g")(
    lambda s, d: rollouts(s, d).groupBy("uid").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v")).select("uid", "n", rnd(F.when(F.col("n") == 1, 0.0).otherwise(F.col("m")), 5).alias("mean"), rnd(F.when(F.col("n") == 1, 1.0).otherwise(F.sqrt(F.greatest("v", F.lit(1e-6)))), 5).alias("std"))
)


@q("metric_dense_index", f"WITH {ROLL} SELECT idx, kind, dense_rank() OVER (ORDER BY kind) - 1 AS gidx FROM roll")
def metric_dense_index(spark, d):
    """Labels to 0..G-1: the ranking is over the distinct labels, not over the rows."""
    r = rollouts(spark, d)
    labels = r.select("kind").distinct().withColumn("gidx", F.dense_rank().over(Window.orderBy("kind")) - 1)
    return r.join(labels, "kind").select("idx", "kind", "gidx")


q("metric_global", f"WITH {ROLL} SELECT rnd(avg(score), 5) AS mean, max(score) AS max, min(score) AS min, rnd(stddev_samp(score), 5) AS std FROM roll")(
    lambda s, d: rollouts(s, d).agg(rnd(F.avg("score"), 5).alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), rnd(F.stddev_samp("score"), 5).alias("std"))
)
q("metric_source_counts", "SELECT source_dataset, count(*) AS videos, count(*) FILTER (subtitle IS NULL OR subtitle = '') AS without_subtitle, rnd(sum(duration), 2) AS seconds FROM videos GROUP BY 1")(
    lambda s, d: table(s, d, "videos").groupBy("source_dataset").agg(F.count("*").alias("videos"), F.count_if(F.col("subtitle").isNull() | (F.col("subtitle") == "")).alias("without_subtitle"), rnd(F.sum("duration"), 2).alias("seconds"))
)
q("metric_keyframes_per_video", "SELECT video_idx, count(DISTINCT vector_row) AS keyframes, min(timestamp) AS first, max(timestamp) AS last FROM keyframe_meta GROUP BY 1")(
    lambda s, d: table(s, d, "keyframe_meta").groupBy("video_idx").agg(F.countDistinct("vector_row").alias("keyframes"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
)
q("metric_usage", f"WITH {TOK} SELECT uid, sum(mask) AS response_tokens, count(*) - sum(mask) AS prompt_tokens, count(*) AS total FROM tok GROUP BY uid")(
    lambda s, d: tokens(s, d).groupBy("uid").agg(F.sum("mask").alias("response_tokens"), (F.count("*") - F.sum("mask")).alias("prompt_tokens"), F.count("*").alias("total"))
)
q("metric_flops", "SELECT o_custkey, rnd(sum(24576.0 * o_shippable + o_shippable * o_shippable) / 1e6, 4) AS mflops FROM (SELECT o_custkey, o_orderkey % 997 AS o_shippable FROM orders) GROUP BY 1")(
    lambda s, d: table(s, d, "orders").withColumn("n", F.col("o_orderkey") % 997).groupBy("o_custkey").agg(rnd(F.sum(24576.0 * F.col("n") + F.col("n") * F.col("n")) / 1e6, 4).alias("mflops"))
)
q("metric_overlong_penalty", "SELECT o_orderkey, rnd(o_totalprice / 1e5 + least(-greatest((o_orderkey % 900) - 600, 0) / 200.0 * 0.5, 0), 6) AS reward FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", rnd(F.col("o_totalprice") / 1e5 + F.least(-F.greatest(F.col("o_orderkey") % 900 - 600, F.lit(0)) / 200.0 * 0.5, F.lit(0.0)), 6).alias("reward"))
)
_BOOT = ", ".join(f"rnd(avg({x}), 5) AS {x}_mean, rnd(stddev_pop({x}), 5) AS {x}_std" for x in ("mean", "best", "worst"))
q("metric_bootstrap", f"""WITH {ROLL}, v AS (SELECT kind, score AS v, row_number() OVER (PARTITION BY kind ORDER BY idx) - 1 AS pl FROM roll WHERE score IS NOT NULL), g AS (SELECT kind, count(*) AS k FROM v GROUP BY 1),
 dr AS (SELECT kind, k, a.r, b.i FROM g, (SELECT unnest(range(1, 201)) AS r) a, (SELECT unnest(range(1, 9)) AS i) b), p AS (SELECT kind, r, CAST(floor({uniform('kind', 'r', 'i', '42')} * k) AS BIGINT) AS pl FROM dr),
 e AS (SELECT kind, r, avg(v) AS mean, max(v) AS best, min(v) AS worst FROM p JOIN v USING (kind, pl) GROUP BY 1, 2) SELECT kind, {_BOOT} FROM e GROUP BY 1""")(
    lambda s, d: _boot(M.bootstrap(rollouts(s, d), "kind", "score", "idx", 8, 200))
)


def _boot(df):
    return df.select("kind", *[rnd(c, 5).alias(c) for c in df.columns if c != "kind"])


QUERIES, SQL = q.queries, q.sql
