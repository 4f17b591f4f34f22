"""Advantage estimator queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import advantage as A
from sparkloom.plans.base import ROLL, TOK, Book, rnd, rollouts, tokens

q = Book()
_OUT = ["idx", "uid"]


def _show(df, digits=5):
    return df.select(*_OUT, rnd("advantage", digits).alias("advantage"))


_STAT = f"WITH {ROLL}, g AS (SELECT *, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s, count(score) OVER w AS n, sum(score) OVER w AS t FROM roll WINDOW w AS (PARTITION BY uid)) "


@q("adv_grpo", _STAT + "SELECT idx, uid, rnd((score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6), 5) AS advantage FROM g")
def adv_grpo(spark, d):
    return _show(A.advantage(rollouts(spark, d), "grpo"))


@q("adv_grpo_centred", _STAT + "SELECT idx, uid, rnd(score - CASE WHEN n = 1 THEN 0 ELSE m END, 5) AS advantage FROM g")
def adv_grpo_centred(spark, d):
    return _show(A.advantage(rollouts(spark, d), "grpo", by_std=False))


@q("adv_grpo_vectorized", _STAT + "SELECT idx, uid, rnd((score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(s * s, 1e-6)) END + 1e-6), 5) AS advantage FROM g")
def adv_grpo_vectorized(spark, d):
    return _show(A.advantage(rollouts(spark, d), "grpo_vectorized"))


@q("adv_rloo", _STAT + "SELECT idx, uid, rnd(CASE WHEN n > 1 THEN (score - m) * n / (n - 1) ELSE score END, 5) AS advantage FROM g")
def adv_rloo(spark, d):
    return _show(A.advantage(rollouts(spark, d), "rloo"))


@q("adv_rloo_vectorized", _STAT + "SELECT idx, uid, rnd(CASE WHEN n > 1 THEN (n * score - t) / (n - 1) ELSE 0 END, 5) AS advantage FROM g")
def adv_rloo_vectorized(spark, d):
    return _show(A.advantage(rollouts(spark, d), "rloo_vectorized"))


@q("adv_grpo_passk", f"""WITH {ROLL}, g AS (SELECT *, row_number() OVER o AS r, stddev_samp(score) OVER (PARTITION BY uid) AS s,
 nth_value(score, 2) OVER (PARTITION BY uid ORDER BY score DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x
 FROM roll WINDOW o AS (PARTITION BY uid ORDER BY score DESC, idx)) SELECT idx, uid, rnd(CASE WHEN r = 1 THEN (score - x) / (s + 1e-6) ELSE 0 END, 5) AS advantage FROM g""")
def adv_grpo_passk(spark, d):
    return _show(A.advantage(rollouts(spark, d), "grpo_passk"))


@q("adv_opo", f"""WITH {ROLL}, l AS (SELECT *, length(kind) AS length FROM roll), g AS (SELECT *, sum(length * score) OVER w / sum(length) OVER w AS b, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY uid))
 SELECT idx, uid, rnd(score - CASE WHEN n = 1 THEN 0 ELSE b END, 5) AS advantage FROM g""")
def adv_opo(spark, d):
    return _show(A.advantage(rollouts(spark, d).withColumn("length", F.length("kind")), "opo"))


@q("adv_gpg", _STAT[:-1] + ", a AS (SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) AS k FROM roll) SELECT idx, uid, rnd(k * (score - CASE WHEN n = 1 THEN 0 ELSE m END), 5) AS advantage FROM g, a")
def adv_gpg(spark, d):
    return _show(A.advantage(rollouts(spark, d), "gpg"))


@q("adv_reinforce_pp_baseline", f"""WITH {ROLL}, c AS (SELECT idx, uid, length(kind) AS w, score - CASE WHEN count(*) OVER (PARTITION BY uid) = 1 THEN 0 ELSE avg(score) OVER (PARTITION BY uid) END AS v FROM roll),
 s AS (SELECT sum(w * v) / sum(w) AS m, (sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w)) / (sum(w) - 1) AS va FROM c)
 SELECT idx, uid, rnd((v - m) / sqrt(va + 1e-8), 5) AS advantage FROM c, s""")
def adv_reinforce_pp_baseline(spark, d):
    return _show(A.advantage(rollouts(spark, d).withColumn("length", F.length("kind")), "reinforce_plus_plus_baseline"))


@q("adv_gdpo", f"""WITH {ROLL}, two AS (SELECT *, score AS a, length(kind) AS b FROM roll), g AS (SELECT idx, uid,
 0.7 * (a - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(a) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(a) OVER w END + 1e-6)
 + 0.3 * (b - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(b) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(b) OVER w END + 1e-6) AS v FROM two WINDOW w AS (PARTITION BY uid)),
 s AS (SELECT avg(v) AS m, var_samp(v) AS va FROM g) SELECT idx, uid, rnd((v - m) / sqrt(va + 1e-8), 5) AS advantage FROM g, s""")
def adv_gdpo(spark, d):
    df = rollouts(spark, d).withColumn("a", F.col("score")).withColumn("b", F.length("kind").cast("double"))
    return _show(A.advantage(df, "gdpo", weights={"a": 0.7, "b": 0.3}))


@q("adv_remax", f"WITH {TOK} SELECT seq, pos, rnd(sum(reward) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - first_value(val) OVER (PARTITION BY seq ORDER BY pos), 5) AS advantage FROM tok")
def adv_remax(spark, d):
    return A.advantage(tokens(spark, d), "remax").select("seq", "pos", rnd("advantage", 5).alias("advantage"))


@q("adv_discounted_returns", f"""WITH RECURSIVE {TOK}, n AS (SELECT seq, max(pos) AS last FROM tok GROUP BY seq),
 r AS (SELECT t.seq, t.pos, CAST(t.reward AS DOUBLE) AS ret, t.mask FROM tok t JOIN n ON n.seq = t.seq AND n.last = t.pos
 UNION ALL SELECT t.seq, t.pos, t.reward + 0.9 * r.ret * r.mask, t.mask FROM r JOIN tok t ON t.seq = r.seq AND t.pos = r.pos - 1) SELECT seq, pos, rnd(ret, 5) AS ret FROM r""")
def adv_discounted_returns(spark, d):
    return A.discounted_returns(tokens(spark, d), 0.9).select("seq", "pos", rnd("return", 5).alias("ret"))


@q("adv_gae", f"""WITH RECURSIVE {TOK}, n AS (SELECT seq, max(pos) AS last FROM tok GROUP BY seq),
 r AS (SELECT t.seq, t.pos, CASE WHEN mask = 1 THEN t.reward - t.val ELSE 0.0 END AS run, CASE WHEN mask = 1 THEN t.val ELSE 0.0 END AS nxt, t.val FROM tok t JOIN n ON n.seq = t.seq AND n.last = t.pos
 UNION ALL SELECT t.seq, t.pos, CASE WHEN t.mask = 1 THEN t.reward + 0.95 * r.nxt - t.val + 0.95 * 0.9 * r.run ELSE r.run END, CASE WHEN t.mask = 1 THEN t.val ELSE r.nxt END, t.val FROM r JOIN tok t ON t.seq = r.seq AND t.pos = r.pos - 1)
 SELECT seq, pos, rnd(run, 5) AS gae, rnd(run + val, 5) AS ret FROM r""")
def adv_gae(spark, d):
    return A.gae(tokens(spark, d), 0.95, 0.9).select("seq", "pos", rnd("gae", 5).alias("gae"), rnd("return", 5).alias("ret"))


@q("adv_token_baseline", f"""WITH {TOK}, t AS (SELECT *, sum(reward * mask) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
 sum((1 - 2 * exp(logp) + exp(logp) * exp(logp)) * mask) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM tok)
 SELECT seq, pos, rnd((g - sum(g * w) OVER p / (sum(w) OVER p + 1e-8)) * mask, 4) AS advantage FROM t WINDOW p AS (PARTITION BY uid, pos)""")
def adv_token_baseline(spark, d):
    return A.token_baseline(tokens(spark, d)).select("seq", "pos", rnd("advantage", 4).alias("advantage"))


@q("adv_token_baseline_compacted", f"""WITH {TOK}, c AS (SELECT * REPLACE (row_number() OVER (PARTITION BY seq ORDER BY pos) AS pos) FROM tok WHERE mask = 1), t AS (SELECT *, sum(reward) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
 sum(1 - 2 * exp(logp) + exp(logp) * exp(logp)) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM c)
 SELECT seq, pos, rnd(g - sum(g * w) OVER p / (sum(w) OVER p + 1e-8), 4) AS advantage FROM t WINDOW p AS (PARTITION BY uid, pos)""")
def adv_token_baseline_compacted(spark, d):
    return A.advantage(tokens(spark, d), "optimal_token_baseline_turns").select("seq", "pos", rnd("advantage", 4).alias("advantage"))


@q("adv_reinforce_pp", f"""WITH RECURSIVE {TOK}, n AS (SELECT seq, max(pos) AS last FROM tok GROUP BY seq),
 r AS (SELECT t.seq, t.pos, CAST(t.reward AS DOUBLE) AS ret, t.mask FROM tok t JOIN n ON n.seq = t.seq AND n.last = t.pos
 UNION ALL SELECT t.seq, t.pos, t.reward + 0.9 * r.ret * r.mask, t.mask FROM r JOIN tok t ON t.seq = r.seq AND t.pos = r.pos - 1),
 s AS (SELECT sum(mask * ret) / sum(mask) AS m, (sum(mask * ret * ret) - sum(mask * ret) * sum(mask * ret) / sum(mask)) / (sum(mask) - 1) AS va FROM r)
 SELECT seq, pos, rnd((ret - m) / sqrt(va + 1e-8) * mask, 4) AS advantage FROM r, s""")
def adv_reinforce_pp(spark, d):
    return A.advantage(tokens(spark, d), "reinforce_plus_plus", gamma=0.9).select("seq", "pos", rnd("advantage", 4).alias("advantage"))


@q("adv_multi_trajectory", f"""WITH {ROLL}, l AS (SELECT uid, kind AS session, arg_max(score, idx) AS score FROM roll GROUP BY uid, kind), g AS (SELECT uid, session,
 (score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6) AS a FROM l WINDOW w AS (PARTITION BY uid))
 SELECT r.idx, r.uid, rnd(a, 5) AS advantage FROM roll r JOIN g ON g.uid = r.uid AND g.session = r.kind""")
def adv_multi_trajectory(spark, d):
    return _show(A.last_of_session(rollouts(spark, d).withColumnRenamed("kind", "session"), "idx"))


@q("trajectory_run_number", f"""WITH {ROLL}, c AS (SELECT idx, uid, kind, CASE WHEN lag(kind) OVER (PARTITION BY uid ORDER BY idx) = kind THEN 0 ELSE 1 END AS new FROM roll),
 i AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY idx) AS island FROM c) SELECT idx, row_number() OVER (PARTITION BY uid, island ORDER BY idx) - 1 AS rollout_n FROM i""")
def trajectory_run_number(spark, d):
    """Position within each run of equal neighbours."""
    w = Window.partitionBy("uid").orderBy("idx")
    r = rollouts(spark, d).withColumn("new", F.when(F.lag("kind").over(w) == F.col("kind"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return r.select("idx", (F.row_number().over(Window.partitionBy("uid", "island").orderBy("idx")) - 1).alias("rollout_n"))


QUERIES, SQL = q.queries, q.sql
