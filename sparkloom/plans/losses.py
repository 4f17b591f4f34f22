"""Loss, divergence and off-policy queries over token rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.functions import kl
from sparkloom.operators import losses as L
from sparkloom.plans.base import TOK, Book, rnd, tokens, uniform

q = Book()
_CL = "greatest(least(logp - old_logp, 20), -20)"
_R = f"exp({_CL})"


def _one(df):
    return df.select(*[rnd(c, 5).alias(c) for c in df.columns])


_REDUCE = {
    "token-mean": "SELECT rnd(sum(x * mask) / sum(mask), 5) AS loss FROM l",
    "seq-mean-token-sum": "SELECT rnd(avg(s), 5) AS loss FROM (SELECT sum(x * mask) AS s, sum(mask) AS n FROM l GROUP BY seq) WHERE n > 0",
    "seq-mean-token-sum-norm": "SELECT rnd(avg(s) / 7, 5) AS loss FROM (SELECT sum(x * mask) AS s, sum(mask) AS n FROM l GROUP BY seq) WHERE n > 0",
    "seq-mean-token-mean": "SELECT rnd(avg(s / (n + 1e-8)), 5) AS loss FROM (SELECT sum(x * mask) AS s, sum(mask) AS n FROM l GROUP BY seq) WHERE n > 0",
}
_CLIP = "greatest(least({r}, 1.2), 0.8)"
_GS = "exp(least(sum((logp - old_logp) * mask) OVER (PARTITION BY seq) / greatest(sum(mask) OVER (PARTITION BY seq), 1), 10))"
_EXPR = {
    "vanilla": f"CASE WHEN adv < 0 THEN least(-adv * 3, greatest(-adv * {_R}, -adv * {_CLIP.format(r=_R)})) ELSE greatest(-adv * {_R}, -adv * {_CLIP.format(r=_R)}) END",
    "gspo": f"greatest(-adv * {_GS}, -adv * {_CLIP.format(r=_GS)})",
    "sapo": f"-(4.0 / CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) / (1 + exp(-CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END * ({_R} - 1))) * adv",
    "gpg": "-logp * adv",
    "cispo": f"-{_CLIP.format(r=_R)} * adv * logp",
    "reinforce": "-adv * logp",
    "dppo_tv": f"-adv * least({_R}, 20) * CASE WHEN (adv > 0 AND logp > old_logp AND abs(exp(logp) - exp(old_logp)) > 0.2) OR (adv < 0 AND NOT logp > old_logp AND abs(exp(logp) - exp(old_logp)) > 0.2) THEN 0 ELSE 1 END",
}
_MODE = {"gspo": "seq-mean-token-mean", "sapo": "seq-mean-token-mean", "reinforce": "seq-mean-token-sum"}


def _loss(name, mode):
    return lambda spark, d: _one(L.loss(tokens(spark, d), name, mode))


for _name, _expr in _EXPR.items():
    _m = _MODE.get(_name, "token-mean")
    q(f"loss_{_name}", f"WITH {TOK}, l AS (SELECT seq, mask, {_expr} AS x FROM tok) " + _REDUCE[_m])(_loss(_name, _m))
for _m, _sql in _REDUCE.items():
    q(f"loss_reduce_{_m.replace('-', '_')}", f"WITH {TOK}, l AS (SELECT seq, mask, adv * logp AS x FROM tok) " + _sql)(lambda spark, d, m=_m: _one(L.aggregate_loss(tokens(spark, d), F.col("adv") * F.col("logp"), m, 7)))

_A, _B = "greatest(least(exp(old_logp), 1 - 1e-8), 1e-8)", "greatest(least(exp(logp), 1 - 1e-8), 1e-8)"
_BKL = f"({_A} * ln({_A} / {_B}) + (1 - {_A}) * ln((1 - {_A}) / (1 - {_B})))"
q("loss_dppo_kl", f"WITH {TOK}, l AS (SELECT seq, mask, -adv * least({_R}, 20) * CASE WHEN (adv > 0 AND logp > old_logp AND {_BKL} > 0.05) OR (adv < 0 AND NOT logp > old_logp AND {_BKL} > 0.05) THEN 0 ELSE 1 END AS x FROM tok) " + _REDUCE["token-mean"])(_loss("dppo_kl", "token-mean"))
q("loss_kl_cov", f"""WITH {TOK}, s AS (SELECT avg(adv) AS ma, avg(logp) AS ml FROM tok WHERE mask = 1), c AS (SELECT tok.*, CASE WHEN mask = 1 THEN (adv - ma) * (logp - ml) END AS cov FROM tok, s),
 k AS (SELECT quantile_cont(cov, 0.98) AS cut FROM c), l AS (SELECT seq, mask, -adv * {_R} + CASE WHEN cov >= cut THEN abs({_CL}) ELSE 0 END AS x FROM c, k) """ + _REDUCE["token-mean"])(_loss("kl_cov", "token-mean"))


q("loss_clip_cov", f"""WITH {TOK}, s AS (SELECT avg(adv) AS ma, avg(logp) AS ml FROM tok WHERE mask = 1), l AS (SELECT seq, mask, CASE WHEN (adv - ma) * (logp - ml) BETWEEN 0.1 AND 2.0 AND {uniform('seq', 'pos', '3')} < 0.05 THEN 0 ELSE {_EXPR["vanilla"]} END AS x FROM tok, s) """ + _REDUCE["token-mean"])(
    lambda s, d: _one(L.loss(tokens(s, d), "clip_cov", share=0.05, low=0.1, high=2.0))
)
for _kind, _sql in {"reverse_k1": "logp - old_logp", "reverse_k2": "0.5 * (logp - old_logp) * (logp - old_logp)", "reverse_abs": "abs(logp - old_logp)"}.items():
    q(f"loss_distillation_{_kind}", f"WITH {TOK}, l AS (SELECT seq, mask, {_sql} AS x FROM tok) " + _REDUCE["token-mean"])(lambda s, d, k=_kind: _one(L.distillation_loss(tokens(s, d), k)))
q("loss_entropy", f"WITH {TOK}, p AS (SELECT seq, mask, exp(logp) AS a, exp(old_logp) AS b FROM tok), l AS (SELECT seq, mask, ln(a + b) - (a * ln(a) + b * ln(b)) / (a + b) AS x FROM p) " + _REDUCE["token-mean"])(
    lambda s, d: _one(L.entropy_loss(tokens(s, d).withColumn("logits", F.array("logp", "old_logp")), "logits"))
)


@q("loss_geo_mean", f"""WITH {TOK}, g AS (SELECT seq, sum(sign(adv) * least(sign(adv) * {_CL}, sign(adv) * greatest(least({_CL}, 0.4), -0.4)) * mask) / (sum(mask) + 1e-8) AS g, sum(adv * mask) / (sum(mask) + 1e-8) AS a FROM tok GROUP BY seq)
 SELECT rnd(avg(-a * exp(g)), 5) AS loss FROM g""")
def loss_geo_mean(spark, d):
    return _one(L.geo_mean(tokens(spark, d)))


@q("loss_value", f"WITH {TOK}, l AS (SELECT seq, mask, 0.5 * greatest(pow(reward * 2 - reward, 2), pow(greatest(least(reward * 2, val + 0.2), val - 0.2) - reward, 2)) AS x FROM tok) " + _REDUCE["token-mean"])
def loss_value(spark, d):
    return _one(L.value_loss(tokens(spark, d).withColumn("vpred", F.col("reward") * 2).withColumn("ret", F.col("reward"))))


_KL = {"k1": "logp - old_logp", "abs": "abs(logp - old_logp)", "k2": "(logp - old_logp) * (logp - old_logp) / 2", "k3": "greatest(least(exp(greatest(least(old_logp - logp, 20), -20)) - greatest(least(old_logp - logp, 20), -20) - 1, 10), -10)"}
q("kl_penalty", f"WITH {TOK} SELECT seq, pos, " + ", ".join(f"rnd({v}, 6) AS {k}_kl" for k, v in _KL.items()) + " FROM tok")(
    lambda spark, d: tokens(spark, d).select("seq", "pos", *[rnd(kl.kl_penalty(F.col("logp"), F.col("old_logp"), k + "+"), 6).alias(f"{k}_kl") for k in _KL])
)


@q("kl_in_reward", f"WITH {TOK} SELECT seq, pos, rnd(reward - 0.02 * (logp - old_logp) * mask, 6) AS reward FROM tok")
def kl_in_reward(spark, d):
    return tokens(spark, d).select("seq", "pos", rnd(F.col("reward") - 0.02 * kl.kl_penalty(F.col("logp"), F.col("old_logp")) * F.col("mask"), 6).alias("reward"))


@q("kl_batch_mean", f"WITH {TOK} SELECT rnd(avg(k), 6) AS kl FROM (SELECT sum((logp - old_logp) * mask) / (sum(mask) + 1e-8) AS k FROM tok GROUP BY seq)")
def kl_batch_mean(spark, d):
    seq = tokens(spark, d).groupBy("seq").agg(kl.masked_mean(F.col("logp") - F.col("old_logp"), F.col("mask")).alias("k"))
    return seq.agg(rnd(F.avg("k"), 6).alias("kl"))


@q("kl_controller", """WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY date_trunc('month', o_orderdate)) AS step, avg(o_totalprice) / 300000 AS kl, count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate)),
 r AS (SELECT 0::BIGINT AS step, 0.2::DOUBLE AS beta UNION ALL SELECT m.step, r.beta * (1 + greatest(least(m.kl / 0.5 - 1, 0.2), -0.2) * m.n / 100000) FROM r JOIN m ON m.step = r.step + 1)
 SELECT step, rnd(beta, 6) AS beta FROM r WHERE step > 0""")
def kl_controller(spark, d):
    """Adaptive coefficient: a fold over the ordered steps (one per month)."""
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg((F.avg("o_totalprice") / 300000).alias("kl"), F.count("*").alias("n"))
    steps = m.agg(F.sort_array(F.collect_list(F.struct("month", "kl", "n"))).alias("s"))  # one entry per step
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * (1 + kl.clamp(x["kl"] / 0.5 - 1, -0.2, 0.2) * x["n"] / 100000)))
    return steps.select(F.posexplode(F.aggregate("s", F.array(F.lit(0.2)), step)).alias("step", "beta")).where("step > 0").select(F.col("step").cast("bigint").alias("step"), rnd("beta", 6).alias("beta"))


@q("math_logits", """WITH l AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS z FROM embeddings), e AS (SELECT *, list_max(z) + ln(list_sum([exp(x - list_max(z)) FOR x IN z])) AS s FROM l)
 SELECT vec_id, rnd(s - list_sum([exp(x - s) * x FOR x IN z]), 5) AS entropy, rnd(z[label + 1] - s, 5) AS logprob, rnd(list_sum([exp(2 * (x - s)) FOR x IN z]), 6) AS pi2 FROM e""")
def math_logits(spark, d):
    z = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").withColumn("z", z)
    return e.select("vec_id", rnd(kl.entropy(F.col("z")), 5).alias("entropy"), rnd(kl.log_prob(F.col("z"), F.col("label")), 5).alias("logprob"), rnd(kl.sum_pi_squared(F.col("z")), 6).alias("pi2"))


@q("math_divergence", """WITH l AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS z FROM embeddings), p AS (SELECT vec_id, [x - (list_max(z) + ln(list_sum([exp(y - list_max(z)) FOR y IN z]))) FOR x IN z] AS lp FROM l)
 SELECT vec_id, rnd(list_sum([exp(x) * (x - ln(1.0 / 64)) FOR x IN lp]), 6) AS kl FROM p""")
def math_divergence(spark, d):
    """Divergence from the uniform distribution."""
    e = table(spark, d, "embeddings").withColumn("z", F.transform("embedding", lambda x: x.cast("double"))).withColumn("s", kl.log_sum_exp(F.col("z")))
    lp = F.transform("z", lambda x: x - F.col("s"))
    return e.select("vec_id", rnd(kl.divergence(F.transform("z", lambda x: F.ln(F.lit(1.0 / 64))), lp), 6).alias("kl"))


@q("math_topk_forward_kl", """WITH l AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS z, list_reverse([CAST(x AS DOUBLE) FOR x IN embedding]) AS y FROM embeddings),
 p AS (SELECT vec_id, unnest([x - (list_max(z) + ln(list_sum([exp(v - list_max(z)) FOR v IN z]))) FOR x IN z]) AS t, unnest([x - (list_max(y) + ln(list_sum([exp(v - list_max(y)) FOR v IN y]))) FOR x IN y]) AS s, unnest(range(64)) AS id FROM l),
 k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, id) AS r FROM p) SELECT vec_id, rnd(sum(exp(t) * (t - s)), 5) AS kl, rnd(sum(exp(t)), 5) AS teacher_mass, rnd(sum(exp(s)), 5) AS student_mass FROM k WHERE r <= 8 GROUP BY vec_id""")
def math_topk_forward_kl(spark, d):
    """Forward KL on the teacher's 8 likeliest ids; top-k is the operator's feature."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z")).withColumn("y", F.reverse("z"))
    e = e.withColumn("zs", kl.log_sum_exp(F.col("z"))).withColumn("ys", kl.log_sum_exp(F.col("y")))
    t, s = F.transform("z", lambda x: x - F.col("zs")), F.transform("y", lambda x: x - F.col("ys"))
    best = F.slice(F.array_sort(F.zip_with(F.transform(t, lambda x, i: F.struct((-x).alias("o"), i.alias("id"), x.alias("t"))), s, lambda a, b: F.struct(a["o"], a["id"], a["t"], b.alias("s")))), 1, 8)
    x = e.select("vec_id", F.inline(best))
    return x.groupBy("vec_id").agg(rnd(F.sum(F.exp("t") * (F.col("t") - F.col("s"))), 5).alias("kl"), rnd(F.sum(F.exp("t")), 5).alias("teacher_mass"), rnd(F.sum(F.exp("s")), 5).alias("student_mass"))


@q("math_normalise", "SELECT vec_id, [rnd(CAST(x AS DOUBLE) / greatest(sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])), 1e-12), 5) FOR x IN embedding] AS unit FROM embeddings")
def math_normalise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(kl.normalised(F.col("embedding")), lambda x: rnd(x, 5)).alias("unit"))


@q("math_tier_weights", """WITH t AS (SELECT o_orderkey, greatest(least(o_totalprice / 400000 - 0.1, 1), 0) AS t FROM orders), w AS (SELECT o_orderkey, 0.8 + t * (0.34 - 0.8) AS a, 0.15 + t * (0.33 - 0.15) AS b, 0.05 + t * (0.33 - 0.05) AS c FROM t)
 SELECT o_orderkey, rnd(a / (a + b + c), 6) AS easy, rnd(b / (a + b + c), 6) AS mid, rnd(c / (a + b + c), 6) AS hard FROM w""")
def math_tier_weights(spark, d):
    w = kl.tier_weights(F.col("o_totalprice") / 400000 - 0.1, [0.8, 0.15, 0.05], [0.34, 0.33, 0.33])
    return table(spark, d, "orders").withColumn("w", w).select("o_orderkey", *[rnd(F.col("w")[i], 6).alias(n) for i, n in enumerate(("easy", "mid", "hard"))])


@q("math_arithmetic", """SELECT o_orderkey, CAST(24576 * k + k * k AS BIGINT) AS workload, CAST(ceil(k / 7.0) AS BIGINT) AS ceil_div, CAST(ceil(k / 7.0) * 7 AS BIGINT) AS round_up, greatest(least(o_totalprice, 200000), 1000) AS clamped
 FROM (SELECT *, o_custkey % 5000 AS k FROM orders)""")
def math_arithmetic(spark, d):
    k = F.col("o_custkey") % 5000
    return table(spark, d, "orders").select("o_orderkey", (24576 * k + k * k).alias("workload"), F.ceil(k / 7.0).alias("ceil_div"), (F.ceil(k / 7.0) * 7).alias("round_up"), kl.clamp(F.col("o_totalprice"), 1000.0, 200000.0).alias("clamped"))


# --- Off-policy correction ---
_SEQ = "sum((logp - old_logp) * mask) OVER (PARTITION BY seq)"
q("offpolicy_weights_token", f"WITH {TOK} SELECT seq, pos, rnd(least({_R} * mask, 2), 6) AS w FROM tok")(lambda spark, d: L.importance_weights(tokens(spark, d)).select("seq", "pos", rnd("w", 6).alias("w")))
q("offpolicy_weights_band", f"WITH {TOK}, x AS (SELECT seq, pos, {_R} * mask AS r FROM tok) SELECT seq, pos, rnd(CASE WHEN r BETWEEN 0.5 AND 2 THEN r ELSE 0 END, 6) AS w FROM x")(lambda spark, d: L.importance_weights(tokens(spark, d), threshold="0.5_2").select("seq", "pos", rnd("w", 6).alias("w")))
q("offpolicy_weights_sequence", f"WITH {TOK}, x AS (SELECT seq, pos, mask, least(exp(greatest(least({_SEQ}, 20), -20)) * mask, 2) AS r FROM tok) SELECT seq, pos, rnd(r / greatest((SELECT avg(r) FROM x WHERE mask = 1), 1e-8), 5) AS w FROM x")(
    lambda spark, d: L.importance_weights(tokens(spark, d), "sequence", 2.0, normalise=True).select("seq", "pos", rnd("w", 5).alias("w"))
)
_K1, _K3 = "(logp - old_logp) * mask", "(exp(logp - old_logp) - 1 - (logp - old_logp)) * mask"
q("offpolicy_rejection_mask", f"""WITH {TOK}, x AS (SELECT seq, pos, mask, {_K1} AS a, sum({_K3}) OVER w / (sum(mask) OVER w + 1e-8) AS b, max({_K3}) OVER w AS c, sum({_K1}) OVER w AS s FROM tok WINDOW w AS (PARTITION BY seq))
 SELECT seq, pos, CASE WHEN mask = 1 AND a BETWEEN ln(0.6) AND ln(1.5) AND b <= 0.02 AND c <= 0.05 AND s BETWEEN ln(1 / 1.8) AND ln(1.8) THEN 1 ELSE 0 END AS kept FROM x""")(
    lambda spark, d: L.rejection_mask(tokens(spark, d), {"token_k1": "0.6_1.5", "seq_mean_k3": 0.02, "seq_max_k3": 0.05, "seq_sum_k1": 1.8}).select("seq", "pos", "kept")
)
q("offpolicy_metrics", f"""WITH {TOK}, o AS (SELECT *, logp - old_logp AS d FROM tok WHERE mask = 1), s AS (SELECT avg(logp) AS l, avg(old_logp) AS o, sum(d) AS sd FROM o GROUP BY seq),
 a AS (SELECT avg(-d) AS kl, avg(exp(d) - d - 1) AS k3_kl, avg(exp(2 * d)) - 1 AS chi2_token FROM o), b AS (SELECT avg(exp(-l)) AS ppl, avg(exp(-o)) AS rollout_ppl, avg(abs(l - o)) AS log_ppl_abs_diff, avg(exp(2 * sd)) - 1 AS chi2_seq FROM s)
 SELECT rnd(kl, 5) AS kl, rnd(k3_kl, 5) AS k3_kl, rnd(chi2_token, 5) AS chi2_token, rnd(ppl, 5) AS ppl, rnd(rollout_ppl, 5) AS rollout_ppl, rnd(log_ppl_abs_diff, 5) AS log_ppl_abs_diff, rnd(chi2_seq, 5) AS chi2_seq FROM a, b""")(
    lambda spark, d: _one(L.offpolicy_metrics(tokens(spark, d)))
)
q("offpolicy_weight_metrics", f"""WITH {TOK}, x AS (SELECT {_R} AS r, least({_R}, 2) AS w FROM tok WHERE mask = 1) SELECT rnd(avg(w), 5) AS mean, rnd(stddev_pop(w), 5) AS std, rnd(sum(w) * sum(w) / (count(*) * sum(w * w)), 5) AS ess,
 rnd(avg(CASE WHEN r > 2 THEN 1.0 ELSE 0.0 END), 5) AS high_share, rnd(avg(CASE WHEN r < 0.5 THEN 1.0 ELSE 0.0 END), 5) AS low_share, rnd(max(r), 5) AS max, rnd(min(r), 5) AS min FROM x""")(
    lambda spark, d: _one(L.weight_metrics(L.importance_weights(tokens(spark, d))))
)
q("offpolicy_bypass_loss", f"WITH {TOK}, l AS (SELECT seq, CASE WHEN mask = 1 AND (logp - old_logp) BETWEEN ln(0.5) AND ln(2) THEN 1 ELSE 0 END AS mask, -adv * logp * least({_R} * mask, 2) AS x FROM tok) " + _REDUCE["seq-mean-token-sum"])(
    lambda spark, d: _one(L.loss(L.rejection_mask(L.importance_weights(tokens(spark, d)), {"token_k1": 2.0}).withColumn("mask", F.col("kept")), "reinforce", "seq-mean-token-sum", weight="w"))
)
q("offpolicy_bypass_logp", f"WITH {TOK} SELECT seq, pos, old_logp AS logp FROM tok")(lambda spark, d: tokens(spark, d).select("seq", "pos", F.col("old_logp").alias("logp")))


# --- Masked statistics ---
_MASK = f"""WITH {TOK}, s AS (SELECT sum(mask) AS n, sum(CASE WHEN mask <> 0 THEN adv * mask ELSE 0 END) AS t FROM tok), m AS (SELECT n, t, t / (n + 1e-8) AS mean FROM s), v AS (SELECT m.*, (SELECT sum((adv - mean) * (adv - mean) * mask) / (n + 1e-8) * n / (n - 1) FROM tok) AS var FROM m)"""


def _masked(spark, d):
    t = tokens(spark, d)
    mean = t.agg(F.sum("mask").alias("n"), kl.masked_sum(F.col("adv"), F.col("mask")).alias("total"), kl.masked_mean(F.col("adv"), F.col("mask")).alias("mean"))
    x = t.crossJoin(F.broadcast(mean))
    var = x.agg(F.first("n").alias("n"), F.first("total").alias("total"), F.first("mean").alias("mean"), (kl.masked_mean((F.col("adv") - F.col("mean")) ** 2, F.col("mask")) * F.first("n") / (F.first("n") - 1)).alias("var"))
    return t, var


q("masked_statistics", _MASK + " SELECT n, rnd(t, 3) AS total, rnd(mean, 6) AS mean, rnd(var, 6) AS var FROM v")(lambda spark, d: _masked(spark, d)[1].select("n", rnd("total", 3).alias("total"), rnd("mean", 6).alias("mean"), rnd("var", 6).alias("var")))


@q("masked_whiten", _MASK + " SELECT seq, pos, rnd((adv - mean) / sqrt(var + 1e-8), 5) AS white FROM tok, v")
def masked_whiten(spark, d):
    t, var = _masked(spark, d)
    return t.crossJoin(F.broadcast(var)).select("seq", "pos", rnd((F.col("adv") - F.col("mean")) / F.sqrt(F.col("var") + 1e-8), 5).alias("white"))


@q("variance_proxy", f"""WITH {TOK}, s AS (SELECT seq, sum((1 - 2 * exp(logp) + exp(2 * logp)) * mask) AS w, avg(adv) AS a FROM tok GROUP BY seq)
 SELECT rnd(avg(a * a * w), 4) AS total_power, rnd(avg(a), 5) AS mean_advantage, rnd(avg(w), 5) AS mean_weight FROM s""")
def variance_proxy(spark, d):
    s = tokens(spark, d).groupBy("seq").agg(F.sum((1 - 2 * F.exp("logp") + F.exp(2 * F.col("logp"))) * F.col("mask")).alias("w"), F.avg("adv").alias("a"))
    return s.agg(rnd(F.avg(F.col("a") ** 2 * F.col("w")), 4).alias("total_power"), rnd(F.avg("a"), 5).alias("mean_advantage"), rnd(F.avg("w"), 5).alias("mean_weight"))


@q("logprob_debug", f"WITH {TOK}, o AS (SELECT exp(logp) AS p, exp(old_logp) AS o FROM tok WHERE mask = 1) SELECT rnd(max(abs(p - o)), 6) AS max_diff, rnd(avg(abs(p - o)), 6) AS mean_diff, rnd(stddev_samp(abs(p - o)), 6) AS std_diff, rnd(corr(p, o), 6) AS pearson FROM o")
def logprob_debug(spark, d):
    o = tokens(spark, d).where("mask = 1").select(F.exp("logp").alias("p"), F.exp("old_logp").alias("o"))
    x = F.abs(F.col("p") - F.col("o"))
    return o.agg(rnd(F.max(x), 6).alias("max_diff"), rnd(F.avg(x), 6).alias("mean_diff"), rnd(F.stddev_samp(x), 6).alias("std_diff"), rnd(F.corr("p", "o"), 6).alias("pearson"))


QUERIES, SQL = q.queries, q.sql
