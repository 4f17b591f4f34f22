"""Grading, reward, conversation and micro-batch queries."""

import re

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sparkloom.common import table
from sparkloom.functions import grading as G
from sparkloom.operators import batches as B
from sparkloom.operators import microbatches as M
from sparkloom.operators import scoring as S
from sparkloom.plans.base import TOK, Book, rnd, tokens

q = Book()


def _orders(s, d):
    return table(s, d, "orders")


q("grade_final_answer", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a FROM orders")(lambda s, d: _orders(s, d).select("o_orderkey", G.final_answer(F.concat(F.lit("x = \\$"), F.format_number("o_custkey", 0), F.lit(" dollars"))).alias("a")))
q("grade_minerva", "SELECT o_orderkey, o_orderkey % 2 = 0 AS ok FROM orders")(
    lambda s, d: _orders(s, d).select("o_orderkey", G.minerva(F.concat(F.lit("Answer: 1\nanswer: \\text{"), (F.col("o_orderkey") + F.col("o_orderkey") % 2).cast("string"), F.lit("}")), F.col("o_orderkey").cast("string")).alias("ok"))
)
q("grade_strict_box", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS score FROM orders")(
    lambda s, d: _orders(s, d).select("o_orderkey", G.strict_box(F.concat(F.lit("so \\boxed{"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-1).cast("string"), F.lit("}.")), F.col("o_custkey").cast("string")).alias("score"))
)
#: Answers in six notations, by the order's key, and truths that some of them miss.
_CASES = ["\\dfrac{@a@}{7}", "\\frac{@b@}{14}", "@a@\\div 7", "x=@a@/7", "\\left(\\frac{@a@}7\\right)", "\\sqrt{\\frac{@c@}{49}}"]


def _math_cases(s, d):
    n, a = F.col("o_orderkey") % 6, F.col("o_custkey") + F.col("o_orderkey") % 2
    fill = {"a": a, "b": a * 2, "c": a * a}
    text = None
    for i, form in enumerate(_CASES):
        parts = [F.lit(x) if j % 2 == 0 else fill[x].cast("string") for j, x in enumerate(re.split(r"@([abc])@", form))]
        one = F.concat(*parts)
        text = F.when(n == i, one) if text is None else text.when(n == i, one)
    return _orders(s, d).select("o_orderkey", text.alias("given"), F.concat(F.col("o_custkey").cast("string"), F.lit("/7")).alias("truth"))


q("grade_math", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM orders")(
    lambda s, d: _math_cases(s, d).select("o_orderkey", G.math_score(F.concat(F.lit("so \\boxed{0}, no: \\boxed{"), "given", F.lit("}.")), F.col("truth")).alias("score"))
)
q("grade_tuples", "SELECT o_orderkey, o_orderkey % 3 = 0 AS same FROM orders")(
    lambda s, d: _orders(s, d).select("o_orderkey", G.answer_equal(F.concat(F.when(F.col("o_orderkey") % 3 == 1, "[").otherwise("("), (F.col("o_custkey") * 2).cast("string"), F.lit("/2, "), F.when(F.col("o_orderkey") % 3 == 2, "x").otherwise("x+0"), F.when(F.col("o_orderkey") % 3 == 2, "]").otherwise(")")), F.concat(F.lit("("), F.col("o_custkey").cast("string"), F.lit(",x)"))).alias("same"))
)
q("grade_expressions", "SELECT o_orderkey, o_orderkey % 2 = 0 AS same FROM orders")(
    lambda s, d: _orders(s, d).select("o_orderkey", G.numeric_equal(F.concat(F.lit("(x+"), F.col("o_custkey").cast("string"), F.lit(")^2")), F.concat(F.lit("x^2+"), (F.col("o_custkey") * 2).cast("string"), F.lit("x+"), (F.col("o_custkey") * F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string"))).alias("same"))
)
q("grade_numeric", "SELECT o_orderkey, abs(o_totalprice * 1.00005 - o_totalprice) <= 1e-4 * o_totalprice AS near, o_custkey = o_custkey + o_orderkey % 2 * o_custkey AS same FROM orders")(
    lambda s, d: _orders(s, d).select("o_orderkey", G.numeric_equal((F.col("o_totalprice") * 1.00005).cast("string"), F.col("o_totalprice").cast("string")).alias("near"), G.numeric_equal(F.concat((F.col("o_custkey") * 3).cast("string"), F.lit("/3")), (F.col("o_custkey") + F.col("o_orderkey") % 2 * F.col("o_custkey")).cast("string")).alias("same"))
)
q("grade_shape", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 0.0 ELSE 1.0 END AS score FROM orders")(
    lambda s, d: _orders(s, d).select("o_orderkey", G.shape_score(F.when(F.col("o_orderkey") % 3 == 0, "<think>a</think>\n<response>b</response>").when(F.col("o_orderkey") % 3 == 1, "<think>a</think>\n<tool_call>\n{}\n</tool_call>").otherwise("<response>b</response>"), F.when(F.col("o_orderkey") % 3 == 1, "<tool_call>").otherwise("<response>")).alias("score"))
)
q("grade_geometry", "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.1 END AS DOUBLE) AS score FROM orders")(
    lambda s, d: _orders(s, d).withColumn("a", F.concat(F.lit("<think>t</think>\\boxed{"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-1).cast("string"), F.lit("}"))).select(
        "o_orderkey", rnd(0.9 * G.math_score(F.col("a"), F.col("o_custkey").cast("string")) + 0.1 * F.col("a").rlike(r"(?s)<think>.*</think>.*\\boxed\{.*\}").cast("double"), 6).alias("score")
    )
)
q("reward_tool_calls", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3.0 WHEN 1 THEN -3.0 + 6.0 * 2.0 / 3.0 WHEN 2 THEN -3.0 + 6.0 * 0.5 / 3.0 + 6.0 * 2.0 / 3.0 ELSE -3.0 END AS score FROM events")(lambda s, d: _tool_rewards(s, d))


def _tool_rewards(s, d):
    """The call itself; another value; the call behind one of another name; what is no call."""
    e = table(s, d, "events")
    call = lambda name, k: F.concat(F.lit('{"name": "'), name, F.lit('", "parameters": {"k": '), k.cast("string"), F.lit("}}"))
    right, other = call(F.col("event_type"), F.col("user_id")), call(F.col("event_type"), F.col("user_id") + 1)
    n = F.col("event_id") % 4
    said = F.when(n == 0, right).when(n == 1, other).when(n == 2, F.concat(call(F.lit("none"), F.lit(1)), F.lit(", "), right))
    read = lambda c: F.from_json(c, S.CALLS)
    e = e.select("event_id", read(F.concat(F.lit("["), right, F.lit("]"))).alias("truth"), F.when(n == 3, read(F.lit("[not json"))).otherwise(read(F.concat(F.lit("["), said, F.lit("]")))).alias("said"))
    return e.select("event_id", S.tool_call_reward(F.col("truth"), F.col("said")).alias("score"))


q("reward_failures_count_zero", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS score FROM events")(
    lambda s, d: S.score_batches(table(s, d, "events").withColumn("x", F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.col("user_id").cast("string"))), "event_id", ["x"], lambda x: (int(x), "extra"))
)
q("reward_components", "SELECT event_id, rnd(value / 100, 6) AS acc, CASE WHEN length(event_type) > 5 THEN 0.1 ELSE 0.0 END AS fmt, rnd(value / 100 + CASE WHEN length(event_type) > 5 THEN 0.1 ELSE 0.0 END, 6) AS total FROM events")(
    lambda s, d: table(s, d, "events").withColumn("r", F.struct((F.col("value") / 100).alias("acc"), F.when(F.length("event_type") > 5, 0.1).otherwise(0.0).alias("fmt"))).select("event_id", rnd("r.acc", 6).alias("acc"), "r.fmt", rnd(F.col("r.acc") + F.col("r.fmt"), 6).alias("total"))
)

# --- Conversations ---


def _talk(s, d):
    call = F.to_json(F.struct(F.lit("submit_answer").alias("name"), F.struct(F.col("event_type").alias("answer")).alias("arguments")))
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return table(s, d, "events").select("event_id", F.array(m("user", F.lit("question")), m("assistant", F.lit("thinking <image>")), m("tool_call", call), m("tool_response", F.lit("ok"))).alias("messages"))


q("talk_answer_instead_of_call", "SELECT event_id, 2 AS n, concat('thinking <image>', chr(10), chr(10), '<answer>', event_type, '</answer>') AS last FROM events")(
    lambda s, d: _talk(s, d).withColumn("m", S.answer_instead_of_call(F.col("messages"))).select("event_id", F.size("m").alias("n"), F.element_at("m", -1)["content"].alias("last"))
)
q("talk_image_tags", "SELECT event_id, event_id % 2 = 1 AS ok FROM events")(lambda s, d: _talk(s, d).select("event_id", S.image_tags_match(F.col("messages"), F.slice(F.array(F.lit("a")), F.lit(1), (F.col("event_id") % 2).cast("int"))).alias("ok")))
q("talk_external_images", "SELECT video_idx, 0 AS message_no, 0 AS image_no, 'image/png' AS mime, sha256(title) AS sha256, octet_length(encode(title)) AS bytes FROM videos WHERE title <> ''")(
    lambda s, d: S.external_images(table(s, d, "videos").where("title <> ''").select("video_idx", F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("see data:image/png;base64,"), F.regexp_replace(F.base64(F.encode("title", "UTF-8")), r"\s", ""), F.lit(" there")).alias("content"))).alias("m")), "video_idx", "m")
)
q("talk_media_parts", "SELECT event_id, CAST(unnest([0, 1, 2]) AS INT) AS at, unnest(['text', 'image', 'text']) AS type, unnest(['look ', '<image>', event_type]) AS value FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.posexplode(S.media_parts(F.concat(F.lit("look <image>"), "event_type"))).alias("at", "p")).select("event_id", "at", "p.type", "p.value")
)
q("talk_roles", "SELECT event_id, ['user', 'assistant', 'tool_call', 'tool_response'] AS roles FROM events")(lambda s, d: _talk(s, d).select("event_id", F.transform(S.exchange_roles(F.col("messages")), lambda m: m["role"]).alias("roles")))

_CASE = "concat('case_', CAST(event_id AS VARCHAR), '_x')"
q("sink_case_samples", f"""SELECT {_CASE} AS case_id, '{{"messages":[{{"role":"user","content":"look <image>"}},{{"role":"tool_response","content":"' || event_type || '"}}],"images":["images/case_' || CAST(event_id AS VARCHAR) || '_x/0_0"]}}' AS sample, true AS tags_match FROM events""")(lambda s, d: _exported(s, d)[0])
q("sink_case_metadata", f"""SELECT {_CASE} AS case_id, '{{"user_id":' || CAST(user_id AS VARCHAR) || '}}' AS metadata FROM events""")(lambda s, d: _exported(s, d)[1])


def _exported(s, d):
    import uuid

    from sparkloom.common import shared_dir

    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    e = table(s, d, "events").select(F.concat(F.lit("case/"), F.col("event_id").cast("string"), F.lit(" x!")).alias("row"), F.array(m("user", F.lit("look data:image/png;base64,QUJD")), m("tool", F.col("event_type"))).alias("m"), F.struct("user_id").alias("meta"))
    return S.export_cases(e, "row", "m", "meta", f"{shared_dir(s)}/cases-{uuid.uuid4().hex}")


# --- Filters ---
q("filter_long_prompts", "SELECT doc_id FROM documents WHERE coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+')), 201) <= 200")(
    lambda s, d: table(s, d, "documents").where(F.coalesce(F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))), F.lit(201)) <= 200).select("doc_id")
)
q("filter_run", "SELECT event_id FROM events WHERE CAST(user_id % 3 AS VARCHAR) = '1' AND event_type IN (SELECT DISTINCT event_type FROM events WHERE user_id = 1)")(
    lambda s, d: table(s, d, "events").where((F.col("user_id") % 3).cast("string") == "1").join(table(s, d, "events").where("user_id = 1").select("event_type").distinct(), "event_type", "left_semi").select("event_id")
)
q("filter_padding_unless_all", "WITH e AS (SELECT *, user_id % 2 = 1 AND event_type = (SELECT min(event_type) FROM events) AS pad FROM events) SELECT event_type, count(*) AS n, rnd(avg(value), 5) AS mean FROM e WHERE NOT pad OR (SELECT count(*) FROM e WHERE NOT pad) = 0 GROUP BY 1")(
    lambda s, d: _padding(table(s, d, "events"))
)


def _padding(e):
    low = e.agg(F.min("event_type").alias("low"))
    e = e.crossJoin(F.broadcast(low)).withColumn("pad", (F.col("user_id") % 2 == 1) & (F.col("event_type") == F.col("low")))
    some = e.agg(F.count_if(~F.col("pad")).alias("real"))
    return e.crossJoin(F.broadcast(some)).where(~F.col("pad") | (F.col("real") == 0)).groupBy("event_type").agg(F.count("*").alias("n"), rnd(F.avg("value"), 5).alias("mean"))


q("filter_seed_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), c AS (SELECT doc_id, regexp_replace(x, '^[\\s\\-*•\\d.)]+|\\s+$', '', 'g') AS x FROM l) SELECT doc_id, x FROM c WHERE length(x) BETWEEN 2 AND 80")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.regexp_replace("x", r"^[\s\-*•\d.)]+|\s+$", "").alias("x")).where(F.length("x").between(2, 80))
)
q("batch_upsample", "SELECT o_orderkey, false AS is_padding FROM orders UNION ALL SELECT -1 - i, true FROM (SELECT unnest(range((64 - count(*) % 64) % 64)) AS i FROM orders)")(lambda s, d: _upsample(s, d))


def _upsample(spark, d, multiple: int = 64):
    """Flagged synthetic rows up to a multiple, each with a key of its own."""
    o = _orders(spark, d).select("o_orderkey", F.lit(False).alias("is_padding"))
    n = o.count()
    return o.unionByName(spark.range(-n % multiple).select((-1 - F.col("id")).alias("o_orderkey"), F.lit(True).alias("is_padding")))


# --- Micro-batches ---
_LEN = "(o_orderkey * 7919) % 1900 + 10"
q("micro_batches")(lambda s, d: M.assign(_orders(s, d).select(F.floor(F.col("o_orderkey") / 256).alias("b"), "o_orderkey", F.expr(_LEN).alias("n")), "b", "o_orderkey", "n", 8192))
q("micro_batches_fit", f"SELECT CAST(floor(o_orderkey / 256) AS BIGINT) AS batch, count(*) AS placed, 0 AS over, true AS few FROM orders GROUP BY 1")(
    lambda s, d: _fit(s, d)
)


def _fit(spark, d):
    """All rows are placed once, no micro-batch is over the budget, and there are at most two more than the tokens need."""
    o = _orders(spark, d).select(F.floor(F.col("o_orderkey") / 256).alias("batch"), F.col("o_orderkey").alias("key"), F.expr(_LEN).alias("n"))
    m = M.assign(o, "batch", "key", "n", 8192).join(o, ["batch", "key"]).groupBy("batch", "micro_batch").agg(F.count("*").alias("placed"), F.sum("n").alias("n"))
    return m.groupBy("batch").agg(F.sum("placed").alias("placed"), F.count_if(F.col("n") > 8192).cast("int").alias("over"), (F.count("*") <= F.ceil(F.sum("n") / 8192) + 2).alias("few"))


q("balance_greedy", f"""WITH RECURSIVE o AS (SELECT CAST(floor(o_orderkey / 128) AS BIGINT) AS batch, o_orderkey AS key, {_LEN} AS n, row_number() OVER (PARTITION BY floor(o_orderkey / 128) ORDER BY o_orderkey) AS k FROM orders),
 r AS (SELECT batch, key, k, CAST(1 AS INT) AS slot, [n, 0, 0, 0] AS sums FROM o WHERE k = 1
 UNION ALL SELECT o.batch, o.key, o.k, list_position(r.sums, list_min(r.sums)), list_transform(r.sums, lambda x, i: x + CASE WHEN i = list_position(r.sums, list_min(r.sums)) THEN o.n ELSE 0 END) FROM r JOIN o ON o.batch = r.batch AND o.k = r.k + 1)
 SELECT batch, key, CAST(slot - 1 AS INT) AS rank, CAST(row_number() OVER (PARTITION BY batch, slot ORDER BY key) - 1 AS INT) AS place FROM r""")(
    lambda s, d: M.greedy_assign(_orders(s, d).withColumn("b", F.floor(F.col("o_orderkey") / 128)).withColumn("n", F.expr(_LEN)), "b", "o_orderkey", "n", 4)
)
q("balance_ranks", "SELECT b AS batch, 4 AS ranks, 8 AS least, 8 AS most, true AS hills FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 32) AS BIGINT) AS b FROM orders) GROUP BY 1 HAVING count(*) = 32")(lambda s, d: _ranks(s, d))


def _ranks(spark, d):
    """Whole batches of 32: four ranks of eight rows, whose loads rise and fall once."""
    o = B.with_positions(_orders(spark, d).select("o_orderkey", F.expr(_LEN).alias("n")), "o_orderkey", name="at").withColumn("b", F.floor(F.col("at") / 32))
    whole = o.groupBy("b").count().where("count = 32").select("b")
    r = M.balance_ranks(o.join(whole, "b", "left_semi"), "b", "o_orderkey", "n", 4).join(o.select(F.col("o_orderkey").alias("key"), "n"), "key")
    loads = r.groupBy("batch", "rank").agg(F.count("*").alias("rows"), F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("l"))
    top = F.array_position("l", F.array_max("l")).cast("int")
    hill = (F.slice("l", F.lit(1), top) == F.array_sort(F.slice("l", F.lit(1), top))) & (F.slice("l", top, F.size("l")) == F.sort_array(F.slice("l", top, F.size("l")), asc=False))
    return loads.groupBy("batch").agg(F.count("*").cast("int").alias("ranks"), F.min("rows").cast("int").alias("least"), F.max("rows").cast("int").alias("most"), F.every(hill).alias("hills"))


q("batch_required_multiple", "SELECT lcm(lcm(6, 4), 9) AS multiple, CAST(ceil(count(*) / 36.0) * 36 AS BIGINT) AS padded FROM orders")(
    lambda s, d: _orders(s, d).agg(F.lit(M.required_multiple([6, 4, 9])).cast("bigint").alias("multiple"), (F.ceil(F.count("*") / M.required_multiple([6, 4, 9])) * M.required_multiple([6, 4, 9])).cast("bigint").alias("padded"))
)
q("balance_groups")(lambda s, d: _grouped(s, d))
q("balance_group_members", f"WITH g AS (SELECT o_custkey % 16 AS batch, o_custkey AS uid, sum(24576 * ({_LEN}) + ({_LEN}) * ({_LEN})) AS load FROM orders GROUP BY 1, 2) SELECT batch, count(*) AS uids, least(8, count(*)) AS parts, sum(load) AS load, true AS even FROM g GROUP BY 1")(lambda s, d: _grouped_fit(s, d))


def _grouped(s, d):
    return M.group_balanced(_orders(s, d).withColumn("b", F.col("o_custkey") % 16).withColumn("n", F.expr(_LEN)), "b", "o_custkey", "n", 8)


def _grouped_fit(s, d):
    """Each uid in one partition, every partition used, no two loads further apart than the heaviest uid."""
    n = F.expr(_LEN)
    loads = _orders(s, d).groupBy(F.col("o_custkey").alias("uid")).agg(F.sum(24576 * n + n * n).alias("load"))
    parts = _grouped(s, d).join(loads, "uid").groupBy("batch", "partition").agg(F.count("*").alias("uids"), F.sum("load").alias("load"), F.max("load").alias("most"))
    return parts.groupBy("batch").agg(F.sum("uids").alias("uids"), F.count("*").alias("parts"), F.sum("load").alias("load"), (F.max("load") - F.min("load") <= F.max("most")).alias("even"))


# --- Statistics of rejection ---


q("offpolicy_rejection_metrics", f"""WITH {TOK}, s AS (SELECT seq, sum((logp - old_logp) * mask) / (sum(mask) + 1e-8) AS x, sum(mask) AS n FROM tok GROUP BY seq) SELECT rnd(avg(x), 6) AS mean, rnd(min(x), 6) AS min, rnd(max(x), 6) AS max, rnd(stddev_samp(x), 6) AS std,
 rnd(avg(CASE WHEN x > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS above, rnd(avg(CASE WHEN x < -0.1 THEN 1.0 ELSE 0.0 END), 6) AS below FROM s WHERE n > 0""")(
    lambda s, d: tokens(s, d).groupBy("seq").agg((F.sum((F.col("logp") - F.col("old_logp")) * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("x"), F.sum("mask").alias("n")).where("n > 0").agg(
        rnd(F.avg("x"), 6).alias("mean"), rnd(F.min("x"), 6).alias("min"), rnd(F.max("x"), 6).alias("max"), rnd(F.stddev_samp("x"), 6).alias("std"), rnd(F.avg((F.col("x") > 0.1).cast("double")), 6).alias("above"), rnd(F.avg((F.col("x") < -0.1).cast("double")), 6).alias("below")
    )
)

# --- Extension points ---


@udtf(returnType="n: bigint, square: bigint")
class Squares:
    """A generator as a table function: n rows per call."""

    def eval(self, n: int):
        for i in range(n):
            yield i, i * i


@q("extension_table_function", "SELECT n_nationkey, i AS n, i * i AS square FROM nation, LATERAL (SELECT unnest(range(n_regionkey + 1)) AS i)")
def extension_table_function(spark, d):
    spark.udtf.register("sparkloom_squares", Squares)
    table(spark, d, "nation").createOrReplaceTempView("sparkloom_nation")
    return spark.sql("SELECT n_nationkey, s.n, s.square FROM sparkloom_nation, LATERAL sparkloom_squares(CAST(n_regionkey + 1 AS BIGINT)) s")


q("extension_weighted_copies", "SELECT o_orderkey, CAST(unnest(range(1, o_orderkey % 3 + 1)) AS INT) AS copy FROM orders WHERE o_orderkey % 3 > 0")(
    lambda s, d: B.repeat_by(_orders(s, d).select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("c")), "c").select("o_orderkey", "copy")
)
q("sink_replay_step", "SELECT event_id, CAST(user_id % 3 AS INT) AS step FROM events")(lambda s, d: _replay(s, d))


def _replay(spark, d):
    """Steps already written are read, missing ones computed and written."""
    import uuid

    from sparkloom.common import shared_dir
    from sparkloom.sources.files import _exists

    root = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("int").alias("step"))
    e.where("step = 0").write.parquet(f"{root}/step=0")
    for step in range(3):
        if not _exists(spark, f"{root}/step={step}/_SUCCESS"):
            e.where(F.col("step") == step).write.parquet(f"{root}/step={step}")
    return spark.read.parquet(*[f"{root}/step={step}" for step in range(3)]).select("event_id", "step")


QUERIES, SQL = q.queries, q.sql
