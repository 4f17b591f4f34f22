"""Selection, batching, set, sort and join queries of the batch protocol."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.operators import batches as B
from sparkloom.plans.base import ROLL, Book, drawn, rnd, rollouts, uniform

q = Book()
_POS = "p AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_pos, count(*) OVER () AS n FROM orders)"


def _orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return B.with_positions(o, "o_orderkey"), o.count()


q("batch_select", "SELECT o_orderkey, o_totalprice FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice"))
q("batch_rename", "SELECT o_orderkey AS key, o_totalprice AS price FROM orders")(lambda s, d: table(s, d, "orders").withColumnsRenamed({"o_orderkey": "key", "o_totalprice": "price"}).select("key", "price"))
q("batch_pop", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")(lambda s, d: table(s, d, "orders").drop("o_custkey", "o_totalprice", "o_orderdate"))
q("batch_mask_select", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")(lambda s, d: table(s, d, "orders").where("o_totalprice > 100000").select("o_orderkey"))


@q("batch_positions", f"WITH {_POS} SELECT o_orderkey, row_pos FROM p")
def batch_positions(spark, d):
    return _orders(spark, d)[0].select("o_orderkey", "row_pos")


@q("batch_take", f"WITH {_POS}, i AS (SELECT c_custkey - 1 AS out, (c_custkey * 7) % (SELECT count(*) FROM orders) AS row_pos FROM customer) SELECT p.o_orderkey, i.out AS row_pos FROM i JOIN p USING (row_pos)")
def batch_take(spark, d):
    """Row selection by an index list with repeats."""
    p, n = _orders(spark, d)
    i = table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("out"), (F.col("c_custkey") * 7 % n).alias("row_pos"))
    return B.take(p.select("o_orderkey", "row_pos"), i)


@q("batch_slice", f"WITH {_POS} SELECT o_orderkey FROM p WHERE row_pos >= 10 AND row_pos < n - 5 AND (row_pos - 10) % 3 = 0")
def batch_slice(spark, d):
    p, n = _orders(spark, d)
    return B.python_slice(p, n, 10, -5, 3).select("o_orderkey")


@q("batch_slice_backwards", f"WITH {_POS} SELECT o_orderkey FROM p WHERE row_pos <= n - 1 AND (n - 1 - row_pos) % 2 = 0")
def batch_slice_backwards(spark, d):
    p, n = _orders(spark, d)
    return B.python_slice(p, n, None, None, -2).select("o_orderkey")


@q("batch_repeat_interleave", f"WITH {_POS} SELECT o_orderkey, row_pos * 3 + r AS row_pos FROM p, range(3) t(r)")
def batch_repeat_interleave(spark, d):
    return B.repeat(_orders(spark, d)[0].select("o_orderkey", "row_pos"), 3)


@q("batch_repeat_tile", f"WITH {_POS} SELECT o_orderkey, r * n + row_pos AS row_pos FROM p, range(2) t(r)")
def batch_repeat_tile(spark, d):
    p, n = _orders(spark, d)
    return B.repeat(p.select("o_orderkey", "row_pos"), 2, interleave=False, n=n)


@q("batch_repeat_by_row", "SELECT o_orderkey, CAST(unnest(range(1, o_custkey % 4 + 1)) AS INT) AS copy FROM orders WHERE o_custkey % 4 > 0")
def batch_repeat_by_row(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("c"))
    return B.repeat_by(o, "c").select("o_orderkey", "copy")


@q("batch_pad_to_divisor", f"WITH {_POS}, m AS (SELECT (64 - max(n) % 64) % 64 AS miss, max(n) AS n FROM p) SELECT o_orderkey, row_pos, false AS is_padding FROM p UNION ALL SELECT o_orderkey, row_pos + m.n, true FROM p, m WHERE row_pos < miss")
def batch_pad_to_divisor(spark, d):
    p, n = _orders(spark, d)
    return B.pad_to_divisor(p.select("o_orderkey", "row_pos"), n, 64)


@q("batch_unpad", f"WITH {_POS} SELECT o_orderkey FROM p WHERE row_pos < n - 7")
def batch_unpad(spark, d):
    p, n = _orders(spark, d)
    return p.where(F.col("row_pos") < n - 7).select("o_orderkey")


@q("batch_chunk", f"WITH {_POS} SELECT o_orderkey, CAST(row_pos // (n // 5) AS INT) AS chunk FROM p")
def batch_chunk(spark, d):
    p, n = _orders(spark, d)
    return B.chunk(p, n, 5).select("o_orderkey", "chunk")


@q("batch_split", f"WITH {_POS} SELECT o_orderkey, row_pos // 64 AS part FROM p")
def batch_split(spark, d):
    return B.split(_orders(spark, d)[0], 64).select("o_orderkey", "part")


@q("batch_split_drop_rest", f"WITH {_POS} SELECT o_orderkey, row_pos // (n // 7) AS part FROM p WHERE row_pos < n // 7 * 7")
def batch_split_drop_rest(spark, d):
    p, n = _orders(spark, d)
    return B.split(p, n // 7).where(F.col("row_pos") < n // 7 * 7).select("o_orderkey", "part")


@q("batch_fold", f"WITH {_POS} SELECT row_pos // 8 AS fold, list(o_orderkey ORDER BY row_pos) AS o_orderkey FROM p GROUP BY 1")
def batch_fold(spark, d):
    return B.fold_rows(_orders(spark, d)[0], 8, ["o_orderkey"])


@q("batch_unfold", f"WITH {_POS} SELECT row_pos // 8 AS fold, CAST(row_pos % 8 AS INT) AS at, o_orderkey FROM p")
def batch_unfold(spark, d):
    return B.unfold_rows(B.fold_rows(_orders(spark, d)[0], 8, ["o_orderkey"]), ["o_orderkey"])


@q("batch_column_chunks", "SELECT vec_id, CAST(c AS INT) AS chunk, embedding[c * 16 + 1 : c * 16 + 16] AS part FROM embeddings, range(4) t(c)")
def batch_column_chunks(spark, d):
    """An array column split into n rows, the others repeated."""
    e = table(spark, d, "embeddings").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return e.select("vec_id", "chunk", F.slice("embedding", F.col("chunk") * 16 + 1, F.lit(16)).alias("part"))


@q("batch_mini_batches", f"WITH {_POS} SELECT e AS epoch, row_pos // 32 AS mini_batch, o_orderkey FROM p, range(2) t(e)")
def batch_mini_batches(spark, d):
    p = _orders(spark, d)[0].withColumn("epoch", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    return p.select("epoch", F.floor(F.col("row_pos") / 32).alias("mini_batch"), "o_orderkey")


@q("batch_reorder", f"WITH {_POS} SELECT o_orderkey, (row_pos + n // 2) % n AS row_pos FROM p")
def batch_reorder(spark, d):
    """Rows moved by a permutation of positions."""
    p, n = _orders(spark, d)
    return p.select("o_orderkey", ((F.col("row_pos") + n // 2) % n).alias("row_pos"))


@q("batch_reverse_index", f"WITH {_POS}, m AS (SELECT row_pos AS pos, (row_pos + n // 3) % n AS idx FROM p) SELECT idx AS pos, pos AS idx FROM m")
def batch_reverse_index(spark, d):
    p, n = _orders(spark, d)
    return p.select(((F.col("row_pos") + n // 3) % n).alias("pos"), F.col("row_pos").alias("idx"))


@q("batch_union_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def batch_union_columns(spark, d):
    o = table(spark, d, "orders")
    return B.union_columns(o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@q("batch_concat", "SELECT c_custkey AS key, c_acctbal AS bal, 'customer' AS src FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def batch_concat(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.lit("customer").alias("src"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("src")))


q("batch_rows_to_columns", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")(
    lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
)

# --- Array columns ---
_ARR = "a AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1)"


def _arrays(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))


q("array_pad_right", f"WITH {_ARR} SELECT k, list_concat(ids, [-1 FOR x IN range(greatest(12 - len(ids), 0))]) AS ids FROM a")(lambda s, d: _arrays(s, d).select("k", B.pad(F.col("ids"), 12, F.lit(-1).cast("bigint")).alias("ids")))
q("array_pad_left", f"WITH {_ARR} SELECT k, list_concat([-1 FOR x IN range(greatest(12 - len(ids), 0))], ids) AS ids FROM a")(lambda s, d: _arrays(s, d).select("k", B.pad(F.col("ids"), 12, F.lit(-1).cast("bigint"), left=True).alias("ids")))
for _side, _cut in (("left", "ids[len(ids) - 5 :]"), ("right", "ids[1 : 6]"), ("middle", "list_concat(ids[1 : 3], ids[len(ids) - 2 :])")):
    q(f"array_fit_{_side}", f"WITH {_ARR} SELECT k, CASE WHEN len(ids) > 6 THEN {_cut} ELSE list_concat([-1 FOR x IN range(6 - len(ids))], ids) END AS ids FROM a")(
        lambda s, d, side=_side: _arrays(s, d).select("k", B.fit(F.col("ids"), 6, -1, truncation=side).alias("ids"))
    )
q("array_response_mask", f"WITH {_ARR} SELECT k, [CASE WHEN list_position(ids, ids[2]) IS NULL OR i <= list_position(ids, ids[2]) THEN 1 ELSE 0 END FOR x, i IN ids] AS mask FROM a WHERE len(ids) > 2")(
    lambda s, d: _arrays(s, d).where(F.size("ids") > 2).select("k", B.response_mask(F.col("ids"), F.col("ids")[1]).alias("mask"))
)
q("array_remove_padding", f"WITH {_ARR} SELECT k, ids[len(ids) - len(ids) // 2 + 1 :] AS ids FROM a")(
    lambda s, d: _arrays(s, d).select("k", B.last_masked(F.col("ids"), F.transform("ids", lambda x, i: (i >= F.size("ids") - F.floor(F.size("ids") / 2)).cast("int"))).alias("ids"))
)
q("array_preference_pair", f"WITH {_ARR} SELECT k, list_concat(list_concat(ids, [k]), [0 FOR x IN range(greatest(15 - len(ids), 0))])[1 : 16] AS chosen FROM a")(
    lambda s, d: _arrays(s, d).select("k", F.slice(B.pad(F.concat("ids", F.array("k")), 16, F.lit(0).cast("bigint")), 1, 16).alias("chosen"))
)

# --- Sort, dedup, anti-join, joins ---
q("dedup_first_by_url", "SELECT record_id, fake_url FROM (SELECT record_id, fake_url, row_number() OVER (PARTITION BY fake_url ORDER BY record_id) AS r FROM batch_records) WHERE r = 1 OR fake_url = ''")(
    lambda s, d: B.first_per_key(table(s, d, "batch_records").select("record_id", "fake_url"), "fake_url", "record_id", keep_empty=True)
)
q("dedup_last_by_id", "SELECT arg_max(record_id, record_id) AS record_id, video_id FROM batch_records GROUP BY video_id")(
    lambda s, d: B.first_per_key(table(s, d, "batch_records").select("record_id", "video_id"), "video_id", "record_id", last=True)
)
q("url_map_last_wins", "SELECT fake_url, arg_max(local_path, record_id) AS local_path FROM batch_records GROUP BY fake_url")(
    lambda s, d: table(s, d, "batch_records").groupBy("fake_url").agg(F.max_by("local_path", "record_id").alias("local_path"))
)
q("resume_pending", "SELECT record_id, batch_id FROM batch_records b WHERE NOT EXISTS (SELECT 1 FROM checkpoint_state c WHERE c.batch_id = b.batch_id)")(
    lambda s, d: table(s, d, "batch_records").join(table(s, d, "checkpoint_state").select("batch_id"), "batch_id", "left_anti").select("record_id", "batch_id")
)
q("resume_state", "WITH s AS (SELECT unnest(list_concat(seen_video_ids, skipped_video_ids)) AS v FROM checkpoint_state) SELECT (SELECT count(DISTINCT v) FROM s) AS seen, (SELECT max(batch_id) + 1 FROM checkpoint_state) AS next_batch")(
    lambda s, d: table(s, d, "checkpoint_state").select(F.explode(F.concat("seen_video_ids", "skipped_video_ids")).alias("v")).agg(F.countDistinct("v").alias("seen")).crossJoin(table(s, d, "checkpoint_state").agg((F.max("batch_id") + 1).alias("next_batch")))
)
q("resume_key_anti_join", "SELECT doc_id FROM documents d WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM videos v WHERE lower(trim(v.video_id)) = lower(trim(d.video_id)))")(
    lambda s, d: table(s, d, "documents").where("source is not null").withColumn("k", F.lower(F.trim("video_id"))).join(table(s, d, "videos").select(F.lower(F.trim("video_id")).alias("k")), "k", "left_anti").select("doc_id")
)
q("stage_status_last", f"WITH {ROLL} SELECT uid, arg_max(kind, idx) AS status, arg_min(kind, idx) AS first_status FROM roll GROUP BY uid")(
    lambda s, d: rollouts(s, d).groupBy("uid").agg(F.max_by("kind", "idx").alias("status"), F.min_by("kind", "idx").alias("first_status"))
)
q("commit_offsets", "WITH b AS (SELECT batch_id, count(*) AS n FROM batch_records WHERE batch_id IN (SELECT batch_id FROM checkpoint_state) GROUP BY 1), o AS (SELECT batch_id, coalesce(sum(n) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b) SELECT r.record_id, CAST(start AS BIGINT) + record_no AS video_idx FROM batch_records r JOIN o USING (batch_id)")(
    lambda s, d: _commit_offsets(s, d)
)


def _commit_offsets(spark, d):
    """Committed batches merged: local numbers shifted by the sizes of the batches before."""
    r = table(spark, d, "batch_records").join(table(spark, d, "checkpoint_state").select("batch_id"), "batch_id", "left_semi")
    sizes = r.groupBy("batch_id").agg(F.count("*").alias("n"))
    # One row per batch: a window over them in one task is small.
    before = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("batch_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return r.join(start, "batch_id").select("record_id", (F.col("start") + F.col("record_no")).alias("video_idx"))


q("join_keyframes", "SELECT m.vector_row, m.timestamp, v.title FROM keyframe_meta m JOIN videos v ON v.video_idx = m.video_idx")(
    lambda s, d: table(s, d, "keyframe_meta").join(table(s, d, "videos").select("video_idx", "title"), "video_idx").select("vector_row", "timestamp", "title")
)
q("join_bridge", "SELECT b.record_id, v.subtitle FROM batch_records b LEFT JOIN (SELECT video_id, max(nullif(subtitle, '')) AS subtitle FROM videos GROUP BY 1) v ON v.video_id = trim(b.video_id)")(
    lambda s, d: table(s, d, "batch_records").select("record_id", F.trim("video_id").alias("video_id")).join(table(s, d, "videos").groupBy("video_id").agg(F.max(F.nullif("subtitle", F.lit(""))).alias("subtitle")), "video_id", "left").select("record_id", "subtitle")
)


@q("join_transcript_window", """SELECT k.vector_row, s.seg_id FROM keyframe_meta k JOIN videos v ON v.video_idx = k.video_idx JOIN transcript_segments s ON s.video_id = v.video_id
 AND s.start_s >= k.timestamp - 2 AND s.end_s <= k.timestamp + 10 + 2""")
def join_transcript_window(spark, d):
    """Range join: segments within a window around a key frame, that is, key frames between a segment's end less 12 and its start plus 2 seconds, be
    its end before its start or not. Time is cut into 16-second bins of the video: an equi-join that spreads even one long video over tasks."""
    k = table(spark, d, "keyframe_meta").join(table(spark, d, "videos").select("video_idx", "video_id"), "video_idx").where("timestamp is not null").withColumn("bin", F.floor(F.col("timestamp") / 16))
    low, high = F.col("end_s") - 12, F.col("start_s") + 2
    s = table(spark, d, "transcript_segments").where("start_s is not null and end_s is not null").select("video_id", "seg_id", "start_s", "end_s", (low - 0.01).alias("low"), (high + 0.01).alias("high")).where("low <= high")  # a little wider than the window, against rounding
    s = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / 16), F.floor(F.col("high") / 16))))
    return k.join(s, ["video_id", "bin"]).where((F.col("start_s") >= F.col("timestamp") - 2) & (F.col("end_s") <= F.col("timestamp") + 12)).select("vector_row", "seg_id")


@q("join_chain_walk", """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), w AS (SELECT a AS seed, b AS node, 1 AS hop, [a, b] AS seen FROM e
 UNION ALL SELECT w.seed, e.b, w.hop + 1, list_append(w.seen, e.b) FROM w JOIN e ON e.a = w.node WHERE w.hop < 6 AND NOT list_contains(w.seen, e.b)) SELECT seed, node, hop FROM w""")
def join_chain_walk(spark, d):
    """Bounded walk along edges with a stop at cycles."""
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b"))
    now = e.select(F.col("a").alias("seed"), F.col("b").alias("node"), F.lit(1).alias("hop"), F.array("a", "b").alias("seen"))
    out = now
    for hop in range(2, 7):
        now = now.join(e, now["node"] == e["a"]).where(~F.array_contains("seen", F.col("b"))).select("seed", F.col("b").alias("node"), F.lit(hop).alias("hop"), F.concat("seen", F.array("b")).alias("seen"))
        out = out.unionByName(now)
    return out.select("seed", "node", "hop")



# --- Sampling ---
q("sample_seeded", f"SELECT o_orderkey FROM orders ORDER BY {drawn('o_orderkey', '42')}, o_orderkey LIMIT 100")(lambda s, d: table(s, d, "orders").orderBy(B.seeded_order("o_orderkey", 42)).limit(100).select("o_orderkey"))


@q("sample_weighted", f"""WITH {ROLL}, c AS (SELECT idx, sum(abs(score) * abs(score) + 1e-8) OVER (ORDER BY idx) AS hi FROM roll), n AS (SELECT count(*) AS n, sum(abs(score) * abs(score) + 1e-8) AS t FROM roll),
 p AS (SELECT i AS draw, {uniform('i', '7')} * t AS x FROM n, LATERAL (SELECT unnest(range(n)) AS i)) SELECT draw, idx FROM p ASOF JOIN c ON p.x < c.hi""")
def sample_weighted(spark, d):
    """Resampling with replacement by weight |score|^2 + 1e-8, as many draws as rows."""
    r = rollouts(spark, d).withColumn("w", F.abs("score") ** 2 + 1e-8)
    return B.resample(r, "idx", "w", r.count(), 7).select("draw", F.col("key").alias("idx"))


q("sample_weights", f"WITH {ROLL} SELECT idx, rnd(abs(score) * abs(score) + 1e-8, 6) AS w, rnd(CASE WHEN score = max(score) OVER () THEN 0.4 ELSE 0.1 END + 1e-8, 6) AS w_max FROM roll")(
    lambda s, d: rollouts(s, d).crossJoin(F.broadcast(rollouts(s, d).agg(F.max("score").alias("m")))).select("idx", rnd(F.abs("score") ** 2 + 1e-8, 6).alias("w"), rnd(F.when(F.col("score") == F.col("m"), 0.4).otherwise(0.1) + 1e-8, 6).alias("w_max"))
)

# --- Partitioning ---
q("balance_karmarkar_karp")(lambda s, d: B.balanced(table(s, d, "orders").withColumn("g", F.floor(F.col("o_orderkey") / 512)), "o_orderkey", "o_totalprice", 8, within="g"))
q("balance_karmarkar_karp_fit", "WITH o AS (SELECT floor(o_orderkey / 512) AS g, floor(o_totalprice) AS len FROM orders) SELECT CAST(g AS BIGINT) AS g, least(8, count(*)) AS parts, count(*) AS placed, true AS even FROM o GROUP BY 1")(lambda s, d: _fit(s, d))


def _fit(spark, d):
    """Every row is placed once, every partition used, and no two sums differ by more than the longest row."""
    o = table(spark, d, "orders").withColumn("g", F.floor(F.col("o_orderkey") / 512))
    sums = B.balanced(o, "o_orderkey", "o_totalprice", 8, within="g").groupBy("g", "partition").agg(F.sum("len").alias("s"), F.count("*").alias("n"), F.max("len").alias("m"))
    return sums.groupBy("g").agg(F.count("*").alias("parts"), F.sum("n").alias("placed"), (F.max("s") - F.min("s") <= F.max("m")).alias("even"))


q("balance_unbalance_report", "WITH p AS (SELECT o_orderkey % 8 AS part, floor(o_orderkey / 2000) AS run, o_totalprice AS len FROM orders), a AS (SELECT sum(len) AS s FROM p GROUP BY part), b AS (SELECT sum(len) AS s FROM p GROUP BY run) SELECT rnd((SELECT min(s) FROM b), 1) AS min_run, rnd((SELECT max(s) FROM b), 1) AS max_run, rnd((SELECT min(s) FROM a), 1) AS min_part, rnd((SELECT max(s) FROM a), 1) AS max_part")(
    lambda s, d: _unbalance(s, d)
)


def _unbalance(spark, d):
    p = table(spark, d, "orders").select((F.col("o_orderkey") % 8).alias("part"), F.floor(F.col("o_orderkey") / 2000).alias("run"), F.col("o_totalprice").alias("len"))
    a = p.groupBy("part").agg(F.sum("len").alias("s")).agg(rnd(F.min("s"), 1).alias("min_part"), rnd(F.max("s"), 1).alias("max_part"))
    b = p.groupBy("run").agg(F.sum("len").alias("s")).agg(rnd(F.min("s"), 1).alias("min_run"), rnd(F.max("s"), 1).alias("max_run"))
    return b.crossJoin(a)  # one row each


q("dispatch_ranks", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")(
    lambda s, d: B.dispatch(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 4, lambda f: f.assign(doubled=f["o_totalprice"] * 2)[["o_orderkey", "doubled"]], "o_orderkey bigint, doubled double")
)

QUERIES, SQL = q.queries, q.sql
