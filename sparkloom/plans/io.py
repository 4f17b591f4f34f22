"""Source, sink, streaming and extension queries: what is written is read back."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.common import shared_dir, table
from sparkloom.functions.draws import chosen
from sparkloom.functions.draws import uniform as draw
from sparkloom.operators.batches import with_positions
from sparkloom.plans.base import Book, drawn, rnd, uniform
from sparkloom.sources import commits, files, shards
from sparkloom.streaming import queues

q = Book()


def _tmp(spark):
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


_VCOLS = ["video_idx", "video_id", "title", "duration"]
_VSCHEMA = "video_idx bigint, video_id string, title string, duration double"


@q("source_jsonl_tolerant", "SELECT video_idx, video_id, title, duration FROM videos")
def source_jsonl_tolerant(spark, d):
    """Blank and malformed lines are skipped."""
    path = _tmp(spark)
    lines = table(spark, d, "videos").select(F.to_json(F.struct(*_VCOLS)).alias("value"))
    lines.unionByName(spark.createDataFrame([("",), ("{broken",)], "value string")).write.text(path)
    return files.read_jsonl(spark, path, _VSCHEMA).where("video_idx is not null")


@q("source_jsonl_strict", "SELECT video_idx, video_id, title, duration FROM videos")
def source_jsonl_strict(spark, d):
    path = _tmp(spark)
    table(spark, d, "videos").select(*_VCOLS).write.json(path)
    return files.read_jsonl(spark, path, _VSCHEMA, strict=True)


@q("source_jsonl_append", "SELECT video_idx, video_id, title, duration FROM videos UNION ALL SELECT video_idx, video_id, title, duration FROM videos WHERE duration > 100")
def source_jsonl_append(spark, d):
    path, v = _tmp(spark), table(spark, d, "videos").select(*_VCOLS)
    v.write.json(path)
    v.where("duration > 100").write.mode("append").json(path)
    return files.read_jsonl(spark, path, _VSCHEMA, strict=True)


@q("source_by_extension", "SELECT video_idx, video_id, title, duration FROM videos UNION ALL SELECT video_idx, video_id, title, duration FROM videos")
def source_by_extension(spark, d):
    path, v = _tmp(spark), table(spark, d, "videos").select(*_VCOLS)
    v.write.parquet(f"{path}/a.parquet")
    v.write.json(f"{path}/b.jsonl")
    return files.read_records(spark, [f"{path}/a.parquet", f"{path}/b.jsonl"], _VSCHEMA).select(*_VCOLS)


q("source_capped", "SELECT key, src FROM (SELECT c_custkey AS key, 0 AS src FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier) ORDER BY src, key LIMIT 1000")(
    lambda s, d: files.capped([table(s, d, "customer").select(F.col("c_custkey").alias("key")), table(s, d, "supplier").select(F.col("s_suppkey").alias("key"))], 1000, "key").select("key", F.col("source_ord").alias("src"))
)
q("source_first_n", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500")(lambda s, d: files.sampled(table(s, d, "orders"), "o_orderkey", 500).select("o_orderkey"))
q("source_sampled", f"SELECT o_orderkey FROM orders ORDER BY {drawn('o_orderkey', '1')}, o_orderkey LIMIT 500")(lambda s, d: files.sampled(table(s, d, "orders"), "o_orderkey", 500, seed=1).select("o_orderkey"))
q("source_skip_ids", "SELECT video_idx FROM videos WHERE video_id IS NOT NULL AND lower(trim(video_id)) NOT IN (SELECT lower(trim(x)) FROM (SELECT unnest(skipped_video_ids) AS x FROM checkpoint_state) WHERE x IS NOT NULL)")(
    lambda s, d: files.pending(table(s, d, "videos").where("video_id is not null"), table(s, d, "checkpoint_state").select(F.explode("skipped_video_ids").alias("video_id")), "video_id").select("video_idx")
)
q("source_coerced", "SELECT video_idx, coalesce(title, '') AS title, coalesce(CASE WHEN isnan(duration) THEN 0 ELSE duration END, 0) AS duration, coalesce(tags, []) AS tags FROM videos")(
    lambda s, d: table(s, d, "videos").select("video_idx", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.nanvl("duration", F.lit(0.0)), F.lit(0.0)).alias("duration"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
)


@q("sink_unified_splits", "SELECT row_id, CASE WHEN extra_info.split = 'train' THEN 'train' ELSE 'val' END AS split FROM rl_rows")
def sink_unified_splits(spark, d):
    path, rl = _tmp(spark), table(spark, d, "rl_rows")
    files.write_unified(rl.where("extra_info.split = 'train'"), rl.where("extra_info.split <> 'train'"), path)
    return spark.read.parquet(path).select("row_id", "split")


@q("sink_generations_by_step", "SELECT event_id, CAST(user_id % 5 AS INT) AS step, value FROM events")
def sink_generations_by_step(spark, d):
    path = _tmp(spark)
    table(spark, d, "events").select("event_id", (F.col("user_id") % 5).cast("int").alias("step"), "value").write.partitionBy("step").json(path)
    return spark.read.schema("event_id bigint, value double, step int").json(path)


@q("sink_videos", "SELECT video_idx, scene_splits FROM videos")
def sink_videos(spark, d):
    path = _tmp(spark)
    table(spark, d, "videos").select("video_idx", "scene_splits").write.parquet(path)
    return spark.read.parquet(path)


q("sink_manifest", "SELECT count(*) AS num_records, count(DISTINCT source_dataset) AS num_sources, 'now' AS built_at FROM videos")(lambda s, d: files.manifest(table(s, d, "videos"), "now"))
q("source_complete_conversations", "SELECT row_id FROM rl_rows WHERE prompt[-1].role = 'user'")(
    lambda s, d: files.complete_conversations(table(s, d, "rl_rows").withColumn("m", F.transform("prompt", lambda m: F.struct(F.when(m["role"] == "user", "assistant").otherwise(m["role"]).alias("role")))), "m").select("row_id")
)
q("source_accepted_tasks", "SELECT concat('v5_', CAST(row_number() OVER (ORDER BY row_id) AS VARCHAR)) AS id, row_id FROM rl_rows WHERE reward_model.ground_truth.answer <> '' AND extra_info.question <> ''")(
    lambda s, d: with_positions(table(s, d, "rl_rows").where("reward_model.ground_truth.answer <> '' and extra_info.question <> ''").select("row_id"), "row_id").select(F.concat(F.lit("v5_"), (F.col("row_pos") + 1).cast("string")).alias("id"), "row_id")
)

# --- Shards ---
_LAY = "p AS (SELECT video_idx, octet_length(encode(coalesce(title, ''))) AS length, row_number() OVER (ORDER BY video_idx) - 1 AS pos FROM videos), s AS (SELECT *, pos // 64 AS shard_no FROM p)"


def _payloads(spark, d):
    return with_positions(table(spark, d, "videos").select("video_idx", F.encode(F.coalesce("title", F.lit("")), "UTF-8").alias("payload")), "video_idx", name="pos")


_OFFSET = "512 + coalesce(sum(512 + CAST(ceil(length / 512.0) AS BIGINT) * 512) OVER (PARTITION BY shard_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
q("shard_layout", f"WITH {_LAY} SELECT video_idx, shard_no, CAST({_OFFSET} AS BIGINT) AS offset, length FROM s")(lambda s, d: shards.layout(_payloads(s, d).withColumn("size", F.length("payload")), "video_idx", "pos", "size", 64))
q("shard_write_scan", f"WITH {_LAY} SELECT CAST(video_idx AS VARCHAR) AS key, shard_no, CAST({_OFFSET} AS BIGINT) AS offset, length FROM s")(lambda s, d: shards.write(_payloads(s, d), "video_idx", "payload", _tmp(s), 64, "pos"))


@q("shard_read_ranges", "SELECT CAST(video_idx AS VARCHAR) AS key, coalesce(title, '') AS payload FROM videos")
def shard_read_ranges(spark, d):
    root = _tmp(spark)
    return shards.read_ranges(shards.write(_payloads(spark, d), "video_idx", "payload", root, 64, "pos"), root).select("key", F.col("payload").cast("string").alias("payload"))


@q("shard_headers", f"WITH {_LAY} SELECT CAST(video_idx AS VARCHAR) AS key, shard_no, CAST({_OFFSET} AS BIGINT) AS offset, length FROM s")
def shard_headers(spark, d):
    """The index made anew from the headers of the files."""
    root = _tmp(spark)
    shards.write(_payloads(spark, d), "video_idx", "payload", root, 64, "pos")
    return shards.scan(spark, root)


_BATCHES = "b AS (SELECT batch_id, record_id, fake_url, local_path, row_number() OVER (PARTITION BY batch_id ORDER BY record_id) - 1 AS no FROM batch_records WHERE batch_id < 3), sz AS (SELECT batch_id, count(*) AS n FROM b GROUP BY 1), sh AS (SELECT batch_id, coalesce(sum(n) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v FROM sz)"


def _committed(spark, d):
    """The first three batches written one by one, in any order, with a vector for every record."""
    root = _tmp(spark)
    numbers = F.row_number().over(Window.partitionBy("batch_id").orderBy("record_id")) - 1
    r = table(spark, d, "batch_records").where("batch_id < 3").select("batch_id", "record_id", "fake_url", "local_path").withColumn("record_no", numbers)
    for batch in (1, 0, 2):
        mine = r.where(F.col("batch_id") == batch)
        vectors = mine.select(F.col("record_no").alias("vector_row"), F.array(F.col("record_id").cast("float")).alias("embedding"))
        meta = mine.select(F.col("record_no").alias("video_idx"), F.lit(1.0).alias("timestamp"), F.col("record_no").alias("vector_row"))
        commits.commit_batch(root, batch, mine, vectors, meta)
    return commits.load(spark, root)


q("commit_load", f"WITH {_BATCHES} SELECT record_id, CAST(v + no AS BIGINT) AS video_idx FROM b JOIN sh USING (batch_id)")(lambda s, d: _committed(s, d)["videos"].select("record_id", "video_idx"))
q("commit_vectors", f"WITH {_BATCHES} SELECT CAST(v + no AS BIGINT) AS video_idx, CAST(v + no AS BIGINT) AS vector_row, CAST(record_id AS FLOAT) AS first FROM b JOIN sh USING (batch_id)")(lambda s, d: _vectors(_committed(s, d)))
q("commit_url_map", f"WITH {_BATCHES} SELECT fake_url, arg_max(local_path, v + no) AS local_path FROM b JOIN sh USING (batch_id) WHERE fake_url IS NOT NULL GROUP BY 1")(lambda s, d: _committed(s, d)["url_map"])


def _vectors(corpus):
    return corpus["keyframe_meta"].select("video_idx", "vector_row").join(corpus["embeddings"].select("vector_row", F.get("embedding", F.lit(0)).alias("first")), "vector_row").select("video_idx", "vector_row", "first")


q("shard_index_last_run", "SELECT video_id, arg_max(video_idx, video_idx) AS video_idx FROM videos GROUP BY video_id")(lambda s, d: table(s, d, "videos").groupBy("video_id").agg(F.max("video_idx").alias("video_idx")))

# --- Streams ---


def _stream(spark, d):
    """Events rewritten as four files in the order of their time, read as a stream, a file at a time."""
    path = _tmp(spark)
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = e.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - (low or 0)) * 4 / ((high or 0) - (low or 0) + 1))
    for i in range(4):
        e.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return queues.read_stream(spark, path, 1), path


@q("stream_tumbling_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, rnd(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_window(spark, d):
    """Complete mode, so the result is that of the whole table."""
    s, path = _stream(spark, d)
    w = s.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = queues.run(w.select(F.col("window.start").alias("start"), "event_type", "n", "total"), path + "-out", path + "-ck", "complete")
    return out.select("start", "event_type", "n", rnd("total", 3).alias("total"))


@q("stream_watermark_window", "WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, rnd(sum(value), 3) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def stream_watermark_window(spark, d):
    """Append mode: windows that the watermark has closed."""
    s, path = _stream(spark, d)
    w = queues.windowed(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"], "1 hour", "10 minutes")
    out = queues.run(w.select(F.col("window.start").alias("start"), "event_type", "n", "total"), path + "-out", path + "-ck")
    return out.select("start", "event_type", "n", rnd("total", 3).alias("total"))


@q("stream_bounded_queue", "SELECT user_id, list_sort(list(event_id))[greatest(count(*) - 15, 1) :] AS items, count(*) AS taken, greatest(count(*) - 16, 0) AS dropped FROM events GROUP BY 1")
def stream_bounded_queue(spark, d):
    """Bounded queue per user that drops the oldest: the last update of each key."""
    s, path = _stream(spark, d)
    stream = queues.bounded_queue(s.select("user_id", "event_id"), "user_id", "event_id", 16)
    out = path + "-out"

    def keep(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b={batch}")

    stream.writeStream.option("checkpointLocation", path + "-ck").outputMode("update").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return queues.latest(spark.read.parquet(out).drop("b"), "user_id", "batch").select("user_id", "items", "taken", "dropped")


_ST = "CASE event_id % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'failure' ELSE 'success' END"
q("stream_replay_groups", f"WITH n AS (SELECT user_id, event_type, arg_max({_ST}, event_id) AS status FROM events GROUP BY 1, 2), o AS (SELECT user_id FROM n GROUP BY 1 HAVING count(*) FILTER (status = 'running') = 0) SELECT n.* FROM n JOIN o USING (user_id) WHERE status = 'success'")(
    lambda s, d: queues.ready_groups(table(s, d, "events").withColumn("st", F.when(F.col("event_id") % 7 == 0, "running").when(F.col("event_id") % 7 == 1, "failure").otherwise("success")), "user_id", "event_type", "st", "event_id").select("user_id", "event_type", "status")
)


@q("stream_token_bucket", """WITH RECURSIVE e AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, CAST(event_id % 9 AS DOUBLE) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r AS (SELECT user_id, k, t, 10.0 - n AS level FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.t, least(10.0, r.level + (e.t - r.t) * 0.02) - e.n FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, rnd(sum(greatest(0, -level / 0.02)), 2) AS waited FROM r GROUP BY 1""")
def stream_token_bucket(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), (F.col("event_id") % 9).cast("double").alias("n"))
    waits = queues.token_bucket(e, "user_id", "t", "n", ["event_id"], 0.02, 10.0)
    return waits.groupBy("user_id").agg(rnd(F.sum("waited"), 2).alias("waited"))


@q("stream_agent_states", """WITH RECURSIVE e AS (SELECT user_id, event_id % 5 AS calls, event_id % 50 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r AS (SELECT user_id, k, tokens AS used, CASE WHEN tokens > 150 THEN 'terminated_length' WHEN calls = 0 THEN 'terminated' WHEN k >= 8 THEN 'terminated_turns' ELSE 'running' END AS state FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.k, r.used + e.tokens, CASE WHEN r.used + e.tokens > 150 THEN 'terminated_length' WHEN e.calls = 0 THEN 'terminated' WHEN e.k >= 8 THEN 'terminated_turns' ELSE 'running' END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 WHERE r.state = 'running')
 SELECT user_id, arg_max(state, k) AS state, CAST(arg_max(used, k) AS BIGINT) AS used, CAST(max(k) AS INT) AS n FROM r GROUP BY 1""")
def stream_agent_states(spark, d):
    turns = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("calls"), (F.col("event_id") % 50).alias("tokens"))
    return queues.agent_states(turns, "user_id", ["event_id"], "calls", "tokens", 8, 150)


q("stream_required_samples", "SELECT n_nationkey, CAST(64 * (n_regionkey + 1) * 4 AS BIGINT) AS required FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", (64 * (F.col("n_regionkey") + 1) * 4).cast("bigint").alias("required")))


@q("source_generated", "SELECT i AS id, i % 7 AS bucket FROM range(10000) t(i)")
def source_generated(spark, d):
    """The Python data source API as the plug-in point for datasets."""
    from sparkloom.sources.generator import GeneratedSource

    spark.dataSource.register(GeneratedSource)
    return spark.read.format("generated").option("rows", 10000).option("partitions", 4).load()


q("sample_categorical", f"WITH u AS (SELECT event_id, {uniform('event_id', '5')} AS u FROM events) SELECT event_id, CASE WHEN u < 0.5 THEN 'two' WHEN u < 0.8 THEN 'three' ELSE 'four' END AS depth FROM u")(
    lambda s, d: table(s, d, "events").select("event_id", chosen(draw("event_id", 5), {"two": 0.5, "three": 0.3, "four": 0.2}).alias("depth"))
)
q("sample_slots", "SELECT n_name AS lang, r_name AS region, era FROM nation, region, (SELECT unnest(['plain', 'region', 'era']) AS era)")(
    lambda s, d: table(s, d, "nation").select(F.col("n_name").alias("lang")).crossJoin(table(s, d, "region").select(F.col("r_name").alias("region"))).withColumn("era", F.explode(F.array(*map(F.lit, ("plain", "region", "era")))))
)

QUERIES, SQL = q.queries, q.sql
