"""Text, URL, time, nested-value, scoring and tool-call queries."""

from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.functions import text as T
from sparkloom.plans.base import Book, rnd

q = Book()


def _docs(s, d):
    return table(s, d, "documents")


def _videos(s, d):
    return table(s, d, "videos")


def _rl(s, d):
    said = F.filter("prompt", lambda m: m["role"] == "user")[0]["content"]
    return table(s, d, "rl_rows").select("row_id", "data_source", said.alias("question"), F.col("reward_model.ground_truth.answer").alias("answer"), F.col("reward_model.ground_truth.gold_urls").alias("gold_urls"), F.col("extra_info.split").alias("split"))


_RL = "rl AS (SELECT row_id, data_source, list_filter(prompt, lambda m: m.role = 'user')[1].content AS question, reward_model.ground_truth.answer AS answer, reward_model.ground_truth.gold_urls AS gold_urls, extra_info.split AS split FROM rl_rows)"
_SOL = "concat('Thinking. <answer> ', question, ' </answer> so <answer>The ', answer, '!</answer>')"


def _solved(s, d):
    return _rl(s, d).withColumn("solution", F.concat(F.lit("Thinking. <answer> "), "question", F.lit(" </answer> so <answer>The "), "answer", F.lit("!</answer>")))


# Only letters that lower to ASCII count, and those lower alike in every engine.
q("text_tokenize", "SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9]+') AS tokens FROM documents")(lambda s, d: _docs(s, d).select("doc_id", T.tokens(F.col("text")).alias("tokens")))
q("text_document", "SELECT video_idx, concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(subtitle, ''), nullif(array_to_string(tags, ' '), '')) AS body FROM videos")(
    lambda s, d: _videos(s, d).select("video_idx", T.document_text(F.col("title"), F.col("description"), F.col("subtitle"), F.array_join("tags", " ")).alias("body"))
)
q("text_truncate_head", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...(truncated)...') ELSE text END AS t FROM documents")(lambda s, d: _docs(s, d).select("doc_id", T.truncate(F.col("text"), 100).alias("t")))
q("text_truncate_tail", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat('...(truncated)...', right(text, 100)) ELSE text END AS t FROM documents")(lambda s, d: _docs(s, d).select("doc_id", T.truncate(F.col("text"), 100, "tail").alias("t")))
q("text_truncate_middle", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 50), '...(truncated)...', right(text, 50)) ELSE text END AS t FROM documents")(lambda s, d: _docs(s, d).select("doc_id", T.truncate_response(F.col("text"), 100, "middle").alias("t")))
q("text_snippet", """WITH v AS (SELECT video_idx, coalesce(nullif(description, ''), nullif(subtitle, ''), nullif(title, ''), '') AS t FROM videos), f AS (SELECT *, list_filter([instr(lower(t), w) FOR w IN ['museum', 'engine', 'the']], lambda i: i > 0) AS hit FROM v)
 SELECT video_idx, trim(CASE WHEN len(hit) > 0 THEN substr(t, greatest(hit[1] - 40, 1), hit[1] + 160 - greatest(hit[1] - 40, 1)) ELSE substr(t, 1, 200) END) AS snippet FROM f""")(
    lambda s, d: _videos(s, d).select("video_idx", T.snippet([F.col("description"), F.col("subtitle"), F.col("title")], F.array(*map(F.lit, ("museum", "engine", "the")))).alias("snippet"))
)
q("text_as_string", "SELECT video_idx, coalesce(array_to_string(tags, ' '), '') AS tags, coalesce(CAST(source_id AS VARCHAR), '') AS source_id FROM videos")(
    lambda s, d: _videos(s, d).select("video_idx", F.coalesce(F.array_join("tags", " "), F.lit("")).alias("tags"), F.coalesce("source_id", F.lit("")).alias("source_id"))
)
q("text_first_answer", f"WITH {_RL} SELECT row_id, trim(regexp_extract({_SOL}, '(?s)<answer>(.*?)</answer>', 1)) AS a FROM rl WHERE answer IS NOT NULL AND question IS NOT NULL")(lambda s, d: _solved(s, d).where("answer is not null and question is not null").select("row_id", T.first_tag(F.col("solution"), "answer").alias("a")))
q("text_last_answer", f"WITH {_RL} SELECT row_id, trim(regexp_extract_all({_SOL}, '(?s)<answer>(.*?)</answer>', 1)[-1]) AS a FROM rl WHERE answer IS NOT NULL AND question IS NOT NULL")(lambda s, d: _solved(s, d).where("answer is not null and question is not null").select("row_id", T.last_tag(F.col("solution"), "answer").alias("a")))
q("text_answer_tags", f"WITH {_RL} SELECT row_id, len(regexp_extract_all({_SOL}, '<answer>')) AS opened, len(regexp_extract_all({_SOL}, '</answer>')) AS closed FROM rl WHERE answer IS NOT NULL AND question IS NOT NULL")(
    lambda s, d: _solved(s, d).where("answer is not null and question is not null").select("row_id", T.count_of(F.col("solution"), "<answer>").alias("opened"), T.count_of(F.col("solution"), "</answer>").alias("closed"))
)
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
q("text_normal_answer", f"WITH {_RL} SELECT row_id, {_NORM.format(x='answer')} AS n FROM rl")(lambda s, d: _rl(s, d).select("row_id", T.normal_answer(F.col("answer")).alias("n")))
q("text_language", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]') THEN 'zh' ELSE 'en' END AS l FROM documents")(lambda s, d: _docs(s, d).select("doc_id", T.language(F.col("text")).alias("l")))
q("text_quick_match", f"""WITH {_RL}, n AS (SELECT row_id, trim(regexp_replace(regexp_replace(lower(trim(concat('It is the ', answer))), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS p, trim(regexp_replace(regexp_replace(lower(trim(answer)), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS g FROM rl WHERE answer IS NOT NULL)
 SELECT row_id, CASE WHEN p = '' OR g = '' THEN false ELSE p = g OR contains(p, g) OR contains(g, p) OR p || 's' = g OR g || 's' = p OR (len(list_filter(string_split(g, ' '), lambda x: x NOT IN ('', 'the', 'a', 'an'))) > 0 AND list_has_all(string_split(p, ' '), list_filter(string_split(g, ' '), lambda x: x NOT IN ('', 'the', 'a', 'an')))) END AS hit FROM n""")(
    lambda s, d: _rl(s, d).where("answer is not null").select("row_id", T.quick_match(F.concat(F.lit("It is the "), "answer"), F.col("answer")).alias("hit"))
)
q("text_judge_verdict", """WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"is_correct": true}' WHEN 1 THEN 'so: "is_correct" : FALSE, done' WHEN 2 THEN 'I say true.' ELSE 'unclear' END AS t FROM events) SELECT event_id, CASE WHEN t LIKE '{%' THEN true WHEN t LIKE 'so%' THEN false WHEN t LIKE 'I say%' THEN true END AS v FROM j""")(
    lambda s, d: table(s, d, "events").select("event_id", T.judge_verdict(F.element_at(F.array(*map(F.lit, ('{"is_correct": true}', 'so: "is_correct" : FALSE, done', "I say true.", "unclear"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("v"))
)
q("text_clues", "SELECT doc_id, list_filter([regexp_replace(x, '^[\\s\\-*•\\d.)]+|\\s+$', '', 'g') FOR x IN string_split(text, chr(10))], lambda x: x <> '') AS clues FROM documents WHERE text IS NOT NULL")(lambda s, d: _docs(s, d).where("text is not null").select("doc_id", T.clues(F.col("text")).alias("clues")))
q("text_numbered_results", "SELECT video_id, string_agg(concat(CAST(r AS VARCHAR), '. ', title), chr(10) ORDER BY r) AS block FROM (SELECT video_id, coalesce(title, '') AS title, row_number() OVER (PARTITION BY video_id ORDER BY video_idx) AS r FROM videos) GROUP BY video_id")(
    lambda s, d: _videos(s, d).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("video_idx", F.coalesce("title", F.lit("")).alias("title")))).alias("l")).select("video_id", T.numbered(F.col("l"), lambda x: x["title"]).alias("block"))
)
q("text_case_id", "SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_.\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS id FROM documents")(lambda s, d: _docs(s, d).select("doc_id", T.case_id(F.col("text")).alias("id")))
q("text_escape_images", "SELECT doc_id, replace(concat(text, ' <image>'), '<image>', '<_image_>') AS t FROM documents")(lambda s, d: _docs(s, d).select("doc_id", F.replace(F.concat("text", F.lit(" <image>")), F.lit("<image>"), F.lit("<_image_>")).alias("t")))
q("text_strip_marker", "SELECT doc_id, regexp_replace(concat('[tool_result]', text), '(?s)^\\[tool_result\\].*?(\\n\\n|$)', '') AS t FROM documents")(lambda s, d: _docs(s, d).select("doc_id", F.regexp_replace(F.concat(F.lit("[tool_result]"), "text"), r"(?s)^\[tool_result\].*?(\n\n|$)", "").alias("t")))
q("text_transcript_block", "SELECT video_id, substr(string_agg(concat('[', CAST(CAST(start_s AS INT) AS VARCHAR), '] ', text), chr(10) ORDER BY start_s, seg_id), 1, 25000) AS block FROM transcript_segments WHERE text IS NOT NULL AND start_s IS NOT NULL GROUP BY video_id")(
    lambda s, d: table(s, d, "transcript_segments").where("text is not null and start_s is not null").groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("start_s", "seg_id", "text"))).alias("l")).select("video_id", F.substring(F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), F.rint(x["start_s"]).cast("int").cast("string"), F.lit("] "), x["text"])), "\n"), 1, 25000).alias("block"))
)
q("text_merge_equal_cues", """WITH t AS (SELECT video_id, seg_id, start_s, end_s, text, CASE WHEN lag(text) OVER w = text THEN 0 ELSE 1 END AS new FROM transcript_segments WHERE text IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY start_s, seg_id)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start_s, seg_id) AS island FROM t) SELECT video_id, min(start_s) AS start_s, max(end_s) AS end_s, min(text) AS text FROM i GROUP BY video_id, island""")(
    lambda s, d: _merge_cues(s, d)
)


def _merge_cues(spark, d):
    """Neighbouring equal texts become one cue that ends where the last of them does."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("start_s", "seg_id")
    t = table(spark, d, "transcript_segments").where("text is not null").withColumn("new", F.when(F.lag("text").over(w) == F.col("text"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return t.groupBy("video_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min("text").alias("text")).drop("island")


# --- Hashes and addresses ---
_ID = "substr(translate(to_base64(unhex(sha1(local_path))), '+/', '-_'), 1, 11)"
q("url_path_id", f"SELECT video_idx, {_ID} AS id, concat('https://www.youtube.com/watch?v=', {_ID}) AS url, concat('https://www.youtube.com/vi/', video_id, '/hqdefault.jpg') AS thumb FROM videos")(
    lambda s, d: _videos(s, d).select("video_idx", T.path_id(F.col("local_path")).alias("id"), T.watch_url(F.col("local_path")).alias("url"), T.thumbnail(F.col("video_id")).alias("thumb"))
)
q("url_parse", "SELECT record_id, nullif(regexp_extract(trim(replace(fake_url, 'www.tube.example', 'www.youtube.com')), '^https://www\\.youtube\\.com/watch\\?v=([A-Za-z0-9_-]{11})$', 1), '') AS id FROM batch_records")(
    lambda s, d: table(s, d, "batch_records").select("record_id", T.url_id(F.replace("fake_url", F.lit("www.tube.example"), F.lit("www.youtube.com"))).alias("id"))
)
q("url_loose_id", "SELECT record_id, coalesce(nullif(regexp_extract(fake_url, '(?:v=|youtu\\.be/|shorts/)([A-Za-z0-9_-]{11})', 1), ''), fake_url) AS id, coalesce(nullif(regexp_extract(fake_url, '(?:v=|youtu\\.be/|shorts/)([A-Za-z0-9_-]{11})', 1), ''), substr(md5(fake_url), 1, 11)) AS id2 FROM batch_records")(
    lambda s, d: table(s, d, "batch_records").select("record_id", T.loose_id(F.col("fake_url")).alias("id"), T.loose_id(F.col("fake_url"), F.substring(F.md5("fake_url"), 1, 11)).alias("id2"))
)
q("url_shard_make", "SELECT video_idx, concat('shard://', replace(local_path, 'shard://', ''), '?o=', CAST(video_idx * 512 AS VARCHAR), '&l=', CAST(length(local_path) AS VARCHAR)) AS uri FROM videos")(
    lambda s, d: _videos(s, d).select("video_idx", T.shard_uri(F.replace("local_path", F.lit("shard://"), F.lit("")), F.col("video_idx") * 512, F.length("local_path")).alias("uri"))
)
q("url_shard_parse", "SELECT video_idx, replace(local_path, 'shard://', '') AS path, video_idx * 512 AS offset, CAST(length(local_path) AS BIGINT) AS length FROM videos")(
    lambda s, d: _videos(s, d).select("video_idx", T.shard_parts(T.shard_uri(F.replace("local_path", F.lit("shard://"), F.lit("")), F.col("video_idx") * 512, F.length("local_path"))).alias("p")).select("video_idx", "p.*")
)
q("url_local_file", "SELECT video_idx, replace(local_path, 'shard://', '/') AS path FROM videos")(lambda s, d: _videos(s, d).select("video_idx", T.local_file(F.concat(F.lit(" 'file:///"), F.replace("local_path", F.lit("shard://"), F.lit("")), F.lit("'"))).alias("path")))

# --- Times ---
q("time_clock", "SELECT seg_id, rnd(coalesce(floor(start_s / 3600) * 3600 + floor((start_s % 3600) / 60) * 60 + floor(start_s % 60), 0), 3) AS sec FROM transcript_segments")(
    lambda s, d: table(s, d, "transcript_segments").select("seg_id", rnd(T.clock_seconds(F.concat_ws(":", *[F.lpad(F.floor(x).cast("string"), 5, "0") for x in (F.col("start_s") / 3600, F.col("start_s") % 3600 / 60, F.col("start_s") % 60)])), 3).alias("sec"))
)
q("time_number_list", "SELECT video_idx, [CAST(video_idx AS DOUBLE), duration] AS t FROM videos WHERE duration IS NOT NULL")(
    lambda s, d: _videos(s, d).where("duration is not null").select("video_idx", T.numbers(F.concat(F.lit("["), F.col("video_idx").cast("string"), F.lit(", bad, "), F.col("duration").cast("string"), F.lit("]"))).alias("t"))
)
q("time_uniform_frames", """WITH v AS (SELECT video_idx, CAST(duration * 25 AS BIGINT) AS n FROM videos WHERE duration > 0), e AS (SELECT video_idx, list_transform(range((n - 1) // 25 + 1), lambda i: i * 25) AS f FROM v WHERE n > 0) SELECT video_idx, CASE WHEN len(f) > 16 THEN list_transform(range(16), lambda i: f[CAST(round_even(i * (len(f) - 1) / 15, 0) AS BIGINT) + 1]) ELSE f END AS frames FROM e""")(
    lambda s, d: _videos(s, d).where("duration > 0").withColumn("n", F.rint(F.col("duration") * 25).cast("bigint")).where("n > 0").select("video_idx", T.uniform_indices(F.col("n"), F.lit(25.0), 1.0, 16).alias("frames"))
)
q("time_scene_middles", "SELECT video_idx, [rnd((x[1] + x[2]) / 2, 4) FOR x IN list_filter(scene_splits, lambda y: y[2] > y[1])] AS mid FROM videos WHERE scene_splits IS NOT NULL")(
    lambda s, d: _videos(s, d).where("scene_splits is not null").select("video_idx", F.transform(T.scene_middles(F.col("scene_splits")), lambda x: rnd(x, 4)).alias("mid"))
)
q("time_sparse_frames", "SELECT video_idx, [CAST(floor(i * (CAST(floor(duration * 25) AS BIGINT) - 1) / 15) AS BIGINT) FOR i IN range(16)] AS frames FROM videos WHERE duration > 1")(
    lambda s, d: _videos(s, d).where("duration > 1").select("video_idx", T.sparse_indices(F.floor(F.col("duration") * 25)).alias("frames"))
)
q("time_dense_frames", "SELECT video_idx, [least(CAST(floor((3 + i) * 25.0) AS BIGINT), CAST(floor(duration * 25) AS BIGINT) - 1) FOR i IN range(least(CAST(floor(least(duration, 60) - 3) AS BIGINT) + 1, 32))] AS frames FROM videos WHERE duration > 5")(
    lambda s, d: _videos(s, d).where("duration > 5").select("video_idx", F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(F.floor(F.least("duration", F.lit(60.0)) - 3), F.lit(31))), lambda i: F.least(F.floor((3 + i) * 25.0), F.floor(F.col("duration") * 25) - 1)).alias("frames"))
)
q("time_json_captions", "SELECT seg_id, start_s AS start, text FROM transcript_segments WHERE trim(text) <> '' AND start_s IS NOT NULL AND text NOT LIKE '%\\\\%' AND start_s = round(start_s, 3)")(
    lambda s, d: _captions(s, d)
)


def _captions(spark, d):
    """Events of caption JSON (milliseconds) to seconds."""
    t = table(spark, d, "transcript_segments").where(r"text is not null and start_s is not null and not contains(text, '\\') and start_s = round(start_s, 3)")
    doc = F.to_json(F.struct(F.array(F.struct(F.rint(F.col("start_s") * 1000).alias("tStartMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))).alias("events")))
    e = F.explode(F.from_json(doc, "struct<events:array<struct<tStartMs:double,segs:array<struct<utf8:string>>>>>")["events"])
    x = t.select("seg_id", e.alias("e"))
    return x.select("seg_id", (F.col("e.tStartMs") / 1000).alias("start"), F.array_join("e.segs.utf8", "").alias("text")).where("trim(text) <> ''")


# --- Nested values ---
q("nested_gold_urls", f"WITH {_RL} SELECT row_id, list_filter(coalesce(gold_urls, []), lambda u: u IS NOT NULL AND u <> '') AS urls FROM rl")(lambda s, d: _rl(s, d).select("row_id", F.filter(F.coalesce("gold_urls", F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != "")).alias("urls")))
q("nested_tags", "SELECT video_idx, coalesce(tags, []) AS tags FROM videos")(lambda s, d: _videos(s, d).select("video_idx", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))
q("nested_rl_row", "SELECT row_id, concat('bc_', CAST(row_id AS VARCHAR)) AS id, extra_info.tools_kwargs IS NOT NULL AS tools, prompt[1].role AS first_role, len(prompt) AS n FROM rl_rows")(
    lambda s, d: table(s, d, "rl_rows").select("row_id", F.concat(F.lit("bc_"), F.col("row_id").cast("string")).alias("id"), F.col("extra_info.tools_kwargs").isNotNull().alias("tools"), F.col("prompt")[0]["role"].alias("first_role"), F.size("prompt").cast("bigint").alias("n"))
)
q("nested_rename_keys", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.transform_keys(F.from_json("props", "map<string,bigint>"), lambda k, v: F.concat(F.lit("val/"), k))["val/k"].alias("v"))
)
q("nested_append_lists", "SELECT user_id, list(CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id) AS k FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")))), lambda x: x["k"]).alias("k"))
)
q("nested_answer_field", f"WITH {_RL} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN answer ELSE concat('plain ', answer) END AS a FROM rl WHERE answer IS NOT NULL")(
    lambda s, d: _rl(s, d).where("answer is not null").withColumn("p", F.when(F.col("row_id") % 2 == 0, F.to_json(F.struct(F.col("answer").alias("Answer")))).otherwise(F.concat(F.lit("plain "), "answer"))).select("row_id", F.coalesce(F.get_json_object("p", "$.Answer"), "p").alias("a"))
)
q("nested_extract_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda s, d: table(s, d, "events").withColumn("t", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).select("event_id", F.get_json_object(F.regexp_extract("t", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), "$.k").cast("bigint").alias("k"))
)
q("nested_double_encoded", f"WITH {_RL} SELECT row_id, answer FROM rl WHERE answer IS NOT NULL")(
    lambda s, d: _rl(s, d).where("answer is not null").withColumn("j", F.to_json(F.struct(F.to_json(F.struct("answer")).alias("arguments")))).select("row_id", F.get_json_object(F.get_json_object("j", "$.arguments"), "$.answer").alias("answer"))
)
q("nested_strip_payloads", "SELECT doc_id, concat(text, ' data:image/png;base64,[stripped]') AS t FROM documents WHERE text IS NOT NULL")(
    lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.regexp_replace(F.concat("text", F.lit(" data:image/png;base64,QUJD/+=")), r"(data:image/[a-z]+;base64,)[A-Za-z0-9+/=]+", "$1[stripped]").alias("t"))
)
q("nested_base64", "SELECT video_idx, title FROM videos WHERE title IS NOT NULL")(lambda s, d: _videos(s, d).where("title is not null").select("video_idx", F.unbase64(F.base64(F.encode("title", "UTF-8"))).cast("string").alias("title")))

# --- Scores ---
_GOLD = "(answer IS NOT NULL AND question IS NOT NULL)"
_LAST = _NORM.format(x="concat('The ', answer, '!')")
q("score_exact_match", f"WITH {_RL} SELECT row_id, {_LAST} = {_NORM.format(x='answer')} AS em FROM rl WHERE {_GOLD}")(lambda s, d: _solved(s, d).where("answer is not null and question is not null").select("row_id", T.em(T.last_tag(F.col("solution"), "answer"), F.array("answer")).alias("em")))
q("score_sub_match", f"WITH {_RL} SELECT row_id, contains({_NORM.format(x='question')}, {_NORM.format(x='answer')}) AS sub FROM rl WHERE {_GOLD}")(lambda s, d: _rl(s, d).where("answer is not null and question is not null").select("row_id", T.sub_em(F.col("question"), F.array("answer")).alias("sub")))
q("score_qa", f"WITH {_RL} SELECT row_id, CASE WHEN {_LAST} = {_NORM.format(x='answer')} THEN 1.0 ELSE 0.1 END AS score FROM rl WHERE {_GOLD}")(lambda s, d: _solved(s, d).where("answer is not null and question is not null").select("row_id", T.qa_score(F.col("solution"), F.array("answer"), 0.1).alias("score")))
q("score_terminal", f"WITH {_RL} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 0.0 ELSE CASE WHEN {_LAST} = {_NORM.format(x='answer')} THEN 1.1 ELSE 0.1 END END AS score FROM rl WHERE {_GOLD}")(
    lambda s, d: _solved(s, d).where("answer is not null and question is not null").select("row_id", F.when(F.col("row_id") % 3 == 0, 0.0).otherwise(F.when(T.em(T.last_tag(F.col("solution"), "answer"), F.array("answer")), 1.1).otherwise(0.1)).alias("score"))
)
q("score_gsm_strict", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS n, o_custkey = o_orderkey AS ok FROM orders")(
    lambda s, d: table(s, d, "orders").withColumn("a", T.gsm_answer(F.concat(F.lit("so 12 and\n#### "), F.format_number(F.col("o_custkey"), 0)))).select("o_orderkey", F.col("a").alias("n"), (F.col("a") == F.col("o_orderkey").cast("string")).alias("ok"))
)
q("score_gsm_flexible", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS n FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", T.gsm_answer(F.concat(F.lit("first 3, then "), F.col("o_custkey").cast("string"), F.lit(" .")), strict=False).alias("n")))
q("score_multiset_jaccard", "WITH t AS (SELECT video_idx, coalesce(tags, []) AS a, list_concat(coalesce(tags, []), ['drone']) AS b FROM videos), c AS (SELECT *, list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) FOR x IN list_distinct(a)]) AS k FROM t) SELECT video_idx, rnd(CASE WHEN len(a) = 0 THEN 0 ELSE k / (len(a) + len(b) - k) END, 6) AS score FROM c")(
    lambda s, d: _videos(s, d).withColumn("a", F.coalesce("tags", F.array().cast("array<string>"))).select("video_idx", rnd(T.match_score(F.col("a"), F.concat("a", F.array(F.lit("drone")))), 6).alias("score"))
)
q("score_boxed", "SELECT o_orderkey, concat('\\frac{', CAST(o_custkey AS VARCHAR), '}{7}') AS inner_text FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", T.boxed(F.concat(F.lit("thus \\boxed{1} or \\boxed{\\frac{"), F.col("o_custkey").cast("string"), F.lit("}{7}} done"))).alias("inner_text"))
)
q("score_minerva", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS pred FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.element_at(F.regexp_extract_all(F.concat(F.lit("Answer: 1\nanswer : "), F.col("o_custkey").cast("string")), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), -1).alias("pred"))
)
q("score_format", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM events")(
    lambda s, d: table(s, d, "events").withColumn("r", F.when(F.col("event_id") % 2 == 0, "<think>x</think>\n<response>y</response>").otherwise("<response>y</response>")).select("event_id", F.when(F.col("r").rlike(r"(?s)^<think>.*?</think>\n<response>.*?</response>$") & (T.count_of(F.col("r"), "<response>") == 1), 1.0).otherwise(0.0).alias("score"))
)
q("score_route", f"WITH {_RL} SELECT row_id, CASE WHEN lower(data_source) LIKE '%train%' THEN 1.0 WHEN lower(data_source) LIKE '%val%' THEN 0.5 ELSE 0.25 END AS score FROM rl")(
    lambda s, d: _rl(s, d).select("row_id", F.when(F.lower("data_source").contains("train"), 1.0).when(F.lower("data_source").contains("val"), 0.5).otherwise(0.25).alias("score"))
)

# --- Tool calls ---
q("tool_tagged_calls", "SELECT event_id, event_type AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0")(
    lambda s, d: table(s, d, "events").withColumn("t", F.when(F.col("event_id") % 3 == 0, "<tool_call>not json</tool_call>").otherwise(F.concat(F.lit("hm <tool_call>"), F.to_json(F.struct(F.col("event_type").alias("name"), F.from_json("props", "k bigint").alias("arguments"))), F.lit("</tool_call>")))).select("event_id", F.explode(T.tagged_calls(F.col("t"))).alias("c")).select("event_id", "c.name", F.get_json_object("c.arguments", "$.k").cast("bigint").alias("k"))
)
q("tool_channel_calls", "SELECT event_id, event_type AS name, props AS arguments FROM events")(
    lambda s, d: table(s, d, "events").withColumn("t", F.concat(F.lit("<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>commentary to=functions."), "event_type", F.lit(" <|constrain|>json<|message|>"), "props", F.lit("<|call|>"))).select("event_id", F.explode(T.channel_calls(F.col("t"))).alias("c")).select("event_id", "c.name", "c.arguments")
)
q("tool_xml_calls", "SELECT event_id, event_type AS name, user_id FROM events")(
    lambda s, d: table(s, d, "events").withColumn("t", F.concat(F.lit("<function="), "event_type", F.lit("><parameter=user>\n"), F.col("user_id").cast("string"), F.lit("\n</parameter></function>"))).select("event_id", F.explode(T.xml_calls(F.col("t"))).alias("c")).select("event_id", "c.name", F.col("c.parameters")["user"].try_cast("bigint").alias("user_id"))
)

# --- Nested values as text ---
q("nested_flatten", """SELECT row_id, data_source, ability, reward_model.style AS "reward_model/style", reward_model.ground_truth.answer AS "reward_model/ground_truth/answer", reward_model.ground_truth.gold_urls AS "reward_model/ground_truth/gold_urls", reward_model.ground_truth.source AS "reward_model/ground_truth/source" FROM rl_rows""")(
    lambda s, d: _flat(table(s, d, "rl_rows").select("row_id", "data_source", "ability", "reward_model"))
)


def _flat(df):
    return df.select(*T.flattened(df))


_EV = "event_id % 4 AS m, CAST(event_id AS VARCHAR) AS id"
q("text_trace_block", f"""WITH e AS (SELECT user_id, event_type, {_EV}, event_id FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e),
 l AS (SELECT user_id, k, n, CASE m WHEN 0 THEN concat('- search(''', event_type, ''') → 4 results', repeat(concat(chr(10), '    • ', event_type, ' — u', id, chr(10), '      ', repeat('s ', 100)), 3)) WHEN 1 THEN concat('- visit u', id, ' goal=''', event_type, ''' ok=True') WHEN 2 THEN concat('- final_answer: ', repeat('x', 200)) ELSE concat('- ', event_type) END AS line FROM k WHERE k <= 6)
 SELECT user_id, concat(string_agg(line, chr(10) ORDER BY k), CASE WHEN n > 6 THEN concat(chr(10), '... (', n - 6, ' more events omitted)') ELSE '' END) AS block FROM l GROUP BY user_id, n""")(lambda s, d: _traces(s, d))


def _traces(s, d):
    """Events of a user as a trace: searches with four long hits, visits, answers and others."""
    m, name = F.col("event_id") % 4, F.col("event_type")
    kind = F.when(m == 0, "search").when(m == 1, "visit").when(m == 2, "final_answer").otherwise(name)
    url = F.concat(F.lit("u"), F.col("event_id").cast("string"))
    hit = F.struct(name.alias("title"), url.alias("url"), F.repeat(F.lit("s "), F.lit(120)).alias("snippet"))
    # Put together are the keys; the long texts are made for the events that are shown.
    keys = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    first = keys.select("user_id", F.size("ids").alias("n"), F.explode(F.slice("ids", 1, 7)).alias("event_id")).join(table(s, d, "events").select("event_id", "event_type"), "event_id")
    e = F.struct("event_id", kind.alias("kind"), name.alias("query"), url.alias("url"), name.alias("goal"), F.lit(True).alias("ok"), F.repeat(F.lit("x"), F.lit(300)).alias("content"), F.array_repeat(hit, 4).alias("results"))
    t = first.groupBy("user_id", "n").agg(F.sort_array(F.collect_list(e)).alias("a"))
    return t.select("user_id", T.trace_block(F.col("a"), total=F.col("n")).alias("block"))


q("text_chain_block", """SELECT video_idx, concat('=== Hop 0 · Entity: ', coalesce(title, '?'), ' (depth=0, category=', coalesce(nullif(source_dataset, ''), '-'), ') ===', chr(10), 'Linked video: title=''', coalesce(title, '?'), ''', url=', fake_url, ', channel=None, duration=', CAST(CAST(floor(duration) AS BIGINT) AS VARCHAR), 's', chr(10),
 'Per-frame captions (subset):', chr(10), '  • t=0.50s — a', chr(10), '  ...(1 more frames omitted)', chr(10), '→ next entity picked: b (reason: c)', chr(10), chr(10), '=== Hop 1 · Entity: b (depth=1, category=-) ===', chr(10), 'Video synthesised description:', chr(10), 'sum', chr(10), 'Background properties (text-verified facts; safe to use as indirect descriptors):', chr(10), '  • p') AS block FROM videos WHERE fake_url IS NOT NULL AND duration IS NOT NULL""")(
    lambda s, d: _chains(s, d)
)


def _chains(s, d):
    kind = "struct<name:string,depth:int,category:string,title:string,url:string,channel:string,duration:bigint,summary:string,properties:array<string>,frames:array<struct<timestamp:double,caption:string>>,next:string,reason:string>"
    title = F.coalesce("title", F.lit("?"))
    pics = F.array(F.struct(F.lit(0.5).alias("timestamp"), F.lit("a").alias("caption")), F.struct(F.lit(1.5).alias("timestamp"), F.lit("b").alias("caption")))
    none = F.lit(None).cast("string")
    first = F.struct(title, F.lit(0), "source_dataset", title, "fake_url", none, F.floor("duration").cast("bigint"), none, F.array().cast("array<string>"), pics, F.lit("b"), F.lit("c")).cast(kind)
    second = F.struct(F.lit("b"), F.lit(1), none, none, none, none, F.lit(None).cast("bigint"), F.lit("sum"), F.array(F.lit("p")), F.array().cast("array<struct<timestamp:double,caption:string>>"), none, none).cast(kind)
    return table(s, d, "videos").where("fake_url is not null and duration is not null").select("video_idx", T.chain_block(F.array(first, second), most=1).alias("block"))


QUERIES, SQL = q.queries, q.sql
