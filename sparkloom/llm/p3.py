"""Queries of problem 3: oversized subtitles and segment texts cut at natural boundaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.splitting import findings, split_texts

#: Table and key of each target of size_limits that is measured in characters.
TARGETS = {"videos.subtitle": ("videos", "video_idx", "subtitle"), "transcript_segments.text": ("transcript_segments", "seg_id", "text")}


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """max_size and overlap by target; size_limits has one row per target, so this collects a handful of rows."""
    rows = table(spark, sf_dir, "size_limits").where(F.col("target").isin(*TARGETS)).collect()
    return {r["target"]: (r["max_size"], r["overlap"]) for r in rows}


def _pieces(spark: SparkSession, sf_dir: str, target: str, limit: tuple[int, int]) -> DataFrame:
    name, key, text = TARGETS[target]
    return split_texts(table(spark, sf_dir, name), key, text, *limit)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every subtitle and segment text."""
    parts = [_pieces(spark, sf_dir, t, x).withColumn("target", F.lit(t)) for t, x in sorted(_limits(spark, sf_dir).items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("target", "item_key", "piece_no", "start_pos", "end_pos", "piece", "cut_strength", "n_chars")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, item_key, kind of the values that the splitter had to cut, and those with an unbroken stretch."""
    parts = [findings(_pieces(spark, sf_dir, t, x), t, x[0]) for t, x in sorted(_limits(spark, sf_dir).items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, item_key of every text with what its pieces must keep: whole (they give the text back), fits (each within the limit), shares
    (consecutive ones share the overlap)."""
    parts = []
    for t, (most, overlap) in sorted(_limits(spark, sf_dir).items()):
        name, key, text = TARGETS[t]
        rows = F.sort_array(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece")))
        p = _pieces(spark, sf_dir, t, (most, overlap)).groupBy("item_key").agg(rows.alias("p"))
        again = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], overlap + 1, most))), "")
        fits = F.forall("p", lambda x: (F.length(x["piece"]) <= most) & (F.length(x["piece"]) == x["end_pos"] - x["start_pos"]))
        shares = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == F.size("p")) | (F.element_at("p", i)["end_pos"] - overlap == F.get("p", i)["start_pos"]))
        body = table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("item_key"), F.col(text).alias("body"))
        parts.append(p.join(body, "item_key").select(F.lit(t).alias("target"), "item_key", (again == F.col("body")).alias("whole"), fits.alias("fits"), shares.alias("shares")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_whole": p3_whole}

_STRETCH = r"[^\s.,;:!?…、。！？]"
SQL = {
    "p3_found": f"""
WITH v AS (
  SELECT 'videos.subtitle' AS target, video_idx AS item_key, subtitle AS body FROM videos
  UNION ALL SELECT 'transcript_segments.text', seg_id, text FROM transcript_segments),
big AS (SELECT v.*, l.max_size FROM v JOIN size_limits l USING (target) WHERE length(body) > l.max_size)
SELECT target, item_key, 'oversized' AS kind FROM big
UNION ALL
SELECT target, item_key, 'unbroken' FROM big
WHERE list_max(list_transform(regexp_extract_all(regexp_replace(body, '[\\x0b\\x1c-\\x1f\\x85\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g'), '{_STRETCH}+'), lambda x: length(x))) > max_size
""",
    "p3_whole": """
SELECT 'videos.subtitle' AS target, video_idx AS item_key, true AS whole, true AS fits, true AS shares FROM videos WHERE subtitle <> ''
UNION ALL SELECT 'transcript_segments.text', seg_id, true, true, true FROM transcript_segments WHERE text <> ''
""",
}
