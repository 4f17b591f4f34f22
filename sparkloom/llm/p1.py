"""Queries of problem 1: clean speaker turns of segments and subtitles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.transcripts import Extractor, layouts, prepared_segments, roster_of, segment_lines, subtitle_lines, subtitle_turns


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    roster = roster_of(table(spark, sf_dir, "speakers"))
    segments = prepared_segments(table(spark, sf_dir, "transcript_segments"))
    subtitles = subtitle_lines(table(spark, sf_dir, "videos"))
    extractor = Extractor(*layouts(segments, subtitles, roster), roster)
    return segment_lines(segments, extractor), subtitle_turns(subtitles, extractor)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, item_key, turn_no, speaker_id of every turn."""
    lines, turns = _parts(spark, sf_dir)
    a = lines.where("opens").select(F.lit("segments").alias("origin"), F.col("seg_id").alias("item_key"), F.lit(0).alias("turn_no"), "speaker_id")
    return a.unionByName(turns.select(F.lit("subtitle").alias("origin"), "item_key", "turn_no", "speaker_id"))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean speech with its speaker: one row per turn of a subtitle, one per line of a segment turn (a turn of
    segments may be of any length; ``opens`` marks its first line)."""
    lines, turns = _parts(spark, sf_dir)
    a = lines.select(F.lit("segments").alias("origin"), "video_id", F.col("seg_id").alias("item_key"), F.col("run_no").alias("line_no"), "speaker_id", "opens", "start_s", "end_s", "speech")
    b = turns.select(F.lit("subtitle").alias("origin"), F.lit(None).cast("string").alias("video_id"), "item_key", F.col("turn_no").alias("line_no"), "speaker_id", F.lit(True).alias("opens"), "start_s", F.lit(None).cast("double").alias("end_s"), "speech")
    return a.unionByName(b)


QUERIES = {"p1_found": p1_found, "p1_turns": p1_turns}
SQL: dict[str, str] = {}
