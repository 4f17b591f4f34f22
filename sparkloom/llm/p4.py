"""Queries of problem 4: the most similar keyframe vectors of every vector."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.pivots import nearest

THRESHOLD = 0.92


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar other vectors of every usable vector, with the video of each side."""
    near = nearest(table(spark, sf_dir, "keyframe_vectors"), "vector_row", "embedding")
    video = table(spark, sf_dir, "keyframe_meta").groupBy("vector_row").agg(F.min("video_idx").alias("video_idx"))
    near = near.join(video.select(F.col("vector_row").alias("id"), "video_idx"), "id", "left")
    near = near.join(video.select(F.col("vector_row").alias("neighbour"), F.col("video_idx").alias("neighbour_video_idx")), "neighbour", "left")
    return near.select(F.col("id").alias("vector_row"), "video_idx", "rank", F.col("neighbour").alias("neighbour_row"), "neighbour_video_idx", F.round("cosine", 6).alias("cosine"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the neighbour lists with a cosine of at least 0.92, row_a < row_b."""
    near = nearest(table(spark, sf_dir, "keyframe_vectors"), "vector_row", "embedding")
    near = near.where(F.col("cosine") >= THRESHOLD)
    return near.select(F.least("id", "neighbour").alias("row_a"), F.greatest("id", "neighbour").alias("row_b")).distinct()


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
SQL = {
    "p4_found": """
WITH u AS (SELECT DISTINCT vector_row AS r, CAST(embedding AS DOUBLE[64]) AS e FROM keyframe_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.r AS row_a, b.r AS row_b FROM u a JOIN u b ON a.r < b.r AND array_cosine_similarity(a.e, b.e) >= 0.92
""",
}
