"""Batches committed one by one under a folder, and the corpus they make together.

A batch's tables are written first, each by Spark's committer, its done mark last; what has no mark was never committed and is
written again. Local numbers (videos and vectors of the batch, from 0) become global when the batches are merged: each is shifted by the sizes of the
batches before it, in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.files import _exists

#: Tables of a batch; all but the records may be missing.
TABLES = ("records", "embeddings", "keyframe_meta", "skipped")


def committed(spark: SparkSession, root: str) -> list[int]:
    """Ids of the committed batches, in order: one small mark per batch."""
    if not _exists(spark, f"{root}/done"):
        return []
    return [r[0] for r in spark.read.schema("n bigint, batch_id bigint").parquet(f"{root}/done").select("batch_id").distinct().orderBy("batch_id").collect()]


def commit_batch(root: str, batch_id: int, records: DataFrame, embeddings: DataFrame | None = None, keyframe_meta: DataFrame | None = None, skipped: DataFrame | None = None) -> None:
    """Write a batch. records: a row per video with a dense local ``record_no``; embeddings: vector_row (local), embedding; keyframe_meta:
    video_idx and vector_row (local), timestamp; skipped: video_id. A batch that is committed already is an error."""
    spark = records.sparkSession
    if batch_id in committed(spark, root):
        raise ValueError(f"batch {batch_id} is committed")
    for name, df in zip(TABLES, (records, embeddings, keyframe_meta, skipped)):
        if df is not None:
            df.drop("batch_id").write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    n = spark.read.parquet(f"{root}/records/batch_id={batch_id}").count()
    vectors = spark.read.parquet(f"{root}/embeddings/batch_id={batch_id}").count() if embeddings is not None else 0
    spark.createDataFrame([(n, vectors)], "n bigint, vectors bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/done/batch_id={batch_id}")


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of all committed batches under global numbers: videos, embeddings, keyframe_meta, skipped, and url_map (last one
    wins), which is made from the videos. A table no batch has is not among them; a folder without batches gives none."""
    done = committed(spark, root)
    if not done:
        return {}
    marks = spark.read.schema("n bigint, vectors bigint, batch_id bigint").parquet(f"{root}/done")
    before = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per batch
    shift = marks.select("batch_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__v"), F.coalesce(F.sum("vectors").over(before), F.lit(0)).alias("__r"))
    out: dict[str, DataFrame] = {}
    for name in TABLES:
        if not _exists(spark, f"{root}/{name}"):
            continue
        t = spark.read.parquet(f"{root}/{name}").withColumn("batch_id", F.col("batch_id").cast("bigint")).where(F.col("batch_id").isin(done)).join(F.broadcast(shift), "batch_id")
        if name == "records":
            t = t.withColumn("video_idx", F.col("__v") + F.col("record_no"))
        if name == "keyframe_meta":
            t = t.withColumn("video_idx", F.col("__v") + F.col("video_idx"))
        if name in ("embeddings", "keyframe_meta"):
            t = t.withColumn("vector_row", F.col("__r") + F.col("vector_row"))
        out["videos" if name == "records" else name] = t.drop("__v", "__r")
    if {"fake_url", "local_path"} <= set(out["videos"].columns):
        out["url_map"] = out["videos"].where("fake_url is not null").groupBy("fake_url").agg(F.max_by("local_path", "video_idx").alias("local_path"))
    return out
