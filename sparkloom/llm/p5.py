"""Queries of problem 5: val and test rows that ask what a train row asks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.crosssplit import cross_split_counts, cross_split_pairs

#: Least overlap of a pair; measured on all same-answer pairs, see README.
FRACTION = 0.15


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform(F.filter("prompt", lambda m: m["role"] == "user"), lambda m: m["content"])
    rows = table(spark, sf_dir, "rl_rows").select(
        "row_id", "data_source", F.lower(F.trim("extra_info.split")).alias("split"), F.array_join(said, "\n").alias("question"), F.col("reward_model.ground_truth.answer").alias("answer")
    )
    return rows.where(F.col("split").isin("train", "val", "test")).withColumn("in_train", F.col("split") == "train")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_a < row_b, one in train, the other in val or test, that ask the same and have the same answer."""
    pairs = cross_split_pairs(_questions(spark, sf_dir), "row_id", "in_train", "question", "answer", FRACTION)
    return pairs.select(F.least("left_id", "right_id").alias("row_a"), F.greatest("left_id", "right_id").alias("row_b"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and data source (case folded) of the held-out row: pairs, and distinct held-out rows in them."""
    rows = _questions(spark, sf_dir)
    counts = cross_split_counts(rows, "row_id", "in_train", "question", "answer", FRACTION)
    held = rows.select(F.col("row_id").alias("right_id"), "split", F.lower(F.trim("data_source")).alias("data_source")).distinct()
    return counts.join(held, "right_id").groupBy("split", "data_source").agg(F.sum("partners").alias("pairs"), F.count("*").alias("leaked_rows"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL: dict[str, str] = {}
