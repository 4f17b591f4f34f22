"""Queries of problem 2: records of a batch that repeat the history."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.batchdedup import refused


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_record_id, record_id of every record to refuse."""
    return refused(table(spark, sf_dir, "batch_records"), table(spark, sf_dir, "checkpoint_state"))


def p2_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per committed batch its records, how many are refused as repeats and how many as skipped videos."""
    records = table(spark, sf_dir, "batch_records")
    bad = refused(records, table(spark, sf_dir, "checkpoint_state"))
    rows = records.join(table(spark, sf_dir, "checkpoint_state").select("batch_id"), "batch_id").select("record_id", "batch_id").distinct()
    rows = rows.join(bad, "record_id", "left")
    return rows.groupBy("batch_id").agg(F.count("*").alias("records"), F.count_if(F.col("first_record_id") > 0).alias("repeats"), F.count_if(F.col("first_record_id") == 0).alias("skipped"))


QUERIES = {"p2_found": p2_found, "p2_by_batch": p2_by_batch}
SQL: dict[str, str] = {}
