"""Queries of problem 7: test items that leaked into documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.leaks import leaks


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: the document holds at least 15 consecutive words of the item."""
    pairs = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"))
    return pairs.where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item the documents that hold it verbatim and in paraphrase."""
    pairs = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"))
    return pairs.groupBy("item_id").agg(F.count_if(F.col("kind") == "verbatim").alias("verbatim_docs"), F.count_if(F.col("kind") == "paraphrase").alias("paraphrase_docs"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL: dict[str, str] = {}
