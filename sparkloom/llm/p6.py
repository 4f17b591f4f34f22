"""Queries of problem 6: documents packed into containers of a fixed token capacity."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.packing import pack


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "size_limits").where("target = 'documents.text'").first()["max_size"]


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container_id, slot, token_offset, doc_id, piece_no, n_tokens, char_start, char_end of every document piece."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", _capacity(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: pieces, tokens, containers, the least possible number of containers, and the share of room used."""
    capacity = _capacity(spark, sf_dir)
    packed = pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity)
    total = packed.agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), (F.max("container_id") + 1).alias("containers"))
    return total.select("*", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("used"))


QUERIES = {"p6_packing": p6_packing, "p6_report": p6_report}
SQL: dict[str, str] = {}
