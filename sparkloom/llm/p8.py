"""Queries of problem 8: personal information in documents."""

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.common import table
from sparkloom.llm.pii import Finder, common_words, lexicon, places, redacted

#: Setting with the key of the pseudonyms, in hexadecimal digits.
KEY = "sparkloom.pseudonym.key"


def _finder(spark: SparkSession, sf_dir: str) -> Finder:
    given, family = lexicon(table(spark, sf_dir, "name_parts"))
    return Finder(given, family, common_words(table(spark, sf_dir, "documents"), "text", given | family))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, start_pos of every place with personal information of the five kinds."""
    found = places(table(spark, sf_dir, "documents"), "doc_id", "text", _finder(spark, sf_dir))
    return found.where(F.col("kind").isin("email", "phone", "id", "address", "name")).select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the text with typed placeholders, for every document. The key is that of the session's setting; without one a new
    key is drawn, so that values are linked within the result only."""
    key = spark.conf.get(KEY, None)
    return redacted(table(spark, sf_dir, "documents"), "doc_id", "text", _finder(spark, sf_dir), bytes.fromhex(key) if key else secrets.token_bytes(32))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
SQL: dict[str, str] = {}
