"""Readers and writers: record files by extension, JSON lines, generations, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.draws import drawn
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines. Tolerant: blank and malformed lines are skipped and a missing path is empty. Strict: both raise."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_records(spark: SparkSession, paths: list[str], schema: StructType | str | None = None) -> DataFrame:
    """Files by extension (.parquet, .json, .jsonl), put together by name."""
    def one(path: str) -> DataFrame:
        ext = path.rstrip("/").rpartition(".")[2]
        if ext == "parquet":
            return spark.read.parquet(path)
        if ext in ("json", "jsonl"):
            return (spark.read.schema(schema) if schema else spark.read).json(path)
        raise ValueError(f"no reader for {path}")

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p) for p in paths])


def capped(parts: list[DataFrame], most: int, order: str) -> DataFrame:
    """Sources in their order with one cap over all of them, rows of a source by ``order``."""
    union = reduce(lambda a, b: a.unionByName(b), [p.withColumn("source_ord", F.lit(i)) for i, p in enumerate(parts)])
    return union.orderBy("source_ord", order).limit(most)


def sampled(df: DataFrame, key: str, most: int, seed: int | None = None) -> DataFrame:
    """The first ``most`` rows by key, or, with a seed, a reproducible sample without replacement."""
    return df.orderBy(drawn(key, seed) if seed is not None else F.col(key), key).limit(most)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet, keys compared trimmed and without letter case."""
    k = lambda: F.lower(F.trim(F.col(key).cast("string")))
    return df.withColumn("__k", k()).join(done.select(k().alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def write_unified(train: DataFrame, held: DataFrame, path: str) -> None:
    """Both splits with one schema, zstd Parquet, one folder per split; an empty split is an error."""
    for df, name in ((train, "train"), (held, "val")):
        if df.limit(1).count() == 0:
            raise ValueError(f"split {name} is empty")
    both = train.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("val")), allowMissingColumns=True)
    both.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def manifest(df: DataFrame, built_at: str) -> DataFrame:
    """One row: counts, and when it was built."""
    return df.agg(F.count("*").alias("num_records"), F.countDistinct("source_dataset").alias("num_sources")).withColumn("built_at", F.lit(built_at))


def complete_conversations(df: DataFrame, messages: str) -> DataFrame:
    """Rows whose last message is the assistant's."""
    return df.where(F.element_at(messages, -1)["role"] == "assistant")
