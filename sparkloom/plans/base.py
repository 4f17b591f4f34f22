"""Shared inputs of the rollout queries: token rows and rollout rows over the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.common import table

#: Token rows: one per lineitem; a sequence is an order, its group (uid) the customer.
TOK = """tok AS (SELECT l_orderkey AS seq, o_custkey AS uid,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pos,
  -l_discount * 5 AS logp, -l_tax * 7 AS old_logp, (l_quantity - 25) / 10 AS adv, l_extendedprice / 100000 AS reward,
  l_quantity / 50 AS val, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
#: Rollout rows: one per event; its group is the user.
ROLL = "roll AS (SELECT event_id AS idx, user_id AS uid, event_type AS kind, value AS score FROM events)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return items.select(
        F.col("l_orderkey").alias("seq"), F.col("o_custkey").alias("uid"), F.row_number().over(order).alias("pos"),
        (-F.col("l_discount") * 5).alias("logp"), (-F.col("l_tax") * 7).alias("old_logp"), ((F.col("l_quantity") - 25) / 10).alias("adv"),
        (F.col("l_extendedprice") / 100000).alias("reward"), (F.col("l_quantity") / 50).alias("val"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("uid"), F.col("event_type").alias("kind"), F.col("value").alias("score"))


def rnd(column, digits: int = 5):
    """Cut to ``digits`` decimals off the usual ties, so that the order of a sum cannot tip the last digit."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c.cast("double") * 10.0**digits + 0.4137) / 10.0**digits


def _expand(sql: str) -> str:
    """Write out rnd(expression, digits) of a SQL text."""
    while (a := sql.find("rnd(")) >= 0:
        depth, i, comma = 0, a + 3, 0
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            if depth == 0:
                break
            i += 1
        scale = "1" + "0" * int(sql[comma + 1 : i])
        sql = f"{sql[:a]}floor(CAST(({sql[a + 4 : comma]}) AS DOUBLE) * {scale}.0 + 0.4137) / {scale}.0{sql[i + 1 :]}"
    return sql


def drawn(*parts: str) -> str:
    """SQL of ``functions.draws.drawn`` over SQL expressions."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def uniform(*parts: str) -> str:
    """SQL of ``functions.draws.uniform``."""
    return f"(({drawn(*parts)} + 0.5) / 4294967296.0)"


class Book:
    """Queries and their SQL, filled by a decorator."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"query {name} exists")
            self.queries[name] = f
            if sql:
                self.sql[name] = _expand(sql)
            return f

        return keep
