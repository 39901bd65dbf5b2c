"""Shared pieces of the registered queries: tables and text-rendered inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects queries with their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None, *tables: str):
        """Register a function of the named tables' frames."""

        def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[name] = lambda spark, d: f(*[table(spark, d, t) for t in tables])
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


def text_orders(orders: DataFrame) -> DataFrame:
    """Orders as a spreadsheet export would hold them: all text, some cells not as declared."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice")).cast("bigint").cast("string")
    return orders.select(
        k.cast("string").alias("id"),
        F.concat(F.lit("$"), cents).alias("amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(k % 10 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" "))).alias("status"),
        F.when(k % 2 == 0, F.lit("Yes")).otherwise(F.lit("no")).alias("paid"),
        F.when(k % 50 == 0, F.lit("oops")).otherwise((k % 7).cast("string")).alias("grade"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_day"),
    )


TEXT_ORDERS = """text_orders AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, '$' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS amount,
  strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE ' ' || o_orderstatus || ' ' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS paid, CASE WHEN o_orderkey % 50 = 0 THEN 'oops' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS grade,
  strftime(o_orderdate, '%m/%d/%Y') AS us_day FROM orders)"""


RATE_LIMIT_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT user_id, rn, event_id, ts, true AS admitted, [t] AS times FROM e WHERE rn = 1 UNION ALL
  SELECT user_id, rn, event_id, ts, len(held) < 2, CASE WHEN len(held) < 2 THEN list_append(held, t) ELSE held END
  FROM (SELECT e.user_id, e.rn, e.event_id, e.ts, e.t, list_filter(s.times, lambda x: x > e.t - 86400000000) AS held FROM s JOIN e ON e.user_id IS NOT DISTINCT FROM s.user_id AND e.rn = s.rn + 1))
SELECT user_id, event_id, ts, admitted FROM s"""
