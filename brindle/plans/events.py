"""Event-time queries over ``events`` (extension) and the numbering of representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import table
from brindle.sources.sinks import numbered
from brindle.streaming.batches import sessions, windowed


def _events(spark, d):
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = windowed(_events(spark, d), "at", "event_type", "value", "1 day")
    return w.select(F.unix_seconds("start").alias("start"), "key", "n", F.round("total", 6).alias("total"))


def session(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(_events(spark, d), "at", "user_id", "6 hours")
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    """WIN10, SNK7: sequential number of each distinct representative by sample and element."""
    return numbered(table(spark, d, "rep_index").select("sample_id", "ie_id").distinct(), ["sample_id", "ie_id"], "number")


QUERIES = {"ext_tumbling": tumbling, "ext_sessions": session, "win10_numbers": numbers}
ORACLE = {
    "ext_tumbling": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type AS key, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "ext_sessions": """WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)), c AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY ALL) SELECT user_id AS key, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
    "win10_numbers": "SELECT sample_id, ie_id, row_number() OVER (ORDER BY sample_id NULLS FIRST, ie_id) AS number FROM (SELECT DISTINCT sample_id, ie_id FROM rep_index)",
}
