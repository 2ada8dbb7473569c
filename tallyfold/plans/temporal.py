"""Queries that join by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.temporal import asof_join, interval_join

_HOUR = 3_600_000_000
#: Orders placed within the month of the events, by their key.
_PLACED = "1704067200000000 + (o_orderkey % 43200) * 60000000"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


def q_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last order in the week before it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS user_id", "o_orderkey", f"{_PLACED} AS placed_us")
    return asof_join(_events(spark, sf_dir), orders, "user_id", "at_us", "placed_us", ["o_orderkey", "placed_us"], "o_orderkey", 168 * _HOUR)


def q_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of two hours, one from every twentieth event, with how many of their worker's events fall into them."""
    events = _events(spark, sf_dir).withColumn("worker", F.col("user_id") % 4)
    leases = events.where("event_id % 20 = 0").select(F.col("event_id").alias("lease_id"), "worker", F.col("at_us").alias("from_us"), (F.col("at_us") + 2 * _HOUR).alias("to_us"))
    found = interval_join(leases, events.select("worker", "event_id", "at_us"), "from_us", "to_us", "at_us", 2 * _HOUR, "worker")
    return found.groupBy("lease_id", "worker").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


QUERIES = {"q_asof": q_asof, "q_interval": q_interval}
ORACLES = {
    "q_asof": f"""SELECT e.event_id, e.user_id, epoch_us(e.ts) AS at_us, CASE WHEN epoch_us(e.ts) - o.placed_us <= {168 * _HOUR} THEN o.o_orderkey END AS o_orderkey, CASE WHEN epoch_us(e.ts) - o.placed_us <= {168 * _HOUR} THEN o.placed_us END AS placed_us
FROM events e ASOF LEFT JOIN (SELECT o_custkey, {_PLACED} AS placed_us, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, {_PLACED}) o ON o.o_custkey = e.user_id AND o.placed_us <= epoch_us(e.ts)""",
    "q_interval": f"""WITH e AS (SELECT event_id, user_id % 4 AS worker, epoch_us(ts) AS at_us FROM events)
SELECT a.event_id AS lease_id, a.worker, count(*) AS n, max(b.event_id) AS last_event FROM e a JOIN e b ON a.worker = b.worker AND b.at_us >= a.at_us AND b.at_us < a.at_us + {2 * _HOUR} WHERE a.event_id % 20 = 0 GROUP BY a.event_id, a.worker""",
}
