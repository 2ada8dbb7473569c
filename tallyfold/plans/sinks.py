"""A query that sends contacts through the two-phase sink and reads back what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.plans.base import LISTING
from tallyfold.sources import outbox
from tallyfold.sources.tables import view
from tallyfold.streaming.flows import work_dir


def _accepts(batch: list[dict]) -> bool:
    """A stand-in for the network: it refuses batches with a contact of every seventeenth number."""
    return all(r["ord"] % 17 for r in batch)


def contact_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of each request that were sent, at once or alone, and that became dead letters."""
    contacts = view(spark, sf_dir, f"SELECT ord, campaign_id, request_id, name, phone FROM ({LISTING}) l")
    path = work_dir(spark, "outbox")
    spark.dataSource.register(outbox.outbox(_accepts, "tallyfold_outbox"))
    contacts.write.format("tallyfold_outbox").option("path", path).option("batch", 20).mode("append").save()
    sent = outbox.committed(spark, path, "sent", "ord long, campaign_id string, request_id string").groupBy("campaign_id", "request_id").agg(F.count("*").alias("sent"), F.lit(0).cast("long").alias("dead"))
    dead = outbox.committed(spark, path, "dead", outbox.DEAD).groupBy("campaign_id", "request_id").agg(F.lit(0).cast("long").alias("sent"), F.sum("size").alias("dead"))
    return sent.unionByName(dead).groupBy("campaign_id", "request_id").agg(F.sum("sent").alias("sent"), F.sum("dead").alias("dead"))


QUERIES = {"contact_outbox": contact_outbox}
ORACLES = {"contact_outbox": f"SELECT campaign_id, request_id, CAST(sum(CASE WHEN ord % 17 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS sent, CAST(sum(CASE WHEN ord % 17 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dead FROM ({LISTING}) l GROUP BY campaign_id, request_id"}
