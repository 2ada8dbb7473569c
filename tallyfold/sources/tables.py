"""Tables as Spark reads them, job files, and the sinks for contacts and dead letters."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
_NAMED = re.compile(rf"\b(FROM|JOIN)(\s+)({'|'.join(TABLES)})\b")
_ALIAS = re.compile(r"\s+[a-z]")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables that stand after its FROM and JOIN, read by Spark's Parquet source. The caller's views stay as they are."""
    mark = uuid.uuid4().hex
    names = {m[2] for m in _NAMED.findall(sql)}
    try:
        for name in names:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"{name}_{mark}")
        return spark.sql(_NAMED.sub(lambda m: f"{m[1]} {m[3]}_{mark}" + ("" if _ALIAS.match(sql, m.end()) else f" AS {m[3]}"), sql))
    finally:
        for name in names:
            spark.catalog.dropTempView(f"{name}_{mark}")


def job_files(spark: SparkSession, folder: str) -> DataFrame:
    """Queued jobs, one JSON file each, first in first out by modification time; unreadable ones carry _corrupt_record."""
    schema = "campaign_id string, campaign_name string, created_at string, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified_at")).orderBy("modified_at", "file_name")


# A contact's columns in CSV, in order.
CONTACT_COLUMNS = "companyName address phone rating reviews category website url locatedIn hours hoursDetail plusCode bookingLink email facebook instagram twitter yelp".split()


def write_contacts(contacts: DataFrame, path: str) -> None:
    """Append contacts' 18 columns as CSV with a header, a folder for each campaign and request; columns that contacts lack are empty."""
    cols = [(F.col(c).cast("string") if c in contacts.columns else F.lit("")).alias(c) for c in CONTACT_COLUMNS]
    contacts.select("campaign_id", "request_id", *cols).write.mode("append").option("header", True).partitionBy("campaign_id", "request_id").csv(path)


def write_dead_letters(contacts: DataFrame, path: str) -> None:
    """Append one JSON record for each failed batch: its keys, size and contacts."""
    fields = [c for c in contacts.columns if c not in ("campaign_id", "request_id", "batch_no")]
    batches = contacts.groupBy("campaign_id", "request_id", "batch_no").agg(F.count("*").alias("size"), F.collect_list(F.struct(*fields)).alias("contacts"))
    batches.drop("batch_no").write.mode("append").json(path)


def active_campaigns(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of the campaigns in JSON documents {campaigns: [...]}, those with both."""
    rows = spark.read.schema("campaigns array<struct<id:string,name:string>>").option("multiLine", True).json(path)
    return rows.select(F.inline("campaigns")).select(F.trim("id").alias("id"), F.trim("name").alias("name")).where("id <> '' and name <> ''")


def requests(spark: SparkSession, path: str, include_inuse: bool = False) -> DataFrame:
    """(id, req_text, status) of JSON documents {requests: [...]}: rows with an id, status in lower case; those in use only on demand."""
    rows = spark.read.schema("requests array<struct<id:string,req_text:string,status:string>>").option("multiLine", True).json(path)
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    rows = rows.select(F.inline("requests")).select(text("id"), text("req_text"), F.lower(text("status")).alias("status")).where("id <> ''")
    return rows if include_inuse else rows.where("status <> 'inuse'")


def progress(documents: DataFrame, campaign_id: str, column: str = "doc") -> DataFrame:
    """documents with `progress`: the text counts of campaigns[id].requests in a JSON column, empty where a level is missing or not of its kind."""
    at = F.get_json_object(column, f"$.campaigns['{campaign_id}'].requests")
    return documents.withColumn("progress", F.coalesce(F.from_json(at, "map<string,string>"), F.create_map().cast("map<string,string>")))


def campaign_stats(spark: SparkSession, path: str) -> DataFrame:
    """(campaign_id, contacts_without_email, template) from JSON documents; the template stays a JSON text for the plan that uses it."""
    schema = "campaign_id string, stats struct<contacts_without_email:string>, source_template string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("campaign_id", F.expr("try_cast(stats.contacts_without_email AS BIGINT)").alias("contacts_without_email"), F.col("source_template").alias("template"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log files as a stream of lines: (source, line, file), the source from [source] before a line."""
    rows = spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    return rows.select(F.regexp_extract("line", r"^\[([^\]]+)\] ", 1).alias("source"), F.regexp_replace("line", r"^\[[^\]]+\] ", "").alias("line"), "file")


def next_job(spark: SparkSession, folder: str) -> DataFrame:
    """The job that has waited longest; none where the queue is empty."""
    return job_files(spark, folder).where("campaign_id is not null").limit(1)
