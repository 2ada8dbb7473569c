"""Flows over streams of jobs, log lines and crawl events.

Each takes a streaming DataFrame and returns one; drain() runs a flow over all
that has arrived, into Parquet, one folder a micro-batch: a batch that runs
again after a failure replaces its own folder, so results hold each row once.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a temporary one in local mode where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
    return f"{shared.rstrip('/')}/tallyfold/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, for flows that read them more than once."""
    path = work_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream with the schema it has now."""
    path = path.rstrip("/")
    # the file source takes a single file only by a pattern; this one matches the path alone
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def jobs(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Job files as they arrive, each once."""
    schema = "campaign_id string, campaign_name string, created_at string"
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder).where("campaign_id is not null")


def unseen(rows: DataFrame, *key: str) -> DataFrame:
    """The first row of each key over the stream's whole life; which of several in one micro-batch is open."""
    return rows.dropDuplicates(list(key))


def unseen_within(rows: DataFrame, at: str, delay: str, *key: str) -> DataFrame:
    """The first row of each key, which is forgotten `delay` after its time: state holds the keys of that long and no more.

    Rows of one key whose times are within the delay of each other come once; a
    key that comes back later may come again. Rows behind the watermark are left
    out; late_rows() tells how many.
    """
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def late_rows(progress: list[dict]) -> int:
    """Of a flow's progress reports: rows that were left out as they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def outcome_counts(lines: DataFrame) -> DataFrame:
    """Running counts by (source, kind) of log lines (source, line); the tests hold in this order."""
    line = F.trim("line")
    arrow = line.contains("->")
    done = line.contains("✓ DONE") & arrow
    kind = (
        F.when(line.contains("FACEBOOK FOUND ") & arrow, "social")
        .when(done & line.contains("[FB priority]"), "social")
        .when(done, "regular")
        .when((line.contains(" - INFO - FOUND ") | line.startswith("FOUND ")) & arrow, "regular")
        .otherwise("none")
    )
    return lines.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The row with the greatest order of each key so far."""
    last = F.max_by(F.struct(order, *columns), F.col(order)).alias("last")
    return rows.groupBy(key).agg(last).select(key, "last.*")


def cooldown(events: DataFrame, key: str, at: str, seconds: float, event_id: str) -> DataFrame:
    """Events (key, event_id, at_us) that come `seconds` or more after the last one kept of their key.

    One micro-batch's events of a key are taken by (time, id), so they must fit
    in a task; bound them with maxFilesPerTrigger. An event older than the last
    one kept by an earlier micro-batch is dropped. Null keys and times are dropped.
    """
    import pandas as pd

    gap = int(seconds * 1_000_000)

    def run(k, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at_us", "event_id"])
        kept = []
        for e, t in zip(rows["event_id"].tolist(), rows["at_us"].tolist()):
            if last is None or t - last >= gap:
                last = t
                kept.append((k[0], e, t))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["key", "event_id", "at_us"])

    rows = events.select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us")).dropna(subset=["key", "at_us"])
    return rows.groupBy("key").applyInPandasWithState(run, "key long, event_id long, at_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def crawl_ends(events: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """(key, queued, seen, outcome) once a key's crawl ends: from events (key string, kind 'queued' or 'seen').

    A crawl is complete when as many pages were seen as queued, at the end of a
    micro-batch; it is timed out when a key gets no event for timeout_ms. Other
    kinds count as neither, null keys are dropped, and a key that has ended
    starts anew with its next event.
    """
    import pandas as pd

    columns = ["key", "queued", "seen", "outcome"]

    def run(k, frames, state):
        queued, seen = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], queued, seen, "timed out")], columns=columns)
            return
        for f in frames:
            queued += int((f["kind"] == "queued").sum())
            seen += int((f["kind"] == "seen").sum())
        if 0 < queued <= seen:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(k[0], queued, seen, "complete")], columns=columns)
            return
        state.update((queued, seen))
        state.setTimeoutDuration(timeout_ms)

    rows = events.select("key", "kind").where("key is not null")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, queued long, seen long, outcome string", "queued long, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: A run's stages, in order.
STAGES = ("maps_scrape", "cleanup_contacts", "email_fast", "email_fallback", "finalize")


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, seq, stage, state, next_stage) of each run so far, from events (run_id, seq, stage, event 'complete' or 'fail'); in update mode a row a change."""
    last = events.groupBy("run_id").agg(F.max_by(F.struct("seq", "stage", "event"), "seq").alias("last")).select("run_id", "last.*")
    state = F.when(~F.col("stage").isin(*STAGES), "unsupported").when(F.col("event") == "fail", "failed").when(F.col("stage") == STAGES[-1], "done").otherwise("open")
    after = F.create_map(*[F.lit(x) for pair in zip(STAGES, STAGES[1:]) for x in pair])
    return last.select("run_id", "seq", "stage", state.alias("state"), F.when(state == "open", after[F.col("stage")]).alias("next_stage"))


def late_counts(events: DataFrame, width: str = "1 hour", lateness: str = "30 minutes") -> DataFrame:
    """Counts by window and type of events (ts, event_type); events later than the watermark are left out. An extension: the contact rules have no event time."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def flush(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", once: bool = False) -> list[dict]:
    """Hand each micro-batch of what has arrived to sink(batch, number); the checkpoint remembers what went through. Returns Spark's progress reports.

    once takes it all as one micro-batch: crawl_ends, which watches the clock, would otherwise go on with empty ones for ever.
    """
    trigger = {"once": True} if once else {"availableNow": True}
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(sink).start()
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def follow(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], should_stop: Callable[[], bool], progress: Callable[[dict], None] | None = None, seconds: float = 1.0) -> None:
    """Hand micro-batches to sink(batch, number) as they come, until should_stop(); progress gets each one's figures as Spark reports them."""
    query = rows.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(sink).start()
    told = -1
    try:
        while not should_stop() and query.isActive:
            query.awaitTermination(seconds)
            for p in query.recentProgress:
                if progress and p["batchId"] > told:
                    told = p["batchId"]
                    progress(p)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()


def drain(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a flow gives for what has arrived: each batch's rows in append mode, the last batch's in complete mode."""
    spark, path = rows.sparkSession, work_dir(rows.sparkSession, name)

    folder = lambda number: f"{path}/rows" if mode == "complete" else f"{path}/rows/tallyfold_batch={number}"
    spark.createDataFrame([], rows.schema).write.parquet(folder(-1))  # what a stream without rows gives

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder(number))

    flush(rows, f"{path}/checkpoint", keep, mode)
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").select(*rows.columns)


def drain_in_parts(parts: list[DataFrame], flow: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> tuple[DataFrame, list[dict]]:
    """What a flow gives in append mode when parts arrive one after another, a micro-batch each, and Spark's progress reports.

    Each part is written beside those before it and taken by the same
    checkpoint, as if the stream had been stopped between.
    """
    spark = parts[0].sparkSession
    path = work_dir(spark, name)
    out, progress = None, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/tallyfold_batch={number}")

    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        rows = flow(spark.readStream.schema(parts[0].schema).parquet(f"{path}/in"))
        if out is None:
            out = rows.schema
            spark.createDataFrame([], out).write.parquet(f"{path}/rows/tallyfold_batch=-1")
        progress += flush(rows, f"{path}/checkpoint", keep, mode)
    return spark.read.schema(out).parquet(f"{path}/rows").select(*out.names), progress
