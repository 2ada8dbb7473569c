"""Shared plumbing: tables in the cluster's shared folder, file access, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local mode, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor costs a task and not the job."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing will read again."""
    spark, path = df.sparkSession, df._stored_at
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a path in the shared folder."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri.removeprefix("file://")
    return fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of texts that this session moves between its executors and their Python workers.

    By rows alone a batch of texts takes tens of MB, and the JVM holds it twice while it grows; a smaller number of bytes that the caller set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not (now or "").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: idle workers live on beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, parts: int):
    """Whether crc32 of the id as text leaves 1 by `parts`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 1, F.lit(False))


def by_key(batches, key, columns, grown=lambda batch: {}):
    """Columns, as arrays, of all rows of one key after another; rows come in order of their key, of integer columns. grown: further columns of a batch."""
    import numpy as np

    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy() for c in (*key, *columns)} | grown(batch)
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in key:
            new |= cols[c][1:] != cols[c][:-1]
        cut = (np.flatnonzero(new) + 1).tolist()
        for i, j in zip([0, *cut], [*cut, batch.num_rows]):
            part = {c: v[i:j] for c, v in cols.items()}
            if held and any(held[0][c][0] != part[c][0] for c in key):
                yield held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in part}
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (a, b), component the smallest node reachable.

    Alternating large-star and small-star contraction: each step ties a node's
    larger (or smaller) neighbours to the smallest one, and ends when no edge
    changes, after O(log^2 n) rounds. Nodes are longs; edges may repeat, point
    either way or be loops. A hot node is a hot join key with one narrow row on
    the other side, which adaptive execution splits.
    """
    norm = lambda e: e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(norm(edges.select("a", "b")), "edges")
    was = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge now points down; the smaller neighbours of a node join its smallest
        large = norm(large)
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        new = stored(norm(small), "edges")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = new
        if mark == was:
            break
        was = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
