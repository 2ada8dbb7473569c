"""A sink for contacts in two phases: tasks send batches and write what became of them, the driver makes a whole job's files count at once.

A task writes its files under a name of its own: job, partition and attempt. The
driver's commit writes one manifest, by a temporary name and a rename, that names
the files of the attempts that ended well. Readers follow manifests, so a task
that runs again, a job that fails and a commit that is repeated leave no row
twice and none by half. What was sent and what wasn't come out of one write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tallyfold.sources.files import file_system

#: Rows of a batch, and keys that a task holds open batches of.
BATCH, OPEN_KEYS = 20, 1000
KINDS = ("sent", "dead")
DEAD = "timestamp string, campaign_id string, request_id string, size long, contacts array<string>"


@dataclass
class Files(WriterCommitMessage):
    """A task's files, and its rows by kind."""

    names: dict
    rows: dict


class _Task:
    """What one attempt writes."""

    def __init__(self, path: str, name: str, accepts: Callable[[list[dict]], bool]):
        self.fs, self.at = file_system(path)
        self.name, self.accepts, self.streams = name, accepts, {}
        self.rows = dict.fromkeys(KINDS, 0)

    def put(self, kind: str, records: list[dict]) -> None:
        if kind not in self.streams:
            self.fs.create_dir(f"{self.at}/{kind}", recursive=True)
            self.streams[kind] = self.fs.open_output_stream(f"{self.at}/{kind}/{self.name}.jsonl", compression=None)
        self.streams[kind].write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in records).encode())

    def send(self, key: tuple, batch: list[dict]) -> None:
        """A batch at once; where it is refused, each row alone, and what is refused again as one dead letter."""
        sent = batch if self.accepts(batch) else [r for r in batch if self.accepts([r])] if len(batch) > 1 else []
        if sent:
            self.put("sent", sent)
        taken = set(map(id, sent))
        dead = [r for r in batch if id(r) not in taken]
        if dead:
            now = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
            self.put("dead", [{"timestamp": now, "campaign_id": key[0], "request_id": key[1], "size": len(dead), "contacts": dead}])
        self.rows["sent"] += len(sent)
        self.rows["dead"] += len(dead)

    def close(self) -> None:
        for s in self.streams.values():
            s.close()


class _Writer(DataSourceWriter):
    def __init__(self, path: str, size: int, job: str, accepts: Callable[[list[dict]], bool]):
        self.path, self.size, self.job, self.accepts = path, size, job, accepts

    def write(self, iterator: Iterator) -> Files:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = _Task(self.path, f"{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}", self.accepts)
        held: dict[tuple, list[dict]] = {}
        for row in iterator:
            record = row.asDict(recursive=True)
            key = (str(record.get("campaign_id") or ""), str(record.get("request_id") or ""))
            batch = held.setdefault(key, [])
            batch.append(record)
            if len(batch) >= self.size:
                task.send(key, held.pop(key))
            elif len(held) > OPEN_KEYS:  # the batch that has been open for longest goes as it is
                oldest = next(iter(held))
                task.send(oldest, held.pop(oldest))
        for key, batch in held.items():
            task.send(key, batch)
        task.close()
        return Files({k: task.name for k in task.streams}, task.rows)

    def commit(self, messages) -> None:
        """The job's manifest, whole or not at all; a job without rows has an empty one."""
        fs, at = file_system(self.path)
        done = [m for m in messages if m is not None]
        manifest = {"job": self.job, "rows": {k: sum(m.rows[k] for m in done) for k in KINDS}, **{k: sorted(m.names[k] for m in done if k in m.names) for k in KINDS}}
        fs.create_dir(f"{at}/_commits", recursive=True)
        with fs.open_output_stream(f"{at}/_commits/.{self.job}", compression=None) as f:
            f.write(json.dumps(manifest).encode())
        fs.move(f"{at}/_commits/.{self.job}", f"{at}/_commits/{self.job}.json")

    def abort(self, messages) -> None:
        """Delete what the job's tasks wrote; what a lost task leaves is in no manifest."""
        from pyarrow import fs as F_

        fs, at = file_system(self.path)
        for kind in KINDS:
            for x in fs.get_file_info(F_.FileSelector(f"{at}/{kind}", allow_not_found=True)):
                if x.base_name.startswith(f"{self.job}-"):
                    fs.delete_file(x.path)


def outbox(accepts: Callable[[list[dict]], bool], name: str = "outbox") -> type[DataSource]:
    """A data source to register (spark.dataSource.register): df.write.format(name).option("path", ...).mode("append").save().

    accepts(batch) sends rows and says whether they were taken; tasks that run
    again send again, so it should be idempotent by contact. Options: path, a
    folder that all executors share; batch, rows of a batch, which are of one
    campaign and request.
    """

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if overwrite:
                raise ValueError("an outbox is only appended to")
            return _Writer(self.options["path"].rstrip("/"), max(1, int(self.options.get("batch", BATCH))), uuid.uuid4().hex, accepts)

    return Outbox


def committed(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of a kind that committed jobs wrote: sent contacts, or dead letters (DEAD, or a schema of contacts)."""
    from pyarrow import fs as F_

    fs, at = file_system(path)
    names = []
    for x in fs.get_file_info(F_.FileSelector(f"{at}/_commits", allow_not_found=True)):
        if x.base_name.endswith(".json") and not x.base_name.startswith("."):
            with fs.open_input_stream(x.path, compression=None) as f:
                names += [f"{path.rstrip('/')}/{kind}/{n}.jsonl" for n in json.loads(f.read())[kind]]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)
