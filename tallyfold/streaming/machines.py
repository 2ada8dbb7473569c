"""State machines over streams with keyed value and map state and timers: a crawl's frontier, and a pipeline run's stages.

They keep their state in RocksDB; `with_state_store` sets that for a session.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyfold.streaming.flows import STAGES

FRONTIER = "key string, n long, page_id long, outcome string, email string, queued int"
MACHINE = "run_id long, seq long, stage string, event string, accepted boolean, reason string, state string, completed int"
#: Why an event is refused, and a run's states; a machine's row tells their places.
REASONS = ("unsupported", "after done", "repeated", "out of order")
STATES = ("open", "failed", "done")


def with_state_store(spark: SparkSession) -> None:
    """State with maps and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Frontier(StatefulProcessor):
    """One contact's crawl: visits its pages in order until one has an e-mail, the budget is used, all that was queued is seen, or time is over.

    State: how far the crawl is (value), which links were seen (map, cleared at
    the end), and a timer from the first page on.
    """

    def __init__(self, budget: int, timeout_ms: int, by_event_time: bool):
        self.budget, self.timeout, self.by_event_time = budget, timeout_ms, by_event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.spot = handle.getValueState("spot", "last long, visited int, queued int, expires long, done boolean")
        self.seen = handle.getMapState("seen", "url string", "place int")

    def _end(self, spot: list, key, page, outcome: str, email=None) -> Row:
        last, visited, queued, expires, _ = spot
        if expires and not (outcome == "timed out" and page is None):
            self.handle.deleteTimer(expires)
        self.seen.clear()
        self.spot.update((last, visited, queued, 0, True))
        return Row(key=key[0], n=visited, page_id=page, outcome=outcome, email=email, queued=queued)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spot = list(self.spot.get()) if self.spot.exists() else None
        if spot and spot[4]:
            return
        after, left = (spot[0], self.budget - spot[1]) if spot else (-1, self.budget)
        # no more than the budget's rest can be visited: the others are never held
        for r in heapq.nsmallest(left, (r for r in rows if r.ord > after), key=lambda r: r.ord):
            if spot is None:
                expires = (r.at_ms if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()) + self.timeout
                self.handle.registerTimer(expires)
                spot = [r.ord, 0, 1, expires, False]
                self.seen.updateValue((r.url,), (0,))
            if self.by_event_time and r.at_ms > spot[3]:
                yield self._end(spot, key, None, "timed out")
                return
            spot[0], spot[1] = r.ord, spot[1] + 1
            if r.email is not None:
                yield self._end(spot, key, r.page_id, "found", r.email)
                return
            if spot[1] >= self.budget:
                yield self._end(spot, key, r.page_id, "budget")
                return
            for link in r.links or []:
                if spot[2] >= self.budget:
                    break
                if not self.seen.containsKey((link,)):
                    self.seen.updateValue((link,), (spot[2],))
                    spot[2] += 1
            if spot[1] >= spot[2]:
                yield self._end(spot, key, r.page_id, "complete")
                return
            yield Row(key=key[0], n=spot[1], page_id=r.page_id, outcome="more", email=None, queued=spot[2])
        if spot:
            self.spot.update(tuple(spot))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.spot.exists() and not self.spot.get()[4]:
            yield self._end(list(self.spot.get()), key, None, "timed out")

    def close(self) -> None:
        pass


def crawl_frontier(pages: DataFrame, links: int = 5, timeout_ms: int = 60_000, by_event_time: bool = True, lateness: str = "0 seconds") -> DataFrame:
    """A row for each page that a contact's crawl visits, and one for its end by time; FRONTIER has the columns.

    pages (key, ord, page_id, url, at, email, links): the answers of a contact's
    pages with their own best e-mail, if any, and their links in the order in
    which to go on. At most links + 1 pages are visited or queued. Pages come in
    order of `ord`, within a micro-batch in any; those at or below the last one
    visited, and all after the end, are left out. Null keys and orders are
    dropped. by_event_time: the timer runs on `at` and the watermark, else on
    the clock.
    """
    with_state_store(pages.sparkSession)
    rows = pages.where("key is not null and ord is not null")
    if by_event_time:
        rows = rows.withWatermark("at", lateness).withColumn("at_ms", F.unix_millis("at"))
    made = Frontier(max(1, links + 1), timeout_ms, by_event_time)
    return rows.groupBy("key").transformWithState(made, FRONTIER, "append", "EventTime" if by_event_time else "ProcessingTime")


@lru_cache(maxsize=4096)
def _step(told: str) -> tuple[int, bool]:
    """(place of the stage, -1 for one that isn't known, whether it failed) of an event as JSON."""
    event = json.loads(told)
    stage = event.get("stage")
    return STAGES.index(stage) if stage in STAGES else -1, event.get("event") == "fail"


class Machine(StatefulProcessor):
    """One run: takes the events that its stages' order allows and refuses the others with a reason.

    Rows cross to Python and back value by value, so they are narrow: seq and
    the event as one text, and back with one number for the verdict.
    """

    def init(self, handle) -> None:
        self.at = handle.getValueState("at", "completed int, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = completed, failed = tuple(self.at.get()) if self.at.exists() else (0, False)
        row, steps = Row("run_id", "seq", "told", "verdict"), len(STAGES)
        for r in sorted(rows, key=lambda r: r.seq):
            place, fails = _step(r.told)
            refused = 0
            if place < 0:
                refused = 1
            elif completed == steps:
                refused = 2
            elif place != completed:
                refused = 3 if place < completed else 4
            elif fails:
                failed = True
            else:
                completed, failed = completed + 1, False
            state = 2 if completed == steps else int(failed)
            yield row(key[0], r.seq, r.told, refused + 10 * state + 100 * completed)
        if (completed, failed) != before:
            self.at.update((completed, failed))

    def close(self) -> None:
        pass


def run_machine(events: DataFrame) -> DataFrame:
    """Each event (run_id, seq, stage, event 'complete' or 'fail') with whether the run takes it, why not, and the run's state after it; MACHINE has the columns.

    A stage is taken when all before it in STAGES are complete and it isn't; one
    that failed may be tried again. Events of a run come in order of seq, within
    a micro-batch in any; a run's events of one micro-batch must fit in a task.
    """
    with_state_store(events.sparkSession)
    rows = events.where("run_id is not null and seq is not null").select("run_id", "seq", F.to_json(F.struct("stage", "event")).alias("told"))
    told = rows.groupBy("run_id").transformWithState(Machine(), "run_id long, seq long, told string, verdict int", "append", "None")
    event, refused, state = F.from_json("told", "stage string, event string"), F.col("verdict") % 10, F.floor(F.col("verdict") / 10).cast("int") % 10
    reason = F.get(F.array(*map(F.lit, REASONS)), refused - 1)  # none before the first
    out = told.withColumn("event", event)
    return out.select("run_id", "seq", "event.stage", "event.event", (refused == 0).alias("accepted"), reason.alias("reason"), F.get(F.array(*map(F.lit, STATES)), state).alias("state"), F.floor(F.col("verdict") / 100).cast("int").alias("completed"))
