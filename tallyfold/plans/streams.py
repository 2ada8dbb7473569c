"""Named queries that run a streaming flow over a whole table, and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.dialect import DuckDB, Spark
from tallyfold.operators.ranking import keep_first
from tallyfold.plans import records
from tallyfold.plans.base import hosts, mailed, ranked
from tallyfold.sources.tables import view
from tallyfold.streaming import flows, machines

LINE = "CASE event_id % 6 WHEN 0 THEN 'FACEBOOK FOUND a -> b' WHEN 1 THEN '✓ DONE (1/2): a -> b [FB priority]' WHEN 2 THEN '✓ DONE (1/2): a -> b [1.0s]' WHEN 3 THEN 'x - INFO - FOUND a -> b' WHEN 4 THEN '✓ DONE (1/2): a (no email)' ELSE event_type END"
SOURCE = "concat('s', user_id % 4)"


def _events(spark, sf_dir):
    return flows.rows_of(spark, f"{sf_dir}/events.parquet")


def stream_outcome_counters(spark, sf_dir):
    return flows.drain(flows.outcome_counts(_events(spark, sf_dir).selectExpr(f"{SOURCE} AS source", f"{LINE} AS line")), "counters", "complete")


def stream_last_activity(spark, sf_dir):
    return flows.drain(flows.latest(_events(spark, sf_dir).selectExpr(f"{SOURCE} AS source", "event_id AS seq", f"{LINE} AS line"), "source", "seq", "line"), "activity", "complete")


def stream_unseen_keys(spark, sf_dir):
    return flows.drain(flows.unseen(_events(spark, sf_dir).select("user_id", "event_type"), "user_id", "event_type"), "unseen")


def stream_cooldown(spark, sf_dir):
    return flows.drain(flows.cooldown(_events(spark, sf_dir), "user_id", "ts", 3600, "event_id"), "cooldown")


def stream_run_states(spark, sf_dir):
    return flows.drain(flows.run_states(_events(spark, sf_dir).selectExpr("user_id AS run_id", "event_id AS seq", f"{_STAGE} AS stage", "CASE WHEN event_id % 11 = 0 THEN 'fail' ELSE 'complete' END AS event")), "runs", "complete")


def stream_watermarked_counts(spark, sf_dir):
    """All windows: in complete mode the watermark closes none."""
    return flows.drain(flows.late_counts(_events(spark, sf_dir).selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type")), "late", "complete")


def _parts(rows, by, n):
    """rows in n parts, one after another by an integer column."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return [rows]
    part = F.least(F.floor((F.col(by) - low) * n / (high - low + 1)), F.lit(n - 1))
    return [rows.where(part == i) for i in range(n)]


def stream_unseen_recent(spark, sf_dir):
    """Users' event types, once an hour, from four parts; the hours that are over leave the state."""
    rows = _events_as_rows(spark, sf_dir).selectExpr("user_id", "event_type", "date_trunc('hour', ts) AS hour", "ts", "event_id")
    return flows.drain_in_parts(_parts(rows, "event_id", 4), lambda r: flows.unseen_within(r, "ts", "2 hours", "user_id", "event_type", "hour").select("user_id", "event_type", "hour"), "recent")[0]


def stream_closed_windows(spark, sf_dir):
    """Windows that the watermark has closed, once each, from five parts; a tenth of the rows come a part too late."""
    rows = _events_as_rows(spark, sf_dir).selectExpr("ts", "event_type", f"{_PART} AS part")
    return flows.drain_in_parts([rows.where(f"part = {i}").drop("part") for i in range(_PARTS)], flows.late_counts, "closed")[0]


def stream_crawl_frontier(spark, sf_dir):
    """The crawl of every host over its pages, from three parts: which pages are visited, how it goes on and how it ends."""
    pages = view(spark, sf_dir, _answers(Spark()))
    links = view(spark, sf_dir, records.crawl_links_topk(Spark(), BUDGET, "page_id, link, rn")).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "link"))), lambda x: x["link"]).alias("links"))  # at most BUDGET a page
    rows = pages.join(links, "page_id", "left").select("key", F.col("page_id").alias("ord"), "page_id", "url", F.timestamp_seconds(F.col("page_id") + 1_704_067_200).alias("at"), "email", "links")
    return flows.drain_in_parts(_parts(flows.kept(rows, "answers"), "page_id", 3), lambda r: machines.crawl_frontier(r, BUDGET - 1, TIMEOUT_MS), "frontier")[0]


def stream_run_machine(spark, sf_dir):
    """Each stage event of a run with whether the stages' order allows it, from three parts."""
    rows = _events_as_rows(spark, sf_dir).selectExpr("user_id AS run_id", "event_id AS seq", f"{_STAGE} AS stage", f"{_EVENT} AS event")
    return flows.drain_in_parts(_parts(rows, "seq", 3), machines.run_machine, "machine")[0]


def _events_as_rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


#: Pages that a crawl visits or queues at most, and its time.
BUDGET, TIMEOUT_MS = 6, 240_500


def _answers(d):
    """A host's pages with their own best e-mail; two of three are taken to hold none."""
    pages = f"(SELECT page_id, html FROM {mailed(d)} WHERE page_id % 3 = 0) third"
    best = f"SELECT page_id, email, tier FROM ({ranked(d, 'business_only', pages)}) r WHERE rn <= 1"
    return f"SELECT h.host AS key, h.page_id, h.url, CASE WHEN b.tier < 9 THEN b.email END AS email FROM ({hosts(d)}) h LEFT JOIN ({best}) b ON b.page_id = h.page_id"


_CRAWL = f"""WITH p AS MATERIALIZED (SELECT key, page_id, url, email, page_id AS t, row_number() OVER (PARTITION BY key ORDER BY page_id) AS n FROM ({_answers(DuckDB())}) a WHERE key IS NOT NULL),
s AS (SELECT key, url AS start, t AS began FROM p WHERE n = 1),
l AS (SELECT p.key, p.n, l.link, row_number() OVER (PARTITION BY p.key, l.link ORDER BY p.n) AS nth FROM p JOIN ({records.crawl_links_topk(DuckDB(), BUDGET, "page_id, link, rn")}) l ON l.page_id = p.page_id),
f AS (SELECT l.key, l.n, count(*) AS new FROM l JOIN s ON s.key = l.key WHERE nth = 1 AND link <> start GROUP BY l.key, l.n),
q AS (SELECT p.*, s.began, CAST(least({BUDGET}, 1 + sum(coalesce(f.new, 0)) OVER (PARTITION BY p.key ORDER BY p.n)) AS INTEGER) AS after, CAST(least({BUDGET}, 1 + sum(coalesce(f.new, 0)) OVER (PARTITION BY p.key ORDER BY p.n) - coalesce(f.new, 0)) AS INTEGER) AS before
  FROM p JOIN s ON s.key = p.key LEFT JOIN f ON f.key = p.key AND f.n = p.n),
o AS (SELECT *, CASE WHEN (t - began) * 1000 > {TIMEOUT_MS} THEN 'timed out' WHEN email IS NOT NULL THEN 'found' WHEN n >= {BUDGET} THEN 'budget' WHEN n >= after THEN 'complete' ELSE 'more' END AS outcome FROM q),
e AS (SELECT *, min(CASE WHEN outcome <> 'more' THEN n END) OVER (PARTITION BY key) AS stop, max(n) OVER (PARTITION BY key) AS pages FROM o)
SELECT key, n, page_id, outcome, CASE WHEN outcome = 'found' THEN email END AS email, CASE WHEN outcome = 'found' OR outcome = 'budget' THEN before ELSE after END AS queued FROM e WHERE n <= coalesce(stop, n) AND outcome <> 'timed out'
UNION ALL SELECT key, n - 1, NULL, outcome, NULL, before FROM e WHERE n = stop AND outcome = 'timed out'
UNION ALL SELECT key, n, NULL, 'timed out', NULL, after FROM e WHERE stop IS NULL AND n = pages AND began * 1000 + {TIMEOUT_MS} <= (SELECT max(t) * 1000 FROM p)"""

_PARTS = 5
#: Six days a part; rows whose id ends with 3 come a part later.
_PART = f"least({_PARTS - 1}, CAST(floor((day(ts) - 1) / 6) AS INT) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END)"
_CLOSED = f"""WITH e AS (SELECT ts, event_type, date_trunc('hour', ts) AS start, {_PART} AS part FROM events),
w AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTE AS mark FROM e GROUP BY part)
SELECT start, event_type, count(*) AS n FROM e JOIN w ON w.part = e.part WHERE (mark IS NULL OR start + INTERVAL 1 HOUR > mark) AND start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM e) GROUP BY start, event_type"""


def run_transitions(d):
    """Each stage event of a run with whether the stages' order allows it, and the run's state after it: a chain of least seqs, a stage each."""
    place = "CASE stage " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(flows.STAGES, 1)) + " ELSE 0 END"
    events = f"(SELECT run_id, seq, stage, event, {place} AS place FROM (SELECT user_id AS run_id, event_id AS seq, {_STAGE} AS stage, {_EVENT} AS event FROM events) s)"
    last, steps = f"SELECT run_id, -1 AS s0 FROM {events} e GROUP BY run_id", len(flows.STAGES)
    for i in range(1, steps + 1):
        own = ", ".join(f"max(l.s{j}) AS s{j}" for j in range(i))
        last = f"SELECT l.run_id, {own}, min(CASE WHEN e.place = {i} AND e.event = 'complete' AND e.seq > l.s{i - 1} THEN e.seq END) AS s{i} FROM ({last}) l JOIN {events} e ON e.run_id = l.run_id GROUP BY l.run_id"
    before = " + ".join(f"CASE WHEN l.s{i} < e.seq THEN 1 ELSE 0 END" for i in range(1, steps + 1))
    seen = f"SELECT e.run_id, e.seq, e.stage, e.event, e.place, {before} AS done FROM {events} e JOIN ({last}) l ON l.run_id = e.run_id"
    reason = f"CASE WHEN place = 0 THEN 'unsupported' WHEN done = {steps} THEN 'after done' WHEN place <= done THEN 'repeated' WHEN place > done + 1 THEN 'out of order' END"
    told = f"SELECT *, {reason} AS reason FROM ({seen}) x"
    taken = f"SELECT *, CASE WHEN reason IS NULL AND event = 'complete' THEN done + 1 ELSE done END AS completed, max(CASE WHEN reason IS NULL THEN seq * 2 + CASE WHEN event = 'fail' THEN 1 ELSE 0 END END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark FROM ({told}) t"
    state = f"CASE WHEN completed = {steps} THEN 'done' WHEN mark % 2 = 1 THEN 'failed' ELSE 'open' END"
    return f"SELECT run_id, seq, stage, event, reason IS NULL AS accepted, reason, {state} AS state, CAST(completed AS INT) AS completed FROM ({taken}) k"


_EVENT = "CASE WHEN event_id % 11 = 0 THEN 'fail' ELSE 'complete' END"
_STAGE = "CASE event_id % 6 WHEN 0 THEN 'maps_scrape' WHEN 1 THEN 'cleanup_contacts' WHEN 2 THEN 'email_fast' WHEN 3 THEN 'email_fallback' WHEN 4 THEN 'finalize' ELSE 'polish' END"
_NEXT = "CASE stage " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(flows.STAGES, flows.STAGES[1:])) + " END"
_STATE = f"CASE WHEN stage NOT IN {flows.STAGES} THEN 'unsupported' WHEN event = 'fail' THEN 'failed' WHEN stage = 'finalize' THEN 'done' ELSE 'open' END"
_KIND = "CASE event_id % 6 WHEN 0 THEN 'social' WHEN 1 THEN 'social' WHEN 2 THEN 'regular' WHEN 3 THEN 'regular' ELSE 'none' END"

QUERIES = {f.__name__: f for f in (stream_unseen_recent, stream_closed_windows, stream_crawl_frontier, stream_run_machine, stream_outcome_counters, stream_last_activity, stream_unseen_keys, stream_cooldown, stream_run_states, stream_watermarked_counts)}
#: A cooldown carries state from each kept event to the next: its text follows each to the first one that comes late enough.
ORACLES = {
    "stream_outcome_counters": f"SELECT {SOURCE} AS source, {_KIND} AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_last_activity": keep_first(f"(SELECT {SOURCE} AS source, event_id AS seq, {LINE} AS line FROM events) l", "source", "seq DESC", "source, seq, line"),
    "stream_run_states": f"SELECT run_id, seq, stage, {_STATE} AS state, CASE WHEN {_STATE} = 'open' THEN {_NEXT} END AS next_stage FROM (SELECT user_id AS run_id, event_id AS seq, {_STAGE} AS stage, CASE WHEN event_id % 11 = 0 THEN 'fail' ELSE 'complete' END AS event FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) r",
    "stream_watermarked_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_cooldown": """WITH RECURSIVE e AS (SELECT CAST(user_id AS BIGINT) AS key, min(event_id) AS event_id, epoch_us(ts) AS at_us FROM events GROUP BY user_id, ts),
n AS (SELECT a.key, a.at_us, min(b.at_us) AS next_at, arg_min(b.event_id, b.at_us) AS next_id FROM e a JOIN e b ON a.key = b.key AND a.at_us + 3600000000 <= b.at_us GROUP BY a.key, a.at_us),
r AS (SELECT key, arg_min(event_id, at_us) AS event_id, min(at_us) AS at_us FROM e GROUP BY key UNION ALL SELECT n.key, n.next_id, n.next_at FROM r JOIN n ON n.key = r.key AND n.at_us = r.at_us)
SELECT key, event_id, at_us FROM r""",
    "stream_unseen_keys": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_unseen_recent": "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events",
    "stream_closed_windows": _CLOSED,
    "stream_crawl_frontier": _CRAWL,
    "stream_run_machine": run_transitions(DuckDB()),
}
