"""Joins by time and state machines against plain loops, timers, late rows and state that shrinks."""

import datetime as dt
import random
import time

from tallyfold.operators.temporal import asof_join, interval_join
from tallyfold.plans import registry, streams
from tallyfold.sources.tables import view
from tallyfold.streaming import flows, machines

SF = "/root/testdata/sf0.001"
ANSWER = "key string, ord long, page_id long, url string, at timestamp, email string, links array<string>"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_join(spark):
    rng = random.Random(4)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(40), None])) for i in range(200)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([*range(0, 40, 3), None]), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, s int, n int")
    for within in (None, 4):
        got = asof_join(a, b, "k", "t", "s", ["n", "s"], "n", within)
        assert plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in plan(got)

        def best(k, t, within=within):
            found = [(s, n) for key, s, n in right if None not in (k, t, s) and key == k and s <= t]
            return max(found) if found and (within is None or t - max(found)[0] <= within) else (None, None)

        assert sorted((r.id, r.s, r.n) for r in got.collect()) == [(i, *best(k, t)) for i, k, t in sorted(left)]
    assert asof_join(a.where("false"), b, "k", "t", "s", ["n"], "n").count() == 0 and asof_join(a, b.where("false"), "k", "t", "s", ["n"], "n").where("n is not null").count() == 0


def test_interval_join(spark):
    rng = random.Random(5)
    spans = [(i, rng.choice("ab"), x := rng.randrange(-50, 100), x + rng.choice([0, 1, 7, 30, -3])) for i in range(60)] + [(90, "a", None, 5), (91, None, 0, 50)]
    points = [(i, rng.choice("ab"), rng.randrange(-60, 140)) for i in range(150)] + [(200, "a", None), (201, None, 5)]
    a, b = spark.createDataFrame(spans, "i int, w string, s long, e long"), spark.createDataFrame(points, "j int, w string, t long")
    for by in ("w", None):
        for width in (1, 7, 1000):
            got = interval_join(a if by else a.drop("w"), b if by else b.drop("w"), "s", "e", "t", width, by)
            assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
            want = sorted((i, j) for i, w, s, e in spans for j, v, t in points if None not in (s, t) and s <= t < e and (not by or (w is not None and w == v)))
            assert sorted((r.i, r.j) for r in got.collect()) == want


FIRST = [
    ("a", 1, 11, "u1", at(0), None, ["x", "y"]), ("a", 2, 12, "x", at(10), None, ["y", "z", "u1"]), ("b", 1, 21, "v", at(5), "e@b.com", ["x"]), ("c", 1, 31, "w", at(1), None, None), ("d", 1, 41, "q", at(2), None, ["r"]),
    ("e", 5, 55, "5", at(14), None, ["t"]), ("e", 1, 51, "1", at(10), None, list("23456789")), ("e", 3, 53, "3", at(12), None, []), ("e", 2, 52, "2", at(11), None, []), ("f", 1, 61, "f", at(15), None, ["g"]), (None, 1, 1, "n", at(0), None, None),
]
SECOND = [("a", 3, 13, "y", at(20), "e@a.com", []), ("a", 4, 14, "z", at(30), None, []), ("b", 2, 22, "x", at(21), "f@b.com", []), ("d", 2, 42, "r", at(100), None, ["s"]), ("a", 2, 12, "x", at(22), "again@a.com", [])]


def test_crawl_frontier_golden(spark):
    """First hit ends a crawl; so do the budget, no more links, and time, by a late page or by the watermark; replayed pages count once."""
    parts = [spark.createDataFrame(x, ANSWER) for x in (FIRST, SECOND)]
    got, _ = flows.drain_in_parts(parts, lambda r: machines.crawl_frontier(r, 2, 60_500), "golden")
    want = {
        ("a", 1, 11, "more", None, 3), ("a", 2, 12, "more", None, 3), ("a", 3, 13, "found", "e@a.com", 3), ("b", 1, 21, "found", "e@b.com", 1), ("c", 1, 31, "complete", None, 1), ("d", 1, 41, "more", None, 2), ("d", 1, None, "timed out", None, 2),
        ("e", 1, 51, "more", None, 3), ("e", 2, 52, "more", None, 3), ("e", 3, 53, "budget", None, 3), ("f", 1, 61, "more", None, 2), ("f", 1, None, "timed out", None, 2),
    }
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_crawl_timer_by_the_clock(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1, "u", at(0), None, ["x"]), ("b", 1, 2, "v", at(0), "b@b.com", [])], ANSWER).coalesce(1).write.parquet(str(tmp_path / "in"))
    ends = []
    pages = spark.readStream.schema(ANSWER).parquet(str(tmp_path / "in"))
    until = time.time() + 90
    flows.follow(machines.crawl_frontier(pages, 5, 500, by_event_time=False), str(tmp_path / "mark"), lambda b, n: ends.extend(tuple(r) for r in b.collect()), lambda: any(r[3] == "timed out" for r in ends) or time.time() > until, None, 0.3)
    assert sorted(ends, key=str) == [("a", 1, 1, "more", None, 2), ("a", 1, None, "timed out", None, 2), ("b", 1, 2, "found", "b@b.com", 1)]


def test_run_machine_golden(spark):
    stages = flows.STAGES
    events = [(1, i + 1, s, "complete") for i, s in enumerate(stages)] + [(1, 9, stages[4], "complete"), (1, 10, "polish", "fail")]
    events += [(2, 1, stages[4], "complete"), (2, 2, stages[0], "fail"), (2, 3, stages[0], "complete"), (2, 4, stages[0], "complete"), (2, 5, stages[2], "fail"), (None, 1, stages[0], "complete"), (3, None, stages[0], "complete")]
    schema = "run_id long, seq long, stage string, event string"
    parts = [spark.createDataFrame(events, schema).where(test).repartition(3) for test in ("seq <= 3 or seq is null", "seq > 3")]
    got = {(r.run_id, r.seq): (r.accepted, r.reason, r.state, r.completed) for r in flows.drain_in_parts(parts, machines.run_machine, "machine")[0].collect()}
    assert got == {(1, i): (True, None, "done" if i == 5 else "open", i) for i in range(1, 6)} | {
        (1, 9): (False, "after done", "done", 5), (1, 10): (False, "unsupported", "done", 5), (2, 1): (False, "out of order", "open", 0), (2, 2): (True, None, "failed", 0),
        (2, 3): (True, None, "open", 1), (2, 4): (False, "repeated", "open", 1), (2, 5): (False, "out of order", "open", 1),
    }


def test_run_machine_moves_narrow_rows(spark):
    """Four values a row come back from Python; odd stages and nulls pass as they are; a state that stays isn't written again."""
    schema = "run_id long, seq long, stage string, event string"
    first = [(1, 1, flows.STAGES[0], "complete"), (2, 1, 'odd "stage", é', None), (3, 1, None, "fail"), (4, 1, flows.STAGES[0], None)]
    parts = [spark.createDataFrame(x, schema) for x in (first, [(1, 2, flows.STAGES[0], "fail"), (2, 2, "", "complete")])]
    got, progress = flows.drain_in_parts(parts, machines.run_machine, "machine")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == [
        (1, 1, flows.STAGES[0], "complete", True, None, "open", 1), (1, 2, flows.STAGES[0], "fail", False, "repeated", "open", 1), (2, 1, 'odd "stage", é', None, False, "unsupported", "open", 0),
        (2, 2, "", "complete", False, "unsupported", "open", 0), (3, 1, None, "fail", False, "unsupported", "open", 0), (4, 1, flows.STAGES[0], None, True, None, "open", 1),
    ]
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1] == 2


def test_run_machine_is_its_batch_twin(spark):
    from tallyfold.functions.dialect import Spark

    a, b = registry.queries()["stream_run_machine"](spark, SF), view(spark, SF, streams.run_transitions(Spark()))
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


def test_seen_set_forgets(spark):
    """Rows of a key within the delay come once; the state falls when the watermark has passed them; late rows are counted."""
    schema = "k long, ts timestamp"
    parts = [[(i, at(i)) for i in range(50)] + [(7, at(40))], [(3, at(60)), (100, at(5000))], [(101, at(5001)), (5, at(1))], [(3, at(5002))]]
    got, progress = flows.drain_in_parts([spark.createDataFrame(p, schema) for p in parts], lambda r: flows.unseen_within(r, "ts", "10 minutes", "k"), "seen")
    assert sorted(r.k for r in got.collect()) == sorted([*range(50), 100, 101, 3])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] <= 3 and flows.late_rows(progress) == 1


def test_windows_close_once(spark):
    schema = "ts timestamp, event_type string"
    parts = [[(at(60), "x"), (at(3700), "x")], [(at(30), "x"), (at(8000), "x")], [(at(3800), "x"), (at(20), "y"), (at(9100), "y")]]
    got, progress = flows.drain_in_parts([spark.createDataFrame(p, schema) for p in parts], flows.late_counts, "closed")
    # after the first part the mark is at 1900 s, after the second at 6200 s, then at 7300 s: the first hour closes with two rows, one more for it is late
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == [(at(0), "x", 2), (at(3600), "x", 2)]
    assert flows.late_rows(progress) == 1
