"""Streaming flows against plain loops, and link rules by hand."""

import json

import pytest

from tallyfold.functions import links as L
from tallyfold.functions.dialect import Spark
from tallyfold.plans import registry
from tallyfold.streaming import flows

SF = "/root/testdata/sf0.001"


def test_cooldown_matches_a_loop(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(CAST(ts AS timestamp)) AS at").collect()
    last, want = {}, set()
    for e in sorted(events, key=lambda e: (e.at, e.event_id)):
        if e.user_id not in last or e.at - last[e.user_id] >= 3600 * 1_000_000:
            last[e.user_id] = e.at
            want.add((e.user_id, e.event_id, e.at))
    found = [tuple(r) for r in registry.queries()["stream_cooldown"](spark, SF).select("key", "event_id", "at_us").collect()]
    assert len(found) == len(set(found)) and set(found) == want


def _append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_cooldown_carries_over_batches(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    kept = []
    for batch in ([(1, 1, 0), (1, 2, 30), (2, 3, 5), (None, 9, 5)], [(1, 4, 50), (1, 5, 61), (2, 6, 65)]):
        rows = spark.createDataFrame(batch, "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        flows.flush(flows.cooldown(stream, "user_id", "ts", 60, "event_id"), str(tmp_path / "mark"), lambda b, n: kept.extend(r.event_id for r in b.collect()))
    assert sorted(kept) == [1, 3, 5, 6]


def test_crawl_ends_when_all_queued_pages_are_seen(spark, tmp_path):
    schema, ends = "key string, kind string", []
    for batch in ([("a", "queued"), ("a", "queued"), ("a", "seen"), ("b", "queued"), ("b", "seen"), (None, "seen")], [("a", "seen"), ("c", "queued"), ("c", None)]):
        _append(spark, batch, schema, tmp_path / "in")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        flows.flush(flows.crawl_ends(stream, 3_600_000), str(tmp_path / "mark"), lambda b, n: ends.extend(tuple(r) for r in b.collect()), once=True)
    assert sorted(ends) == [("a", 2, 2, "complete"), ("b", 1, 1, "complete")]


def test_jobs_are_taken_once(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    got = []
    for n in (1, 2):
        (tmp_path / "jobs" / f"{n}.json").write_text(json.dumps({"campaign_id": f"c{n}", "campaign_name": "x", "created_at": ""}))
        flows.flush(flows.jobs(spark, str(tmp_path / "jobs")), str(tmp_path / "mark"), lambda b, _: got.extend(r.campaign_id for r in b.collect()))
    assert got == ["c1", "c2"]


@pytest.mark.parametrize(
    ("rule", "link", "want"),
    [
        (L.blocked_resource, "https://acmefix.com/a.PNG?x=1", True), (L.blocked_resource, "/fonts/a%2Ewoff2", True), (L.blocked_resource, "https://acmefix.com/png", False), (L.blocked_resource, "https://a.com/x?f=a.png", False),
        (L.looks_like_url, "//acmefix.com", True), (L.looks_like_url, "AcmeFix.com/x", True), (L.looks_like_url, "call us", False), (L.looks_like_url, "", False),
        (L.slashless, "https://a.com/b//?q=/#x/", "https://a.com/b?q=/#x/"), (L.slashless, "https://a.com/", "https://a.com"), (L.slashless, "/b/", "/b"),
        (L.clean_url, '"acmefix.com"', "https://acmefix.com"), (L.clean_url, "HTTP://A.com/B", "http://A.com/B"), (L.clean_url, "", ""), (L.clean_url, "https:///x", ""),
        (L.social_strict, "https://www.facebook.com/acme", True), (L.social_strict, "https://facebook.com/sharer/x", False), (L.social_strict, "https://facebook.com/", False), (L.social_strict, "https://a.com/facebook.com/x", False),
        (L.social_loose, "https://a.com/facebook.com/x", True), (L.social_loose, "https://Facebook.com/tr?id=1", False),
    ],
)
def test_links_golden(spark, rule, link, want):
    assert spark.createDataFrame([(link,)], "x string").selectExpr(f"{rule(Spark(), 'x')} AS v").first().v == want
