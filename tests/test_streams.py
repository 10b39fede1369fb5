"""Streams after every batch against the same work over the whole tables: gate state, metrics, mirror, event appends."""

import time

import pytest
from pyspark.sql import functions as F

from granary.sources import events as N
from granary.streaming import jobs as X

LOGS = "id long, session_id long, user_id long, retrieval_score double, refused boolean, human_audit_prompted boolean, judge_json string"
AUDITS = (
    "id long, user_id long, chat_log_id long, groundedness_score int, citation_score int, relevance_score int, completeness_score int, clarity_score int, "
    "overall_verdict string, updated_at timestamp"
)
CLICKS = "id long, user_id long, chat_log_id long"


def logs_of(ids):
    judge = lambda i: None if i % 4 == 3 else f'{{"overall_score": {i % 6}}}' if i % 7 else "broken"
    return [(i, i // 3, None if i % 10 == 9 else i % 6, None if i % 8 == 7 else i / 40, i % 5 == 0, i % 9 == 0, judge(i)) for i in ids]


def audits_of(rows):
    from datetime import datetime

    return [(n, u, log, s, s, 3, 4, 5, v, datetime(2026, 1, 1, 0, minute)) for n, (u, log, s, v, minute) in enumerate(rows)]


BATCHES = [
    # logs, audits (user, log, score, verdict, minute), clicks
    (range(0, 10), [(1, 2, 4, "pass", 1), (2, 2, 1, "fail", 1), (1, 15, 5, "partial", 2)], 2),
    (range(10, 14), [(1, 2, 2, "partial", 9), (1, 2, 5, "pass", 5)], 0),
    (range(14, 30), [(3, 3, 3, "unable_to_judge", 3), (1, None, 3, "pass", 4), (9, 999, 3, "pass", 4)], 5),
    (range(30, 31), [(2, 2, 4, "pass", 0), (3, 3, 3, "odd", 30)], 1),
]


def test_live_metrics_equal_the_batch_form_after_every_batch(spark, tmp_path):
    tables, seen = {}, {"logs": [], "audits": [], "clicks": []}
    for name, schema in (("logs", LOGS), ("audits", AUDITS), ("clicks", CLICKS)):
        (tmp_path / name).mkdir()
        tables[name] = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    got, n = [], 0
    live = X.live_metrics(tables["logs"], tables["audits"], tables["clicks"])
    q = live.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for logs, audits, clicks in BATCHES:
            made = audits_of(audits)
            new = {"logs": logs_of(logs), "audits": [(r[0] + n, *r[1:]) for r in made], "clicks": [(k, 1, 2) for k in range(clicks)]}
            n += len(made)
            for name, schema in (("logs", LOGS), ("audits", AUDITS), ("clicks", CLICKS)):
                seen[name] += new[name]
                if new[name]:
                    spark.createDataFrame(new[name], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            q.processAllAvailable()
            want = X.dashboard(*[spark.createDataFrame(seen[k], s) for k, s in (("logs", LOGS), ("audits", AUDITS), ("clicks", CLICKS))]).first().asDict()
            assert {k: pytest.approx(v) for k, v in want.items()} == got[-1].asDict()
    finally:
        q.stop()
    assert want["active_users"] == 6 and want["total_human_audits"] == 4 and want["human_unable_to_judge"] == 0 and want["citation_clicks"] == 8


def test_metrics_of_no_rows(spark):
    none = X.dashboard(*[spark.createDataFrame([], s) for s in (LOGS, AUDITS, CLICKS)]).first()
    assert none.total_chats == none.human_pass == none.citation_clicks == 0 and none.avg_human_score is None and none.avg_retrieval_score is None


def test_gate_state_is_bounded_where_sessions_expire(spark, tmp_path):
    from datetime import datetime, timedelta

    kind = "id long, user_id long, session_id long, ts timestamp, score double, reviewed boolean"
    rows = [(i, i % 2, i // 3, datetime(2026, 1, 1) + timedelta(minutes=9 * i), 5.0, False) for i in range(60)]
    settings = {"enabled": True, "interval": 2, "cooldown_minutes": 0}
    events = spark.createDataFrame(rows, kind)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    got, states = [], []
    for k in range(4):
        events.filter(f"id div 15 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = X.review_gate_stream(stream, settings, keep_ms=1500).writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(b.collect()))
        q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        until = time.time() + 40
        while len({r.id for r in got}) < 15 * (k + 1) and time.time() < until:
            time.sleep(0.5)
        time.sleep(2.5)
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1:]
        q.stop()
    want = {(r.id, r.show, r.reason) for r in X.review_gate(events, settings).collect()}
    # all 60 events make 30 sessions of users; a session's events lie within one batch, so forgetting it between batches changes no decision
    assert {(r.id, r.show, r.reason) for r in got} == want
    assert len(states) == 4 and max(states) <= 2 * 5 + 2


def test_sink_that_fails_twice_gets_every_event_once(spark, tmp_path):
    kind = "id long, user_id long, value double, created_at timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    sent, calls = [], []

    def sink(batch, number):
        calls.append(number)
        if len(calls) in (2, 3):
            raise OSError("away")
        sent.append((number, sorted(r.local_id for r in batch.collect())))

    def run(k):
        spark.createDataFrame([(k * 2 + i, 1, 0.5, None) for i in range(2)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        X.mirror(stream, "click", ["value"], sink, str(tmp_path / "c"), str(tmp_path / "box"), availableNow=True).awaitTermination()

    for k in range(4):
        run(k)
    assert sent == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5]), (3, [6, 7])]
    assert calls == [0, 1, 1, 1, 2, 3]
    box = N.Outbox(spark, str(tmp_path / "box"), "click", next(p.name for p in (tmp_path / "box" / "click").iterdir()))
    assert (box.taken(), box.waiting()) == (3, [])
    box.put(spark.range(1), 3)  # a batch that comes again after it was taken
    assert box.drain(sink) == 0 and box.waiting() == []


def test_events_are_checked_before_they_are_appended(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame(
        [("1", "7", "a.pdf", "2026-01-01 00:00:00"), ("x", "7", "b.pdf", "2026-01-01 00:00:00"), ("3", None, "c.pdf", "2026-01-01 00:00:00")],
        "id string, user_id string, file_name string, created_at string")
    bad = N.append_events(rows, path, "citation_click", batch="7")
    assert {(r.id, r.problem) for r in bad.collect()} == {("x", "id is not bigint"), ("3", "user_id is missing")}
    N.append_events(rows, path, "citation_click", batch="7")
    got = N.read_events(spark, path, "citation_click").collect()
    assert [(r.id, r.user_id, r.file_name, r.page_start) for r in got] == [(1, 7, "a.pdf", None)]
    with pytest.raises(ValueError, match="columns not in the schema"):
        N.split_events(rows.withColumn("more", F.lit(1)), "citation_click")
    with pytest.raises(ValueError, match="missing"):
        N.split_events(rows.drop("user_id"), "citation_click")
    with pytest.raises(ValueError, match="unknown kind"):
        N.split_events(rows, "other")
