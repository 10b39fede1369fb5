"""The review gate as batch and stream, event mirroring, incremental ingest and live metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from granary.operators.analytics import GATE

DECISION = "id long, user_id long, session_id long, ts timestamp, show boolean, reason string, query_count long"

class Gate:
    """Decides one user's events in order; each decision depends on those before it."""

    def __init__(self, settings: dict, queries: dict | None = None, prompts: dict | None = None, last=None):
        self.s = GATE | settings
        self.queries, self.prompts, self.last = dict(queries or {}), dict(prompts or {}), last

    def decide(self, session: int | None, ts, score: float | None, reviewed: bool) -> tuple[bool, str, int]:
        """An event without a session is counted among all of the user's, and has no session limit."""
        self.queries[None] = self.queries.get(None, 0) + 1
        if session is not None:
            self.queries[session] = self.queries.get(session, 0) + 1
        n = self.queries[session]
        if not self.s["enabled"]:
            return False, "disabled", n
        if reviewed:
            return False, "already_reviewed", n
        every = self.s["interval"] > 0 and n % self.s["interval"] == 0
        low = score is not None and score == score and score <= self.s["threshold"]
        if not (every or low):
            return False, "not_due", n
        return *self.decide_due(session, ts, every, low), n

    def decide_due(self, session: int | None, ts, every: bool, low: bool) -> tuple[bool, str]:
        if session is not None and 0 < self.s["max_per_session"] <= self.prompts.get(session, 0):
            return False, "session_limit"
        if self.s["cooldown_minutes"] > 0 and self.last is not None and ts - self.last < timedelta(minutes=self.s["cooldown_minutes"]):
            return False, "cooldown"
        self.prompts[session] = self.prompts.get(session, 0) + 1
        self.last = ts
        return True, "interval_and_low_score" if every and low else "interval" if every else "low_score"

    def rows(self, events: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values(["ts", "id"])
        out = [self.decide(None if pd.isna(s) else int(s), t.to_pydatetime(), c, bool(r)) for s, t, c, r in zip(events["session_id"], events["ts"], events["score"], events["reviewed"])]
        made = pd.DataFrame(out, columns=["show", "reason", "query_count"])
        return pd.concat([events[["id", "user_id", "session_id", "ts"]].reset_index(drop=True), made], axis=1)


def review_gate(events: DataFrame, settings: dict) -> DataFrame:
    """Decisions for events (id, user_id, session_id, ts, score, reviewed), each user's in order of time.

    Counts and all decisions that don't depend on earlier ones are native. Only due events, which do, go through Python:
    a user's in order, in Arrow batches, of which a task holds one at a time beside its user's state.
    """
    s = GATE | settings
    order = [F.asc_nulls_last("ts"), F.asc("id")]
    of_user, of_session = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) for keys in (["user_id"], ["user_id", "session_id"]))
    counted = events.withColumn("query_count", F.when(F.col("session_id").isNull(), of_user).otherwise(of_session).cast("long"))
    every = (F.col("query_count") % s["interval"] == 0) if s["interval"] > 0 else F.lit(False)
    low = F.coalesce(~F.isnan(F.col("score").cast("double")) & (F.col("score") <= s["threshold"]), F.lit(False))
    known = F.lit("disabled") if not s["enabled"] else F.when(F.col("reviewed"), "already_reviewed").when(~(every | low), "not_due")
    judged = counted.select("id", "user_id", "session_id", "ts", known.alias("reason"), "query_count", every.alias("every"), low.alias("low"))
    plain = judged.filter("reason is not null").select("id", "user_id", "session_id", "ts", F.lit(False).alias("show"), "reason", "query_count")
    due = judged.filter("reason is null").select("id", "user_id", "session_id", "ts", "query_count", "every", "low")
    due = due.repartition("user_id").sortWithinPartitions("user_id", *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, user = Gate(settings), object()
        for f in frames:
            out = []
            for u, k, at, e, l in zip(f["user_id"], f["session_id"], f["ts"], f["every"], f["low"]):
                u, k = (None if pd.isna(x) else int(x) for x in (u, k))
                if u != user:
                    gate, user = Gate(settings), u
                out.append(gate.decide_due(k, at.to_pydatetime(), bool(e), bool(l)))
            made = f[["id", "user_id", "session_id", "ts"]].copy()
            made["show"], made["reason"], made["query_count"] = [x for x, _ in out], [x for _, x in out], f["query_count"]
            yield made

    return plain.unionByName(due.mapInPandas(run, DECISION))


def _micros(at: datetime | None) -> int | None:
    return None if at is None else (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)


class GateProcessor(StatefulProcessor):
    """Review gate over a stream: counts of each session of a user, and the user's own with the last prompt.

    A batch reads and writes the sessions that have events in it and no others. With a time to live, a session or user that
    had no event for so long is forgotten and begins anew.
    """

    def __init__(self, settings: dict, keep_ms: int | None = None):
        self.settings, self.keep_ms = settings, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session_id long", "queries long, prompts long", self.keep_ms)
        self.user = handle.getValueState("user", "queries long, prompts long, last long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        gate = Gate(self.settings)
        if self.user.exists():
            n, prompts, last = self.user.get()
            gate.queries[None], gate.prompts[None] = n, prompts
            gate.last = None if last is None else datetime(1970, 1, 1) + timedelta(microseconds=last)
        touched = [int(k) for k in events["session_id"].dropna().unique()]
        for k in touched:
            if self.sessions.containsKey((k,)):
                gate.queries[k], gate.prompts[k] = self.sessions.getValue((k,))
        out = gate.rows(events)
        for k in touched:
            self.sessions.updateValue((k,), (gate.queries.get(k, 0), gate.prompts.get(k, 0)))
        self.user.update((gate.queries.get(None, 0), gate.prompts.get(None, 0), _micros(gate.last)))
        yield out

    def close(self) -> None:
        pass


def review_gate_stream(events: DataFrame, settings: dict, keep_ms: int | None = None) -> DataFrame:
    """review_gate for a streaming frame; events of later batches are decided when they arrive. Needs RocksDB state.

    keep_ms is how long a session or user without events is remembered, by the cluster's clock; None keeps all. Decisions
    equal those of review_gate as long as none comes back later than that. With it, batches run on for the sake of the clock also
    without events: give the query a processing-time trigger.
    """
    mode = "None" if keep_ms is None else "ProcessingTime"
    return events.groupBy("user_id").transformWithStateInPandas(GateProcessor(settings, keep_ms), DECISION, "Append", mode)


def mirror(events: DataFrame, kind: str, payload: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, outbox: str, **trigger) -> StreamingQuery:
    """Sends event envelopes to sink, batch by batch in order, each until it was taken once; a failing sink never stops the stream.

    See Outbox: a batch is written to the outbox before it is sent, and the ledger there tells which ones were taken.
    """
    from granary.sources.events import Outbox, envelope

    def send(batch: DataFrame, number: int) -> None:
        box = Outbox(batch.sparkSession, outbox, kind)
        box.put(batch, number)
        box.drain(sink)

    started = envelope(events, kind, payload).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (started.trigger(**trigger) if trigger else started).start()


def ingest_stream(pages: DataFrame, store: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Newly arrived pages merged into the CorpusStore under store: a version for each batch that changes a page.

    A document that arrives in parts is chunked anew from all its pages so far. Pages that are stored already change nothing:
    batches may be sent again, and the stream may start without its checkpoint; with updated_at older pages do not undo later ones.
    """
    from granary.sources.store import CorpusStore

    def step(batch: DataFrame, number: int) -> None:
        CorpusStore(batch.sparkSession, store, buckets).merge(batch)

    started = pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (started.trigger(**trigger) if trigger else started).start()


SUMS = (
    "total_chats long, active_users long, score_sum double, scored long, refusals long, human_audit_prompts long, total_human_audits long, "
    "human_sum double, llm_sum double, llm_scored long, human_pass long, human_partial long, human_fail long, human_unable_to_judge long, citation_clicks long"
)
VERDICTS = ("pass", "partial", "fail", "unable_to_judge")


class AuditProcessor(StatefulProcessor):
    """Audits of one chat log joined with the log's judge score: what each batch adds to the sums over the latest audits.

    A later audit of the same user takes the earlier one's place; audits that come before their log wait for it.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "llm double", self.keep_ms)
        self.audits = handle.getMapState("audits", "user_id long", "at long, id long, human double, verdict string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        known, llm = self.log.exists(), None
        if known:
            (llm,) = self.log.get()
        logs = events[events["is_log"]]
        out: list[dict] = []

        def count(audit: tuple, sign: int) -> None:
            _, _, human, verdict = audit
            row = {"total_human_audits": sign, "human_sum": sign * human, "llm_sum": sign * (llm or 0.0), "llm_scored": sign * (llm is not None)}
            out.append(row | ({f"human_{verdict}": sign} if verdict in VERDICTS else {}))

        if not known and len(logs):
            value = logs.iloc[0]["llm"]
            known, llm = True, None if pd.isna(value) else float(value)
            self.log.update((llm,))
            for _, audit in list(self.audits.iterator()):
                count(tuple(audit), 1)
        for r in events[~events["is_log"]].sort_values(["at", "id"]).itertuples():
            new = (int(r.at), int(r.id), float(r.human), r.verdict)
            old = tuple(self.audits.getValue((int(r.user_id),))) if self.audits.containsKey((int(r.user_id),)) else None
            if old is not None and old[:2] >= new[:2]:
                continue
            self.audits.updateValue((int(r.user_id),), new)
            if known:
                if old is not None:
                    count(old, -1)
                count(new, 1)
        names = [c.split()[0] for c in SUMS.split(", ")]
        yield pd.DataFrame([{n: r.get(n, 0) for n in names} for r in out], columns=names)

    def close(self) -> None:
        pass


def live_metrics(logs: DataFrame, audits: DataFrame | None = None, clicks: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """chat_metrics, audit metrics and citation clicks over streams, exact after every batch; run in update or complete mode.

    One query: logs add to sums; a user counts when it is first seen (state: one key a user); audits (id, user_id, chat_log_id, scores,
    overall_verdict, updated_at) meet the log they judge (judge_json) in state kept by log, the latest of a user counting; clicks
    count. Rows that may repeat should be made unique before. keep_ms bounds how long a log waits for audits.
    Averages of nothing are null, counts of nothing 0.
    """
    from granary.operators.analytics import human_average, judge_score

    kinds = dict(c.split() for c in SUMS.split(", "))

    def row(of: DataFrame, **own: Column | int) -> DataFrame:
        made = {n: own.get(n, 0) for n in kinds}
        return of.select(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds[n]).alias(n) for n, v in made.items()])

    score = F.col("retrieval_score")
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    parts = [
        row(logs, total_chats=1, score_sum=F.coalesce(score, F.lit(0.0)), scored=score.isNotNull(), refusals=one(F.col("refused")), human_audit_prompts=one(F.col("human_audit_prompted"))),
        row(logs.filter("user_id is not null").select("user_id").dropDuplicates(["user_id"]), active_users=1),
    ]
    if audits is not None:
        made = audits.filter("chat_log_id is not null and user_id is not null").select(
            F.col("chat_log_id").alias("log"), F.lit(False).alias("is_log"), "user_id", F.unix_micros("updated_at").alias("at"), "id",
            human_average().alias("human"), F.col("overall_verdict").alias("verdict"), F.lit(None).cast("double").alias("llm"))
        judged = logs.select(
            F.col("id").alias("log"), F.lit(True).alias("is_log"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("at"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("human"), F.lit(None).cast("string").alias("verdict"),
            judge_score(F.col("judge_json")).cast("double").alias("llm"))
        mode = "None" if keep_ms is None else "ProcessingTime"
        parts.append(judged.unionByName(made).groupBy("log").transformWithStateInPandas(AuditProcessor(keep_ms), SUMS, "Update", mode))
    if clicks is not None:
        parts.append(row(clicks, citation_clicks=1))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return metrics_of(whole.groupBy().agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in kinds]))


def metrics_of(sums: DataFrame) -> DataFrame:
    """The metrics' columns from their sums."""
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    return sums.select(
        "total_chats", "active_users", mean("score_sum", "scored").alias("avg_retrieval_score"), "refusals", "human_audit_prompts", "total_human_audits",
        mean("human_sum", "total_human_audits").alias("avg_human_score"), mean("llm_sum", "llm_scored").alias("avg_llm_score_snapshot"),
        *[f"human_{v}" for v in VERDICTS], "citation_clicks")


def dashboard(logs: DataFrame, audits: DataFrame, clicks: DataFrame) -> DataFrame:
    """live_metrics over whole tables: the latest audit of each user and log, with that log's judge score."""
    from granary.operators.analytics import human_average, judge_score

    last = F.row_number().over(Window.partitionBy("user_id", "chat_log_id").orderBy(F.desc("updated_at"), F.desc("id")))
    latest = audits.filter("chat_log_id is not null and user_id is not null").withColumn("_r", last).filter("_r = 1")
    judged = logs.groupBy(F.col("id").alias("chat_log_id")).agg(F.first(judge_score(F.col("judge_json"))).alias("llm"))
    verdicts = [F.count_if(F.col("overall_verdict") == v).alias(f"human_{v}") for v in VERDICTS]
    of_audits = latest.join(judged, "chat_log_id").agg(
        F.count("*").alias("total_human_audits"), F.avg(human_average()).alias("avg_human_score"), F.avg("llm").alias("avg_llm_score_snapshot"), *verdicts)
    of_logs = logs.agg(
        F.count("*").alias("total_chats"), F.count_distinct("user_id").alias("active_users"), F.avg("retrieval_score").alias("avg_retrieval_score"),
        F.count_if("refused").alias("refusals"), F.count_if("human_audit_prompted").alias("human_audit_prompts"))
    # three frames of one row each
    n_clicks = clicks.agg(F.count("*").alias("n")).scalar()
    single = lambda df: df.withColumn("_one", F.lit(1))
    return single(of_logs).join(single(of_audits), "_one").drop("_one").withColumn("citation_clicks", n_clicks)


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per hour and type; later ones than the watermark are left out."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
