"""Operational events: their schemas, checked appends, envelopes, and an outbox that sends each batch until it was taken."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = logging.getLogger(__name__)

#: Columns of each kind of event; those with ! may not be null (fixed values).
EVENTS = {
    "chat_log": "id long!, session_id long, user_id long!, question string!, answer string!, chunking_strategy string!, top_k int, run_judge boolean!, "
    "retrieved_count int, citations_json string!, evidence_json string!, judge_json string, retrieval_score double, refused boolean!, corpus_version int, "
    "index_version int, human_audit_prompted boolean!, created_at timestamp!",
    "feedback": "id long!, user_id long!, chat_log_id long, feedback_type string, rating int, comment string, created_at timestamp!",
    "demo_feedback": "id long!, user_id long!, role_department string, ease_score int!, helpfulness_score int!, trustworthiness_score int!, "
    "citations_useful string!, incorrect_or_misleading boolean, incorrect_notes string, missing_expectation string, improvement string, "
    "would_use_at_work string!, final_comments string, created_at timestamp!",
    "citation_click": "id long!, user_id long!, chat_log_id long, citation_label string, chunk_id string, file_name string!, page_start int, page_end int, "
    "source_strategy string, created_at timestamp!",
}


def event_schema(kind: str) -> T.StructType:
    if kind not in EVENTS:
        raise ValueError(f"unknown kind of event: {kind}")
    fields = []
    for c in EVENTS[kind].split(", "):
        name, of = c.split()
        fields.append(T.StructField(name, T._parse_datatype_string(of.rstrip("!")), not of.endswith("!")))
    return T.StructType(fields)


def split_events(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows in the kind's schema, and those whose values don't fit with `problem`, the first of them by column.

    Columns that the schema lacks raise an error, as do required columns that are not there; optional ones become null.
    """
    schema = event_schema(kind)
    extra, missing = set(rows.columns) - set(schema.names), [f.name for f in schema if not f.nullable and f.name not in rows.columns]
    if extra or missing:
        raise ValueError(f"{kind}: columns not in the schema {sorted(extra)}, missing {missing}")
    cast = {f.name: (F.col(f.name) if f.name in rows.columns else F.lit(None)) for f in schema}
    found = F.lit(None).cast("string")
    for f in reversed(schema.fields):
        value, given = cast[f.name].try_cast(f.dataType), cast[f.name]
        found = F.when(given.isNotNull() & value.isNull(), f"{f.name} is not {f.dataType.simpleString()}").otherwise(found)
        if not f.nullable:
            found = F.when(given.isNull(), f"{f.name} is missing").otherwise(found)
    marked = rows.withColumn("problem", found)
    good = marked.filter("problem is null").select(*[cast[f.name].try_cast(f.dataType).alias(f.name) for f in schema])
    return good, marked.filter("problem is not null")


def append_events(rows: DataFrame, path: str, kind: str, batch: str | None = None) -> DataFrame:
    """Appends the events of one kind under path/kind and returns those that don't fit its schema.

    The events of a named batch take the place of what that batch appended before, so that it may be sent again.
    """
    good, bad = split_events(rows, kind)
    good.write.mode("overwrite").parquet(f"{path}/{kind}/batch={batch or uuid.uuid4().hex}")
    return bad


def read_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(event_schema(kind)).parquet(f"{path}/{kind}/batch=*")


def envelope(events: DataFrame, kind: Column | str, payload: list[str]) -> DataFrame:
    """Event rows as (event_type, local_id, user_id, session_id, chat_log_id, created_at, payload JSON)."""
    own = {c: F.col(c) if c in events.columns else F.lit(None).cast("long") for c in ("user_id", "session_id", "chat_log_id")}
    return events.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), F.col("id").alias("local_id"), *[c.alias(n) for n, c in own.items()],
        "created_at", F.to_json(F.struct(*payload)).alias("payload"))


class Outbox:
    """Batches of one kind of envelopes that wait to be sent, and a ledger of those that were taken.

    A batch is written whole before it is sent; its ledger entry is one small file that appears by a rename after the sink
    took it. Batches are sent in order, and none before the one ahead of it was taken, so a sink that fails and
    recovers gets every event once, in order. Only where the driver dies between the sink's return and the entry is a
    batch sent twice, with the same number: a sink that must not see it twice keeps the last number. Numbers belong to a stream:
    one that starts without its checkpoint has a name of its own and begins at 0, its events are sent again.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str, stream: str | None = None):
        self.spark = spark
        stream = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        self.path = f"{path.rstrip('/')}/{kind}/{stream}"

    def _listed(self, name: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        whole = lambda p: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if whole(s.getPath())) if fs.exists(path) else []

    def waiting(self) -> list[int]:
        return [n for n in self._listed("waiting") if n > self.taken()]

    def taken(self) -> int:
        """The last batch that the sink took, -1 if none."""
        return max(self._listed("taken"), default=-1)

    def put(self, batch: DataFrame, number: int) -> None:
        """Writes a batch that was not taken yet; a batch that comes again takes its own place."""
        if number > self.taken():
            batch.write.mode("overwrite").parquet(f"{self.path}/waiting/{number}")

    def drain(self, sink: Callable[[DataFrame, int], None]) -> int:
        """Sends what waits, in order, until the sink fails; returns how many batches it took."""
        sent = 0
        for n in self.waiting():
            batch = self.spark.read.parquet(f"{self.path}/waiting/{n}")
            try:
                sink(batch, n)
            except Exception as e:  # the mirror never breaks the flow it copies
                LOG.warning("mirror: batch %s waits: %s", n, e)
                break
            self.spark.createDataFrame([(n,)], "batch long").coalesce(1).write.mode("overwrite").json(f"{self.path}/taken/{n}")
            self._tidy(n)
            sent += 1
        return sent

    def _tidy(self, last: int) -> None:
        """Deletes batches that were taken, and ledger entries before the last one."""
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name, numbers in (("waiting", [n for n in self._listed("waiting") if n <= last]), ("taken", [n for n in self._listed("taken") if n < last])):
            for n in numbers:
                path = Path(f"{self.path}/{name}/{n}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
