"""Readers, sinks, snapshots and table adapters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEB_RECORD = "url string, final_url string, title string, text string, status_code int, content_type string, fetched_at timestamp"
CHUNK_FILES = "chunk_id string, doc_id string, file_name string, source_path string, text string, page_start int, page_end int, section_title string, word_count int, char_count int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else one folder of the session's own: a temporary one where driver and tasks are one process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _OWN:
        one = master == "local" or master.startswith("local[")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-granary-") if one else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/granary_scratch"
    return _OWN[app]


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df written to the session's shared folder and read again, which cuts its lineage; see scratch()."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Within it, every snapshot of the library is a scratch table that is deleted at its end: for results written inside.

    Scratches nest; what an inner one made goes with it.
    """
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield snapshot
    finally:
        _SCRATCH.reset(token)
        for name in held:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load_corpus(documents: DataFrame | None, web: DataFrame | None) -> DataFrame:
    """Pages of documents and of the web together; an error when there are none."""
    parts = [d for d in (documents, web) if d is not None]
    if not parts:
        raise ValueError("no corpus")
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    if out.isEmpty():
        raise ValueError("the corpus is empty")
    return out


def read_web_records(spark: SparkSession, path: str) -> DataFrame:
    """Web records from JSON lines; blank lines are skipped, malformed ones fail the read."""
    return spark.read.schema(WEB_RECORD).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder per strategy."""
    chunks.write.mode("overwrite").partitionBy("strategy").format(kind).save(path)


def chunk_texts(structure: DataFrame, fixed: DataFrame) -> DataFrame:
    """(chunk_id, text): of both strategies, fixed-size going before structure; a missing text is empty."""
    both = structure.select("chunk_id", "text", F.lit(0).alias("o")).unionByName(fixed.select("chunk_id", "text", F.lit(1).alias("o")))
    return both.groupBy("chunk_id").agg(F.coalesce(F.max_by("text", "o"), F.lit("")).alias("text"))


def read_json_list(spark: SparkSession, path: str, schema: str | T.StructType, required: list[str]) -> DataFrame:
    """Rows of a JSON file that holds one list of objects; required fields must be there and ids unique."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    missing = df.filter(" or ".join(f"`{c}` is null" for c in required)) if required else df.limit(0)
    twice = df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if not missing.isEmpty():
        raise ValueError("a required field is missing")
    if not twice.isEmpty():
        raise ValueError("an id is there twice")
    return df


def explode_runs(runs: DataFrame) -> DataFrame:
    """(id, strategy, rank, hit) of saved runs (id, strategies map<string, struct<hits array>>)."""
    each = runs.select("id", F.explode("strategies").alias("strategy", "run"))
    return each.select("id", "strategy", F.posexplode("run.hits").alias("_p", "hit")).select("id", "strategy", (F.col("_p") + 1).alias("rank"), "hit")


def write_evaluation(metrics: DataFrame, path: str) -> None:
    """One JSON object per question, its metrics by strategy."""
    item = F.struct(*[c for c in metrics.columns if c not in ("id", "strategy")])
    held = metrics.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", item)))).alias("strategies"))
    held.write.mode("overwrite").json(path)


class EvaluationFile(NamedTuple):
    """runs (id, strategy, run) and hits (id, strategy, rank, hit), run and hit as VARIANT; problems (file, pos, id, problem)."""

    runs: DataFrame
    hits: DataFrame
    problems: DataFrame


def read_evaluation(spark: SparkSession, path: str, lines: bool = False) -> EvaluationFile:
    """Saved evaluations: records {id, strategies: {name: {hits: [...]}}}, in one list a file or, with lines, one a line.

    The file is read once. Records that cannot be used are set apart as problems: unreadable, not an object, no id,
    double id (all of its records), no strategies, and, for one strategy only, no hits list. Blank lines and files are
    left out. pos is the record's place in its file's list, null for lines. A list is read by one task: use lines for large ones.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    # the parser ignores what follows the first value of a text: within brackets and within braces it does not
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), "value", F.lit("}"))).isNotNull() & (F.size(listed) == 1)
    read = raw.select("file", F.when(alone, F.get(listed, F.lit(0))).alias("v"))
    if lines:
        each = read.select("file", F.lit(None).cast("int").alias("pos"), F.col("v").alias("e"))
    else:
        many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
        each = read.select("file", F.posexplode(many).alias("pos", "e"))
    at = F.try_variant_get("e", "$.id", "string")
    named = F.try_variant_get("e", "$.strategies", "map<string,variant>")
    held = snapshot(each.select("file", "pos", "e", at.alias("id")), "evaluation")
    twice = held.filter("id is not null").groupBy("id").agg(F.count("*").alias("_n"))
    checked = held.join(twice, "id", "left")
    whole = F.coalesce(F.startswith(F.schema_of_variant("e"), F.lit("OBJECT")), F.lit(False))
    problem = (
        F.when(F.col("e").isNull(), "unreadable").when(~whole, "not an object").when(F.col("id").isNull(), "no id")
        .when(F.col("_n") > 1, "double id").when(named.isNull(), "no strategies")
    )
    checked = checked.withColumn("problem", problem)
    runs = checked.filter("problem is null").select("file", "pos", "id", F.explode(named).alias("strategy", "run"))
    lists = runs.withColumn("_h", F.try_variant_get("run", "$.hits", "array<variant>"))
    lacks = lists.filter("_h is null").select("file", "pos", "id", F.concat(F.lit("no hits list: "), F.col("strategy")).alias("problem"))
    hits = lists.select("id", "strategy", F.posexplode("_h").alias("_p", "hit")).select("id", "strategy", (F.col("_p") + 1).alias("rank"), "hit")
    problems = checked.filter("problem is not null").select("file", "pos", "id", "problem").unionByName(lacks)
    return EvaluationFile(runs.select("id", "strategy", "run"), hits, problems)


def write_confusion(summary: DataFrame, path: str) -> None:
    columns = ["subset", "strategy", "questions", "tp_sources", "fp_sources", "fn_sources", "tn_sources", "source_micro_precision", "source_micro_recall", "source_micro_f1"]
    summary.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def export_tables(tables: dict[str, DataFrame], path: str, json_columns: dict[str, dict[str, str]] | None = None, secret: tuple[str, ...] = ("password_hash",)) -> None:
    """Every table as JSON in order of id, its JSON texts decoded and secret columns left out."""
    for name, df in tables.items():
        df = df.drop(*secret)
        for column, schema in (json_columns or {}).get(name, {}).items():
            df = df.withColumn(column, F.from_json(column, schema))
        df.orderBy("id").write.mode("overwrite").json(f"{path}/{name}")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file_name, bytes and sha256 of PDF files, by ending and first bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    good = files.filter(F.startswith("content", F.lit(b"%PDF")))
    return good.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def web_manifest(records: DataFrame) -> DataFrame:
    return records.select("final_url", F.length("text").cast("long").alias("text_length"), F.sha2("text", 256).alias("text_sha256"))


def manifest_differences(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(final_url, problem): pages missing on one side or with another text."""
    now = web_manifest(records).select("final_url", F.col("text_sha256").alias("_s"))
    both = manifest.select("final_url", "text_sha256").join(now, "final_url", "full")
    problem = F.when(F.col("_s").isNull(), "missing in corpus").when(F.col("text_sha256").isNull(), "missing in manifest").when(F.col("_s") != F.col("text_sha256"), "text differs")
    return both.select("final_url", problem.alias("problem")).filter("problem is not null")


def corpus_listing(documents: DataFrame, web: DataFrame, kind: str | None = None, order: str = "pdf_first") -> DataFrame:
    """(type, name, bytes) of documents (name, bytes) and web pages (name, text), in one of four orders."""
    both = documents.select(F.lit("pdf").alias("type"), "name", F.col("bytes").cast("long").alias("bytes")).unionByName(
        web.select(F.lit("web").alias("type"), "name", F.octet_length("text").cast("long").alias("bytes")))
    both = both.filter(F.col("type") == kind) if kind else both
    keys = {"pdf_first": ["type", "name"], "web_first": [F.desc("type"), "name"], "size": [F.desc("bytes"), "name"], "name": ["name"]}
    return both.orderBy(*keys[order])


def index_status(chunks: DataFrame, pages: DataFrame, corpus_version: int, index_version: int) -> DataFrame:
    """One row: chunks per strategy, pages, versions, ready if both strategies have chunks."""
    n = [F.count_if(F.col("strategy") == s).alias(s) for s in ("fixed_size", "structure_aware")]
    count = pages.agg(F.count("*").alias("n")).scalar()
    return chunks.agg(*n).select(
        "fixed_size", "structure_aware", count.alias("pages"), F.lit(corpus_version).alias("corpus_version"), F.lit(index_version).alias("index_version"),
        ((F.col("fixed_size") > 0) & (F.col("structure_aware") > 0)).alias("ready"),
    )


def document_pages(documents: DataFrame, lines: int = 5) -> DataFrame:
    """documents as page rows: every run of lines lines is a page."""
    parts = documents.select("doc_id", "source", F.split("text", "\n", -1).alias("l"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("l") / lines).cast("int") - 1)
    each = parts.select("doc_id", "source", "l", F.explode(starts).alias("p"))
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return each.select(
        F.col("doc_id").cast("string").alias("doc_id"), name.alias("file_name"), F.concat(F.lit("corpus/"), name).alias("source_path"),
        (F.col("p") + 1).alias("page_num"), F.array_join(F.slice("l", F.col("p") * lines + 1, lines), "\n").alias("text"))


def chat_logs(conversations: DataFrame) -> DataFrame:
    """conversations as chat logs: a user turn with the assistant turn that follows it, scores derived from ids."""
    a = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    b = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    key = F.col("conv_id") * 1000 + F.col("turn")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + key * 60)
    judge = F.concat(F.lit('{"overall_score": '), (key % 6).cast("string"), F.lit("}"))
    return a.join(b, ["conv_id", "turn"]).select(
        key.alias("id"), F.col("conv_id").alias("session_id"), (F.col("conv_id") % 17).alias("user_id"), "question", "answer",
        F.when(key % 5 == 0, "[]").otherwise('["C1"]').alias("citations_json"), F.when(key % 4 != 3, judge).alias("judge_json"),
        ((key % 97) / 97.0).alias("retrieval_score"), (key % 11 == 0).alias("refused"), (key % 13 == 0).alias("human_audit_prompted"), at.alias("created_at"))
