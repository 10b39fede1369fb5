"""From raw documents to packed training sequences: toxic documents go, then repeated lines, then near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import jaccard_join, line_dedup, packing, toxicity
from granary.llm.common import boxed, quoted, stored, unboxed
from granary.llm.queries import END_ID, SEQUENCE_TOKENS, table, tokenizer_file, toxicity_model

TOXIC = 0.7


def _spare(docs: DataFrame, name: str) -> str:
    """name, with underscores behind it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC. The model learns from the labelled rows among docs.

    Null and empty texts are scored like an empty window and stay where most documents are ordinary. Repeated rows are
    scored each, null ids have no label, other columns stay whatever their names, an empty table gives an empty one.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    score = _spare(docs, "score")
    return toxicity.score(docs, model, out=score).filter(quoted(score) < TOXIC).select(*map(quoted, docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; one that keeps no line but blank ones goes.

    n_chars, where there is such a column, becomes the length of what is left. Documents that had no line of words to
    begin with stay, null texts too. Rows that repeat id and text count as one document and stay alike; null ids come
    last. Other columns stay whatever their names, an empty table gives an empty one.
    """
    others = docs.select(*[quoted(c) for c in docs.columns if c not in ("doc_id", "text")])
    rest = boxed(others) if others.columns else F.struct(F.lit(0).alias("none"))
    left = line_dedup.dedup_lines(docs.select("doc_id", "text", rest.alias("rest")))
    kept = left.filter((F.col("n_removed") == 0) | F.col("text").rlike("\\S") | F.col("text").isNull())
    columns = {c: F.col("rest").getField(c) for c in others.columns} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies; texts without words all stay.

    Of rows that repeat id and text one stays. Null ids are documents like others and are kept only where no other id is
    in their group. Other columns stay whatever their names, an empty table gives an empty one.
    """
    judged = jaccard_join.jaccard_links(docs).filter("kept").select("doc_id", "th").distinct()
    worded = F.coalesce(F.col("row.text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    held = docs.select(boxed(docs).alias("row"))
    keyed = held.filter(worded).select("row", F.col("row.doc_id").alias("own_id"), F.xxhash64("row.text").alias("own_th"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_th") == F.col("th"))
    one = keyed.join(judged, same, "left_semi").dropDuplicates(["own_id", "own_th"]).select("row")
    return one.unionByName(held.filter(~worded)).select(*unboxed("row", docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and place in it, see packing.pieces and packing.pack."""
    cut = packing.pieces(docs, tokenizer_file("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)
    return packing.pack(cut, SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Compression lengths and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
