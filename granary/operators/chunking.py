"""Fixed-size and structure-aware chunks of cleaned pages, and the chunk snapshot's upsert and delete."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from granary.operators import text as T

FIXED = {"size": 320, "overlap": 60}
SECTION = {"size": 380, "overlap": 70, "least": 20}
COLUMNS = ["chunk_id", "doc_id", "file_name", "source_path", "strategy", "text", "page_start", "page_end", "section_title", "word_count", "char_count", "section_index", "piece_index"]


def _keys(df: DataFrame) -> list[str]:
    """What all steps are dealt and grouped by: the document, behind the column _deal, derived from it, by which the caller has dealt the pages, if there is one."""
    return [c for c in ("_deal", "doc_id") if c in df.columns]


class Prepared(NamedTuple):
    """Pages dealt by document, their lines (blank ones null) and their repeated lines.

    pages has _file and _path of the document's first page. lines has those, repeats (whether the line is a repeated one) and kind:
    0 for the lines of a page, 1 for those of its text with inline headings broken out, where the document can have numbered headings.
    """

    pages: DataFrame
    lines: DataFrame
    repeated: DataFrame


def prepare(pages: DataFrame, share: float = 0.4, longest: int = 120) -> Prepared:
    """pages has clean_text. They are dealt by document once: every later step is a window or an aggregation within a document,
    which shuffles nothing more. Repeated lines are those of text.repeated_lines.

    The number of tasks is given, as merged ones would be too few and too large: a page is sorted some times over as lines.
    """
    keys = _keys(pages)
    doc = Window.partitionBy(*keys)
    first = F.min(F.struct("page_num", "file_name", "source_path")).over(doc)
    may = F.max(F.coalesce(F.col("clean_text").rlike("(?i)[0-9]|appendix"), F.lit(False))).over(doc)
    held = pages.select(*keys, "page_num", "file_name", "source_path", "clean_text")
    if "_deal" not in keys:
        held = held.repartition(2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    held = held.withColumns({"_f": first, "_n": F.size(F.collect_set("page_num").over(doc)), "_may": may})
    held = held.select(*keys, "page_num", F.col("_f.file_name").alias("_file"), F.col("_f.source_path").alias("_path"), "_n", "_may", F.coalesce("clean_text", F.lit("")).alias("clean_text"))
    broken = F.when(F.col("_may"), F.struct(F.lit(1).alias("kind"), T.strip(break_inline_headings(F.col("clean_text"))).alias("t")))
    kinds = F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col("clean_text").alias("t")), broken))
    each = held.withColumn("_k", F.explode(kinds)).drop("_may", "clean_text")
    lines = T.lines_of(each.select(*[c for c in each.columns if c != "_k"], "_k.kind", F.col("_k.t").alias("clean_text")), blanks=True)
    counted = (F.col("kind") == 0) & (F.length("line") <= longest) & ~F.col("line").rlike(r"^(\d+\.|[a-zA-Z]\))$")
    own = Window.partitionBy(*keys, "line")
    once = F.row_number().over(Window.partitionBy(*keys, "line", "kind", "page_num").orderBy("line_no")) == 1
    lines = lines.withColumn("_c", F.coalesce(counted, F.lit(False)) & once).withColumn("_seen", F.sum(F.col("_c").cast("int")).over(own))
    often = (F.col("_n") > 1) & (F.col("_seen") >= F.greatest(F.lit(2), F.floor(F.col("_n") * share)))
    repeats = F.col("line").isNotNull() & F.col("doc_id").isNotNull() & often
    lines = lines.withColumn("repeats", repeats).drop("_n", "_seen")
    repeated = lines.filter("_c and repeats").groupBy(*keys, "line").agg(F.lit(True).alias("_r")).select("doc_id", "line")
    return Prepared(held.drop("_n", "_may"), lines.drop("_c"), repeated)


def _pieces(lines: DataFrame, keys: list[str], size: int, overlap: int, **more: Column) -> DataFrame:
    """keys, piece_index, text, word_count, page range and more aggregates of windows of words over the lines of each key.

    Lines are cut into runs of at most a window's step first, so a row is bounded whatever a line's length. A run's
    running word number says in which windows it takes part and with which words, so a window is put together
    from its own runs and no document stands in one row.
    """
    stride = max(1, size - overlap)
    own = Window.partitionBy(*keys)
    runs = F.regexp_extract_all("line", F.lit(f"(?:[^ ]++ ?+){{1,{stride}}}+"), F.lit(0))
    words = lines.select("*", F.posexplode(runs).alias("run_no", "run")).drop("line").withColumn("run", F.rtrim("run"))
    # one space between the words of a run
    words = words.withColumn("n", F.length("run") - F.length(F.replace("run", F.lit(" "), F.lit(""))) + 1)
    before = F.sum("n").over(own.orderBy("page_num", "line_no", "run_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = words.withColumn("a", before).withColumn("all", F.sum("n").over(own)).withColumn("w", F.split("run", " ")).drop("run")
    last = F.ceil(F.greatest(F.col("all") - size, F.lit(0)) / stride)
    low = F.greatest(F.floor((F.col("a") - size) / stride) + 1, F.lit(0))
    high = F.least(F.floor((F.col("a") + F.col("n") - 1) / stride), last)
    each = placed.filter(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    start = F.greatest(F.col("k") * stride - F.col("a"), F.lit(0))
    end = F.least(F.col("k") * stride + size - F.col("a"), F.col("n"))
    cut = F.array_join(F.slice("w", (start + 1).cast("int"), (end - start).cast("int")), " ")
    part = F.struct("page_num", "line_no", "run_no", cut.alias("t"))
    made = each.withColumn("m", end - start).groupBy(*keys, F.col("k").cast("int").alias("piece_index")).agg(
        F.array_sort(F.collect_list(part)).alias("l"), F.sum("m").cast("int").alias("word_count"), F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"),
        *[c.alias(name) for name, c in more.items()])
    return made.withColumn("text", F.array_join(F.transform("l", lambda x: x["t"]), " ")).drop("l")


def fixed_size_chunks(pages: DataFrame, size: int = FIXED["size"], overlap: int = FIXED["overlap"], ready: Prepared | None = None) -> DataFrame:
    """Windows of words that run on across pages, without repeated lines. pages has clean_text; ready is prepare(pages)."""
    ready = ready or prepare(pages)
    keys = _keys(ready.lines)
    lines = ready.lines.filter("kind = 0 and line is not null and not repeats and doc_id is not null").drop("kind", "repeats")
    made = _pieces(lines, keys, size, overlap, file_name=F.any_value("_file"), source_path=F.any_value("_path"))
    return made.select(
        F.format_string("%s::fixed::%04d", T.slugify(F.col("doc_id")), "piece_index").alias("chunk_id"),
        "doc_id", "file_name", "source_path", F.lit("fixed_size").alias("strategy"), "text", "page_start", "page_end",
        F.lit("Fixed-size window").alias("section_title"), "word_count", F.length("text").alias("char_count"),
        F.lit(0).alias("section_index"), "piece_index",
    )


#: Patterns of headings (fixed values, here and in the functions below).
SUBCLAUSE = r"^\d+\.\d+(\.\d+)*\b"
BULLET = "^[\u2022\\-]"


def is_numeric_heading(line: Column) -> Column:
    c = T.clean_line(line)
    major = c.rlike(r"^\d+\.\s*\S") | c.rlike(r"^\d{1,2}\s+[A-Z]")
    odd = c.rlike(r"^(19|20)\d{2}(\.|\s|$)") | c.rlike(r"\.{3,}") | c.rlike(r"\s\d+$") | c.rlike(SUBCLAUSE)
    return major & ~odd & F.length(c).between(2, 160)


def is_appendix_heading(line: Column) -> Column:
    c = T.clean_line(line)
    return c.rlike(r"(?i)^appendix\b") & F.length(c).between(6, 180)


def is_fallback_heading(line: Column) -> Column:
    c = T.clean_line(line)
    words = F.split(c, " ")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / F.size(words)
    odd = c.rlike(r"^(19|20)\d{2}\.") | c.rlike(BULLET) | c.rlike(SUBCLAUSE) | is_numeric_heading(line) | c.endswith(".")
    return F.length(c).between(3, 110) & ~odd & ((F.size(words) < 2) | (capital >= 0.4))


def break_inline_headings(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?<=[.)\]])\s+(\d+\.\s+[A-Z])", "\n$1")
    c = F.regexp_replace(c, r"(?<=[.)\]])\s+(\d{1,2}\s+[A-Z])", "\n$1")
    return F.regexp_replace(c, r"(?<=[a-z])\s+(\d+\.\s+[A-Z])", "\n$1")


def _is_title(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Z(\[]") & ~c.rlike(BULLET) & ~c.rlike(SUBCLAUSE), F.lit(False))


def _page(lines: DataFrame) -> WindowSpec:
    """The lines of a page in order."""
    return Window.partitionBy(*_keys(lines), *(["kind"] if "kind" in lines.columns else []), "page_num").orderBy("line_no")


def join_split_headings(lines: DataFrame, where: Column | None = None) -> DataFrame:
    """Lines (doc_id, page_num, line_no, line) with '1', '.', 'Title' and the like joined to '1. Title', where a condition on the page holds.

    A joined title can't start another heading, so looking ahead and back one decision equals scanning in order.
    """
    w = _page(lines)
    one, two = F.lead("line", 1).over(w), F.lead("line", 2).over(w)
    number, dotted = F.col("line").rlike(r"^\d+$"), F.col("line").rlike(r"^\d+\.$")
    take = F.when(number & (one == ".") & _is_title(two), 2).when((number | dotted) & _is_title(one), 1).otherwise(0)
    take = take if where is None else F.when(where, take).otherwise(0)
    title = F.when(F.col("take") == 2, F.col("two")).otherwise(F.col("one"))
    seen = lines.withColumns({"one": one, "two": two}).withColumn("take", take)
    gone = (F.coalesce(F.lag("take", 1).over(w), F.lit(0)) >= 1) | (F.coalesce(F.lag("take", 2).over(w), F.lit(0)) == 2)
    joined = F.when(F.col("take") > 0, F.concat(F.regexp_replace("line", r"\.$", ""), F.lit(". "), title)).otherwise(F.col("line"))
    return seen.withColumn("gone", gone).filter("not gone").withColumn("line", joined).drop("one", "two", "take", "gone")


def _numeric(lines: DataFrame) -> DataFrame:
    """Adds starts to lines of both kinds: numbered and appendix headings, which are looked for in those of kind 1. Of these, repeated lines go,
    and of each page the first line and then the last of those left, if they are bare numbers."""
    keys, broken = _keys(lines), F.col("kind") == 1
    lines = lines.filter(~broken | (F.col("line").isNotNull() & ~F.col("repeats")))
    for step in (F.lag, F.lead):
        bare = broken & F.coalesce(F.col("line").rlike(r"^\d{1,4}$"), F.lit(False))
        lines = lines.withColumn("_edge", step("line_no", 1).over(_page(lines)).isNull()).filter(~(F.col("_edge") & bare)).drop("_edge")
    lines = join_split_headings(lines, broken)
    lines = lines.withColumn("line", F.when(broken, T.clean_line(F.col("line"))).otherwise(F.col("line")))
    lines = lines.withColumn("_a", F.when(broken, is_appendix_heading(F.col("line"))).otherwise(False))
    earlier = Window.partitionBy(*keys, "kind").orderBy("page_num", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_after", F.coalesce(F.max("_a").over(earlier), F.lit(False)))
    return lines.withColumn("starts", F.when(broken, F.col("_a") | (~F.col("_after") & is_numeric_heading(F.col("line")))).otherwise(False)).drop("_a", "_after")


def _fallback(lines: DataFrame) -> DataFrame:
    """For lines of kind 0, starts: heading-like lines after a blank or removed line, or at a page's start. Repeated lines become null, as do
    a page's first and last lines that are bare numbers."""
    plain, bare = F.col("kind") == 0, F.coalesce(F.col("line").rlike(r"^\d{1,4}$"), F.lit(False))
    lines = lines.withColumn("line", F.when(~plain | ~F.col("repeats"), F.col("line")))
    w = _page(lines)
    page = Window.partitionBy(*_keys(lines), "kind", "page_num")
    full = F.when(F.col("line").isNotNull(), F.col("line_no"))
    edge = F.coalesce((F.col("line_no") == F.min(full).over(page)) | (F.col("line_no") == F.max(full).over(page)), F.lit(False))
    lines = lines.withColumn("_edge", edge).withColumn("line", F.when(~(plain & F.col("_edge") & bare), F.col("line"))).drop("_edge")
    lines = lines.withColumn("_b", F.lag(F.col("line").isNull(), 1, True).over(w))
    return lines.withColumn("starts", F.when(plain, F.col("_b") & F.coalesce(is_fallback_heading(F.col("line")), F.lit(False))).otherwise(F.col("starts"))).drop("_b")


def section_lines(ready: Prepared) -> DataFrame:
    """Lines with section (its number in the document) and head (the title, on its first line at least; null for the overview): numbered
    sections where a document has two headings or more, else fallback ones, else the whole document, repeated lines kept.

    Both kinds of lines go one way, sorted by document, kind, page and line once; then a document keeps those of one kind.
    """
    keys = _keys(ready.lines)
    doc, kind = Window.partitionBy(*keys), Window.partitionBy(*keys, "kind")
    lines = _numeric(ready.lines.filter("doc_id is not null")).withColumn("_major", F.sum(F.col("starts").cast("int")).over(doc))
    lines = lines.filter(F.col("kind") == F.when(F.col("_major") >= 2, 1).otherwise(0)).drop("_major").withColumn("_line", F.col("line"))
    lines = _fallback(lines).withColumn("whole", F.count("line").over(doc) == 0)
    lines = lines.withColumn("line", F.when(F.col("whole"), F.col("_line")).otherwise(F.col("line"))).filter("line is not null")
    lines = lines.withColumn("starts", F.col("starts") & ~F.col("whole"))
    number = F.sum(F.col("starts").cast("int")).over(kind.orderBy("page_num", "line_no").rowsBetween(Window.unboundedPreceding, 0))
    head = F.when(F.col("whole"), "Full document").when(F.col("starts"), F.col("line"))
    return lines.withColumn("section", number).withColumn("head", head).drop("kind", "repeats", "starts", "whole", "_line")


def sections(pages: DataFrame, ready: Prepared | None = None) -> DataFrame:
    """doc_id, section, section_title, text and page range: each section's lines in one text."""
    lines = section_lines(ready or prepare(pages))
    held = F.array_sort(F.collect_list(F.struct("page_num", "line_no", "line")))
    texts = F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("text")
    title = F.coalesce(F.max("head"), F.lit("Document Overview")).alias("section_title")
    return lines.groupBy(*_keys(lines), "section").agg(title, F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), texts).drop("_deal")


def structure_aware_chunks(pages: DataFrame, size: int = SECTION["size"], overlap: int = SECTION["overlap"], least: int = SECTION["least"], ready: Prepared | None = None) -> DataFrame:
    """Word windows of the sections; short pieces go but keep their index. pages has clean_text; ready is prepare(pages)."""
    ready = ready or prepare(pages)
    lines = section_lines(ready)
    keys = _keys(lines)
    lines = lines.withColumn("section_index", (F.col("section") - F.min("section").over(Window.partitionBy(*keys))).cast("int"))
    cut = _pieces(lines, [*keys, "section"], size, overlap, head=F.max("head"), section_index=F.any_value("section_index"), file_name=F.any_value("_file"), source_path=F.any_value("_path"))
    # a section's pieces hold all of its lines
    own = Window.partitionBy(*keys, "section")
    title = F.coalesce(F.max("head").over(own), F.lit("Document Overview"))
    cut = cut.withColumns({"section_title": title, "page_start": F.min("page_start").over(own), "page_end": F.max("page_end").over(own)}).filter(F.col("word_count") >= least)
    return cut.select(
        F.format_string("%s::section::%04d-%02d", T.slugify(F.col("doc_id")), "section_index", "piece_index").alias("chunk_id"),
        "doc_id", "file_name", "source_path", F.lit("structure_aware").alias("strategy"), "text", "page_start", "page_end",
        "section_title", "word_count", F.length("text").alias("char_count"), "section_index", "piece_index",
    )


def build_chunks(pages: DataFrame, strategy: str) -> DataFrame:
    made = {"fixed_size": fixed_size_chunks, "structure_aware": structure_aware_chunks}
    if strategy not in made:
        raise ValueError(f"unknown strategy: {strategy}")
    return made[strategy](pages)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old without a row of the same keys in new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by(chunks: DataFrame, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Chunks without those of one file_name or source_path, and the number deleted by strategy."""
    hit = F.coalesce(F.col(column) == value, F.lit(False))
    return chunks.filter(~hit), chunks.filter(hit).groupBy("strategy").agg(F.count("*").alias("deleted"))


def next_version(versions: DataFrame) -> Column:
    """The version after the latest of a snapshot table (version), as a scalar subquery; 1 for the first."""
    return versions.select((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("v")).scalar()


def embed(chunks: DataFrame, batch_function: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """chunk_id, strategy and embedding; the caller's function gets batch texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for low in range(0, len(f), batch):
                texts = f["text"].iloc[low : low + batch].tolist()
                vectors = batch_function(texts)
                if len(vectors) != len(texts):
                    raise ValueError("an embedding is missing")
                out += vectors
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "strategy": f["strategy"], "embedding": out})

    return chunks.select("chunk_id", "strategy", "text").mapInPandas(run, "chunk_id string, strategy string, embedding array<float>")


def ingest(pages: DataFrame, old: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Chunks of both strategies from pages cleaned once; merged into old unless force starts anew."""
    ready = prepare(pages)
    made = fixed_size_chunks(pages, ready=ready).unionByName(structure_aware_chunks(pages, ready=ready))
    return made if force or old is None else upsert(old, made, ["doc_id", "strategy", "section_index", "piece_index"])
