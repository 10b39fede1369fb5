"""Page text cleaning as column expressions, and repeated-line removal per document."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def once(c: Column, f) -> Column:
    """f(c) with c computed once: a lambda's body would compute it again for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: All characters of white space (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, in Arrow batches; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def replace_unknown(c: Column) -> Column:
    return F.replace(c, F.lit("\ufffd"), F.lit("'"))


def join_hyphenated(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("-\n")), F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")).otherwise(c)


def _line_feeds(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def tidy_newlines(c: Column) -> Column:
    """Line feeds only, at most one blank line in a row, every line and the whole stripped."""
    c = F.regexp_replace(_line_feeds(c), "\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n"))


def collapse_spaces(c: Column) -> Column:
    # single spaces and bare line feeds, the usual ones, match nothing
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}|\t", " "), " +\n *|\n +", "\n"))


def is_page_label(line: Column) -> Column:
    return strip(line).rlike(r"(?i)^(page\s+\d+(\s+of\s+\d+)?|\d+\s+of\s+\d+)$")


def is_bare_number(line: Column) -> Column:
    return strip(line).rlike(r"^\d{1,4}$")


def drop_page_labels(c: Column, window: int = 3) -> Column:
    """Without page labels anywhere and without bare numbers among the first and last non-blank lines."""
    # what a line is, found once for each: blank, a label, a bare number or anything else
    other = lambda s: ~F.lower(F.substring(s, 1, 1)).isin("p", *"0123456789")
    kind = lambda s: F.when(s == "", 0).when(other(s), 3).when(is_page_label(s), 1).when(is_bare_number(s), 2).otherwise(3)

    def kept(ranked: Column) -> Column:
        full = F.transform(F.filter(ranked, lambda r: r["k"] != 0), lambda r: r["i"])
        edges = F.concat(F.slice(full, 1, window), F.slice(F.reverse(full), 1, window))
        keep = lambda edge: lambda r: r["k"].isin(0, 3) | ((r["k"] == 2) & ~F.array_contains(edge, r["i"]))
        return once(edges, lambda edge: F.array_join(F.transform(F.filter(ranked, keep(edge)), lambda r: r["x"]), "\n"))

    lines = F.split(_line_feeds(c), "\n", -1)
    return strip(once(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"), once(strip(x), kind).alias("k"))), kept))


def basic_clean(c: Column) -> Column:
    """All cleaning steps but NFKC, null as empty."""
    return collapse_spaces(drop_page_labels(tidy_newlines(join_hyphenated(replace_unknown(F.coalesce(c, F.lit("")))))))


def with_clean(df: DataFrame, text: str, out: str, normalize: bool = True) -> DataFrame:
    """df with out, the cleaned text. NFKC, the one step in Python, has a projection of its own."""
    if normalize:
        return df.withColumn("_nfkc", nfkc(F.coalesce(text, F.lit("")))).withColumn(out, basic_clean(F.col("_nfkc"))).drop("_nfkc")
    return df.withColumn(out, basic_clean(F.col(text)))


def is_ascii(c: Column) -> Column:
    """Whether plain character classes do for c: Unicode ones are far slower."""
    return F.octet_length(c) == F.length(c)


def clean_line(c: Column) -> Column:
    """One line: plain spaces, no zero-width marks, single spaces, '1 .' as '1.', '1.X' as '1. X'; null as empty."""
    c = F.coalesce(c, F.lit(""))
    plain = strip(c)
    # the first character becomes a space, the others go; single plain spaces match nothing
    full = F.regexp_replace(strip(F.translate(c, "\u00a0\u200b\u200c\u200d\ufeff", " ")), r"(?U)\s{2,}|[^\S ]", " ")
    full = F.regexp_replace(F.regexp_replace(full, r"^(\d+)\s+\.", "$1."), r"^(\d+)\.([A-Za-z(\[])", "$1. $2")
    odd = F.contains(c, F.lit("  ")) | F.substring(plain, 1, 1).between("0", "9") | c.rlike(r"[\t\x0b-\r\x1c-\x1f]")
    return F.when(is_ascii(c) & ~odd, plain).otherwise(full)


def lines_of(pages: DataFrame, text: str = "clean_text", blanks: bool = False) -> DataFrame:
    """One row per cleaned line, with line_no from 0: blank lines as null, or left out."""
    each = pages.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "_line")).drop(text)
    if not blanks:
        # on the raw line: a condition on the cleaned one would clean it twice
        seen = F.when(is_ascii(F.col("_line")), F.col("_line")).otherwise(F.translate("_line", "\u200b\u200c\u200d\ufeff", ""))
        return each.filter(strip(seen) != "").withColumn("line", clean_line(F.col("_line"))).drop("_line")
    return each.withColumn("line", F.nullif(clean_line(F.col("_line")), F.lit(""))).drop("_line")


def looks_scanned(c: Column, least_chars: int = 80, least_letters: float = 0.35) -> Column:
    """Fewer than least_chars characters besides white space, or too few letters among them; null is scanned."""
    without = lambda plain, any_: F.length(F.when(is_ascii(c), F.regexp_replace(c, plain, "")).otherwise(F.regexp_replace(c, any_, "")))
    letters = without("[^A-Za-z]+", r"\P{L}+")
    few = lambda n: (n < least_chars) | (letters / F.greatest(n, F.lit(1)) < least_letters)
    return F.when(c.isNull(), True).otherwise(once(without(r"[\s\x1c-\x1f]+", r"(?U)\s+"), few))


def clean_pages(pages: DataFrame, normalize: bool = True) -> DataFrame:
    """Adds clean_text and likely_scanned, the flag from the raw text."""
    return with_clean(pages.withColumn("likely_scanned", looks_scanned(F.col("text"))), "text", "clean_text", normalize)


def repeated_lines(pages: DataFrame, share: float = 0.4, longest: int = 120, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, line): lines on at least max(2, share of the pages) pages of their document.

    Lines over longest characters and lone list marks are exempt, as are documents of one page. Both aggregations
    combine before their shuffle; a page counts a line once. lines are lines_of(pages), if they are there already.
    """
    count = pages.groupBy("doc_id").agg(F.count_distinct("page_num").alias("n")).filter("n > 1")
    lines = lines_of(pages) if lines is None else lines
    lines = lines.filter((F.length("line") <= longest) & ~F.col("line").rlike(r"^(\d+\.|[a-zA-Z]\))$"))
    seen = lines.select("doc_id", "page_num", "line").distinct().groupBy("doc_id", "line").agg(F.count("*").alias("k"))
    least = F.greatest(F.lit(2), F.floor(F.col("n") * share))
    return seen.join(count, "doc_id").filter(F.col("k") >= least).select("doc_id", "line")


def without_repeated(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    return lines.join(repeated, ["doc_id", "line"], "left_anti")


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"))


def slugify(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, 80), F.lit("")), F.lit("doc"))


def windows(words: Column, size: int, overlap: int) -> Column:
    """Arrays of size words, each starting size - overlap after the one before; the last may be shorter."""
    stride = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(words) - size, F.lit(0)) / stride).cast("int"))
    cut = once(words, lambda w: F.transform(starts, lambda k: F.slice(w, k * stride + 1, size)))
    return F.when(F.size(words) > 0, cut).otherwise(F.array())
