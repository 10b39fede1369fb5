"""Line deduplication by a deletion-neighbourhood join (Mor and Fraenkel, 1982), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import boxed, dropped, maybe_among, quoted, stored, unboxed

#: Segments of a line, and characters up to which a segment is not cut again.
SEGMENTS, LONG_SEGMENT = 32, 64


def _left(c: str, n: Column) -> Column:
    return F.substring(F.col(c), F.lit(1), n.cast("int"))


def _right(c: str, n: Column) -> Column:
    return F.substring(F.col(c), (F.length(c) - n + 1).cast("int"), n.cast("int"))


def _halves(c: str) -> Column:
    """Hashes of first and last halves, such that two lines with one edit between them share one."""
    n = F.length(c)
    out = []
    for m in (n, n - 1):  # the shorter of two lines is this line, or one character shorter
        a = F.floor(m / 2)
        out += [F.xxhash64(F.lit(0), a, _left(c, a)), F.xxhash64(F.lit(1), a, _right(c, a))]
    return F.array_distinct(F.array(*out))


def _segments(c: str, longer: bool, outer: Column | None = None) -> Column:
    """Structs (longer, outer, mid): outer hashes all of the text but segment j, mid is that segment.

    Without longer, segments are those of the text's own length; with it, of one character less, and mid is a character
    longer: a text and one with one more character then share the outer hash of the segment that holds the edit.
    """
    m = F.length(c) - int(longer)
    s = F.ceil(m / SEGMENTS)

    def one(j: Column) -> Column:
        rest = F.greatest(m - (j + 1) * s, F.lit(0))
        mid = F.substring(F.col(c), (j * s + 1).cast("int"), (F.length(c) - j * s - rest).cast("int"))
        within = [] if outer is None else [outer]
        return F.struct(F.lit(longer).alias("longer"), F.xxhash64(*within, m, j, _left(c, j * s), _right(c, rest)).alias("outer"), mid.alias("mid"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(m / s) - 1), one)


def _within_one(a: str, b: str) -> Column:
    """Whether one edit or none lies between two texts: the end of what they begin with alike is halved for, then the rest must be equal."""
    la, lb = F.length(a), F.length(b)
    whole = F.struct(F.lit(0).alias("low"), F.least(la, lb).alias("high"))

    def halve(x: Column, _: Column) -> Column:
        mid = F.floor((x["low"] + x["high"] + 1) / 2).cast("int")
        same = _left(a, mid) == _left(b, mid)
        return F.struct(F.when(same, mid).otherwise(x["low"]).alias("low"), F.when(same, x["high"]).otherwise(mid - 1).alias("high"))

    # 2**31 halves to nothing in 31 steps; short texts stop moving sooner
    alike = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.least(la, lb) + 1)).cast("int") + 1), whole, halve, lambda x: x["low"])
    rest = lambda c, more: F.substring(F.col(c), alike + 1 + more.cast("int"), F.length(c))
    return (F.abs(la - lb) <= 1) & (rest(a, la >= lb) == rest(b, lb >= la))


def _cut_lines(text: DataFrame) -> DataFrame:
    """(h, g, first, longer, outer, mid) of the segments whose outside another line shares, cut again while they are long."""

    def shared(cut: DataFrame) -> DataFrame:
        outers = cut.groupBy("outer").agg(F.count("*").alias("n")).filter("n > 1").select("outer")
        return stored(cut.join(outers, "outer", "left_semi"), "segments")

    # a line of one character has no shorter one but the empty line, which is blank
    first = F.when(F.length("line") > 1, F.concat(_segments("line", False), _segments("line", True))).otherwise(_segments("line", False))
    whole = stored(text.select("h", "g", "first", F.explode(first).alias("s")).select("h", "g", "first", "s.*"), "cut")
    near = shared(whole)
    dropped(whole)
    size = F.length("mid") - F.col("longer").cast("int")  # the same for both of a pair
    while (near.agg(F.max(size)).first()[0] or 0) > LONG_SEGMENT:
        short = F.array(F.struct("longer", "outer", "mid"))
        again = F.when(F.col("longer"), _segments("mid", True, F.col("outer"))).otherwise(_segments("mid", False, F.col("outer")))
        parts = F.when(size <= LONG_SEGMENT, short).otherwise(again)
        closer = shared(near.select("h", "g", "first", F.explode(parts).alias("s")).select("h", "g", "first", "s.*"))
        dropped(near)
        near = closer
    return near


def _variants() -> Column:
    """Structs (role, key): deletions of one character of mid within its outer hash.

    Lines of one length meet where they lose a character at one place (role s); a line that is one longer (role b)
    loses a character and meets the shorter as it is (role f).
    """
    outer, mid = F.col("outer"), F.col("mid")
    places = F.sequence(F.lit(1), F.length(mid))
    without = lambda i: F.concat(F.substring(mid, F.lit(1), i - 1), F.substring(mid, i + 1, F.length(mid)))
    key = lambda role, *x: F.struct(F.lit(role).alias("role"), F.xxhash64(outer, *x).alias("key"))
    same = F.transform(places, lambda i: key("s", F.lit(1), i, without(i)))
    more = F.transform(places, lambda i: key("b", F.lit(2), without(i)))
    return F.when(F.col("longer"), F.array_distinct(more)).otherwise(F.array_append(same, key("f", F.lit(2), mid)))


def _earlier_within_one(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h, g, first, near): the earliest line within one edit of each distinct line that has an earlier one.

    Three widths of neighbourhood keep the emitted rows few and lose no pair: lines that share no half with
    another line have no neighbour; of the others, segments whose outside no other line shares hold no edit; what
    is left emits its deletions. Groups of equal variants are only reduced to their earliest line, never paired.
    """
    halves = distinct.select("h", "g", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    suspects = stored(halves.join(shared, "half", "left_semi").select("h", "g", "first").distinct(), "suspects")
    where = F.xxhash64("h", "first")
    found = maybe_among(lines.select("h", "g", "line", F.col("at").alias("first")), where, suspects.select(where.alias("k")))
    # an inner join: a semi join would be moved below the filter and shuffle every line
    text = stored(found.join(suspects, ["h", "g", "first"]).dropDuplicates(["h", "g"]), "suspect_lines")
    dropped(suspects)

    cut = _cut_lines(text)
    near = stored(cut.select("h", "g", "first", F.explode(_variants()).alias("v")).select("h", "g", "first", "v.*"), "variants")
    dropped(cut)
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("first"))).alias(role)
    groups = near.groupBy("key").agg(F.count("*").alias("n"), least("s"), least("b"), least("f")).filter("n > 1").drop("n")
    partner = F.when(F.col("role") == "s", F.col("s")).when(F.col("role") == "f", F.col("b")).otherwise(F.col("f"))
    pairs = near.join(groups, "key").select("h", "g", "first", partner.alias("near")).filter(F.col("near") < F.col("first")).distinct()
    own = text.select("h", "g", F.col("line"))
    other = text.select(F.col("first").alias("near"), F.col("line").alias("near_line"))
    sure = pairs.join(own, ["h", "g"]).join(other, "near").filter(_within_one("line", "near_line"))
    return sure.groupBy("h", "g").agg(F.min("near").alias("near"))


def dedup_lines(df: DataFrame, bound: int = 1, text: str = "text", order: str = "doc_id") -> DataFrame:
    """All columns of df, the text without repeated lines, with n_lines and n_removed (both long).

    Lines are what line feeds separate. A line goes if a line before it is equal or within bound edits (0 or 1
    characters inserted, deleted or replaced), whatever their lengths; whether the line before goes itself doesn't
    matter. Lines stand in order of (order column, hash of the text, place in the text). Blank lines always stay.

    A line that a third of all documents hold is one row after partial aggregation, and joins back to its places
    in a join that Spark can split. Each document's text moves once, with the places of its lines that go. Very long
    texts are rows like others: their lines are compared one by one, and a very long line is cut into segments of segments, so
    that the deletions of a short one are emitted whatever the line's length. The filter before the join of near lines is
    a bitmap of 2**23 bits: beyond some ten million distinct suspects it lets most lines pass, which costs a shuffle of
    them and loses nothing.

    Nulls: a null text stays null, with 0 lines; a null order value comes last. Rows that repeat an order value are
    documents of their own, told apart by their texts; rows equal in both count as one document and stay alike.
    Empty texts have one blank line. An empty table gives an empty one. Other columns may have any name; those named
    n_lines or n_removed are replaced.
    """
    if bound not in (0, 1):
        raise ValueError("bound must be 0 or 1")
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    held = df.select(*map(quoted, names))
    docs = held.select(boxed(held).alias("row"), quoted(order).alias("id"), F.xxhash64(quoted(text)).alias("th"))
    parts = F.split(F.col("row").getField(text), "\n", -1)
    each = docs.select("id", "th", F.posexplode(parts).alias("no", "line"))
    at = F.struct(F.col("id").isNull().alias("none"), "id", "th", "no").alias("at")
    lines = each.filter(F.col("line").rlike("\\S")).select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), at, "line")
    slim = lines.select("h", "g", "at", _halves("line").alias("halves") if bound else F.array(F.lit(0).cast("long")).alias("halves"))
    part = [F.max(F.get("halves", F.lit(k))).alias(f"_{k}") for k in range(4)]
    distinct = slim.groupBy("h", "g").agg(F.min("at").alias("first"), F.count("*").alias("n"), *part)
    halves = F.array_compact(F.array(*[f"_{k}" for k in range(4)])).alias("halves")
    distinct = stored(distinct.select("h", "g", "first", "n", halves), "lines")
    keep = distinct.select("h", "g", "first", "n")
    if bound:
        keep = keep.join(_earlier_within_one(lines, distinct), ["h", "g"], "left").withColumn("first", F.least("first", "near"))
        repeated = keep.filter((F.col("n") > 1) | F.col("near").isNotNull())
    else:
        repeated = keep.filter("n > 1")
    gone = lines.select("h", "g", "at").join(repeated.select("h", "g", "first"), ["h", "g"]).filter(F.col("at") > F.col("first"))
    gone = gone.groupBy(F.col("at.id").alias("gone_id"), F.col("at.th").alias("gone_th")).agg(F.collect_set("at.no").alias("gone"))

    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th"))
    both = docs.join(gone, same, "left").withColumn("parts", parts)
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    kept = F.array_join(F.transform(places, lambda i: F.get("parts", i)), "\n")
    left = F.when(F.col("gone").isNull(), F.col("row").getField(text)).otherwise(kept).alias(text)
    columns = dict(zip(names, unboxed("row", names))) | {text: left}
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    some = lambda c: F.when(F.col(c).isNotNull(), count(c)).otherwise(F.lit(0).cast("long"))
    return both.select(*columns.values(), some("parts").alias("n_lines"), some("gone").alias("n_removed"))
