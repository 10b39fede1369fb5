"""Web pages: HTML to text and links, URL rules, crawl frontier, upsert, exact and near duplicates."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import bundles as B
from granary.operators import text as T
from granary.sources.tables import snapshot

#: Tags whose text is not read, tags that break lines, and endings of files that are not pages (fixed values).
SKIPPED = ["button", "canvas", "footer", "form", "header", "nav", "noscript", "script", "select", "style", "svg"]
BREAKS = [
    "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "main", "nav", "ol", "p",
    "section", "table", "td", "th", "tr", "ul",
]
NOT_PAGES = [
    "avi", "css", "csv", "doc", "docx", "gif", "ico", "jpeg", "jpg", "js", "json", "mp3", "mp4", "pdf", "png", "svg", "webp", "xls", "xlsx", "zip",
]


class Token(NamedTuple):
    kind: str  # open, close or text
    value: str
    href: str | None = None


class _Tokens(HTMLParser):
    """The page as a list of tokens, character references decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Token] = []
        self.handle_data = lambda data: self.found.append(Token("text", data.strip()))
        self.handle_endtag = lambda tag: self.found.append(Token("close", tag))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append(Token("open", tag, dict(attrs).get("href") if tag == "a" else None))


def _tokens(source: str) -> list[Token]:
    parser = _Tokens()
    try:
        parser.feed(source)
        parser.close()
    except (ValueError, AssertionError):
        pass  # what was read before the fault counts
    return parser.found


def page_parts(source: str, base: str) -> tuple[str, str, list[str]]:
    """(title, text with line breaks, absolute links) of a page; links count inside skipped tags too."""
    title: list[str] = []
    text: list[str] = []
    links: list[str] = []
    skipped: list[str] = []  # skipped tags that are open
    in_title = False
    for token in _tokens(source):
        depth = len(skipped)
        if token.kind == "open" and token.value in SKIPPED:
            skipped.append(token.value)
        elif token.kind == "close" and skipped and skipped[-1] == token.value:
            skipped.pop()
        if token.kind != "text":
            in_title = token.kind == "open" if token.value == "title" else in_title
            # a tag that opens or closes a skipped part breaks no line
            if token.value in BREAKS and depth == len(skipped):
                text.append("\n")
            if token.href and token.kind == "open":
                links.append(urljoin(base, token.href))
        elif token.value and not skipped:
            (title if in_title else text).append(token.value if in_title else f"{token.value} ")
    return " ".join(title), "".join(text), links


def _closed_only(source: str) -> str:
    """source with the ampersands escaped that begin no known reference closed by a semicolon."""
    known = lambda m: m[0] if m[0].startswith("&#") or m[0][1:] in html5 else "&amp;" + m[0][1:]
    return re.sub(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", lambda m: "&amp;" if m[0] == "&" else known(m), source)


#: Pages that a task's Python holds as objects at a time.
PAGES_AT_ONCE = 64


def read_html(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", closed: bool = False) -> DataFrame:
    """key, url, title, raw_text and links of HTML pages, parsed in Arrow batches; clean the text with basic_clean.

    closed: only character references that a semicolon closes are decoded; by default also those that HTML lets stand open.
    """
    kind = pages.schema[key].dataType.simpleString()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few pages at a time: what is read of a page takes several times its size
            for low in range(0, batch.num_rows, PAGES_AT_ONCE):
                few = batch.slice(low, PAGES_AT_ONCE)
                sources = ((h.as_py() or "") for h in few.column(2))
                bases = ((u.as_py() or "") for u in few.column(1))
                read = [page_parts(_closed_only(h) if closed else h, u) for h, u in zip(sources, bases)]
                title, text, links = ([r[k] for r in read] for k in range(3))
                made = [pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(links, pa.list_(pa.string()))]
                yield pa.record_batch([few.column(0), few.column(1), *made], ["c0", "c1", "c2", "c3", "c4"])
                del few, read, title, text, links, made
            pa.default_memory_pool().release_unused()

    made = pages.select(F.col(key).alias("c0"), F.col(url).alias("c1"), F.col(source).alias("c2"))
    made = made.mapInArrow(run, f"c0 {kind}, c1 string, c2 string, c3 string, c4 array<string>")
    return made.select(F.col("c0").alias(key), F.col("c1").alias(url), F.col("c2").alias("title"), F.col("c3").alias("raw_text"), F.col("c4").alias("links"))


def canonical_url(url: Column) -> Column:
    """Without fragment and closing slashes; empty unless http or https."""
    c = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    c = F.regexp_replace(c, r"^(https?://[^/?]*)(\?|$)", "$1/$2")
    return F.when(c.rlike("^https?:"), F.regexp_replace(c, "/+$", "")).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host, with its port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def domain_allowed(url: Column, domains: list[str]) -> Column:
    host, out = host_of(url), F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit("." + d))
    return (host != "") & out


def is_page_url(url: Column) -> Column:
    return ~F.lower(path_of(url)).rlike(rf"\.({'|'.join(NOT_PAGES)})$")


def path_matches(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    path = F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/"))
    some = lambda patterns: path.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    return (some(include) if include else F.lit(True)) & ~(some(exclude) if exclude else F.lit(False))


def skip_reason(url: Column, domains: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Why a URL is not fetched, the first reason that holds; null if it is."""
    return (
        F.when(~domain_allowed(url, domains), "outside_allowed_domains")
        .when(~is_page_url(url), "non_html_extension")
        .when(~path_matches(url, include, exclude), "path_filter_excluded")
    )


def robots_allow(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds allowed: by the first rule (host, agent, ord, prefix, allow) of the agent's group whose prefix fits the path.

    The group named * counts for hosts that have none for the agent.
    A host without any rule row is unreadable and denied; one whose rules don't fit is allowed.
    """
    group = F.when(F.col("agent") == agent, 0).when(F.col("agent") == "*", 1)
    each = rules.withColumn("_g", group).filter("_g is not null")
    # an agent's own group counts alone where the host has one
    best = each.groupBy("host").agg(F.min("_g").alias("_best"))
    own = each.join(best, "host").filter("_g = _best").select(F.col("host").alias("_host"), "ord", "prefix", "allow")
    keyed = urls.withColumn("_host", host_of(F.col("url")))
    fits = F.startswith(F.coalesce(F.nullif(path_of(F.col("url")), F.lit("")), F.lit("/")), F.col("prefix"))
    first = keyed.join(own, "_host").filter(fits).groupBy("url").agg(F.min_by("allow", "ord").alias("_rule"))
    known = rules.select(F.col("host").alias("_host"), F.lit(True).alias("_known")).distinct()
    out = keyed.join(first, "url", "left").join(known, "_host", "left")
    return out.withColumn("allowed", F.coalesce("_known", F.lit(False)) & F.coalesce("_rule", F.lit(True))).drop("_host", "_rule", "_known")


def web_pages_as_pages(records: DataFrame) -> DataFrame:
    """Page rows of web records (final_url, title, text): title falls back to path and URL; empty texts go."""
    url = F.col("final_url")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.regexp_replace(path_of(url), "^/+|/+$", ""), F.lit("")), url)
    named = records.withColumn("_t", title).filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    return named.select(
        F.concat(F.lit("Web - "), F.substring("_t", 1, 90), F.lit(" - "), F.substring(url, 1, 90)).alias("doc_id"),
        F.concat(F.lit("Web - "), F.substring("_t", 1, 140)).alias("file_name"), url.alias("source_path"), F.lit(1).alias("page_num"), "text",
    )


def merge_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """One record per final_url: those of new go before those of old, later rows (pos) before earlier ones."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    order = Window.partitionBy("final_url").orderBy(F.desc("_batch"), F.desc("pos"))
    return both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_batch")


def delete_record(records: DataFrame, url: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", "")
    target = url.strip().rstrip("/")
    return records.filter((plain(F.col("url")) != target) & (plain(F.col("final_url")) != target))


def first_urls(urls: DataFrame) -> DataFrame:
    """(url, pos) of each URL's first place."""
    return urls.groupBy("url").agg(F.min("pos").alias("pos"))


def numbered(df: DataFrame, order: list[str], counted: Column) -> DataFrame:
    """df with _n, the row's number in order, and _k, how many rows up to it are counted; order must be unique.

    Rows are dealt by ranges of order; a task ranks its own range, and the ranges before it add their totals. The
    totals are one row a range.
    """
    dealt = snapshot(df.repartitionByRange(*order).withColumns({"_p": F.spark_partition_id(), "_c": counted.cast("long")}), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_p").agg(F.count("*").alias("n"), F.sum("_c").alias("c"))
    starts = sums.select("_p", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_{x}0") for x in "nc"])
    own = Window.partitionBy("_p").orderBy(*order)
    ranked = dealt.withColumns({"_r": F.row_number().over(own), "_s": F.sum("_c").over(own)}).join(F.broadcast(starts), "_p")
    return ranked.withColumns({"_n": F.col("_n0") + F.col("_r"), "_k": F.col("_c0") + F.col("_s")}).drop("_p", "_c", "_r", "_s", "_n0", "_c0")


def crawl(seeds: DataFrame, fetched: DataFrame, edges: DataFrame, domains: list[str], max_depth: int, max_pages: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, least_words: int = 80, rules: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """(url, depth, ord, reason): pages visited breadth-first over fetched pages, in order, null reason if kept.

    seeds (url, pos), fetched (url, words; null words means the fetch failed), edges (src, dst, pos), rules those of
    robots_allow; without them no URL is blocked. Links that skip_reason names are not queued; seeds are, and get their
    reason. Each level is one join and one anti-join; levels end at max_depth, or
    when max_pages pages were kept, if that is given.
    """
    level = first_urls(seeds.select(canonical_url(F.col("url")).alias("url"), "pos").filter("url <> ''")).select("url", F.lit(0).alias("depth"), "pos")
    done = None
    for depth in range(max_depth + 1):
        judged = level.join(fetched, "url", "left")
        blocked = F.lit(None).cast("string")
        if rules is not None:
            judged = judged.join(robots_allow(level.select("url"), rules, agent), "url")
            blocked = F.when(~F.col("allowed"), "blocked_by_robots_txt")
        missing = F.when(F.col("words").isNull(), "fetch_error").when(F.col("words") < least_words, "too_little_text")
        judged = judged.withColumn("reason", F.coalesce(skip_reason(F.col("url"), domains, include, exclude), blocked, missing))
        judged = numbered(judged.select("url", "depth", "pos", "reason"), ["pos", "url"], F.col("reason").isNull())
        if max_pages is not None:
            before = 0 if done is None else done.filter("reason is null").count()
            judged = judged.filter(F.col("_k") - F.col("reason").isNull().cast("int") < max_pages - before)
        judged = snapshot(judged.select("url", "depth", F.col("_n").alias("ord"), "reason"), "frontier")
        done = judged if done is None else done.unionByName(judged)
        # pages with little text were fetched: they are not kept, but their links are followed
        parents = judged.filter("reason is null or reason = 'too_little_text'").select(F.col("url").alias("src"), "ord")
        links = parents.join(edges, "src").select(canonical_url(F.col("dst")).alias("url"), F.struct("ord", "pos").alias("at")).filter("url <> ''")
        links = links.filter(skip_reason(F.col("url"), domains, include, exclude).isNull())
        nxt = links.groupBy("url").agg(F.min("at").alias("at")).join(done.select("url").distinct(), "url", "left_anti")
        level = nxt.select("url", F.lit(depth + 1).alias("depth"), (F.col("at.ord").cast("long") * F.lit(10**9) + F.col("at.pos")).alias("pos"))
        level = snapshot(level, "level")
        if depth == max_depth or level.isEmpty():
            break
    return done


def sitemap_urls(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(source, at, url, is_sitemap) from sitemap XML and robots texts (source, body), at being the place in the text; keep
    names further columns to keep."""
    locs = F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"))
    robots = F.transform(F.filter(F.split("body", "\r?\n"), lambda x: x.rlike("(?i)^\\s*sitemap:")), lambda x: F.trim(F.regexp_replace(x, "(?i)^\\s*sitemap:", "")))
    each = documents.select("source", *(keep or []), F.posexplode(F.concat(locs, robots)).alias("at", "url"))
    return each.withColumn("is_sitemap", F.lower(path_of(F.col("url"))).endswith(".xml"))


def expand_sitemaps(sitemaps: DataFrame, documents: DataFrame, domains: list[str], most: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, visited): pages (url, pos) that sitemaps list, and visited (url, depth, pos, reason) sitemaps.

    sitemaps (url, pos) are read from documents (source, body), fetched before; what they list goes level by level,
    each level a join and an anti-join. A sitemap outside domains or without a document has a reason. Pages are
    canonical, within domains and path filters, each at its first place; most, if given, keeps the first so many.
    """
    body = documents.select(F.col("source").alias("url"), "body")
    level = snapshot(first_urls(sitemaps).withColumn("depth", F.lit(0)), "sitemaps")
    visited = pages = None
    while not level.isEmpty():
        depth = level.select("depth").first()[0]
        judged = level.join(body, "url", "left")
        reason = F.when(~domain_allowed(F.col("url"), domains), "sitemap_outside_allowed_domains").when(F.col("body").isNull(), "fetch_error")
        judged = numbered(judged.select("url", "depth", "pos", reason.alias("reason")), ["pos", "url"], F.lit(True))
        judged = snapshot(judged.select("url", "depth", F.col("_n").alias("pos"), "reason"), "sitemaps")
        visited = judged if visited is None else visited.unionByName(judged)
        read = judged.filter("reason is null").join(body, "url").select(F.col("url").alias("source"), "pos", "body")
        place = F.struct(F.lit(depth).alias("depth"), "pos", "at")
        found = snapshot(sitemap_urls(read, ["pos"]).select(place.alias("place"), "url", "is_sitemap"), "listed")
        listed = found.filter("not is_sitemap").select(canonical_url(F.col("url")).alias("url"), "place")
        listed = listed.filter((F.col("url") != "") & skip_reason(F.col("url"), domains, include, exclude).isNull())
        pages = listed if pages is None else pages.unionByName(listed)
        below = found.filter("is_sitemap").groupBy("url").agg(F.min("place").alias("place")).join(visited.select("url"), "url", "left_anti")
        order = F.col("place.pos") * F.lit(10**9) + F.col("place.at")
        level = snapshot(below.select("url", order.alias("pos"), F.lit(depth + 1).alias("depth")), "sitemaps")
    if pages is None:
        empty = first_urls(sitemaps).limit(0)
        return empty, empty.select("url", F.lit(0).alias("depth"), "pos", F.lit("").alias("reason"))
    pages = numbered(pages.groupBy("url").agg(F.min("place").alias("place")), ["place", "url"], F.lit(True)).select("url", F.col("_n").alias("pos"))
    return (pages if most is None else pages.filter(F.col("pos") <= most)), visited


def plain_words(c: Column) -> Column:
    """Lower-case letters a-z and digits, everything else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def shingles(c: Column, size: int = 8) -> Column:
    """Distinct runs of size words of plain_words text; a shorter text is one run."""
    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        made = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<string>"))

    return T.once(F.filter(F.split(c, " "), lambda x: x != ""), runs)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def exact_groups(records: DataFrame, key: str = "url") -> DataFrame:
    """(norm_hash, copies, first, last) of texts that are equal as plain words: counts and ends combine before the shuffle."""
    return _normalised(records, key).groupBy("norm_hash").agg(F.count("*").alias("copies"), F.min(key).alias("first"), F.max(key).alias("last")).filter("copies > 1")


def exact_duplicates(records: DataFrame, key: str = "url") -> DataFrame:
    """(norm_hash, copies, key, bytes): a row for each member of a group of texts that are equal as plain words.

    The group is keyed by a 256-bit digest; members meet their group in an equality join that Spark can split.
    """
    return _normalised(records, key).join(exact_groups(records, key).select("norm_hash", "copies"), "norm_hash").select("norm_hash", "copies", key, "bytes")


def _normalised(records: DataFrame, key: str) -> DataFrame:
    plain = records.withColumn("_n", plain_words(F.col("text"))).filter("_n <> ''")
    return plain.select(key, F.sha2("_n", 256).alias("norm_hash"), F.octet_length("text").alias("bytes"))


#: Counters of tokens; which token falls to which is fixed, whatever the input.
COUNTERS = 1 << 20
BLOCKS = 64


def _levels(sets: DataFrame, tokens: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]] = lambda batches: (b.column("g").flatten().to_numpy() for b in batches)) -> np.ndarray:
    """A level for each counter of tokens: 0 up to a common load, then one more for every ninth part more of it.

    Each task counts its own tokens and sends a byte a counter, its load to a twelfth part: any order of the tokens is right
    that is one for all sets. Blocks of counters are added up apart, and COUNTERS numbers go to the driver.
    tokens: how they are read of sets, by default from column g.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, dtype=np.int64)
        for g in tokens(batches):
            held += np.bincount(g & (COUNTERS - 1), minlength=COUNTERS)
        blocks = np.minimum(np.rint(8 * np.log2(1.0 + held)), 255).astype(np.uint8).reshape(BLOCKS, -1)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([blocks[k].tobytes() for k in at], pa.binary())], ["b", "c"])

    def add(rows: pa.Table) -> pa.Table:
        loads = sum(np.exp2(np.frombuffer(c.as_py(), np.uint8) / 8) - 1 for c in rows.column("c"))
        return pa.table([rows.column("b")[:1].combine_chunks(), pa.array([loads.tobytes()], pa.binary())], ["b", "c"])

    loads = np.zeros((BLOCKS, COUNTERS // BLOCKS))
    for row in sets.mapInArrow(run, "b long, c binary").groupBy("b").applyInArrow(add, "b long, c binary").collect():
        loads[row.b] = np.frombuffer(row.c)
    loads = loads.reshape(-1)
    common = max(loads.sum() / COUNTERS, 2.0)
    return np.floor(8 * np.log2(np.maximum(loads / common, 1.0))).astype(np.int16)


def _prefixes(records: DataFrame, threshold: float, size: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets (id, g), prefixes (id, n, t), copies (id, copies)) of distinct plain texts, see near_duplicates.

    Copies fold by digests, so no text is shuffled; of the hashes only the prefixes are.
    """
    kind = records.schema[key].dataType.simpleString()
    both = lambda n: F.struct(F.unhex(F.sha2(n, 256)).alias("h"), F.transform(shingles(n, size), lambda x: F.xxhash64(x)).alias("g"))
    read = records.filter("text is not null").select(F.col(key).alias("id"), T.once(plain_words(F.col("text")), both).alias("s"))
    # texts without words have no shingles; a filter before this would compute the words twice
    held = snapshot(read, "shingles").select("id", "s.h", "s.g").filter(F.size("g") > 0)
    copies = snapshot(held.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "copies")
    sent = records.sparkSession.sparkContext.broadcast(_levels(held.select("g")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for b in batches:
            lists = b.column("g")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            chosen, low = [], 0
            for end in ends:
                g = flat[low:end]
                k = len(g) - math.ceil(len(g) * threshold) + 1
                chosen.append(g[np.lexsort((g, level[g & (COUNTERS - 1)]))[:k]])
                low = end
            sizes = [len(c) for c in chosen]
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(chosen) if chosen else np.zeros(0, np.int64)))
            yield pa.record_batch([b.column("id"), b.column("h"), lists.value_lengths(), tokens], ["id", "h", "n", "p"])

    firsts = held.mapInArrow(run, f"id {kind}, h binary, n int, p array<bigint>").join(copies.select("id", "h"), ["id", "h"], "left_semi")
    return held.select("id", "g"), firsts.select("id", "n", F.explode("p").alias("t")), copies.select("id", "copies")


#: Up to so many pairs, their ids go to every task, and sets of other ids are not shuffled.
FEW_PAIRS = 1 << 18


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(left, right, similarity) of those pairs (left, right) whose whole sets are alike."""
    pairs = snapshot(pairs, "pairs")
    if pairs.count() <= FEW_PAIRS:
        ids = pairs.select(F.col("left").alias("id")).union(pairs.select("right"))
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    held = pairs.join(sets.select(F.col("id").alias("left"), F.col("g").alias("gl")), "left").join(sets.select(F.col("id").alias("right"), F.col("g").alias("gr")), "right")
    return held.select("left", "right", jaccard(F.col("gl"), F.col("gr")).alias("similarity")).filter(F.col("similarity") >= threshold).distinct()


def near_duplicates(records: DataFrame, threshold: float = 0.86, size: int = 8, key: str = "url") -> DataFrame:
    """(left, right, similarity): pairs of different plain texts with Jaccard similarity of threshold or more.

    Prefix filter: shingle hashes go in one order for all sets, those of crowded counters last, and two sets this alike
    share one of their first n - ceil(threshold * n) + 1. Equal texts fold into their smallest key first, so copies don't
    multiply; pass members on with exact_duplicates. Pairs keep only ids until both sets join for the exact test.
    """
    sets, prefix, _ = _prefixes(records, threshold, size, key)
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))
    pairs = a.join(b, fits).select(F.col("a.id").alias("left"), F.col("b.id").alias("right")).distinct()
    return _alike(pairs, sets, threshold)


#: Sets of one token that are compared with one another; of a commoner token only some are compared with all at a time.
LIGHT = 32


def _word_hashes(records: DataFrame, key: str) -> DataFrame:
    """(id, h, w): a digest of each plain text and the hashes of its words in order."""
    each = lambda n: F.struct(F.unhex(F.substring(F.sha2(n, 256), 1, 32)).alias("h"), F.when(n != "", F.transform(F.split(n, " "), lambda x: F.xxhash64(x))).alias("w"))
    read = records.filter("text is not null").select(F.col(key).alias("id"), T.once(plain_words(F.col("text")), each).alias("s"))
    return read.select("id", "s.h", "s.w")


def _met(rows: DataFrame, threshold: float) -> DataFrame:
    """Those rows (t, id, lo, hi) whose token another bundle has too, at sizes that let them be alike, with in_bucket, their number."""
    near = Window.partitionBy("t").orderBy("lo")
    every = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    larger = F.col("hi") >= (threshold - B.TINY) * F.lead("lo").over(near)
    smaller = F.max("hi").over(near.rowsBetween(Window.unboundedPreceding, -1)) >= (threshold - B.TINY) * F.col("lo")
    met = (F.min("id").over(every) != F.max("id").over(every)) & (F.coalesce(larger, F.lit(False)) | F.coalesce(smaller, F.lit(False)))
    kept = rows.withColumn("_met", met).filter("_met").drop("_met").distinct()
    return snapshot(kept.withColumn("in_bucket", F.count("*").over(Window.partitionBy("t"))), "prefix")


def _share(a: DataFrame, b: DataFrame, apart: Column, threshold: float) -> DataFrame:
    return a.alias("a").join(b.alias("b"), (F.col("a.t") == F.col("b.t")) & apart & B.fits("a", "b", threshold))


def _likely(few: DataFrame, many: DataFrame, threshold: float) -> DataFrame:
    """(left, right): pairs of bundles that share a token of the few, and so many tokens that they can be alike (B.enough).

    Of tokens that many bundles have, a pair may share as many as the one of it that has fewer of them.
    """
    ends = [F.max(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("lo", "hi")]
    each = _share(few, few, F.col("a.id") < F.col("b.id"), threshold).groupBy(F.col("a.id").alias("left"), F.col("b.id").alias("right")).agg(F.count("*").alias("o"), *ends)
    spare = many.groupBy("id").agg(F.count("*").alias("m"))
    for end in ("left", "right"):
        each = each.join(spare.select(F.col("id").alias(end), F.col("m").alias(f"m_{end}")), end, "left")
    shared = F.col("o") + F.least(F.coalesce("m_left", F.lit(0)), F.coalesce("m_right", F.lit(0)))
    return each.filter(B.enough(shared, "a_", "b_", threshold)).select("left", "right")


def _linked(pairs: DataFrame, held: DataFrame, kind: str, threshold: float, sift: bool = False) -> DataFrame:
    """(left, right, a, b, similarity): those pairs (left, right) of bundles of which some members are alike, by digests a and b.

    sift: the pairs' prefixes are compared first, and whole sets go only of those that share enough of them.
    """
    def of(pairs: DataFrame) -> DataFrame:
        if pairs.count() > FEW_PAIRS:
            return held
        return held.join(F.broadcast(pairs.select(F.col("left").alias("rep")).union(pairs.select("right"))), "rep", "left_semi")

    def joined(pairs: DataFrame, names: list[str]) -> DataFrame:
        side = lambda end, x: of(pairs).select(F.col("rep").alias(end), *[F.col(c).alias(f"{x}_{c}") for c in names])
        return pairs.join(side("left", "x"), "left").join(side("right", "y"), "right")

    pairs = snapshot(pairs, "pairs")
    if sift:
        some = joined(pairs, ["p", "lo", "hi"]).filter(B.enough(F.size(F.array_intersect("x_p", "y_p")), "x_", "y_", threshold))
        pairs = snapshot(some.select("left", "right"), "pairs")
    return B.alike(joined(pairs, ["hs", "g", "more", "less"]), kind, threshold)


def near_groups(records: DataFrame, threshold: float = 0.86, size: int = 8, key: str = "url", light: int = LIGHT) -> tuple[DataFrame, DataFrame]:
    """(members, links): groups of different plain texts that near_duplicates() would chain together, and links that chain them.

    members has (key, group, copies): a row for each distinct text in a group, by its smallest key; group is the smallest of all
    and copies the number of records with that text. links has (left, right, similarity), at least one for each member but one.

    Near copies that lie side by side are chained to bundles before anything is shuffled (bundler()); how rows lie decides
    what is moved, not the result. Of every bundle the prefixes go once. Only bundles that share so many tokens with another
    that they can be alike, or a token that many have, are read again, with their whole sets: bundles that share a token of
    their prefix are compared while they may be in different groups: all of them if the token has few, else a few pivots of it with all others, round by round. What is in one group
    already is not compared again, so a group of n near copies costs some n comparisons, and a token is settled once all its
    bundles but those of one group have been pivots or all are in one group. Nothing is left out.
    """
    kind = records.schema[key].dataType.simpleString()
    words = _word_hashes(records, key)
    tokens = lambda batches: (np.concatenate(sets) for _, sets in B.sliced(batches, size))
    sent = records.sparkSession.sparkContext.broadcast(_levels(words.select("w"), tokens))
    made = snapshot(words.mapInArrow(B.bundler(lambda: sent.value, threshold, size, False), B.schema(kind, False)), "bundles")
    member = lambda df, *more: df.select(*more, F.explode(F.arrays_zip("ids", "hs", "copies")).alias("m")).select(*more, F.col("m.ids").alias("id"), F.col("m.hs").alias("h"), F.col("m.copies").alias("copies"))

    def parted(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
        return prefix.filter(F.col("in_bucket") <= light).drop("in_bucket"), prefix.filter(F.col("in_bucket") > light).drop("in_bucket")

    # of bundles with the same texts the first stands for all
    few, many = parted(_met(made.filter("rep is not null").select(F.col("sig").alias("id"), "lo", "hi", F.explode("p").alias("t")), threshold))
    pairs = snapshot(_likely(few, many, threshold), "pairs")
    met = pairs.select(F.col("left").alias("sig")).union(pairs.select("right")).union(many.select("id")).distinct()
    first = made.select("sig", "rep", "ids", "hs", "copies").join(met, "sig", "left_semi").groupBy("sig").agg(F.min_by(F.struct("ids", "hs", "copies"), "rep").alias("m"))
    again = snapshot(member(first.select("sig", "m.*"), "sig"), "again")
    read = B.perhaps_in(records.filter("text is not null"), key, again.select("id"))
    held = _word_hashes(read, key).mapInArrow(B.bundler(lambda: sent.value, threshold, size, True), B.schema(kind, True))
    held = snapshot(held, "held").filter("rep is not null")
    few, many = parted(_met(held.select(F.col("rep").alias("id"), "lo", "hi", F.explode("p").alias("t")), threshold))

    def alike(a: DataFrame, b: DataFrame, apart: Column) -> DataFrame:
        near = _share(a, b, apart, threshold).select(F.least("a.id", "b.id").alias("left"), F.greatest("a.id", "b.id").alias("right")).distinct()
        return _linked(near, held, kind, threshold, True)

    # of the few, each first meets its smallest partner; the other pairs only where that has not brought them together
    pairs = snapshot(_likely(few, many, threshold), "pairs")
    links = snapshot(_linked(pairs.groupBy("right").agg(F.min("left").alias("left")).select("left", "right"), held, kind, threshold), "links")
    groups = connected(links, "left", "right")
    of_left = groups.select(F.col("id").alias("left"), F.col("group").alias("gl"))
    of_right = groups.select(F.col("id").alias("right"), F.col("group").alias("gr"))
    rest = pairs.join(of_left, "left", "left").join(of_right, "right", "left").filter(F.coalesce("gl", "left") != F.coalesce("gr", "right")).select("left", "right")
    rest = rest.join(pairs.groupBy("right").agg(F.min("left").alias("left")), ["left", "right"], "left_anti")
    pivot = many.groupBy("t").agg(F.min("id").alias("pivot"))
    pivots = many.join(pivot, (many["t"] == pivot["t"]) & (many["id"] == pivot["pivot"]), "left_semi").select("t", "id", "lo", "hi")
    used = snapshot(pivots.select("t", "id"), "used")
    links = snapshot(links.union(_linked(rest, held, kind, threshold)).union(alike(pivots, many, F.col("a.id") != F.col("b.id"))).distinct(), "links")
    take = 4
    while True:
        groups = connected(links, "left", "right")
        placed = many.select("t", "id", "lo", "hi").join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
        placed = snapshot(placed, "placed")
        of = placed.groupBy("t", "group").agg(F.count("*").alias("k"))
        largest = of.groupBy("t").agg(F.max_by("group", F.struct("k", "group")).alias("largest"), F.count("*").alias("groups")).filter("groups > 1")
        left = placed.join(largest, "t").filter("group <> largest").join(used, ["t", "id"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("t").orderBy("group", "id"))
        pivots = snapshot(left.select("t", "id", "lo", "hi", "group", turn.alias("turn")).filter(F.col("turn") <= take).drop("turn"), "pivots")
        if pivots.isEmpty():
            break
        used = snapshot(used.union(pivots.select("t", "id")), "used")
        links = snapshot(links.union(alike(pivots, placed, F.col("a.group") != F.col("b.group"))).distinct(), "links")
        take *= 2

    # a text read again is in the group of its bundle then, any other in that of its first bundle
    asked = again.select("h").distinct()
    placed = held.select(F.col("rep").alias("id"), F.explode("hs").alias("h")).join(groups, "id", "left").join(asked, "h", "left_semi")
    own = member(made, "rep").select("h", "id", "copies", F.col("rep").alias("c"), F.lit(None).cast(kind).alias("v"))
    none = [F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast(kind).alias("c")]
    texts = own.unionByName(placed.select("h", *none, F.coalesce("group", "id").alias("v"))).groupBy("h")
    texts = texts.agg(F.min("id").alias("id"), F.sum("copies").alias("copies"), F.coalesce(F.min("v"), F.min("c")).alias("c")).filter("id is not null")
    texts = snapshot(texts, "texts")
    of = texts.groupBy("c").agg(F.min("id").alias("group"), F.count("*").alias("k")).filter("k > 1")
    members = texts.join(of, "c").select(F.col("id").alias(key), "group", "copies")

    # links within bundles, each text's to the one it was linked to, and those between bundles
    alone = made.filter("rep is not null").join(again.select("sig"), "sig", "left_anti").groupBy("sig").agg(F.min_by(F.struct("hs", "up", "near"), "rep").alias("m")).select("m.*")
    inner = lambda df: df.select("hs", F.explode(F.arrays_zip("hs", "up", "near")).alias("m")).filter("m.up >= 0").select(F.element_at("hs", F.col("m.up") + 1).alias("a"), F.col("m.hs").alias("b"), F.col("m.near").alias("similarity"))
    found = inner(alone).union(inner(held).join(asked.withColumnRenamed("h", "b"), "b", "left_semi").select("a", "b", "similarity"))
    found = found.union(links.select("a", "b", "similarity").filter("a <> b"))
    found = found.join(texts.select(F.col("h").alias("a"), F.col("id").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("id").alias("y")), "b")
    return members, found.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "similarity").distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group): what links reach from one another, by the smallest id; ids without links have no row.

    Every id takes the least group among its neighbours', its group's id takes the least of its members', and all go on to
    the group of their group, so that a chain halves with every round; a round is a few joins and combined minima.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to")).union(links.select(F.col(b), F.col(a))).distinct()
    both = snapshot(both, "both")
    now = snapshot(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("group")), "groups")
    while True:
        near = both.join(now.select(F.col("id").alias("to"), "group"), "to").groupBy("id").agg(F.min("group").alias("near"))
        least = now.join(near, "id").select("id", F.least("group", "near").alias("group"), F.col("group").alias("before"))
        # a group's own id learns what its members have seen, then everyone goes on to the group of its group
        told = least.filter("group <> before").groupBy(F.col("before").alias("id")).agg(F.min("group").alias("told"))
        hooked = snapshot(least.join(told, "id", "left").select("id", F.least("group", F.coalesce("told", "group")).alias("group"), "before"), "hooked")
        further = hooked.select(F.col("id").alias("_of"), F.col("group").alias("_further"))
        after = snapshot(hooked.join(further, F.col("group") == F.col("_of")).select("id", F.col("_further").alias("group"), "before"), "groups")
        if after.filter("group <> before").isEmpty():
            return after.select("id", "group")
        now = after.select("id", "group")


def duplicate_report(records: DataFrame, threshold: float = 0.86, key: str = "url") -> DataFrame:
    """kind (exact, near) with its number of groups and pages, and kind total for all records."""
    exact = exact_groups(records, key).agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("pages"))
    near = near_duplicates(records, threshold, key=key).agg(F.count("*").alias("groups"), (2 * F.count("*")).alias("pages"))
    total = records.agg(F.lit(0).cast("long").alias("groups"), F.count("*").alias("pages"))
    parts = [d.select(F.lit(k).alias("kind"), "groups", "pages") for k, d in (("exact", exact), ("near", near), ("total", total))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
