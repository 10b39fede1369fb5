"""Retrieval evaluation: gold sources, per-question metrics at K, macro and micro summaries, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import text as T
from granary.operators.web import host_of, path_of

LOCALES = ("gb", "en-gb", "uk", "en-us", "us")
SUBSETS = ("all", "core", "answerable")
GOLD_FIELDS = ("primary_expected_documents", "secondary_acceptable_documents", "primary_relevant_source", "source_locator")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def file_key(c: Column) -> Column:
    """A file name or title without 'pdf' at its end and 'web' at its start."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(slug(c), r"\bpdf$", "")), r"^web\s+", ""))


def url_key(c: Column) -> Column:
    """host and path of a URL, without www. and closing slash; empty without a host."""
    c = F.trim(F.coalesce(c, F.lit("")))
    host = F.regexp_replace(host_of(c), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.lower(path_of(c)), "/+", "/"), "/$", "")
    return F.when(host_of(c) == "", "").otherwise(F.concat(host, path))


def path_key(c: Column) -> Column:
    """The path's parts, a leading locale left out."""
    parts = F.filter(F.split(F.lower(path_of(F.trim(F.coalesce(c, F.lit(""))))), "/+"), lambda p: p != "")
    local = F.coalesce(F.get(parts, F.lit(0)).isin(*LOCALES), F.lit(False))
    return F.array_join(F.when(local, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts), "/")


def is_url(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^https?://"), F.lit(False))


def gold_sources(gold: DataFrame, fields: tuple[str, ...] = GOLD_FIELDS) -> DataFrame:
    """(id, pos, raw, kind, norm, path_key): each item's sources in order, the first of each key."""

    def cut(name: str) -> Column:
        c = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        none = (c == "") | (F.lower(c) == "nan") | F.startswith(F.lower(c), F.lit("none -"))
        return F.when(none, F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ";|\n"), lambda x: F.trim(x)))

    all_ = F.concat(*[cut(f) for f in fields if f in gold.columns])
    each = gold.select("id", F.posexplode(all_).alias("at", "raw")).filter((F.col("raw") != "") & ~F.startswith(F.lower("raw"), F.lit("none -")))
    url = is_url(F.col("raw"))
    keyed = each.withColumns({
        "kind": F.when(url, "url").otherwise("file_or_title"), "norm": F.when(url, url_key(F.col("raw"))).otherwise(file_key(F.col("raw"))),
        "path_key": F.when(url, path_key(F.col("raw"))).otherwise(""),
    }).filter("norm <> ''")
    first = keyed.groupBy("id", "norm").agg(F.min(F.struct("at", "raw", "kind", "path_key")).alias("f"))
    return first.select("id", F.col("f.at").alias("pos"), "f.raw", "f.kind", "norm", "f.path_key")


def hit_keys(hits: DataFrame) -> DataFrame:
    """hits with source_key, title_key and hit_path of their source_path, file_name and doc_id."""
    title = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.col("doc_id"))
    http = F.coalesce(F.col("source_path").rlike("^https?://"), F.lit(False))
    source = F.when(http, url_key(F.col("source_path"))).otherwise(file_key(F.coalesce(F.nullif(title, F.lit("")), F.col("source_path"))))
    return hits.withColumns({"source_key": source, "title_key": file_key(title), "hit_path": path_key(F.col("source_path"))})


def match_gold(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits (id, strategy, rank, ...) with matched_norm and matched_pos: the first gold source that fits; null if none.

    An equality join on the question; containment is tested only among one question's few gold sources.
    """
    keyed = hit_keys(hits)
    url = (F.col("norm") == F.col("source_key")) | ((F.col("path_key") != "") & (F.col("path_key") == F.col("hit_path")))
    name = (F.col("norm") == F.col("source_key")) | F.contains("title_key", F.col("norm")) | F.contains("norm", F.col("title_key"))
    fits = F.when(F.col("kind") == "url", url).otherwise(name)
    found = keyed.join(gold, "id").filter(fits).groupBy("id", "strategy", "rank").agg(F.min(F.struct("pos", "norm")).alias("m"))
    return keyed.join(found, ["id", "strategy", "rank"], "left").select("*", F.col("m.norm").alias("matched_norm"), F.col("m.pos").alias("matched_pos")).drop("m")


def source_universe(chunks: DataFrame) -> DataFrame:
    keyed = hit_keys(chunks).filter("source_key <> ''")
    return keyed.agg(F.count_distinct("source_key").alias("universe"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def question_metrics(questions: DataFrame, matched: DataFrame, gold: DataFrame, k: int, universe: int) -> DataFrame:
    """Per (id, strategy): precision (over k), recall, F1, chunk and source counts; null where an item has no gold."""
    top = matched.filter(F.col("rank") <= k)
    hit = F.col("matched_norm").isNotNull()
    sums = top.groupBy("id", "strategy").agg(
        F.count_if(hit).alias("tp"), F.count_distinct("matched_norm").alias("tps"),
        F.count_distinct(F.when(~hit & (F.col("source_key") != ""), F.col("source_key"))).alias("fps"),
        F.coalesce(F.min("matched_pos"), F.lit(-1)).alias("least"), F.count("*").alias("retrieved_count"))
    n = gold.groupBy("id").agg(F.count("*").alias("gold_source_count"), F.min("pos").alias("primary"))
    grid = questions.select("id").join(matched.select("id", "strategy").distinct(), "id")
    g = grid.join(sums, ["id", "strategy"], "left").join(n, "id", "left")
    some = F.col("gold_source_count").isNotNull()
    p, r = F.col("tp") / k, F.col("tps") / F.col("gold_source_count")
    only = lambda c: F.when(some, c)
    fn = F.col("gold_source_count") - F.col("tps")
    return g.select(
        "id", "strategy", only(p).alias("precision_at_k"), only(r).alias("recall_at_k"), only(f1(p, r)).alias("f1_at_k"),
        only(F.col("tp")).alias("tp_chunks"), only(F.greatest(F.lit(0), k - F.col("tp"))).alias("fp_chunks"), only(F.col("tps")).alias("tp_sources"),
        only(F.col("fps")).alias("fp_sources"), only(fn).alias("fn_sources"),
        only(F.greatest(F.lit(0), universe - F.col("tps") - F.col("fps") - fn)).alias("tn_sources"),
        F.coalesce("gold_source_count", F.lit(0)).alias("gold_source_count"), only(F.col("least") == F.col("primary")).alias("primary_source_hit"),
        "retrieved_count",
    )


def ranked_hits(matched: DataFrame, gold: DataFrame, k: int, chars: int = 600) -> DataFrame:
    """The first k hits per (id, strategy) as evaluation rows: relevant, the gold source as it was written, an excerpt."""
    raw = gold.select("id", F.col("pos").alias("matched_pos"), F.col("raw").alias("_raw"))
    top = matched.filter(F.col("rank") <= k).join(raw, ["id", "matched_pos"], "left")
    given = [c for c in ("section_title", "page_start", "page_end", "score", "vector_score", "metadata_boost") if c in matched.columns]
    source = F.coalesce(F.nullif(F.col("source_strategy"), F.lit("")), "strategy") if "source_strategy" in matched.columns else F.col("strategy")
    return top.select(
        "id", "strategy", "rank", "chunk_id", "file_name", "source_path", *given, source.alias("source_strategy"), F.col("matched_norm").isNotNull().alias("relevant"),
        F.coalesce("_raw", F.lit("")).alias("matched_gold_source"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text_excerpt"),
    )


def full_audit(items: DataFrame, results: DataFrame, metrics: DataFrame, hits: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per item and strategy: its result, metrics and ranked hits (a list of at most k), and the item's comparison.

    results (id, strategy, ...) are compact_results with id for question_id, comparisons (id, comparison); an item
    without one has a null comparison.
    """
    row = F.struct(*[c for c in hits.columns if c not in ("id", "strategy")])
    lists = hits.groupBy("id", "strategy").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    both = results.join(metrics, ["id", "strategy"]).join(lists, ["id", "strategy"], "left")
    return items.join(both, "id").join(comparisons, "id", "left")


def macro_summary(metrics: DataFrame, membership: DataFrame) -> DataFrame:
    """Means per subset and strategy; membership (id, subsets) may name several subsets an item."""
    each = metrics.join(membership.select("id", F.explode("subsets").alias("subset")), "id").filter("precision_at_k is not null")
    return each.groupBy("subset", "strategy").agg(
        F.count("*").alias("questions"), F.avg("precision_at_k").alias("macro_precision"), F.avg("recall_at_k").alias("macro_recall"),
        F.avg("f1_at_k").alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp_sources", "fp_sources", "fn_sources", "tn_sources")])


def confusion(summary: DataFrame) -> DataFrame:
    """Adds micro precision, recall and F1 of the source counts, 0 where undefined."""
    tp, fp, fn = F.col("tp_sources"), F.col("fp_sources"), F.col("fn_sources")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = summary.withColumns({"source_micro_precision": safe(tp, tp + fp), "source_micro_recall": safe(tp, tp + fn)})
    return out.withColumn("source_micro_f1", f1(F.col("source_micro_precision"), F.col("source_micro_recall")))


#: Quotation marks of UTF-8 read as Windows-1252, and what they stand for (fixed values).
MISREAD = [("\u00e2\u20ac\u2122", "'"), ("\u00e2\u20ac\u0153", '"'), ("\u00e2\u20ac\u009d", '"')]


def plain_text(c: Column) -> Column:
    """Lower-case with misread quotation marks mended and single spaces; real marks and spaces at the ends stay."""
    c = F.lower(F.coalesce(c, F.lit("")))
    for bad, good in MISREAD:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.regexp_replace(c, r"(?U)\s+", " ")


def group_coverage(text: Column, groups: Column) -> tuple[Column, Column]:
    """(matched, missing) keyword groups: a group is matched where the text has any of its phrases."""
    has = lambda g: F.exists(g, lambda p: F.contains(text, plain_text(p)))
    name = lambda gs: F.transform(gs, lambda g: F.array_join(g, " / "))
    return name(F.filter(groups, has)), name(F.filter(groups, lambda g: ~has(g)))


def word_runs(words: Column, k: int) -> Column:
    """Hashes of the distinct runs of k words; none if there are fewer words."""
    def made(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
        return F.when(F.size(w) >= k, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return T.once(words, made)


def _runs_of(words: Column, sizes: list[int]) -> Column:
    """(k, g) of all runs of each size in sizes."""
    def of(k: int) -> Column:
        return F.transform(word_runs(words, k), lambda g: F.struct(F.lit(k).alias("k"), g.alias("g")))

    return F.concat(*map(of, sizes))


def _by_size(words: Column, k: Column, sizes: list[int]) -> Column:
    """(k, g) of the runs of a row's own size k."""
    out = F.array().cast("array<struct<k:int,g:bigint>>")
    for n in sizes:
        out = F.when(k == n, _runs_of(words, [n])).otherwise(out)
    return out


def passage_shares(passages: DataFrame, docs: DataFrame, size: int = 5) -> DataFrame:
    """(id, doc_id, shared, shingles, share): how many of a passage's shingles a document holds, for all pairs that share one.

    Shingles are runs of size words of the whole lower-case text; a shorter passage is one run. Runs meet in an
    equality join of their hashes, so only pairs that share text are formed. docs are (doc_id, text).
    """
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " "), lambda x: x != "")
    asked = passages.select("id", words.alias("w")).withColumn("n", F.least(F.size("w"), F.lit(size))).filter("n > 0")
    sizes = sorted(r[0] for r in asked.select("n").distinct().collect())  # at most size numbers
    if not sizes:
        return asked.join(docs.select("doc_id").limit(0)).select("id", "doc_id", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("shingles"), F.lit(0.0).alias("share"))
    keys = asked.select("id", _by_size(F.col("w"), F.col("n"), sizes).alias("r"))
    keys = keys.select("id", F.size("r").cast("long").alias("shingles"), F.explode("r").alias("r")).select("id", "shingles", "r.k", "r.g")
    held = docs.select("doc_id", F.explode(_runs_of(words, sizes)).alias("r")).select("doc_id", "r.k", "r.g")
    shared = keys.join(held, ["k", "g"]).groupBy("id", "doc_id", "shingles").agg(F.count("*").alias("shared"))
    return shared.select("id", "doc_id", "shared", "shingles", (F.col("shared") / F.col("shingles")).alias("share"))


def holding(docs: DataFrame, parts: DataFrame, part: str, size: int = 3) -> DataFrame:
    """All columns of docs (doc_id, t) and parts where t contains the part; both have single spaces only.

    The part's words other than its first and last are whole words of t too, so runs of up to size of them find the
    candidates by an equality join. A part of fewer than three words has no such word and is tested against every text.
    """
    words = F.split(F.col(part), " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = parts.withColumn("_w", inner).withColumn("_k", F.least(F.size("_w"), F.lit(size)))
    sizes = sorted(r[0] for r in keyed.select("_k").distinct().collect())  # at most size + 1 numbers
    fits = F.contains("t", F.col(part))
    short = docs.join(keyed.filter("_k = 0").drop("_w", "_k"), fits)
    if not (some := [k for k in sizes if k > 0]):
        return short
    one = keyed.withColumn("g", F.xxhash64(F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " "))).withColumnRenamed("_k", "k").filter("k > 0").drop("_w")
    runs = docs.select("doc_id", F.explode(_runs_of(F.split("t", " "), some)).alias("r")).select("doc_id", "r.k", "r.g")
    pairs = runs.join(one, ["k", "g"]).drop("k", "g")
    found = docs.join(pairs, "doc_id").filter(fits)
    return found.unionByName(short) if 0 in sizes else found


def chunk_relevance(hits: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits judged against chunk labels (id, source_match, min_groups, groups): source and enough keyword groups.

    A chunk without text falls back to the hit's own excerpt.
    """
    keyed = hit_keys(hits).join(texts.select("chunk_id", F.col("text").alias("_full")), "chunk_id", "left").join(labels, "id")
    full = F.coalesce(F.nullif(F.col("_full"), F.lit("")), F.col("text_excerpt"), F.lit(""))
    src = lambda s: F.when(is_url(s), (url_key(s) == F.col("source_key")) | ((path_key(s) != "") & (path_key(s) == F.col("hit_path")))).otherwise(
        (file_key(s) == F.col("source_key")) | (file_key(s) == F.col("title_key")) | ((file_key(s) != "") & (F.contains(F.col("title_key"), file_key(s)) | F.contains(file_key(s), F.col("title_key")))))
    out = keyed.withColumn("_t", plain_text(full)).withColumn("source_match_found", F.exists("source_match", src))
    matched, missing = group_coverage(F.col("_t"), F.col("groups"))
    out = out.withColumns({"matched_groups": matched, "missing_groups": missing, "text_excerpt": F.substring(full, 1, 900)})
    relevant = F.col("source_match_found") & (F.size("matched_groups") >= F.col("min_groups"))
    reason = F.when(relevant, "relevant").when(~F.col("source_match_found"), "other source").otherwise("too few keyword groups")
    return out.withColumns({"chunk_relevant": relevant, "relevance_reason": reason}).drop("_t", "_full")


def chunk_metrics(judged: DataFrame, k: int) -> DataFrame:
    """Per (id, strategy): precision, passage recall, F1, hit and reciprocal rank at k."""
    own = judged.filter(F.col("rank") <= k).groupBy("id", "strategy")
    out = own.agg(F.count_if("chunk_relevant").alias("relevant"), F.min(F.when(F.col("chunk_relevant"), F.col("rank"))).alias("first_rank"))
    p, r = F.col("relevant") / k, F.when(F.col("relevant") > 0, 1.0).otherwise(0.0)
    return out.withColumns({"precision_at_k": p, "passage_recall_at_k": r, "f1_at_k": f1(p, r), "hit_at_k": r.cast("int"), "mrr": F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))})


def chunk_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("strategy").agg(
        F.count("*").alias("questions"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision_at_k", "passage_recall_at_k", "f1_at_k", "hit_at_k", "mrr")],
        F.sum("relevant").alias("total_relevant"))


def label_mismatches(labels: DataFrame, run: DataFrame) -> DataFrame:
    """(id, problem) of labels that the run lacks or that ask another question."""
    both = labels.select("id", "question").join(run.select("id", F.col("question").alias("_q")), "id", "left")
    return both.filter(~F.col("question").eqNullSafe(F.col("_q"))).select("id", F.when(F.col("_q").isNull(), "missing").otherwise("question differs").alias("problem"))


def summary_differences(stored: DataFrame, computed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, metric, stored, computed) of stored numbers that recomputing does not give."""
    names = [c for c in stored.columns if c not in keys]
    long = lambda d, v: d.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "metric", v)
    both = long(stored, "stored").join(long(computed, "computed"), [*keys, "metric"], "left")
    same = (F.abs(F.col("stored") - F.col("computed")) <= tolerance) | (F.col("stored").isNull() & F.col("computed").isNull())
    return both.filter(~F.coalesce(same, F.lit(False)))


def gold_violations(gold: DataFrame) -> DataFrame:
    """(rule, id) of label rows (id, question, groups, min_groups, answerability) that break a rule; expected_refusal, if there, is Yes or No."""
    rules = {
        "empty_question": F.coalesce(F.trim("question"), F.lit("")) == "",
        "untrimmed_question": F.col("question") != F.trim("question"),
        "min_groups": ~F.col("min_groups").between(1, F.size("groups")),
        "answerability": ~F.col("answerability").isin("Answerable", "OCR required"),
    }
    if "expected_refusal" in gold.columns:
        rules["yes_no"] = yes_no(F.col("expected_refusal")).isNull()
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in rules.items()]))
    found = gold.select(F.explode(broken).alias("rule"), "id")
    twice = gold.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("rule"), "id")
    return found.unionByName(twice)


def yes_no(c: Column) -> Column:
    """True for yes, false for no, in letters of either size and with spaces round them; else null."""
    said = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(said == "yes", True).when(said == "no", False)


def order_violations(gold: DataFrame, expected: DataFrame) -> DataFrame:
    """(pos, expected, found) of places at which gold (pos, id) and expected (pos, id) name different ids or one names none."""
    a, b = expected.select("pos", F.col("id").alias("expected")), gold.select("pos", F.col("id").alias("found"))
    return a.join(b, "pos", "full").filter(~F.col("expected").eqNullSafe(F.col("found")))


def set_violations(part: DataFrame, whole: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(id, problem) of rows of part that whole (unique id) lacks or has otherwise; columns maps part's names to whole's."""
    other = whole.select("id", F.lit(True).alias("_held"), *[F.col(b).alias(f"_{n}") for n, b in enumerate(columns.values())])
    both = part.select("id", *columns).join(other, "id", "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_{n}")), f"{c} differs") for n, c in enumerate(columns)]
    problems = F.when(F.col("_held").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select("id", F.explode(problems).alias("problem"))


def parse_groups(c: Column) -> Column:
    """'a|b; c' as [[a, b], [c]], trimmed, without empty parts."""
    parts = lambda x, sep: F.filter(F.transform(F.split(x, sep), lambda y: F.trim(y)), lambda y: y != "")
    return F.transform(parts(c, ";"), lambda g: parts(g, r"\|"))


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """sha256 over the ordered rows' JSON digests; only digests meet in one place, for sets of labels."""
    rows = df.select(F.struct(F.col(key), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("d")).alias("r"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["d"]), ""), 256).alias("sha256"))
