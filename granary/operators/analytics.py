"""Sessions, history, metrics and insight mining over chat logs, audits and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUES = ("refused", "low_llm", "low_human", "missing_document")
AUDIT_SCORES = ["groundedness_score", "citation_score", "relevance_score", "completeness_score", "clarity_score"]
TAGS_OF_GAPS = ("wrong_document", "missing_detail", "unnecessary_refusal", "citation_mismatch")
#: Review gate defaults.
GATE = {"enabled": False, "interval": 5, "threshold": 3, "max_per_session": 1, "cooldown_minutes": 10}


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def chat_title(question: Column) -> Column:
    c = flat(question)
    return F.when(c == "", "New chat").when(F.length(c) > 80, F.concat(F.rtrim(F.substring(c, 1, 77)), F.lit("..."))).otherwise(c)


def preview(answer: Column, limit: int = 180) -> Column:
    c = flat(answer)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("...")))


def backfill_sessions(logs: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs, new sessions): each log without a known session gets one of its own, numbered last + log id."""
    known = logs.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    lost = logs.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    last = sessions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = lost.withColumn("session_id", (F.col("id") + last).cast("long"))
    new = numbered.select(F.col("session_id").alias("id"), "user_id", chat_title(F.col("question")).alias("title"), "created_at", F.col("created_at").alias("updated_at"))
    return known.unionByName(numbered.select(*known.columns)), new


def history(sessions: DataFrame, logs: DataFrame, limit: int = 30) -> DataFrame:
    """Each user's latest sessions with messages, with their number and the latest question."""
    of = logs.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max_by("question", "id").alias("latest_question"))
    joined = sessions.join(of, sessions["id"] == of["session_id"]).drop("session_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("id")))
    return joined.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def session_detail(logs: DataFrame, session_id: int, user_id: int) -> DataFrame:
    """A user's logs of one session in order, JSON texts decoded."""
    own = logs.filter((F.col("session_id") == session_id) & (F.col("user_id") == user_id))
    cited = F.from_json("citations_json", "array<struct<label:string,file_name:string,chunk_id:string>>")
    return own.withColumn("citations", F.coalesce(cited, F.array().cast(cited_type()))).drop("citations_json").orderBy("id")


def cited_type() -> str:
    return "array<struct<label:string,file_name:string,chunk_id:string>>"


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, column: str) -> dict[str, DataFrame]:
    """chat_sessions, chat_logs and what hangs on them, without the sessions or users in keys (column)."""
    out = dict(tables)
    logs = tables["chat_logs"]
    gone = logs.join(keys, column, "left_semi").select(F.col("id").alias("chat_log_id"))
    out["chat_logs"] = logs.join(keys, column, "left_anti")
    session_key = keys.withColumnRenamed(column, "id") if column == "session_id" else keys
    out["chat_sessions"] = tables["chat_sessions"].join(session_key, "id" if column == "session_id" else column, "left_anti")
    for name in ("feedback", "human_audits", "citation_events"):
        if name in tables:
            out[name] = tables[name].join(gone, "chat_log_id", "left_anti")
    return out


def split_valid(rows: DataFrame, *rules: Column) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows; a rule that is null rejects."""
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.coalesce(r, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def valid_feedback(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_valid(rows, F.col("rating").isNull() | F.col("rating").between(1, 5))


def valid_survey(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    scores = [F.col(c).between(1, 5) for c in ("ease_score", "helpfulness_score", "trustworthiness_score")]
    return split_valid(rows, *scores, F.col("citations_useful").isin("yes", "somewhat", "no"), F.col("would_use_at_work").isin("yes", "maybe", "no"))


def valid_audits(rows: DataFrame, tags: list[str]) -> tuple[DataFrame, DataFrame]:
    """Audits whose scores and choices are allowed; unknown tags are cut from the good ones."""
    good, bad = split_valid(
        rows, *[F.col(c).between(1, 5) for c in AUDIT_SCORES],
        F.col("overall_verdict").isin("pass", "partial", "fail", "unable_to_judge"), F.col("reviewer_confidence").isin("low", "medium", "high"),
    )
    return good.withColumn("issue_tags", F.array_intersect("issue_tags", F.array(*map(F.lit, tags)))), bad


def upsert_audits(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest audit of each (user, chat log); created_at is that of the first."""
    keys = ["user_id", "chat_log_id"]
    both = old.unionByName(new)
    w = Window.partitionBy(*keys)
    return both.withColumns({
        "created_at": F.min("created_at").over(w),
        "_r": F.row_number().over(w.orderBy(F.desc("updated_at"), F.desc("id"))),
    }).filter("_r = 1").drop("_r")


def metrics(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count("*").alias("total_chats"), F.count_distinct("user_id").alias("users"), F.avg("retrieval_score").alias("avg_retrieval_score"),
        F.count_if("refused").alias("refusals"), F.count_if("human_audit_prompted").alias("prompts"),
    )


def audit_metrics(audits: DataFrame) -> DataFrame:
    verdicts = [F.count_if(F.col("overall_verdict") == v).alias(f"n_{v}") for v in ("pass", "partial", "fail", "unable_to_judge")]
    return audits.agg(F.count("*").alias("audits"), F.avg(human_average()).alias("avg_human"), F.avg("llm_overall_score").alias("avg_llm"), *verdicts)


def human_average() -> Column:
    out = F.lit(0.0)
    for c in AUDIT_SCORES:
        out = out + F.col(c)
    return out / 5.0


def categorise(question: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule with a term in the lower-cased question, as plain substring; else Other. Order decides."""
    q, out = F.lower(F.coalesce(question, F.lit(""))), F.lit("Other")
    for label, terms in reversed(rules):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(q, F.lit(t))
        out = F.when(hit, label).otherwise(out)
    return out


def judge_score(raw: Column) -> Column:
    return F.get_json_object(raw, "$.overall_score").try_cast("int")


def has_no_citations(raw: Column) -> Column:
    """True for null, unreadable and empty lists alike."""
    return F.coalesce(F.size(F.from_json(raw, "array<string>")) <= 0, F.lit(True))


def active_resolutions(resolutions: DataFrame) -> DataFrame:
    return resolutions.filter(F.col("active") & F.col("issue_type").isin(*ISSUES))


def resolver_rows(resolutions: DataFrame, users: DataFrame) -> DataFrame:
    """Resolutions with resolved_by_email; one whose user (id, email) is gone does not count."""
    known = users.select(F.col("id").alias("resolved_by"), F.col("email").alias("resolved_by_email"))
    return resolutions.join(known, "resolved_by")


def overlay(items: DataFrame, resolutions: DataFrame, issue_type: str, key: str, include_resolved: bool = False) -> DataFrame:
    """items with issue_type, item_key, resolved, resolved_at, resolved_by_email and resolution_note; resolved ones only if asked for.

    Resolutions without the columns at and resolved_by_email give nulls. Of several for one key the latest counts.
    """
    have = lambda c, kind: F.col(c) if c in resolutions.columns else F.lit(None).cast(kind)
    at = F.struct(have("at", "timestamp").alias("at"), have("resolved_by_email", "string").alias("by"), have("note", "string").alias("note"))
    own = active_resolutions(resolutions).filter(F.col("issue_type") == issue_type).groupBy(F.col("item_key").alias("_k")).agg(F.max(at).alias("_r"))
    text = items[key].cast("string")
    out = items.join(own, text == own["_k"], "left").withColumns({
        "issue_type": F.lit(issue_type), "item_key": text, "resolved": F.col("_k").isNotNull(), "resolved_at": F.col("_r.at"), "resolved_by_email": F.col("_r.by"), "resolution_note": F.col("_r.note"),
    }).drop("_k", "_r")
    return out if include_resolved else out.filter(~F.col("resolved"))


def enrich(logs: DataFrame, resolutions: DataFrame, rules: list[tuple[str, list[str]]], include_resolved: bool = False) -> DataFrame:
    """Logs with category, llm_score, and which issues are active."""
    out = logs.withColumns({"category": categorise(F.col("question"), rules), "llm_score": judge_score(F.col("judge_json")), "no_citations": has_no_citations(F.col("citations_json"))})
    for issue, holds in (("refused", F.col("refused")), ("low_llm", F.col("llm_score") <= 3)):
        done = active_resolutions(resolutions).filter(F.col("issue_type") == issue).select(F.col("item_key").alias(f"_{issue}")).distinct()
        out = out.join(done, F.col("id").cast("string") == F.col(f"_{issue}"), "left")
        out = out.withColumn(f"{issue}_active", F.coalesce(holds, F.lit(False)) & (F.lit(include_resolved) | F.col(f"_{issue}").isNull())).drop(f"_{issue}")
    return out


def enrich_audits(audits: DataFrame, logs: DataFrame, resolutions: DataFrame, rules: list[tuple[str, list[str]]], include_resolved: bool = False) -> DataFrame:
    """Audits with their log's question and category, human_average and low_human_active."""
    asked = logs.select(F.col("id").alias("chat_log_id"), "question", "answer", categorise(F.col("question"), rules).alias("category"))
    out = audits.join(asked, "chat_log_id").withColumn("human_average", human_average())
    done = active_resolutions(resolutions).filter("issue_type = 'low_human'").select(F.col("item_key").alias("_d")).distinct()
    out = out.join(done, F.col("id").cast("string") == F.col("_d"), "left")
    needs = (F.col("human_average") < 4) | F.col("overall_verdict").isin("partial", "fail", "unable_to_judge")
    return out.withColumn("low_human_active", needs & (F.lit(include_resolved) | F.col("_d").isNull())).drop("_d")


def category_stats(enriched: DataFrame, audits: DataFrame) -> DataFrame:
    """Per category: logs, refusals, low scores of both kinds, average scores to two places."""
    a = enriched.groupBy("category").agg(
        F.count("*").alias("total"), F.count_if("refused_active").alias("refusals"), F.count_if("low_llm_active").alias("low_llm"), F.round(F.avg("llm_score"), 2).alias("avg_llm_score"))
    b = audits.groupBy("category").agg(F.count_if("low_human_active").alias("low_human"), F.round(F.avg("human_average"), 2).alias("avg_human_score"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "category", "full").select("category", zero("total"), zero("refusals"), zero("low_llm"), zero("low_human"), "avg_llm_score", "avg_human_score")


def top_categories(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("total"), "category").limit(n)


def refused_queue(enriched: DataFrame, n: int = 12) -> DataFrame:
    return enriched.filter("refused_active").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def low_llm_queue(enriched: DataFrame, n: int = 12) -> DataFrame:
    """Lowest score first, with 0 after all others."""
    return enriched.filter("low_llm_active").orderBy(F.when(F.col("llm_score") == 0, 99).otherwise(F.col("llm_score")), "created_at", F.desc("id")).limit(n)


def low_human_queue(audits: DataFrame, n: int = 12) -> DataFrame:
    return audits.filter("low_human_active").orderBy(F.round("human_average", 2), "updated_at", F.desc("id")).limit(n)


def corpus_gaps(enriched: DataFrame, audits: DataFrame, stats: DataFrame, resolutions: DataFrame, include_resolved: bool = False, n: int = 10) -> DataFrame:
    """Categories with most warnings: count, rate to logs (3 places), first question, signals, suggested action.

    A log warns once whatever its signals, newest first; a low audit with a gap tag warns too, after all logs.
    """
    signals = F.array_compact(F.array(
        F.when(F.col("refused_active"), "refused"), F.when(F.col("low_llm_active"), "low LLM judge score"), F.when(F.col("no_citations"), "no citations")))
    order = lambda kind, at: F.struct(F.lit(kind).alias("k"), (-F.unix_micros(at)).alias("t"), (-F.col("id")).alias("i")).alias("o")
    a = enriched.select("category", "question", order(0, F.col("created_at")), signals.alias("s")).filter(F.size("s") > 0)
    tags = F.transform("issue_tags", lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    gap = F.col("low_human_active") & F.arrays_overlap("issue_tags", F.array(*map(F.lit, TAGS_OF_GAPS)))
    b = audits.filter(gap).select("category", "question", order(1, F.col("updated_at")), tags.alias("s"))
    both = a.unionByName(b)
    found = both.groupBy("category").agg(
        F.count("*").alias("count"), F.min_by("question", "o").alias("representative_question"), F.min("o").alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("signals"))
    out = overlay(found, resolutions, "missing_document", "category", include_resolved).join(stats.select("category", F.col("total").alias("category_total")), "category", "left")
    out = out.withColumn("warning_rate", F.when(F.col("category_total") > 0, F.round(F.col("count") / F.col("category_total"), 3)))
    return suggest_action(out).orderBy(F.desc("count"), "first").limit(n).drop("first")


def with_judge_snapshot(audits: DataFrame, logs: DataFrame) -> DataFrame:
    """audits with llm_overall_score, the judge's overall score of the audited log; null where there is none."""
    score = F.get_json_object("judge_json", "$.overall_score").try_cast("int")
    return audits.join(logs.select(F.col("id").alias("chat_log_id"), score.alias("llm_overall_score")), "chat_log_id", "left")


def suggest_action(gaps: DataFrame, boundary: dict[str, str] | None = None, private: tuple[str, ...] = (), sources: tuple[str, ...] = ()) -> DataFrame:
    """action_type and suggested_action by the first rule that holds.

    boundary names the action of categories that are refused rightly; private holds phrases of questions, sources words of
    categories (in small letters). The two lists and the boundary are a deployment's.
    """
    has = lambda s: F.array_contains("signals", s)
    asked = F.lower(F.coalesce("representative_question", F.lit("")))
    any_of = lambda c, xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(c, x)) if xs else F.lit(False)
    low = F.exists("signals", lambda s: F.lower(s) == "low llm judge score")
    rules = [
        *[(F.col("category") == c, "correct_refusal", action) for c, action in (boundary or {}).items()],
        (any_of(asked, private), "correct_refusal", "Correct refusal"),
        (has("wrong document") | has("citation mismatch"), "retrieval_review", "Check retrieval/citations"),
        (has("unnecessary refusal"), "retrieval_review", "Reduce false refusal"),
        (has("missing detail"), "answer_review", "Improve answer detail"),
        (has("refused") & low, "corpus_gap", "Check corpus coverage"),
        (has("refused"), "corpus_gap", "Check source coverage"),
        (low, "judge_review", "Review answer/judge score"),
        (any_of(F.lower("category"), sources), "corpus_gap", "Verify source coverage"),
    ]
    picked = F.coalesce(*[F.when(when, F.struct(F.lit(kind).alias("k"), F.lit(action).alias("a"))) for when, kind, action in rules],
                        F.struct(F.lit("answer_review").alias("k"), F.lit("Review flagged pattern").alias("a")))
    return gaps.withColumn("_a", picked).withColumns({"action_type": F.col("_a.k"), "suggested_action": F.col("_a.a")}).drop("_a")


def resolve(resolutions: DataFrame, events: DataFrame) -> DataFrame:
    """Resolutions after events (issue_type, item_key, note, active, at): the latest of each key; an unresolve of an unknown key does nothing."""
    keys = ["issue_type", "item_key"]
    last = events.groupBy(*keys).agg(F.max_by(F.struct("note", "active", "at"), "at").alias("e"), F.max("active").alias("_some"))
    old = resolutions.select(*keys, F.struct("note", "active", "at").alias("old"))
    both = old.join(last, keys, "full").filter(F.col("old").isNotNull() | F.col("_some"))
    return both.select(*keys, F.coalesce("e", "old").alias("r")).select(*keys, "r.note", "r.active", "r.at")


def resolved_counts(resolutions: DataFrame) -> DataFrame:
    """One row with a count for each issue type."""
    own = active_resolutions(resolutions)
    return own.agg(*[F.count_if(F.col("issue_type") == t).alias(t) for t in ISSUES])


def category_shares(stats: DataFrame) -> DataFrame:
    """warning_percent of a category's logs, at most 100, and volume_percent of the largest category, at least 6."""
    warnings = F.col("refusals") + F.col("low_llm") + F.col("low_human")
    top = stats.agg(F.max("total").alias("m")).scalar()
    return stats.withColumns({
        "warning_percent": F.when(F.col("total") > 0, F.least(F.lit(100.0), 100.0 * warnings / F.col("total"))).otherwise(0.0),
        "volume_percent": F.when(top > 0, F.greatest(F.lit(6.0), 100.0 * F.col("total") / top)).otherwise(6.0),
    })


def quality_band(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 4, "strong").when(score >= 3, "okay").otherwise("low")


def score_percent(score: Column) -> Column:
    """A score as a whole percentage from 0 to 100; N/A without one."""
    whole = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100 + 0.5)
    return F.when(score.isNull(), "N/A").otherwise(F.concat(whole.cast("string"), F.lit("%")))


def boost_points(boost: Column) -> Column:
    """A boost in points, negative ones as none; N/A without one."""
    whole = F.floor(F.greatest(F.lit(0.0), boost) * 100 + 0.5)
    return F.when(boost.isNull(), "N/A").otherwise(F.concat(F.lit("+"), whole.cast("string"), F.lit(" pts")))


def settings_merged(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Stored settings (key, value, updated_at), latest of each key, and defaults of keys not stored."""
    last = stored.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))
    return last.unionByName(defaults.join(last, "key", "left_anti"))


def settings_typed(settings: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row, a typed column for each key."""
    return settings.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).try_cast(t).alias(k.replace(".", "_")) for k, t in kinds.items()])


def touched_sessions(sessions: DataFrame, logs: DataFrame) -> DataFrame:
    """Sessions with updated_at moved to their latest log."""
    last = logs.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("_t"))
    return sessions.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_t")).drop("_t")


def relabelled_sessions(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """Sessions (id, title, updated_at) with the title of their latest label (session_id, title, at), which also moves updated_at.

    Of labels at one time the greatest title counts; labels of unknown sessions do nothing.
    """
    last = labels.groupBy(F.col("session_id").alias("id")).agg(F.max(F.struct("at", "title")).alias("_l"))
    out = sessions.join(last, "id", "left")
    return out.withColumns({"title": F.coalesce("_l.title", "title"), "updated_at": F.greatest("updated_at", "_l.at")}).drop("_l")


def own_rows(rows: DataFrame, user: int, sees_all: bool = False) -> DataFrame:
    """The rows that a user may read: their own, or all; rows of nobody (null) are read by those who see all."""
    return rows if sees_all else rows.filter(F.col("user_id") == user)


def preferred_user(users: DataFrame, emails: list[str]) -> DataFrame:
    """The first of the emails that exists."""
    place = F.array_position(F.array(*map(F.lit, emails)), F.col("email"))
    return users.withColumn("_p", place).filter("_p > 0").orderBy("_p", "id").limit(1).drop("_p")


def insight_payload(stats: DataFrame, refused: DataFrame, low_llm: DataFrame, low_human: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of JSON lists, each cut to what a summary prompt can carry; the frames are reports of at most 12 rows."""
    parts = [("categories", stats, 10), ("refused", refused, 8), ("low_llm", low_llm, 8), ("low_human", low_human, 8), ("gaps", gaps, 10)]
    cols = [d.limit(n).agg(F.to_json(F.collect_list(F.struct("*"))).alias(k)).scalar().alias(k) for k, d, n in parts]
    return stats.sparkSession.range(1).select(*cols)
