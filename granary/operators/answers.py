"""Answer records: context and prompts, citations and evidence, judge normalisation, strategy comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_CHARS = 1800
SCORES = ["groundedness_score", "citation_score", "relevance_score", "completeness_score", "clarity_score"]
LISTS = ["failure_modes", "unsupported_claims", "missing_citations", "incorrect_citations", "required_improvements"]
#: Phrases in a judge's notes that cap its scores (fixed values).
SCOPE_MARKERS = [
    "scope drift", "scope_drift", "wrong source", "wrong_source_document", "wrong document", "outside the requested document", "overbroad_answer",
]
DETAIL_MARKERS = [
    "materially incomplete", "major omission", "missing important", "missing critical", "missing core", "omits the main", "generic summary",
    "too generic", "not specific enough", "incomplete_answer", "missing_core_policy_detail",
]


def contexts(hits: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """question_id and context: numbered blocks of its hits in rank order."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] "), show("file_name"), F.lit(" | "), show("section_title"), F.lit(" | pages "), show("page_start"), F.lit("-"), show("page_end"))
    block = F.struct("rank", F.concat(head, F.lit("\n"), F.substring("text", 1, chars)).alias("b"))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))


def answer_prompts(questions: DataFrame, hits: DataFrame, system: str) -> DataFrame:
    """question_id, system and user messages; a question without hits has an empty context."""
    user = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nAnswer:"))
    return questions.join(contexts(hits), "question_id", "left").select("question_id", F.lit(system).alias("system"), user.alias("user"))


def judge_prompts(answers: DataFrame, hits: DataFrame, system: str) -> DataFrame:
    """As answer_prompts, with the answer (question_id, question, answer) to be judged."""
    user = F.concat(F.lit("Question:\n"), F.col("question"), F.lit("\n\nAnswer:\n"), F.col("answer"), F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")))
    return answers.join(contexts(hits), "question_id", "left").select("question_id", F.lit(system).alias("system"), user.alias("user"))


def _citation(hits: DataFrame, text: bool) -> list[Column]:
    """The columns of a citation, or of a row of evidence, of hits that are numbered by _n."""
    label = F.concat(F.lit("C"), F.col("_n").cast("string"))
    strategy = F.coalesce(F.nullif(F.col("source_strategy"), F.lit("")), "strategy") if "source_strategy" in hits.columns else F.col("strategy")
    document = [] if text else [F.col("doc_id").alias("document")]
    names = ["chunk_id", *["text"] * text, "file_name", "source_path", *document, "section_title", "page_start", "page_end", "score", "vector_score", "metadata_boost"]
    return [label.alias("label"), *[F.col(n) if isinstance(n, str) else n for n in names], strategy.alias("source_strategy")]


def _numbered(hits: DataFrame) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def citations(hits: DataFrame, text: bool = False) -> DataFrame:
    """One row per hit, labelled C1, C2, ... by rank; with text they are evidence rows."""
    return _numbered(hits).select("question_id", *_citation(hits, text))


def clamp_score(c: Column, default: Column | int = 1, text: Column | bool = False) -> Column:
    """An integer from 1 to 5; what is no number or integer text becomes the default.

    Numbers lose their fraction; text says that c was a JSON string, in which a fraction is no integer.
    """
    text = F.lit(text) if isinstance(text, bool) else text
    number = c.rlike(r"^[+-]?\d+\.\d+([eE][+-]?\d+)?$") & ~text
    whole = F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("int")).when(number, c.try_cast("double").try_cast("int"))
    held = F.when(whole.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), whole)))
    return F.coalesce(held, F.lit(default) if isinstance(default, int) else default)


def _is_text(raw: str, name: str) -> Column:
    """Whether the JSON field is a string."""
    field = F.try_variant_get(F.try_parse_json(F.col(raw)), f"$.{name}", "variant")
    return F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))


def _string_list(c: Column) -> Column:
    """A JSON list as strings; one value as a list of it; null and '' as empty."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.array(c))


def _marked(c: Column, markers: list[str]) -> Column:
    return c.rlike("|".join(markers))


def normalise_judges(judges: DataFrame, raw: str = "judge_json") -> DataFrame:
    """Typed judge columns from JSON text: clamped scores, defaults, lists, then calibration.

    Text that is no JSON object is a parse error: all scores 1, verdict fail, confidence low. Notes that speak of
    scope drift cap relevance, completeness and overall at 3; of lacking detail, completeness and overall. The markers
    are looked for before any cap, scope goes first, and each change is named in calibration_adjustments.
    """
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    bad = F.coalesce(F.try_parse_json(F.col(raw)).isNull() | ~F.ltrim(F.col(raw)).startswith("{"), F.lit(True))
    out = judges.withColumn("parse_error", bad).withColumns({s: clamp_score(get(s), text=_is_text(raw, s)) for s in SCORES})
    out = out.withColumn("overall_score", F.least(F.lit(5), clamp_score(get("overall_score"), F.least(*SCORES), _is_text(raw, "overall_score"))))
    by_score = F.when(F.col("overall_score") >= 4, "pass").when(F.col("overall_score") >= 3, "partial").otherwise("fail")
    out = out.withColumn("verdict", F.when(get("verdict").isin("pass", "partial", "fail"), get("verdict")).otherwise(by_score))
    confidence = F.when(bad, "low").when(get("confidence").isin("low", "medium", "high"), get("confidence")).otherwise("medium")
    out = out.withColumns({"confidence": confidence, "supported": F.coalesce(~get("supported").isin("false", "0", "", "null", "[]", "{}"), F.col("verdict") == "pass")})
    out = out.withColumns({k: _string_list(get(k)) for k in LISTS})
    out = out.withColumn("failure_modes", F.when(F.col("parse_error"), F.array(F.lit("unclear_answer"))).otherwise(F.col("failure_modes")))
    out = out.withColumn("notes", F.coalesce(get("notes"), F.lit("No judge note provided.")))
    said = F.lower(F.concat_ws(" ", "notes", "required_improvements", "failure_modes"))
    out = out.withColumns({"_scope": _marked(said, SCOPE_MARKERS) & ~F.col("parse_error"), "_detail": _marked(said, DETAIL_MARKERS) & ~F.col("parse_error")})
    out = out.withColumn("calibration_adjustments", F.array().cast("array<string>"))
    for flag, caps, name in (("_scope", ["relevance", "completeness", "overall"], "scope_drift"), ("_detail", ["completeness", "overall"], "detail_gap")):
        for cap in caps:
            over = F.col(flag) & (F.col(f"{cap}_score") > 3)
            out = out.withColumns({
                "calibration_adjustments": F.when(over, F.array_append("calibration_adjustments", F.lit(f"capped_{cap}_for_{name}"))).otherwise(F.col("calibration_adjustments")),
                f"{cap}_score": F.when(over, 3).otherwise(F.col(f"{cap}_score")),
            })
        known = ["scope_drift", "wrong_source_document"] if flag == "_scope" else ["incomplete_answer"]
        lacks = F.col(flag) & ~F.arrays_overlap("failure_modes", F.array(*map(F.lit, known)))
        out = out.withColumns({
            "failure_modes": F.when(F.coalesce(lacks, F.lit(False)), F.array_append("failure_modes", F.lit(known[0]))).otherwise(F.col("failure_modes")),
            "verdict": F.when(F.col(flag) & (F.col("verdict") == "pass"), "partial").otherwise(F.col("verdict")),
        })
    return out.drop("_scope", "_detail")


def claim_checks(judges: DataFrame, key: str, raw: str = "judge_json") -> DataFrame:
    """One row per claim check, with defaults for what it lacks."""
    kind = "array<struct<claim:string,citations_used:array<string>,support_status:string,issue:string>>"
    each = judges.select(key, F.posexplode(F.from_json(F.get_json_object(raw, "$.claim_checks"), kind)).alias("pos", "c"))
    return each.select(
        key, "pos", F.coalesce("c.claim", F.lit("")).alias("claim"), F.array_join(F.coalesce("c.citations_used", F.array().cast("array<string>")), ", ").alias("citations"),
        F.coalesce("c.support_status", F.lit("unknown")).alias("support_status"), F.coalesce("c.issue", F.lit("")).alias("issue"),
    )


def chat_records(questions: DataFrame, hits: DataFrame, answers: DataFrame, corpus_version: int, index_version: int) -> DataFrame:
    """One record per question: its answer, citations and evidence as JSON, best score, refusal and versions; hits are read once."""
    from granary.operators.retrieval import REFUSE_BELOW, says_refusal

    item = F.struct("_n", F.struct(*_citation(hits, False)).alias("c"), F.struct(*_citation(hits, True)).alias("e"))
    held = _numbered(hits).groupBy("question_id").agg(F.max("score").alias("retrieval_score"), F.array_sort(F.collect_list(item)).alias("_l"))
    json = lambda of: F.to_json(F.transform("_l", lambda x: x[of]))
    lists = held.select("question_id", "retrieval_score", json("c").alias("citations_json"), json("e").alias("evidence_json"))
    out = questions.select("question_id", "question").join(lists, "question_id", "left").join(answers, "question_id", "left")
    refused = F.coalesce(F.col("retrieval_score") < REFUSE_BELOW, F.lit(True)) | F.coalesce(says_refusal(F.col("answer")), F.lit(False))
    given = [c for c in answers.columns if c != "question_id"]
    return out.select(
        "question_id", "question", "retrieval_score", refused.alias("refused"), *given,
        F.coalesce("citations_json", F.lit("[]")).alias("citations_json"), F.coalesce("evidence_json", F.lit("[]")).alias("evidence_json"),
        F.lit(corpus_version).alias("corpus_version"), F.lit(index_version).alias("index_version"),
    )


CALLS = ("embedding", "vector_query", "generation", "judge", "total")


def with_calls(records: DataFrame, calls: DataFrame, models: dict[str, str], run_judge: bool = True) -> DataFrame:
    """chat_records with retrieved_count's companions: models, latencies and token counts of the calls behind each answer.

    calls (question_id, kind, model, duration_ms, prompt_tokens, completion_tokens, total_tokens) has a row for each call
    that was made, of a kind in CALLS; of several of one kind the longest counts. A call that was not made has null figures
    and the model that models names for its kind; without run_judge the judge has no model.
    latency_ms and models repeat them as structs.
    """
    item = F.struct("duration_ms", "model", "prompt_tokens", "completion_tokens", "total_tokens")
    wide = calls.groupBy("question_id").pivot("kind", list(CALLS)).agg(F.max(item))
    out = records.join(wide, "question_id", "left")
    model = {k: F.coalesce(F.col(f"{k}.model"), F.lit(models.get(k)).cast("string")) for k in ("embedding", "generation", "judge")}
    if not run_judge:
        model["judge"] = F.lit(None).cast("string")
    tokens = {f"{k}_{n}_tokens": F.col(f"{k}.{n}_tokens") for k in ("generation", "judge") for n in ("prompt", "completion", "total")}
    out = out.withColumns({
        **{f"{k}_model": c for k, c in model.items()}, **{f"{k}_latency_ms": F.col(f"{k}.duration_ms") for k in CALLS}, **tokens, "run_judge": F.lit(run_judge),
    })
    latency = F.struct(*[F.col(f"{k}_latency_ms").alias(k) for k in CALLS])
    return out.withColumns({"latency_ms": latency, "models": F.struct(*[F.col(f"{k}_model").alias(k) for k in model])}).drop(*CALLS)


def _first_citations(cited: DataFrame, top: int, chars: int) -> DataFrame:
    """(question_id, strategy, citations): the first rows of `citations` with text, by label, pages as one text."""
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    item = F.struct(
        F.substring("label", 2, 9).cast("int").alias("n"), "label", "file_name", "section_title", F.concat_ws("-", page("page_start"), page("page_end")).alias("pages"), "score", "vector_score",
        "metadata_boost", "source_strategy", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text"))
    # a rank first, so that no list is longer than top
    order = Window.partitionBy("question_id", "strategy").orderBy(F.substring("label", 2, 9).cast("int"))
    few = cited.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top)
    lists = few.groupBy("question_id", "strategy").agg(F.array_sort(F.collect_list(item)).alias("c"))
    return lists.select("question_id", "strategy", F.transform("c", lambda x: x.dropFields("n")).alias("citations"))


def compact_results(records: DataFrame, cited: DataFrame, top: int = 5, chars: int = 700) -> DataFrame:
    """A strategy's record (question_id, strategy, answer, judge_json, ...) with the judge's fields flat and its first citations.

    Other columns of records stay. Null and unreadable judge_json give null fields and empty failure modes.
    """
    field = lambda n: F.get_json_object("judge_json", f"$.{n}")
    score = lambda n: field(n).try_cast("double")
    judged = {f"judge_{n}": score(n) for n in ("overall_score", "groundedness_score", "citation_score", "relevance_score", "completeness_score", "clarity_score")}
    judged |= {f"judge_{n}": field(n) for n in ("verdict", "confidence", "notes")}
    modes = F.array_join(F.coalesce(F.from_json(field("failure_modes"), "array<string>"), F.array().cast("array<string>")), ", ")
    few = _first_citations(cited, top, chars)
    out = records.withColumns({**judged, "judge_failure_modes": modes}).drop("judge_json").join(few, ["question_id", "strategy"], "left")
    return out.withColumn("citations", F.coalesce("citations", F.array().cast(few.schema["citations"].dataType)))


def compare_strategies(results: DataFrame, strategies: list[str]) -> DataFrame:
    """One row per question with a struct per strategy; a strategy without a result is null."""
    item = F.struct(*[c for c in results.columns if c not in ("question_id", "strategy")])
    return results.groupBy("question_id").pivot("strategy", strategies).agg(F.first(item))


def comparison_prompts(questions: DataFrame, records: DataFrame, cited: DataFrame, strategies: list[str], instructions: str, top: int = 4) -> DataFrame:
    """(question_id, prompt): instructions and, as JSON, the question with each strategy's answer, score, judge and citations."""
    held = records.join(_first_citations(cited, top, 700), ["question_id", "strategy"], "left")
    item = F.struct("answer", "retrieval_score", F.try_parse_json("judge_json").alias("judge"), "citations")
    each = held.filter(F.col("strategy").isin(*strategies)).groupBy("question_id").pivot("strategy", strategies).agg(F.first(item))
    payload = F.to_json(F.struct("question", F.struct(*[f"`{s}`" for s in strategies]).alias("strategies")))
    return questions.select("question_id", "question").join(each, "question_id").select("question_id", F.concat(F.lit(f"{instructions}\n\nData:\n"), payload).alias("prompt"))


def distinct_questions(rows: DataFrame) -> DataFrame:
    """(question, pos): single spaces, first of each regardless of case, empty ones left out."""
    plain = rows.select(F.trim(F.regexp_replace("question", r"(?U)\s+", " ")).alias("question"), "pos").filter("question <> ''")
    return plain.groupBy(F.lower("question").alias("_l")).agg(F.min(F.struct("pos", "question")).alias("m")).select("m.question", "m.pos")
