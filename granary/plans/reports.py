"""Registered queries of chat records, strategy comparisons, actions, labels and evaluation files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import analytics as A
from granary.operators import answers as G
from granary.operators import evaluation as E
from granary.operators import retrieval as R
from granary.plans.queries import VECTORS, query, t, vectors
from granary.sources import tables as S

STRATEGIES = ("fixed_size", "structure_aware")

# --- chat records and strategy comparisons --------------------------------------------------------------------

RANKED = f"""{VECTORS}, r as (select *, row_number() over (partition by question_id, strategy order by score desc, distance, chunk_id) as rank from scored where vector_rank <= 20),
best as (select question_id, strategy, max(score) as retrieval_score, count(*) as retrieved_count from r where rank <= 5 group by all)"""


def strategy_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, a record of each question and strategy with a judge by number, and the evidence of each."""
    q, v, c = vectors(spark, d)
    hits = R.retrieve(q, v, c, 5)
    k = F.col("question_id")
    judge = F.to_json(F.struct(
        (k / 100 % 5 + 1).cast("int").alias("overall_score"), (k / 100 % 4 + 1).cast("int").alias("clarity_score"), F.when(k % 200 == 0, "pass").otherwise("fail").alias("verdict"),
        F.array(F.lit("scope_drift"), F.lit("weak_citation")).alias("failure_modes"), F.lit("n").alias("notes")))
    best = hits.groupBy("question_id", "strategy").agg(F.max("score").alias("retrieval_score"), F.count("*").alias("retrieved_count"))
    records = best.withColumns({"answer": F.concat(F.lit("a"), k.cast("string"), F.lit(" "), F.col("strategy")), "judge_json": F.when(k % 300 != 0, judge)})
    cited = [G.citations(hits.filter(F.col("strategy") == s), True).withColumn("strategy", F.lit(s)) for s in STRATEGIES]
    return q, records, cited[0].unionByName(cited[1])


@query(f"""with {RANKED} select best.question_id, best.strategy, 'a' || best.question_id || ' ' || best.strategy as answer, round(retrieval_score, 9) as retrieval_score, retrieved_count,
 case when best.question_id % 300 <> 0 then (best.question_id // 100 % 5 + 1)::double end as judge_overall_score, case when best.question_id % 300 <> 0 then (best.question_id // 100 % 4 + 1)::double end as judge_clarity_score,
 case when best.question_id % 300 <> 0 then case when best.question_id % 200 = 0 then 'pass' else 'fail' end end as judge_verdict, case when best.question_id % 300 <> 0 then 'scope_drift, weak_citation' else '' end as judge_failure_modes,
 string_agg('C' || rank || '|Policy Guide ' || cl || '.pdf|' || case when chunk_id % 3 = 0 then 'Scope and Purpose' else 'Fees' end || '|' || chunk_id % 9 || '-' || chunk_id % 9 + 1 || '|' || left('Chunk  text ' || chunk_id % 50, 8), ';' order by rank) as cited,
 round(sum(score), 8) as score_sum from best join r using (question_id, strategy) where rank <= 3 group by all""")
def compact_results(spark: SparkSession, d: str) -> DataFrame:
    _, records, cited = strategy_records(spark, d)
    out = G.compact_results(records, cited, 3, 8)
    text = F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["label"], c["file_name"], c["section_title"], c["pages"], c["text"])), ";")
    total = F.aggregate("citations", F.lit(0.0), lambda s, c: s + c["score"])
    names = ["question_id", "strategy", "answer", "retrieved_count", "judge_overall_score", "judge_clarity_score", "judge_verdict", "judge_failure_modes"]
    return out.select(*names, F.round("retrieval_score", 9).alias("retrieval_score"), text.alias("cited"), F.round(total, 8).alias("score_sum"))


@query(f"""with {RANKED} select f.question_id, 'a' || f.question_id || ' fixed_size' as fixed_answer, 'a' || f.question_id || ' structure_aware' as structure_answer, case when f.question_id % 300 <> 0 then case when f.question_id % 200 = 0 then 'pass' else 'fail' end end as verdict,
 max(f.chunk_id) filter (f.rank = 1) as first_chunk, 4::bigint as n_citations from r f where f.strategy = 'fixed_size' and f.rank <= 5 group by all""")
def strategy_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the prompts and of the wide rows that compare the strategies of a question."""
    q, records, cited = strategy_records(spark, d)
    prompts = G.comparison_prompts(q, records, cited, list(STRATEGIES), "Compare the answers.")
    payload = lambda path: F.get_json_object(F.substring_index("prompt", "Data:\n", -1), f"$.strategies.{path}")
    wide = G.compare_strategies(G.compact_results(records, cited).withColumn("first", F.col("retrieved_count")), list(STRATEGIES))
    first = cited.filter("strategy = 'fixed_size' and label = 'C1'").select("question_id", F.col("chunk_id").alias("first_chunk"))
    both = prompts.join(wide, "question_id").join(first, "question_id")
    return both.select(
        "question_id", payload("fixed_size.answer").alias("fixed_answer"), F.col("structure_aware.answer").alias("structure_answer"), payload("structure_aware.judge.verdict").alias("verdict"), "first_chunk",
        F.size(F.from_json(payload("fixed_size.citations"), "array<string>")).cast("long").alias("n_citations"))


@query(f"""with {RANKED}, w as (select question_id, max(retrieval_score) as retrieval_score from best group by all) select question_id, round(retrieval_score, 9) as retrieval_score, retrieval_score < 0.9 as refused,
 'embed-1' as embedding_model, case when retrieval_score >= 0.9 and question_id % 200 = 0 then 'gen-2' else 'gen-1' end as generation_model, 'judge-1' as judge_model, (question_id % 700 + 1)::double as embedding_latency_ms,
 case when retrieval_score >= 0.9 then (question_id % 900 + 50)::double end as generation_latency_ms, case when retrieval_score >= 0.9 then (question_id % 50 + 7)::bigint end as generation_total_tokens, null::bigint as judge_total_tokens,
 (question_id % 700 + 1)::double as total_latency_ms from w""")
def call_records(spark: SparkSession, d: str) -> DataFrame:
    """Chat records with the models, latencies and tokens of their calls; refused questions have no generation."""
    q, v, c = vectors(spark, d)
    hits = R.retrieve(q, v, c, 5)
    base = R.refusals(q, hits, 0.9).withColumnRenamed("best_score", "retrieval_score")
    k, none = F.col("question_id"), F.lit(None).cast("long")

    def calls(rows: DataFrame, kind: str, model, ms, tokens) -> DataFrame:
        return rows.select("question_id", F.lit(kind).alias("kind"), model.alias("model"), ms.cast("double").alias("duration_ms"), none.alias("prompt_tokens"), none.alias("completion_tokens"), tokens.cast("long").alias("total_tokens"))

    made = calls(base, "embedding", F.lit("embed-1"), k % 700 + 1, none).unionByName(calls(base, "total", F.lit(None).cast("string"), k % 700 + 1, none))
    made = made.unionByName(calls(base.filter(~F.col("refused")), "generation", F.when(k % 200 == 0, "gen-2"), k % 900 + 50, k % 50 + 7))
    out = G.with_calls(base, made, {"embedding": "embed-0", "generation": "gen-1", "judge": "judge-1"})
    return out.select(
        "question_id", F.round("retrieval_score", 9).alias("retrieval_score"), "refused", "models.embedding", "models.generation", "models.judge", "latency_ms.total", "embedding_latency_ms", "generation_latency_ms",
        "generation_total_tokens", "judge_total_tokens",
    ).withColumnsRenamed({"embedding": "embedding_model", "generation": "generation_model", "judge": "judge_model", "total": "total_latency_ms"})


# --- actions, resolutions, labels of scores, sessions ---------------------------------------------------------

_SIGNALS = ("refused", "low LLM judge score", "wrong document", "unnecessary refusal", "missing detail", "no citations")


@query("""with s as (select doc_id, source, lower(coalesce(text, '')) as asked, doc_id // 1 % 64 as bits from documents),
b as (select *, bits & 1 > 0 as refused, bits & 2 > 0 as low, bits & 4 > 0 as wrong, bits & 8 > 0 as unneeded, bits & 16 > 0 as lacks from s)
select doc_id, case when doc_id % 50 = 0 then 'correct_refusal' when contains(asked, 'zu') then 'correct_refusal' when wrong or unneeded then 'retrieval_review' when lacks then 'answer_review' when refused then 'corpus_gap' when low then 'judge_review'
 when doc_id % 9 = 0 then 'corpus_gap' else 'answer_review' end as action_type,
 case when doc_id % 50 = 0 then 'Review the boundary' when contains(asked, 'zu') then 'Correct refusal' when wrong then 'Check retrieval/citations' when unneeded then 'Reduce false refusal' when lacks then 'Improve answer detail'
 when refused and low then 'Check corpus coverage' when refused then 'Check source coverage' when low then 'Review answer/judge score' when doc_id % 9 = 0 then 'Verify source coverage' else 'Review flagged pattern' end as suggested_action from b""")
def suggested_actions(spark: SparkSession, d: str) -> DataFrame:
    """The action of every document's text as a question, with signals by the bits of its number."""
    k = F.col("doc_id")
    category = F.when(k % 50 == 0, "Boundary").when(k % 9 == 0, "Contact Details").otherwise("Fees")
    signals = F.array_compact(F.array(*[F.when(F.getbit(k, F.lit(n)) == 1, s) for n, s in enumerate(_SIGNALS)]))
    rows = t(spark, d, "documents").select("doc_id", category.alias("category"), F.col("text").alias("representative_question"), signals.alias("signals"))
    return A.suggest_action(rows, {"Boundary": "Review the boundary"}, ("zu",), ("contact details",)).select("doc_id", "action_type", "suggested_action")


@query("""with res as (select c_custkey * 3 as item, c_custkey % 7 as note, n_name as email, c_custkey as done_at from customer join nation on n_nationkey = c_custkey % 30 where c_custkey % 5 <> 0)
select o_orderkey, item is not null as resolved, done_at as resolved_at, email as resolved_by_email, note::varchar as resolution_note from orders left join res on o_orderkey = item""")
def resolved_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items with their resolutions; those by users that do not exist do not count."""
    users = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("email"))
    k = F.col("c_custkey")
    made = t(spark, d, "customer").select(
        F.lit("refused").alias("issue_type"), (k * 3).cast("string").alias("item_key"), (k % 7).cast("string").alias("note"), k.alias("at"), (k % 5 != 0).alias("active"), (k % 30).alias("resolved_by"))
    out = A.overlay(t(spark, d, "orders").select("o_orderkey"), A.resolver_rows(made, users), "refused", "o_orderkey", True)
    return out.select("o_orderkey", "resolved", "resolved_at", "resolved_by_email", "resolution_note")


@query("""select vec_id, case when x is null then 'N/A' else floor(greatest(0, least(1, x)) * 100 + 0.5)::bigint || '%' end as percent, case when x is null then 'N/A' else '+' || floor(greatest(0, x) * 100 + 0.5)::bigint || ' pts' end as points
 from (select vec_id, case when vec_id % 17 = 0 then null else embedding[1]::double end as x from embeddings)""")
def score_labels(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("vec_id") % 17 != 0, F.col("embedding")[0].cast("double"))
    return t(spark, d, "embeddings").select("vec_id", A.score_percent(score).alias("percent"), A.boost_points(score).alias("points"))


@query("""with l as (select o_custkey as id, arg_max(o_orderkey, (o_orderdate::date, o_orderkey::varchar)) as label, max(o_orderdate::date) as last_at from orders group by 1)
select c_custkey as id, coalesce('run ' || label, c_name) as title, greatest(date '1995-01-01', last_at) as updated_at from customer left join l on l.id = c_custkey where c_nationkey = 7""")
def relabelled_sessions(spark: SparkSession, d: str) -> DataFrame:
    """One owner's sessions (customers) under the titles of their latest labels (orders)."""
    sessions = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.to_date(F.lit("1995-01-01")).alias("updated_at"), F.col("c_nationkey").alias("user_id"))
    labels = t(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.concat(F.lit("run "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderdate").cast("date").alias("at"))
    return A.own_rows(A.relabelled_sessions(sessions, labels), 7).select("id", "title", "updated_at")


# --- labels and evaluation files ------------------------------------------------------------------------------


@query("""with g as (select item_id, text, item_id % 6 as k from benchmark), n as (select item_id + 1 as pos, 'EQ' || lpad((item_id + 1)::varchar, 5, '0') as id, item_id % 10 = 0 as off from g)
select 'order' as rule, pos::varchar as id from n where off union all select case when k = 0 then 'missing' else 'text differs' end, item_id::varchar from g where k in (0, 1) union all select 'yes_no', item_id::varchar from g where item_id % 7 = 0""")
def label_rules(spark: SparkSession, d: str) -> DataFrame:
    """Order of ids, Yes and No, and equality with another label set, over the benchmark."""
    b, k = t(spark, d, "benchmark"), F.col("item_id")
    named = F.concat(F.lit("EQ"), F.lpad((k + 1).cast("string"), 5, "0"))
    expected = b.select((k + 1).alias("pos"), named.alias("id"))
    order = E.order_violations(b.select((k + 1).alias("pos"), F.when(k % 10 != 0, named).otherwise("EQx").alias("id")), expected)
    part = b.select(k.alias("id"), "text")
    whole = b.filter(k % 6 != 0).select(k.alias("id"), F.when(k % 6 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("question"))
    gold = b.select(k.alias("id"), F.lit("q").alias("question"), E.parse_groups(F.lit("a")).alias("groups"), F.lit(1).alias("min_groups"), F.lit("Answerable").alias("answerability"),
                    F.when(k % 7 == 0, "maybe").when(k % 2 == 0, " YES ").otherwise("No").alias("expected_refusal"))
    text = lambda df, rule, id_: df.select(rule.alias("rule"), F.col(id_).cast("string").alias("id"))
    sets = E.set_violations(part, whole, {"text": "question"})
    return text(order, F.lit("order"), "pos").unionByName(text(sets, F.col("problem"), "id")).unionByName(text(E.gold_violations(gold), F.col("rule"), "id"))


_TURNS = "select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id, coalesce(role, '') order by coalesce(turn, -1), coalesce(text, '')) as rank from conversations"


def saved_evaluation(spark: SparkSession, d: str) -> S.EvaluationFile:
    """Conversations written as records by role, some of them broken, and read back."""
    k = F.col("conv_id")
    turn = F.struct(F.coalesce("turn", F.lit(-1)).alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    runs = t(spark, d, "conversations").groupBy("conv_id", F.coalesce("role", F.lit("")).alias("strategy")).agg(F.array_sort(F.collect_list(turn)).alias("h"))
    run = F.struct(F.when(k % 10 != 3, F.transform("h", lambda h: F.struct(h["text"]))).alias("hits"), F.size("h").alias("n"))
    whole = runs.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("strategy", run))).alias("s"))
    id_ = F.when(k % 10 != 4, F.when(k % 10 == 5, k - 3).otherwise(k).cast("string"))
    record = F.to_json(F.struct(id_.alias("id"), F.when(k % 10 != 6, F.col("s")).alias("strategies")))
    path = f"{S._shared_folder(spark)}/evaluation-{uuid.uuid4().hex}"
    whole.select(F.when(k % 10 == 7, F.concat(record, F.lit("]"))).when(k % 10 == 8, F.lit('["list"]')).otherwise(record).alias("value")).write.text(path)
    return S.read_evaluation(spark, path, lines=True)


# the record of a conversation ending in 5 goes under the number of the one ending in 2, if that one is not there
_GOOD = "conv_id % 10 in (0, 1, 9) or (conv_id % 10 = 2 and conv_id + 3 not in (select conv_id from conversations)) or (conv_id % 10 = 5 and conv_id - 3 not in (select conv_id from conversations))"


@query(f"with h as ({_TURNS}) select case when conv_id % 10 = 5 then conv_id - 3 else conv_id end::varchar as id, role as strategy, rank, text from h where {_GOOD}")
def evaluation_hits(spark: SparkSession, d: str) -> DataFrame:
    return saved_evaluation(spark, d).hits.select("id", "strategy", F.col("rank").cast("long").alias("rank"), F.variant_get("hit", "$.text", "string").alias("text"))


@query("""with c as (select distinct conv_id, conv_id % 10 as k from conversations), r as (select distinct conv_id, coalesce(role, '') as role from conversations)
select case when k in (4, 7, 8) then null when k = 5 then conv_id - 3 else conv_id end::varchar as id, case when k = 4 then 'no id' when k = 6 then 'no strategies' when k = 7 then 'unreadable' when k = 8 then 'not an object' else 'double id' end as problem
 from c where k in (4, 6, 7, 8) or (k = 2 and conv_id + 3 in (select conv_id from c)) or (k = 5 and conv_id - 3 in (select conv_id from c))
union all select conv_id::varchar, 'no hits list: ' || role from r where conv_id % 10 = 3""")
def evaluation_problems(spark: SparkSession, d: str) -> DataFrame:
    return saved_evaluation(spark, d).problems.select("id", "problem")
