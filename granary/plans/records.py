"""Registered queries of sections, web records, sessions, audits and labels, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import analytics as A
from granary.operators import answers as G
from granary.operators import chunking as C
from granary.operators import evaluation as E
from granary.operators import retrieval as R
from granary.operators import web as W
from granary.plans.queries import CANON, HYBRID, LOGS, PAGES, PATH, evaluation_tables, query, t, vectors
from granary.sources import events as N
from granary.sources import tables as S

# --- sections -------------------------------------------------------------------------------------------------

#: A word made of letters alone that stands for a document's text.
BODY = "translate(md5(coalesce(text, '')), '0123456789', 'ghijklmnop')"


def sectioned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's digest under headings of one of three forms by doc_id: numbered, capitalised, or repeated lines only."""
    docs = t(spark, d, "documents").select("doc_id", F.expr(BODY).alias("b"))
    forms = [
        ["concat('1. Purpose\n', b, ' one\n2\n.\nScope of it\n', b, ' two')", "concat('7\n3. Fees\n', b, ' ends. 4. Limits\n', b, ' three\n8')", "concat('Appendix A\n', b, ' four\n5. Late')"],
        ["concat(b, ' one.\n\nPurpose Of It\n', b, ' two.')", "concat(b, ' three.')"],
        ["'the same line'", "'the same line'"],
    ]
    page = F.struct(F.lit(0).alias("page_num"), F.lit("").alias("clean_text"))
    parts = F.array(page)
    for k, form in enumerate(forms):
        own = F.array(*[F.struct(F.lit(n + 1).alias("page_num"), F.expr(x).alias("clean_text")) for n, x in enumerate(form)])
        parts = F.when(F.col("doc_id") % 3 == k, own).otherwise(parts)
    each = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(parts).alias("p"))
    return each.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("file_name"), F.concat(F.lit("/"), "doc_id").alias("source_path"), "p.page_num", "p.clean_text")


SECTIONS = f"""b as (select doc_id, {BODY} as b from documents),
rows as (select doc_id::varchar as doc_id, unnest(case doc_id % 3 when 0 then [(1, '1. Purpose', concat_ws(chr(10), '1. Purpose', b || ' one'), 1, 1), (2, '2. Scope of it', concat_ws(chr(10), '2. Scope of it', b || ' two'), 1, 1),
 (3, '3. Fees', concat_ws(chr(10), '3. Fees', b || ' ends.'), 2, 2), (4, '4. Limits', concat_ws(chr(10), '4. Limits', b || ' three'), 2, 2), (5, 'Appendix A', concat_ws(chr(10), 'Appendix A', b || ' four', '5. Late'), 3, 3)]
 when 1 then [(0, 'Document Overview', b || ' one.', 1, 1), (1, 'Purpose Of It', concat_ws(chr(10), 'Purpose Of It', b || ' two.', b || ' three.'), 1, 2)]
 else [(0, 'Full document', concat_ws(chr(10), 'the same line', 'the same line'), 1, 2)] end) as r from b)"""


@query(f"with {SECTIONS} select doc_id, r[1]::bigint as section, r[2] as section_title, r[3] as text, r[4]::int as page_start, r[5]::int as page_end from rows")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(sectioned_pages(spark, d)).select("doc_id", F.col("section").cast("long").alias("section"), "section_title", "text", "page_start", "page_end")


@query(f"""with {SECTIONS}, s as (select doc_id, row_number() over (partition by doc_id order by r[1]) - 1 as section_index, r[2] as section_title, string_split(replace(r[3], chr(10), ' '), ' ') as w from rows),
p as (select *, unnest(range(0, (ceil(greatest(len(w) - 3, 0) / 2.0))::bigint + 1)) as k from s)
select doc_id || '::section::' || lpad(section_index::varchar, 4, '0') || '-' || lpad(k::varchar, 2, '0') as chunk_id, section_title, array_to_string(w[k * 2 + 1 : k * 2 + 3], ' ') as text,
 len(w[k * 2 + 1 : k * 2 + 3])::int as word_count, length(array_to_string(w[k * 2 + 1 : k * 2 + 3], ' '))::int as char_count from p where len(w[k * 2 + 1 : k * 2 + 3]) >= 2""")
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.structure_aware_chunks(sectioned_pages(spark, d), 3, 1, 2).select("chunk_id", "section_title", "text", "word_count", "char_count")


# --- web records and the corpus -------------------------------------------------------------------------------


@query(rf"""with {PAGES}, w as (select url, html as text, case when page_id % 3 = 0 then null when page_id % 3 = 1 then ' ' else 'Title ' || page_id end as title from pages_raw where page_id % 10 <> 0),
n as (select *, coalesce(nullif(trim(title), ''), nullif(regexp_replace({PATH.format("url")}, '^/+|/+$', '', 'g'), ''), url) as t from w)
select doc_id, file_name, source_path, page_num, md5(text) as text_md5 from pages
union all select 'Web - ' || left(t, 90) || ' - ' || left(url, 90), 'Web - ' || left(t, 140), url, 1, md5(text) from n""".replace("pages_raw", "main.pages"))
def corpus_pages(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages")
    title = F.when(F.col("page_id") % 3 == 0, None).when(F.col("page_id") % 3 == 1, " ").otherwise(F.concat(F.lit("Title "), F.col("page_id").cast("string")))
    records = p.select(F.col("url").alias("final_url"), title.alias("title"), F.when(F.col("page_id") % 10 == 0, "  ").otherwise(F.col("html")).alias("text"))
    both = S.load_corpus(S.document_pages(t(spark, d, "documents")), W.web_pages_as_pages(records))
    return both.select("doc_id", "file_name", "source_path", "page_num", F.md5("text").alias("text_md5"))


@query(f"select {CANON.format('url')} as url, min(page_id) as pos from pages group by 1")
def first_urls(spark: SparkSession, d: str) -> DataFrame:
    return W.first_urls(t(spark, d, "pages").select(W.canonical_url(F.col("url")).alias("url"), F.col("page_id").alias("pos")))


@query("select page_id from pages where page_id % 5 <> 3")
def deleted_record(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("http://e.com/"), (F.col("page_id") % 5).cast("string"), F.lit("/"))
    return W.delete_record(t(spark, d, "pages").select("page_id", "url", own.alias("final_url")), " http://e.com/3 ").select("page_id")


@query("""with r as (select 'u' || page_id % 50 as final_url, page_id as pos, html, 0 as b from pages where page_id % 2 = 0 union all select 'u' || page_id % 50, page_id, html, 1 from pages where page_id % 3 = 0)
select final_url, arg_max(pos, b * 1000000000 + pos) as pos, md5(arg_max(html, b * 1000000000 + pos)) as text_md5 from r group by final_url""")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "pages").select(F.concat(F.lit("u"), (F.col("page_id") % 50).cast("string")).alias("final_url"), F.col("page_id").alias("pos"), F.col("html").alias("text"))
    return W.merge_records(r.filter("pos % 2 = 0"), r.filter("pos % 3 = 0")).select("final_url", "pos", F.md5("text").alias("text_md5"))


@query("""with s as (select 'c' || doc_id as chunk_id, text from documents where doc_id % 2 = 0), f as (select 'c' || doc_id as chunk_id, case when doc_id % 9 <> 0 then lang end as text from documents where doc_id % 3 = 0)
select coalesce(s.chunk_id, f.chunk_id) as chunk_id, md5(coalesce(case when f.chunk_id is not null then f.text else s.text end, '')) as text_md5 from s full join f on s.chunk_id = f.chunk_id""")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").withColumn("chunk_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    fixed = docs.filter("doc_id % 3 = 0").select("chunk_id", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("text"))
    return S.chunk_texts(docs.filter("doc_id % 2 = 0").select("chunk_id", "text"), fixed).select("chunk_id", F.md5("text").alias("text_md5"))


@query("""select event_id as local_id, user_id, null::bigint as session_id, null::bigint as chat_log_id, 'click' as event_type, ts as created_at, '{"id":' || event_id || ',"event_type":"' || event_type || '"}' as payload
 from events where event_type = 'click'""")
def event_records(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").filter("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), "event_type")
    return N.envelope(e, "click", ["id", "event_type"])


@query("select coalesce(max(l_linenumber), 0) + 1 as version from lineitem")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    versions = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("version"))
    return t(spark, d, "region").limit(1).select(C.next_version(versions).alias("version"))


# --- answers --------------------------------------------------------------------------------------------------

TOP = f"{HYBRID}, top as (select *, case when chunk_id % 3 = 0 then 'Scope and Purpose' else 'Fees' end as section_title from hybrid where hrank <= 5)"
CONTEXT = f"""{TOP}, ctx as (select question_id, ql, string_agg('[C' || hrank || '] Policy Guide ' || cl || '.pdf | ' || section_title || ' | pages ' || chunk_id % 9 || '-' || chunk_id % 9 + 1 || chr(10) || 'Chunk  text ' || chunk_id % 50,
 chr(10) || chr(10) order by hrank) as context from top group by question_id, ql)"""


@query(f"""with {TOP} select question_id, 'C' || hrank as label, chunk_id, 'Chunk  text ' || chunk_id % 50 as text, 'Policy Guide ' || cl || '.pdf' as file_name, 'corpus/Policy Guide ' || cl || '.pdf' as source_path,
 section_title, (chunk_id % 9)::int as page_start, (chunk_id % 9 + 1)::int as page_end, round(score, 9) as score, round(vector_score, 9) as vector_score, round(boost, 9) as metadata_boost, strategy as source_strategy from top""")
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    q, v, c = vectors(spark, d)
    return G.citations(R.hybrid(q, v, c, 5), True).withColumns({n: F.round(n, 9) for n in ("score", "vector_score", "metadata_boost")})


@query(f"""with {CONTEXT} select question_id, 'Answer from the context.' as system, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: What does policy guide ' || ql || ' say about the scope' || chr(10) || chr(10) || 'Answer:' as user from ctx""")
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    q, v, c = vectors(spark, d)
    return G.answer_prompts(q, R.hybrid(q, v, c, 5), "Answer from the context.")


@query(f"""with {CONTEXT} select question_id, 'Judge it.' as system, 'Question:' || chr(10) || 'What does policy guide ' || ql || ' say about the scope' || chr(10) || chr(10) || 'Answer:' || chr(10) || 'See [C1].' || chr(10) || chr(10)
 || 'Context:' || chr(10) || context as user from ctx""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    q, v, c = vectors(spark, d)
    return G.judge_prompts(q.withColumn("answer", F.lit("See [C1].")), R.hybrid(q, v, c, 5), "Judge it.")


@query("select conv_id, turn, starts_with(lower(trim(case when turn % 3 = 0 then '  I cannot find ' || text else text end)), 'i cannot find') as refuses from conversations")
def said_refusals(spark: SparkSession, d: str) -> DataFrame:
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  I cannot find "), "text")).otherwise(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", R.says_refusal(answer).alias("refuses"))


CLAIMS = """'{"claim_checks": [{"claim": "c' || doc_id || '", "citations_used": ["C1", "C2"], "support_status": "supported"}, {"issue": "none"}]}'"""


@query("""select doc_id, pos::int as pos, case pos when 0 then 'c' || doc_id else '' end as claim, case pos when 0 then 'C1, C2' else '' end as citations, case pos when 0 then 'supported' else 'unknown' end as support_status,
 case pos when 0 then '' else 'none' end as issue from labels, (select unnest([0, 1]) as pos) where doc_id % 4 <> 0""")
def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    judged = t(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.expr(CLAIMS)).alias("judge_json"))
    return G.claim_checks(judged, "doc_id")


# --- sessions, audits and resolutions -------------------------------------------------------------------------


def logs_of(spark: SparkSession, d: str) -> DataFrame:
    return S.chat_logs(t(spark, d, "conversations"))


@query(f"""with {LOGS}, m as (select coalesce(max(session_id), 0) as m from logs where session_id % 3 = 0)
select id, case when session_id % 3 = 0 then session_id else id + m end as session_id from logs, m""")
def backfilled_sessions(spark: SparkSession, d: str) -> DataFrame:
    logs = logs_of(spark, d)
    sessions = logs.filter("session_id % 3 = 0").select(F.col("session_id").alias("id")).distinct()
    return A.backfill_sessions(logs, sessions)[0].select("id", "session_id")


@query(f"with {LOGS} select id, question, case when id % 5 = 0 then 0 else 1 end as n_citations, case when id % 5 <> 0 then 'C1' end as first_label from logs where session_id = 17 and user_id = 0")
def session_detail(spark: SparkSession, d: str) -> DataFrame:
    logs = logs_of(spark, d).withColumn("citations_json", F.when(F.col("id") % 5 != 0, '[{"label": "C1", "file_name": "f"}]').otherwise("no list"))
    return A.session_detail(logs, 17, 0).select("id", "question", F.size("citations").alias("n_citations"), F.get("citations", F.lit(0))["label"].alias("first_label"))


@query(f"""with {LOGS}, kept as (select * from logs where user_id not in (3, 5)) select 'chat_logs' as name, id from kept union all select distinct 'chat_sessions', session_id from kept
 union all select 'feedback', id * 10 from kept union all select 'human_audits', id * 10 + 1 from kept where id % 2 = 0""")
def cascaded_delete(spark: SparkSession, d: str) -> DataFrame:
    logs = logs_of(spark, d)
    hung = {"feedback": logs.select((F.col("id") * 10).alias("id"), F.col("id").alias("chat_log_id")), "human_audits": logs.filter("id % 2 = 0").select((F.col("id") * 10 + 1).alias("id"), F.col("id").alias("chat_log_id"))}
    tables = {"chat_logs": logs, "chat_sessions": logs.select(F.col("session_id").alias("id"), "user_id").distinct()} | hung
    left = A.delete_cascade(tables, logs.filter("user_id in (3, 5)").select("user_id").distinct(), "user_id")
    out = [x.select(F.lit(n).alias("name"), "id") for n, x in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def audit_rows(logs: DataFrame, step: int) -> DataFrame:
    """An audit of each log whose id step divides; scores from 0 to 6, so that some are out of range."""
    k = F.col("id")
    scores = [((k / step + n).cast("long") % 7).cast("int").alias(c) for n, c in enumerate(A.AUDIT_SCORES)]
    verdict = F.when(k % 5 == 0, "odd").otherwise("pass").alias("overall_verdict")
    return logs.filter(k % step == 0).select(
        (k * 10 + step).alias("id"), "user_id", k.alias("chat_log_id"), *scores, verdict, F.lit("low").alias("reviewer_confidence"),
        F.array(F.lit("wrong_document"), F.lit("made up")).alias("issue_tags"), F.timestamp_seconds(k * 60 + step).alias("created_at"), F.timestamp_seconds(k * 60 + step).alias("updated_at"))


AUDITS = f"""{LOGS}, steps as (select unnest([1, 2]) as step), rows as (select id * 10 + step as id, user_id, id as chat_log_id, step, id // step as h, id % 5 = 0 as odd from logs, steps where id % step = 0),
good as (select * from rows where not odd and h % 7 between 1 and 5 and (h + 1) % 7 between 1 and 5 and (h + 2) % 7 between 1 and 5 and (h + 3) % 7 between 1 and 5 and (h + 4) % 7 between 1 and 5)"""


@query(f"with {AUDITS} select id, not exists (select 1 from good g where g.id = rows.id) as rejected from rows where step = 1")
def valid_audits(spark: SparkSession, d: str) -> DataFrame:
    good, bad = A.valid_audits(audit_rows(logs_of(spark, d), 1), ["wrong_document"])
    return good.select("id", F.lit(False).alias("rejected")).unionByName(bad.select("id", F.lit(True).alias("rejected")))


@query(f"""with {AUDITS}, l as (select chat_log_id, arg_max(id, step) as id, min(chat_log_id * 60 + step) as created, max(step) as step from rows group by chat_log_id)
select id, chat_log_id, created as created_at, case when chat_log_id % 4 <> 3 then chat_log_id % 6 end as llm_overall_score from l""")
def upserted_audits(spark: SparkSession, d: str) -> DataFrame:
    logs = logs_of(spark, d)
    merged = A.upsert_audits(audit_rows(logs, 1), audit_rows(logs, 2))
    out = A.with_judge_snapshot(merged, logs)
    return out.select("id", "chat_log_id", F.unix_timestamp("created_at").alias("created_at"), F.col("llm_overall_score").cast("long").alias("llm_overall_score"))


@query("""select doc_id as id, not (doc_id % 7 between 1 and 5 and (doc_id + 1) % 7 between 1 and 5 and (doc_id + 2) % 7 between 1 and 5 and doc_id % 4 <> 3 and doc_id % 5 <> 0) as rejected from labels""")
def valid_surveys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    scores = {c: (k + n) % 7 for n, c in enumerate(["ease_score", "helpfulness_score", "trustworthiness_score"])}
    useful = F.element_at(F.array(*map(F.lit, ["yes", "somewhat", "no", "maybe"])), (k % 4 + 1).cast("int"))
    rows = t(spark, d, "labels").withColumns(scores | {"citations_useful": useful, "would_use_at_work": F.when(k % 5 != 0, "maybe")})
    good, bad = A.valid_survey(rows)
    return good.select(k.alias("id"), F.lit(False).alias("rejected")).unionByName(bad.select(k.alias("id"), F.lit(True).alias("rejected")))


@query("""with e as (select user_id % 40 as k, event_type = 'click' as active, ts, event_id from events), last as (select k, arg_max(active, ts) as active, bool_or(active) as ever, max(ts) as seen from e group by k)
select 'refused' as issue_type, coalesce(k, o)::varchar as item_key, coalesce(active, true) as active, coalesce(seen, timestamp '2020-01-01') as "at" from last full join (select n_nationkey * 2 as o from nation) n on k = o where o is not null or ever""")
def resolved_issues(spark: SparkSession, d: str) -> DataFrame:
    old = t(spark, d, "nation").select(F.lit("refused").alias("issue_type"), (F.col("n_nationkey") * 2).cast("string").alias("item_key"), F.lit("old").alias("note"), F.lit(True).alias("active"), F.to_timestamp(F.lit("2020-01-01")).alias("at"))
    events = t(spark, d, "events").select(F.lit("refused").alias("issue_type"), (F.col("user_id") % 40).cast("string").alias("item_key"), F.lit("n").alias("note"), (F.col("event_type") == "click").alias("active"), F.col("ts").alias("at"))
    return A.resolve(old, events).drop("note")


@query(f"with {LOGS} select id, case when llm_score is null then 'unknown' when llm_score >= 4 then 'strong' when llm_score >= 3 then 'okay' else 'low' end as band from logs")
def quality_bands(spark: SparkSession, d: str) -> DataFrame:
    score = F.get_json_object("judge_json", "$.overall_score").try_cast("int")
    return logs_of(spark, d).select("id", A.quality_band(score).alias("band"))


@query(f"with {LOGS} select session_id as id, max(id * 60) + 1700000000 as updated_at from logs group by 1")
def touched_sessions(spark: SparkSession, d: str) -> DataFrame:
    logs = logs_of(spark, d)
    sessions = logs.groupBy(F.col("session_id").alias("id")).agg(F.min("created_at").alias("updated_at"))
    return A.touched_sessions(sessions, logs).select("id", F.unix_timestamp("updated_at").alias("updated_at"))


@query("select c_custkey as id, c_name as email from customer where c_name = 'Customer#000000003' or c_custkey = 3 order by 1 limit 1")
def preferred_user(spark: SparkSession, d: str) -> DataFrame:
    users = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    third = users.filter("id = 3").first()
    return A.preferred_user(users, ["nobody", third.email if third else "Customer#000000003"])


# --- evaluation -----------------------------------------------------------------------------------------------


@query("select count(distinct label) as universe from embeddings")
def source_universe(spark: SparkSession, d: str) -> DataFrame:
    return E.source_universe(vectors(spark, d)[2])


JUDGED = f"""{HYBRID}, r5 as (select *, row_number() over (partition by question_id, strategy order by score desc, distance, chunk_id) as rank5 from scored where vector_rank <= 20),
hh as (select question_id as id, strategy, rank5 as rank, chunk_id, ql, cl from r5 where rank5 <= 5 union all select question_id, 'hybrid', hrank, chunk_id, ql, cl from hybrid where hrank <= 5),
judged as (select *, contains('policy guide ' || cl, 'policy guide ' || ql) or contains('policy guide ' || ql, 'policy guide ' || cl) as src,
 contains('chunk text ' || chunk_id % 50, 'text ' || id % 7) as second, case when id % 200 = 0 then 1 else 2 end as least from hh),
rel as (select *, src and 1 + second::int >= least as relevant from judged)"""


def chunk_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(judged hits of three strategies, questions): a label wants the question's guide and one or two groups of phrases."""
    q, _, c = vectors(spark, d)
    hits = evaluation_tables(spark, d)[1]
    k = F.col("question_id")
    groups = F.array(F.array(F.lit("CHUNK  text"), F.lit("never said")), F.array(F.concat(F.lit("text "), (k % 7).cast("string"))))
    labels = q.select(k.alias("id"), F.array(F.concat(F.lit("Policy Guide "), F.col("label").cast("string"), F.lit(".pdf"))).alias("source_match"), F.when(k % 200 == 0, 1).otherwise(2).alias("min_groups"), groups.alias("groups"))
    texts = c.filter("chunk_id % 2 = 0").select("chunk_id", "text")  # others fall back to the hit's excerpt
    return E.chunk_relevance(hits.select("id", "strategy", "rank", "chunk_id", "file_name", "source_path", "doc_id", F.col("text").alias("text_excerpt")), labels, texts), q


@query(f"""with {JUDGED} select id, strategy, rank::int as rank, chunk_id, relevant as chunk_relevant, (1 + second::int)::int as n_matched, case when relevant then 'relevant' when not src then 'other source' else 'too few keyword groups' end as relevance_reason from rel""")
def chunk_relevance(spark: SparkSession, d: str) -> DataFrame:
    return chunk_labels(spark, d)[0].select("id", "strategy", "rank", "chunk_id", "chunk_relevant", F.size("matched_groups").alias("n_matched"), "relevance_reason")


METRICS = f"""{JUDGED}, cm as (select id, strategy, count(*) filter (relevant) as relevant, min(rank) filter (relevant) as first_rank from rel group by 1, 2),
cmm as (select *, relevant / 5.0 as p, case when relevant > 0 then 1.0 else 0.0 end as r, coalesce(1.0 / first_rank, 0.0) as mrr from cm)"""


@query(f"with {METRICS} select id, strategy, relevant, first_rank::int as first_rank, p as precision_at_k, r as passage_recall_at_k, case when p + r > 0 then round(2 * p * r / (p + r), 9) else 0.0 end as f1_at_k, r::int as hit_at_k, round(mrr, 9) as mrr from cmm")
def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.chunk_metrics(chunk_labels(spark, d)[0], 5).withColumns({"f1_at_k": F.round("f1_at_k", 9), "mrr": F.round("mrr", 9)})


@query(f"with {METRICS} select strategy, count(*) as questions, round(avg(p), 9) as macro_precision_at_k, round(avg(r), 9) as macro_passage_recall_at_k, round(avg(mrr), 9) as macro_mrr, sum(relevant)::bigint as total_relevant from cmm group by 1")
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    out = E.chunk_summary(E.chunk_metrics(chunk_labels(spark, d)[0], 5))
    return out.select("strategy", "questions", *[F.round(c, 9).alias(c) for c in ("macro_precision_at_k", "macro_passage_recall_at_k", "macro_mrr")], "total_relevant")


@query(f"""with {JUDGED} select id, strategy, rank::int as rank, chunk_id, 'Policy Guide ' || cl || '.pdf' as file_name, src as relevant, case when src then 'Policy Guide ' || ql || '.pdf' else '' end as matched_gold_source, left('Chunk  text ' || chunk_id % 50, 600) as text_excerpt from rel""")
def ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    _, matched, gold = evaluation_tables(spark, d)
    return E.ranked_hits(matched, gold, 5).select("id", "strategy", "rank", "chunk_id", "file_name", "relevant", "matched_gold_source", "text_excerpt")


@query(f"""with {JUDGED} select id, 'q' || id as question, strategy, count(*) as n_hits, count(*) filter (src) / 5.0 as precision_at_k, 'a' as answer, case when id % 300 = 0 then null else 'even' end as comparison from rel group by id, strategy""")
def full_audit(spark: SparkSession, d: str) -> DataFrame:
    q, matched, gold = evaluation_tables(spark, d)
    metrics = E.question_metrics(q, matched, gold, 5, 75).select("id", "strategy", "precision_at_k")
    results = metrics.select("id", "strategy", F.lit("a").alias("answer"))
    comparisons = q.filter("id % 300 <> 0").select("id", F.lit("even").alias("comparison"))
    out = E.full_audit(q.select("id", F.concat(F.lit("q"), F.col("id").cast("string")).alias("question")), results, metrics, E.ranked_hits(matched, gold, 5), comparisons)
    return out.select("id", "question", "strategy", F.size("hits").cast("long").alias("n_hits"), "precision_at_k", "answer", "comparison")


@query("select item_id as id, case when item_id % 3 = 0 then 'missing' else 'question differs' end as problem from benchmark where item_id % 3 = 0 or item_id % 5 = 0")
def label_mismatches(spark: SparkSession, d: str) -> DataFrame:
    labels = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    run = labels.filter("id % 3 <> 0").withColumn("question", F.when(F.col("id") % 5 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")))
    return E.label_mismatches(labels, run)


@query("""select lang, 'longest' as metric, (max(n_chars) + 1)::double as stored, max(n_chars)::double as computed from documents where lang = 'de' group by lang
 union all select lang, 'documents', (count(*) + 2)::double, count(*)::double from documents where lang = 'fr' group by lang""")
def summary_differences(spark: SparkSession, d: str) -> DataFrame:
    computed = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.max("n_chars").alias("longest"))
    off = lambda c, lang, n: F.when(F.col("lang") == lang, F.col(c) + n).otherwise(F.col(c))
    stored = computed.withColumns({"longest": off("longest", "de", 1), "documents": off("documents", "fr", 2)})
    return E.summary_differences(stored, computed, ["lang"])


@query("""with g as (select item_id % 40 as id, item_id as i, case when item_id % 7 = 0 then '' when item_id % 11 = 0 then ' x' else 'q' end as question, item_id % 4 as least from benchmark)
select 'empty_question' as rule, id from g where question = '' union all select 'untrimmed_question', id from g where question = ' x' union all select 'min_groups', id from g where least not between 1 and 2
 union all select 'answerability', id from g where i % 13 = 0 union all select 'duplicate_id', id from g group by id having count(*) > 1""")
def gold_violations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    gold = t(spark, d, "benchmark").select(
        (i % 40).alias("id"), F.when(i % 7 == 0, "").when(i % 11 == 0, " x").otherwise("q").alias("question"), E.parse_groups(F.lit("a | b; ;c")).alias("groups"),
        (i % 4).alias("min_groups"), F.when(i % 13 == 0, "Maybe").otherwise("Answerable").alias("answerability"))
    return E.gold_violations(gold)
