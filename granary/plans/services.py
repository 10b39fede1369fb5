"""Registered queries of the versioned store, live metrics, duplicate groups, rule tables, term lists and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import analytics as A
from granary.operators import rules as Y
from granary.operators import web as W
from granary.plans.queries import HOST, LOGS, NEAR, ORACLE_SQL, PAGES, PATH, RULES, query, t
from granary.sources import fingerprints as H
from granary.sources import tables as S
from granary.sources.store import CorpusStore
from granary.streaming import jobs as X

# --- versioned store ------------------------------------------------------------------------------------------

_TEXT = "array_to_string(l[p * 5 + 1 : p * 5 + 5], chr(10)) as text"
#: Page 1 of every fourth document is revised after the first version.
REVISED = PAGES.replace(_TEXT, "case when p = 0 and doc_id::bigint % 4 = 0 then 'Revised notice' || chr(10) else '' end || " + _TEXT)


_FILLED: dict[tuple[str, str], CorpusStore] = {}


def filled_store(spark: SparkSession, d: str) -> CorpusStore:
    """All documents in two versions: even ones first, then odd ones and revised pages; the second batch is sent twice.

    Filled once an application; the queries read it.
    """
    at = (spark.sparkContext.applicationId, d)
    if at not in _FILLED:
        _FILLED[at] = _filled(spark, d)
    return _FILLED[at]


def _filled(spark: SparkSession, d: str) -> CorpusStore:
    store = CorpusStore(spark, f"{S._shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    pages = S.document_pages(t(spark, d, "documents"))
    number = F.col("doc_id").cast("long")
    store.merge(pages.filter(number % 2 == 0))
    revised = pages.filter((number % 4 == 0) & (F.col("page_num") == 1)).withColumn("text", F.concat(F.lit("Revised notice\n"), "text"))
    second = pages.filter(number % 2 != 0).unionByName(revised)
    store.merge(second)
    store.merge(second)
    return store


@query(f"""with {PAGES}, second as (with {REVISED} select doc_id, page_num, text from pages)
select 1 as version, doc_id, page_num, md5(text) as text_md5 from pages where doc_id::bigint % 2 = 0 union all select 2, doc_id, page_num, md5(text) from second""")
def store_pages(spark: SparkSession, d: str) -> DataFrame:
    store = filled_store(spark, d)
    at = [store.read("pages", v).select(F.lit(v).alias("version"), "doc_id", "page_num", F.md5("text").alias("text_md5")) for v in range(1, store.version() + 1)]
    return at[0].unionByName(at[1])


@query(ORACLE_SQL["fixed_size_chunks"].replace(PAGES, REVISED))
def store_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = filled_store(spark, d).read("chunks").filter("strategy = 'fixed_size'")
    return made.select("chunk_id", "doc_id", "file_name", "piece_index", "text", "page_start", "page_end", "word_count")


@query(f"""with {PAGES}
select doc_id, page_num, case when doc_id::bigint % 2 = 0 then 'changed' else 'added' end as change from pages where doc_id::bigint % 2 <> 0 or (doc_id::bigint % 4 = 0 and page_num = 1)""")
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    return filled_store(spark, d).changes(1, 2)


@query(f"""select *, fixed_size > 0 and structure_aware > 0 as ready from (select (select count(*) from ({ORACLE_SQL["fixed_size_chunks"].replace(PAGES, REVISED)})) as fixed_size,
 (select count(*) from ({ORACLE_SQL["structure_aware_chunks"].replace(PAGES, REVISED)})) as structure_aware, (with {PAGES} select count(*) from pages) as pages, 2 as corpus_version, 2 as index_version)""")
def store_status(spark: SparkSession, d: str) -> DataFrame:
    return filled_store(spark, d).status()


# --- live metrics ---------------------------------------------------------------------------------------------


@query(f"""with {LOGS}, a as (select id as log, (id % 3) as u, (id % 5 + 1) as s, case id % 4 when 0 then 'pass' when 1 then 'fail' else 'partial' end as verdict, 1 as n from logs where id % 2 = 0
 union all select id, (id % 3), 5, 'unable_to_judge', 2 from logs where id % 6 = 0),
last as (select * from a qualify row_number() over (partition by log, u order by n desc) = 1)
select count(*) as total_chats, count(distinct user_id) as active_users, round(avg(retrieval_score), 9) as avg_retrieval_score, count(*) filter (refused) as refusals, count(*) filter (prompted) as human_audit_prompts,
 (select count(*) from last) as total_human_audits, (select round(avg((s + s + 3 + 4 + 5) / 5.0), 9) from last) as avg_human_score, (select round(avg(llm_score), 9) from last join logs on logs.id = last.log) as avg_llm_score_snapshot,
 (select count(*) filter (verdict = 'pass') from last) as human_pass, (select count(*) filter (verdict = 'partial') from last) as human_partial, (select count(*) filter (verdict = 'fail') from last) as human_fail,
 (select count(*) filter (verdict = 'unable_to_judge') from last) as human_unable_to_judge, (select count(*) from events where event_type = 'click') as citation_clicks from logs""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    logs = S.chat_logs(t(spark, d, "conversations"))
    k = F.col("id")
    verdict = F.when(k % 4 == 0, "pass").when(k % 4 == 1, "fail").otherwise("partial")

    def audits(rows: DataFrame, n: int, score, verdict) -> DataFrame:
        scores = [c.cast("int").alias(name) for c, name in zip((score, score, F.lit(3), F.lit(4), F.lit(5)), A.AUDIT_SCORES)]
        return rows.select((k * 10 + n).alias("id"), (k % 3).alias("user_id"), k.alias("chat_log_id"), *scores, verdict.alias("overall_verdict"), F.timestamp_seconds(F.lit(n)).alias("updated_at"))

    given = audits(logs.filter(k % 2 == 0), 1, k % 5 + 1, verdict).unionByName(audits(logs.filter(k % 6 == 0), 2, F.lit(5), F.lit("unable_to_judge")))
    out = X.dashboard(logs, given, t(spark, d, "events").filter("event_type = 'click'"))
    return out.withColumns({c: F.round(c, 9) for c in ("avg_retrieval_score", "avg_human_score", "avg_llm_score_snapshot")})


# --- duplicate groups -----------------------------------------------------------------------------------------

_COPIED = "(select doc_id * 10 + k as doc_id, text || repeat(' extra' || k, k::bigint) as text from documents, (select unnest([0, 1, 2, 3]) as k))"


@query(f"""with recursive {NEAR.replace("from documents", f"from {_COPIED}")}, links as (select "left" as a, "right" as b from near union select "right", "left" from near),
reach as (select a, a as b from links union select r.a, l.b from reach r join links l on r.b = l.a),
sizes as (select min(doc_id) as id, count(*) as copies from (select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as n from {_COPIED}) where n <> '' group by n)
select a as doc_id, min(b) as "group", any_value(copies) as copies from reach join sizes on sizes.id = a group by a""")
def near_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near copies among all documents and three altered copies of each."""
    copies = t(spark, d, "documents").withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    text = F.concat("text", F.repeat(F.concat(F.lit(" extra"), F.col("k").cast("string")), F.col("k")))
    return W.near_groups(copies.select((F.col("doc_id") * 10 + F.col("k")).alias("doc_id"), text.alias("text")), key="doc_id")[0]


# --- rule tables and term lists -------------------------------------------------------------------------------


@query(f"""with u as (select page_id, url, {HOST.format("url")} as host, {PATH.format("url")} as path from pages),
h as (select distinct regexp_extract(host, '[^.]+\\.[^.]+$') as host from u where host <> ''), r as (select row_number() over (order by host, prefix) as ord, host, prefix, case when length(prefix) % 2 = 0 then 'allow' else 'block' end as verdict
 from h, (select unnest(['', '/', '/en', '/de/1', '/en/2', '/fr/33']) as prefix)),
fit as (select u.page_id, r.ord, r.verdict, length(r.host) + length(r.prefix) as size from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.prefix))
select page_id, (select arg_max(ord, (size, -ord)) from fit where fit.page_id = u.page_id) as longest_ord, (select arg_max(verdict, (size, -ord)) from fit where fit.page_id = u.page_id) as longest_verdict,
 (select min(ord) from fit where fit.page_id = u.page_id) as first_ord from u""")
def rule_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every page's url under six rules for each domain of the table."""
    pages = t(spark, d, "pages").select("page_id", "url")
    domain = F.regexp_extract(W.host_of(F.col("url")), r"[^.]+\.[^.]+$", 0)
    rules = pages.select(domain.alias("host")).filter("host <> ''").distinct().withColumn("prefix", F.explode(F.array(*map(F.lit, ["", "/", "/en", "/de/1", "/en/2", "/fr/33"]))))
    ranked = W.numbered(rules, ["host", "prefix"], F.lit(True)).select(F.col("_n").cast("long").alias("ord"), "host", "prefix")
    ranked = ranked.withColumn("verdict", F.when(F.length("prefix") % 2 == 0, "allow").otherwise("block"))
    longest = Y.longest_rule(pages, ranked).withColumnsRenamed({"rule_ord": "longest_ord", "rule_verdict": "longest_verdict"})
    first = Y.first_rule(pages, ranked).select("page_id", F.col("rule_ord").alias("first_ord"))
    return longest.join(first, "page_id").select("page_id", "longest_ord", "longest_verdict", "first_ord")


@query(f"with {LOGS} select id, category from logs")
def term_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories by one reading of each question for all terms, 2,000 of which occur nowhere."""
    rules = [*RULES, ("Never", [f"never{n}" for n in range(2000)])]
    return Y.categorise_by_terms(S.chat_logs(t(spark, d, "conversations")).select("id", "question"), "question", rules).select("id", "category")


# --- fingerprints ---------------------------------------------------------------------------------------------


@query("select doc_id as key, case when doc_id % 97 = 0 then 'changed' else 'removed' end as change from documents where doc_id % 97 = 0 or doc_id % 101 = 0")
def table_differences(spark: SparkSession, d: str) -> DataFrame:
    """Rows that differ between the documents and an altered copy, found from the top of two hash trees."""
    docs = t(spark, d, "documents")
    lang = F.when(F.col("doc_id") % 97 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang"))
    other = docs.filter("doc_id % 101 <> 0 or doc_id % 97 = 0").withColumn("lang", lang)
    path = f"{S._shared_folder(spark)}/ranged-{uuid.uuid4().hex}"
    for name, df in (("a", docs), ("b", other)):
        H.write_ranged(df, f"{path}/{name}", "doc_id")
    ranges = H.differing_ranges(H.hash_tree(docs, "doc_id", 1), H.hash_tree(other, "doc_id", 1), 1)
    read = [spark.read.option("basePath", f"{path}/{x}").schema(docs.schema.add("range", "string")).parquet(f"{path}/{x}") for x in "ab"]
    return H.changed_rows(*read, "doc_id", ranges)
