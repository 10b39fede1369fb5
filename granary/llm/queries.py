"""One query for each operator, over whole tables with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import collocations, ego_join, jaccard_join, line_dedup, lm, packing, prefix_trie, repeats, reputation, sharding, sp_codec, topk, toxicity
from granary.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = sharding.histogram_shards(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The rules that op4's contract fixes.
CONTRACT_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")
#: The rules of op4's SQL and of an older test; net/de/ differs from the contract there.
HOST_RULES = ("block com/en/", "allow example.com/en/7", "block net/de/", "block example.net/de/8", "block org/es/")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """A labelled page (page_id = doc_id) is bad where it is toxic or of low quality."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


@query
def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules and then by its host's reputation."""
    rules = [reputation.rule(x) for x in CONTRACT_RULES]
    return reputation.host_reputation(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")), rules)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FITS = " ".join(
    f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}'"
    for r in sorted(map(reputation.rule, HOST_RULES), key=lambda r: -len(r.text))
)
_VERDICTS = " ".join(f"when '{r.text}' then '{r.verdict}'" for r in map(reputation.rule, HOST_RULES))
_TWO = ", ".join(f"'{x}'" for x in reputation.TWO_LABEL_SUFFIXES)


def _prior_sql(level: str) -> str:
    return f"""(select m, 1 / least(greatest(case when below > 0 then (spread - (g - 1) * m * (1 - m)) / below else 0.0 end, 0.001), 0.999) - 1 as s
 from (select *, kk - k * k / greatest(n, 1.0) as spread, m * (1 - m) * (n - nn / greatest(n, 1.0) - (g - 1)) as below
 from (select *, (k + 1) / (n + 2) as m from (select coalesce(sum(n), 0)::double as n, coalesce(sum(bad), 0)::double as k,
 coalesce(sum(n::double * n), 0.0)::double as nn, coalesce(sum(bad::double * bad / n), 0.0)::double as kk, count(*)::double as g from {level} where n > 0))))"""


ORACLE_SQL["op4_host_reputation"] = f"""
with cut as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
seen as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
known as (select doc_id as page_id, case when toxic = 1 or quality = 0 then 1 else 0 end as bad from labels),
labelled as (select host, count(*) as n, sum(bad) as bad from seen join known using (page_id) group by host),
named as (select distinct host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as labels from seen),
lasts as (select host, labels, array_to_string(labels[-2:], '.') as two, array_to_string(labels[-3:], '.') as three from named),
hosts as (select l.host, coalesce(n, 0)::bigint as n, coalesce(bad, 0)::bigint as bad, case when two in ({_TWO}) then three else two end as domain,
 case when two in ({_TWO}) then two else labels[-1] end as suffix from lasts l left join labelled b on l.host = b.host),
domains as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from hosts group by 1, 2),
suffixes as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by 1),
top as (select suffix, (bad + s * m) / (n + s) as rate_s from suffixes, {_prior_sql("suffixes")}),
mid as (select domain, suffix, (bad + s * rate_s) / (n + s) as rate_d from domains join top using (suffix), {_prior_sql("domains")}),
low as (select host, n, bad, bad + s * rate_d as a, n - bad + s * (1 - rate_d) as b from hosts join mid using (domain, suffix), {_prior_sql("hosts")}),
judged as (select host, n as n_labelled, bad as n_bad, round(a / (a + b) - 1.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) as bound from low),
ruled as (select page_id, host, path, case {_FITS} end as rule, n_labelled, n_bad, bound from seen join judged using (host))
select page_id, host, path, rule, case rule {_VERDICTS} else case when bound > 0.35 then 'block' else 'allow' end end as verdict,
 n_labelled, n_bad, bound from ruled"""

#: Of the public word-level tokenizer; op8's contract fixes it, the capacity and the end id.
SEQUENCE_TOKENS, END_ID = 4096, 1


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of at most 4096 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)
    return packing.pack(cut, SEQUENCE_TOKENS)


@query
def op5_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked where their cosine is 0.9 or more."""
    return ego_join.cosine_links(table(spark, sf_dir, "embeddings"), 0.9)


ORACLE_SQL["op5_ego_join"] = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a as vec_id, min(b) as component_id from reach group by a),
counts as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from component left join counts using (vec_id)"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the public BPE model and decoded again."""
    path = tokenizer_file("piece_bpe_32k.model")
    decoded = sp_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    text = F.coalesce("text", F.lit(""))
    return decoded.select(
        "doc_id", "ids", F.size("ids").alias("n_ids"), F.crc32("decoded").alias("decoded_crc32"), (F.col("decoded") == text).alias("round_trip")
    )


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every 50th embedding, by integer inner product."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL["op9_exact_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier line equals or is one edit away from."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"), F.length("text").cast("long").alias("kept_chars"))


ORACLE_SQL["op10_line_dedup"] = """
with cut as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
each as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as no from cut),
l as (select doc_id, no, line from each where regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]')),
d as (select line, length(line) as k, min((doc_id, no)) as first from l group by line),
keys as (select line, k, first, unnest([('p', k // 2, left(line, k // 2)), ('p', (k - 1) // 2, left(line, (k - 1) // 2)),
 ('s', k // 2, right(line, k // 2)), ('s', (k - 1) // 2, right(line, (k - 1) // 2))]) as half from d),
pairs as (select distinct a.line as line, a.k as ka, b.line as other, b.k as kb, b.first as near from keys a join keys b
 on a.half = b.half and a.line <> b.line and abs(a.k - b.k) <= 1 and b.first < a.first),
edits as (select line, near from pairs where len(list_filter(range(0, greatest(ka, kb)::bigint), lambda i:
 left(line, i) = left(other, i) and (case when ka = kb then substr(line, (i + 2)::bigint) = substr(other, (i + 2)::bigint)
 when ka > kb then substr(line, (i + 2)::bigint) = substr(other, (i + 1)::bigint)
 else substr(line, (i + 1)::bigint) = substr(other, (i + 2)::bigint) end))) > 0),
m as (select d.line, least(d.first, coalesce(n.near, d.first)) as first from d left join (select line, min(near) as near from edits group by line) n on d.line = n.line),
gone as (select l.doc_id, list(l.no) as nos from l join m on l.line = m.line where (l.doc_id, l.no) > m.first group by l.doc_id),
kept as (select c.doc_id, c.text, len(c.parts) as n_lines, coalesce(len(g.nos), 0) as n_removed,
 array_to_string(list_filter(c.parts, lambda x, i: not coalesce(list_contains(g.nos, i), false)), chr(10)) as t from cut c left join gone g on c.doc_id = g.doc_id)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, n_removed::bigint as n_removed, md5(t) as kept_md5, length(t)::bigint as kept_chars from kept"""


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked where their five-word shingles are alike by 0.8 or more."""
    out = jaccard_join.jaccard_links(table(spark, sf_dir, "documents"), 0.8, 5)
    return out.select("doc_id", "class_id", "copies_id", "n_links", "kept")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by unigrams and by the log-bilinear model."""
    return lm.language_model_scores(table(spark, sf_dir, "documents"), remainder(7) == 2)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on labelled rows that are not held out."""
    return toxicity.fit(docs, labels.filter(remainder(3) != 1))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs.select("doc_id", "text"), toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    seqs = stored(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))), "turns")
    ends = prefix_trie.member_digests(prefix_trie.members(seqs))
    sha = F.coalesce("sha256", prefix_trie.empty_digest())
    nodes = prefix_trie.trie(seqs)
    held = nodes.filter("node is not null").join(ends, "node", "left").unionByName(nodes.filter("node is null").withColumn("sha256", F.lit(None).cast("string")))
    return held.withColumn("ends_sha256", sha).drop("node", "sha256")


# crc32 of a text bit by bit: only the low two bits of the result matter, the polynomial is the usual one
_CRC = (
    "xor(list_reduce(list_concat([4294967295::bigint], range(0::bigint, 8 * length({0}))), lambda x, k: "
    "case when (xor(x, case when k % 8 = 0 then ascii(substr({0}, k // 8 + 1, 1)) else 0 end) & 1) = 1 "
    "then xor(xor(x, case when k % 8 = 0 then ascii(substr({0}, k // 8 + 1, 1)) else 0 end) >> 1, 3988292384::bigint) "
    "else xor(x, case when k % 8 = 0 then ascii(substr({0}, k // 8 + 1, 1)) else 0 end) >> 1 end), 4294967295::bigint)"
)

ORACLE_SQL["op12_prefix_trie"] = f"""
with recursive t as (select conv_id as c, turn, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as d,
 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as w from conversations where conv_id is not null),
o as (select c, d, w, row_number() over (partition by c order by turn nulls first, d) as i from t),
convs as (select distinct c from o),
hs as (select c, c - c % 20 as b, {_CRC.format("c::varchar")} % 4 as h from convs),
heads as (select hs.c, o.i, o.d, o.w from hs join o on o.c = hs.b and o.i <= hs.h),
n_heads as (select c, count(*) as n from heads group by c),
r as (select c, i, d, w from heads union all
 select o.c, o.i - hs.h + coalesce(n, 0), d, w from o join hs on hs.c = o.c left join n_heads on n_heads.c = o.c where o.i > hs.h),
walk as (select c, 0::bigint as i, md5('') as k, null::varchar as up, 0::bigint as w from convs
 union all select r.c, r.i, md5(k || r.d), k, r.w from walk join r on r.c = walk.c and r.i = walk.i + 1),
lasts as (select c, max(i) as n from walk group by c),
node as (select k, any_value(up) as up, any_value(i) as depth, min(walk.c) as conv_id, count(*) as n_convs, any_value(w) as w,
 string_agg(case when n = i then walk.c::varchar end, ',' order by walk.c) as ids from walk join lasts on lasts.c = walk.c group by k),
kids as (select up as k, count(*) as n from node where up is not null group by up),
own as (select node.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * w as saves from node left join kids on kids.k = node.k),
pairs as (select k as top, k from own union all select own.up, pairs.k from pairs join own on own.k = pairs.top where own.up is not null),
sums as (select top, sum(saves)::bigint as saved_tokens, sum((n_children = 0)::int)::bigint as n_leaves from pairs join own on own.k = pairs.k group by top)
select own.conv_id, own.depth, p.conv_id as parent_conv_id, own.n_convs, own.n_children::bigint as n_children, n_leaves, saved_tokens,
 sha256(coalesce(own.ids, '')) as ends_sha256 from own join sums on sums.top = own.k left join node p on p.k = own.up"""


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start elsewhere too."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of each language over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


_JOINED = {k: " || ' ' || ".join(f"w{j}" for j in range(1, k + 1)) for k in (1, 2, 3, 4)}
_CUTS = " union all ".join(
    f"select c.*, {j} as k, x.f as l, y.f as r from c join f x on x.lang = c.lang and x.size = {j} and x.phrase = array_to_string(c.ws[1:{j}], ' ')"
    f" join f y on y.lang = c.lang and y.size = c.size - {j} and y.phrase = array_to_string(c.ws[{j + 1}:], ' ') where c.size > {j}"
    for j in (1, 2, 3)
)
ORACLE_SQL["op11_collocations"] = f"""
with pieces as (select doc, lang, p, unnest(regexp_extract_all(piece, '[^ \t]+')) as w, generate_subscripts(regexp_extract_all(piece, '[^ \t]+'), 1) as i
 from (select doc, lang, unnest(ps) as piece, generate_subscripts(ps, 1) as p from (select row_number() over () as doc, coalesce(lang, 'und') as lang,
 string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\n-\r]') as ps from documents))),
t as (select lang, w as w1, lead(w, 1) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4 from pieces window o as (partition by doc, p order by i)),
f as ({" union all ".join(f"select lang, {k} as size, {_JOINED[k]} as phrase, count(*) as f from t where w{k} is not null group by all" for k in (1, 2, 3, 4))}),
c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as ws from f where size > 1 and f >= 30),
s as (select *, 2000000::hugeint * a // (l + r) as score from ({_CUTS})),
best as (select * from s qualify row_number() over (partition by lang, phrase, size order by score, k) = 1),
gone as (select distinct lang, unnest([array_to_string(ws[1:size - 1], ' '), array_to_string(ws[2:], ' ')]) as phrase, a from c where size > 2),
covered as (select lang, phrase, max(a) as most from gone group by 1, 2),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
kept as (select best.* from best left join covered v on v.lang = best.lang and v.phrase = best.phrase where v.most is null or 100 * v.most < 80 * best.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, rank, phrase, a, l, r.r, n.n, score::bigint as score from r join n on n.lang = r.lang where rank <= 2000"""
