"""Findings of reviews on the corpus queries."""

import json

import numpy as np
from pyspark.sql import functions as F

from granary.operators import answers as G
from granary.operators import chunking as C
from granary.operators import retrieval as R
from granary.operators import web as W
from granary.plans import queries as q
from granary.sources.store import CorpusStore
from tests.compare import differences


def against_sql(spark, folder, name, **tables):
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return differences(spark, name, q.QUERIES[name], q.ORACLE_SQL[name], str(folder))


def test_titles_with_unclosed_references(spark, tmp_path):
    titles = ["a &amp; b", "cut &amp", "cut &am", "x &quot", "&lt;p&gt; &#39;q&#39;", "&amp;lt;", "a&b;", "x&quoty;"]
    rows = [(k, f"http://a/{k}", f"<html><head><title>{t}</title></head></html>") for k, t in enumerate(titles)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert against_sql(spark, tmp_path, "all_html_titles", pages=pages) == ""


def test_pages_are_read_a_few_at_a_time(spark):
    rows = [(k, f"http://a/{k}", f"<title>t{k}</title><p>body {k}</p><a href='/x{k}'>l</a>") for k in range(3 * W.PAGES_AT_ONCE + 5)]
    pages = spark.createDataFrame(rows, "id long, at string, body string").coalesce(1)
    got = W.read_html(pages, "id", "at", "body").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(k, f"http://a/{k}", f"t{k}", f"\nbody {k} \nl ", [f"http://a/x{k}"]) for k, *_ in rows]
    assert got[0].asDict().keys() == {"id", "at", "title", "raw_text", "links"}


def test_manifest_leaves_out_urls_that_repeat(spark, tmp_path):
    rows = [(7, "http://a", "x"), (14, "http://b", "y"), (3, "http://b", "z"), (21, None, "n"), (28, "http://c", None), (1, "http://d", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert against_sql(spark, tmp_path, "manifest_differences", pages=pages) == ""


def test_near_copies_fold_and_crowded_shingles_go_last(spark):
    common = " ".join(f"c{k}" for k in range(60))
    texts = [" ".join(f"w{d}x{k}" for k in range(300)) + " " + common for d in range(40)]
    rows = [(d, x) for d, x in enumerate(texts)] + [(100 + d, x + " more") for d, x in enumerate(texts)] + [(200, texts[3].upper()), (201, "!"), (202, None)]
    records = spark.createDataFrame(rows, "url long, text string")
    sets, prefix, copies = W._prefixes(records, 0.86, 8, "url")
    # the passage in all texts has 53 runs of eight words, which no set of 345 or more needs in its first seventh
    assert prefix.groupBy("t").count().agg({"count": "max"}).first()[0] <= 2
    assert {r.id: r.copies for r in copies.filter("copies > 1").collect()} == {3: 2}
    found = {(r.left, r.right) for r in W.near_duplicates(records).collect()}
    assert found == {(d, 100 + d) for d in range(40)}
    members = W.near_groups(records)[0].collect()
    assert {(r.url, r.group) for r in members} == {(d, d % 100) for d in [*range(40), *range(100, 140)]}


def exchanges(df, capsys):
    capsys.readouterr()
    df.explain()
    return [x for x in capsys.readouterr().out.splitlines() if "Exchange " in x]


def test_chunks_shuffle_pages_once_by_document(spark, capsys):
    rows = [(f"d{d}", f"d{d}.pdf", f"corpus/d{d}.pdf", p, f"Heading {d}\n" + f"word{d} and {p} more text here " * 30 + "\nfooter") for d in range(6) for p in (1, 2, 3)]
    pages = spark.createDataFrame(rows, "doc_id string, file_name string, source_path string, page_num int, clean_text string")
    fixed, both = exchanges(C.fixed_size_chunks(pages), capsys), exchanges(C.ingest(pages), capsys)
    # the second strategy's is the same one again
    assert len(fixed) == 1 and len(both) == 2 and all("hashpartitioning(doc_id" in x for x in both)
    assert "footer" not in C.fixed_size_chunks(pages).first().text
    tasks = C.fixed_size_chunks(pages).select(F.spark_partition_id().alias("p"), "doc_id").distinct().groupBy("doc_id").count()
    assert {r["count"] for r in tasks.collect()} == {1}


def test_a_merge_writes_buckets_in_several_tasks(spark, tmp_path):
    rows = [(f"d{d}", f"d{d}.pdf", f"corpus/d{d}.pdf", 1, f"text of {d}") for d in range(40)]
    pages = spark.createDataFrame(rows, "doc_id string, file_name string, source_path string, page_num int, text string")
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    assert [store.merge(pages), store.merge(pages.filter("doc_id = 'd7'").withColumn("text", F.lit("new")))] == [1, 2]
    files = store.read("pages", 1).select(F.input_file_name().alias("f"), store.bucket().alias("b")).distinct().groupBy("b").count()
    assert all(r["count"] > 1 for r in files.collect())
    texts = {r.doc_id: (r.text, r.clean_text, r.digest is not None) for r in store.read("pages").collect()}
    assert texts == {f"d{d}": (("new",) * 2 if d == 7 else (f"text of {d}",) * 2) + (True,) for d in range(40)}


def vectors_with_copies(spark, n=600, width=37, distinct=90):
    own = np.random.default_rng(5).normal(size=(distinct, width)).astype("float32")
    rows = [(k, "even" if k % 2 == 0 else "odd", own[k * 7 % distinct].tolist()) for k in range(n)]
    rows[3], rows[10], rows[11] = (3, "odd", [0.0] * width), (10, "even", None), (11, "odd", [1.0, 2.0])
    rows[12] = (12, "even", [float("nan")] + [1.0] * (width - 1))
    return rows, spark.createDataFrame(rows, "chunk_id long, strategy string, embedding array<float>")


def test_search_deals_pairs_of_blocks_to_tasks_and_keeps_ties_in_order(spark, capsys, monkeypatch):
    rows, vectors = vectors_with_copies(spark)
    asked = vectors.filter("chunk_id % 20 < 13").select(F.col("chunk_id").alias("question_id"), "embedding")
    monkeypatch.setattr(R, "BLOCK", 100)
    monkeypatch.setattr(R, "SLICE", 37 * 80)
    near = R.nearest(asked, vectors, 15)
    # one block of questions is no longer one task: as many as pairs, which AQE does not join up
    dealt = [x for x in exchanges(near, capsys) if "hashpartitioning(block" in x]
    assert len(dealt) == 2 and all("slice" in x and "REPARTITION_BY_NUM" in x for x in dealt)
    pairs = 4 * 8
    assert all(f", {2 * pairs})" in x for x in dealt)
    good = [(k, s, np.array(e, float)) for k, s, e in rows if e and len(e) == 37 and k not in (3, 12)]
    want = set()
    for q, _, a in good:
        if q % 20 < 13:
            for strategy in ("even", "odd"):
                each = sorted((round(1 - float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), 12), c) for c, s, b in good if s == strategy)
                want |= {(q, strategy, c, at + 1) for at, (_, c) in enumerate(each[:15])}
    got = {(r.question_id, r.strategy, r.chunk_id, r.vector_rank) for r in near.collect() if r.question_id != 11}
    assert got == want
    assert {(r.strategy, r.chunk_id) for r in near.filter("question_id = 11").collect()} == {("odd", 11)}


def test_chat_records_search_once(spark, capsys):
    _, vectors = vectors_with_copies(spark)
    asked = vectors.filter("chunk_id in (0, 3, 20)").select(F.col("chunk_id").alias("question_id"), F.lit("what?").alias("question"), "embedding")
    chunks = vectors.select(
        "chunk_id", *[F.lit(x).alias(n) for n, x in (("doc_id", "d"), ("file_name", "f"), ("source_path", "s"), ("section_title", "t"))],
        F.lit(1).alias("page_start"), F.col("chunk_id").cast("int").alias("page_end"), F.concat(F.lit("text "), "chunk_id").alias("text"))
    answers = spark.createDataFrame([(0, "It is [C1]."), (20, "I cannot find it.")], "question_id long, answer string")
    hits = R.hybrid(asked, vectors, chunks, 3)
    records = G.chat_records(asked, hits, answers, 4, 2)
    capsys.readouterr()
    records.explain()
    assert capsys.readouterr().out.count("FlatMapCoGroupsInArrow") == 1
    got = {r.question_id: r for r in records.collect()}
    assert {k: (r.refused, r.answer, r.corpus_version, r.index_version) for k, r in got.items()} == {0: (False, "It is [C1].", 4, 2), 3: (True, None, 4, 2), 20: (True, "I cannot find it.", 4, 2)}
    assert (got[3].citations_json, got[3].evidence_json, got[3].retrieval_score) == ("[]", "[]", None)
    cited, evidence = json.loads(got[0].citations_json), json.loads(got[0].evidence_json)
    own = hits.filter("question_id = 0").orderBy("rank").collect()
    assert [(c["label"], c["chunk_id"]) for c in cited] == [(f"C{k + 1}", h.chunk_id) for k, h in enumerate(own)] and len(own) == 3
    assert list(cited[0])[:6] == ["label", "chunk_id", "file_name", "source_path", "document", "section_title"] and "text" not in cited[0]
    assert [e["text"] for e in evidence] == [h.text for h in own] and "document" not in evidence[0]
    assert got[0].retrieval_score == max(h.score for h in own)
