"""The pipeline over the smallest tables, stage by stage."""

import corpus_pipeline as p
from granary.llm.queries import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = table(spark, FOLDER, "documents")
    left = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, left, FOLDER).cache()
        assert out.columns == docs.columns and 0 < out.count() <= left.count(), name
        left = out
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    packed = p.STAGES[-1][1](spark, left, FOLDER).collect()
    assert {r.doc_id for r in packed} == ids


def test_run(spark):
    assert p.run(spark, FOLDER).count() > 0


def test_planted_cases(spark):
    base = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"term{k}" for k in range(80))
    rows = [(1, base), (2, base + " more"), (3, other), (4, ""), (5, None), (6, other)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], table(spark, FOLDER, "documents").schema)
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, docs, FOLDER).collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in p.drop_lines(spark, docs, FOLDER).collect()) == [1, 2, 3, 4, 5]


def test_stages_keep_columns_of_any_name_nulls_and_no_rows(spark):
    names = ["score", "_score", "n_removed", "n_lines", "_id", "_th", "th", "own_id", "own_th", "row", "rest", "parts", "gone", "a.b"]
    texts = [(1, "alpha beta gamma delta epsilon zeta\nline two here"), (None, "some other words in a line of text"), (None, "keepme\nyyy"), (5, None), (6, "")]
    texts += [(7, texts[0][1]), (8, "word " * 60_000)]
    kinds = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, x, len(x or ""), *names) for i, x in texts], kinds)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all([r[n] for n in names] == names for r in rows), name
        left = {(r.doc_id, r.text) for r in rows}
        # the later copy goes where copies or lines are judged; everything else stays
        gone = set() if name == "toxicity" else {(7, texts[0][1])}
        assert left == set(texts) - gone, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    assert p.STAGES[-1][1](spark, docs, "").count() == 6 + -(-60_001 // 4096)
