"""Records, labels and evaluation files on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import analytics as A
from granary.operators import answers as G
from granary.operators import evaluation as E
from granary.sources import tables as S


def test_evaluation_files_come_back_and_broken_records_are_set_apart(spark, tmp_path):
    whole = {"id": "a", "strategies": {"x": {"hits": [{"t": 1}, {"t": 2}], "f1": 0.5}, "y": {"hits": []}}}
    records = [whole, {"id": "b"}, {"strategies": {}}, 7, {"id": "c", "strategies": {"x": {"hits": 3}}}, {"id": "d", "strategies": {}}, {"id": "d", "strategies": {}}]
    (tmp_path / "one.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps([whole]) + "]")
    (tmp_path / "blank.json").write_text("  ")
    got = S.read_evaluation(spark, str(tmp_path))
    assert [(r.id, r.strategy, r.rank, r.t) for r in got.hits.select("id", "strategy", "rank", F.variant_get("hit", "$.t", "int").alias("t")).orderBy("rank").collect()] == [("a", "x", 1, 1), ("a", "x", 2, 2)]
    assert sorted((r.id, r.strategy) for r in got.runs.collect()) == [("a", "x"), ("a", "y"), ("c", "x")]
    problems = sorted((r.file.rsplit("/", 1)[1], r.pos, r.id or "", r.problem) for r in got.problems.collect())
    assert problems == [("bad.json", 0, "", "unreadable"), ("one.json", 1, "b", "no strategies"), ("one.json", 2, "", "no id"), ("one.json", 3, "", "not an object"),
                        ("one.json", 4, "c", "no hits list: x"), ("one.json", 5, "d", "double id"), ("one.json", 6, "d", "double id")]


@pytest.mark.parametrize("text", ['{"id": "a"} {"id": "b"}', '{"id": "a"},{"id": "b"}', '{"id": "a"}}', '{"id": "a"', "]["])
def test_a_line_holds_one_record(spark, tmp_path, text):
    (tmp_path / "f").write_text(text + "\n")
    assert [r.problem for r in S.read_evaluation(spark, str(tmp_path), lines=True).problems.collect()] == ["unreadable"]


def test_written_metrics_can_be_read_again(spark, tmp_path):
    metrics = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.25)], "id string, strategy string, f1 double")
    S.write_evaluation(metrics, str(tmp_path / "m"))
    got = S.read_evaluation(spark, str(tmp_path / "m"), lines=True)
    assert sorted((r.id, r.strategy, r.f1) for r in got.runs.select("id", "strategy", F.variant_get("run", "$.f1", "double").alias("f1")).collect()) == [("a", "x", 0.5), ("a", "y", 0.25)]
    assert {r.problem for r in got.problems.collect()} == {"no hits list: x", "no hits list: y"}


def test_score_texts_resolutions_and_own_rows(spark):
    scores = spark.createDataFrame([(0.125,), (1.5,), (-1.0,), (None,)], "x double").select(A.score_percent(F.col("x")), A.boost_points(F.col("x"))).collect()
    assert [tuple(r) for r in scores] == [("13%", "+13 pts"), ("100%", "+150 pts"), ("0%", "+0 pts"), ("N/A", "N/A")]
    items = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    done = spark.createDataFrame([("refused", "1", "old", True, 1, 5), ("refused", "1", "new", True, 2, 6), ("refused", "2", "n", True, 1, 9), ("low_llm", "2", "n", True, 1, 5)],
                                 "issue_type string, item_key string, note string, active boolean, at int, resolved_by int")
    users = spark.createDataFrame([(5, "five"), (6, "six")], "id int, email string")
    got = {r.id: (r.resolved, r.resolved_at, r.resolved_by_email, r.resolution_note) for r in A.overlay(items, A.resolver_rows(done, users), "refused", "id", True).collect()}
    assert got == {1: (True, 2, "six", "new"), 2: (False, None, None, None), None: (False, None, None, None)}
    assert [r.id for r in A.overlay(items.filter("id is not null"), done.drop("at", "resolved_by"), "refused", "id").collect()] == []
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, user_id int")
    assert [r.id for r in A.own_rows(rows, 5).collect()] == [1] and A.own_rows(rows, 5, True).count() == 3


def test_unreadable_judges_and_missing_citations(spark):
    records = spark.createDataFrame([(1, "x", "a", 0.5, None), (2, "x", "b", 0.5, "{broken"), (3, "x", None, None, '{"overall_score": "4", "failure_modes": []}')],
                                    "question_id int, strategy string, answer string, retrieval_score double, judge_json string")
    cited = spark.createDataFrame([(1, "x", "C1", None, None, 1, None, 0.5, 0.5, 0.0, "x", None)],
                                  "question_id int, strategy string, label string, file_name string, section_title string, page_start int, page_end int, score double, vector_score double, metadata_boost double, source_strategy string, text string")
    got = {r.question_id: r for r in G.compact_results(records, cited).collect()}
    assert [(got[i].judge_overall_score, got[i].judge_failure_modes, len(got[i].citations)) for i in (1, 2, 3)] == [(None, "", 1), (None, "", 0), (4.0, "", 0)]
    assert got[1].citations[0].pages == "1-None" and got[1].citations[0].text == ""
    questions = spark.createDataFrame([(1, "q"), (9, "none")], "question_id int, question string")
    prompt = G.comparison_prompts(questions, records, cited, ["x", "y z"], "Compare.").collect()
    assert len(prompt) == 1 and json.loads(prompt[0].prompt.split("Data:\n")[1])["strategies"]["x"]["answer"] == "a"


def test_label_rules(spark):
    said = spark.createDataFrame([(" Yes ",), ("no",), ("n",), (None,)], "x string").select(E.yes_no(F.col("x"))).collect()
    assert [r[0] for r in said] == [True, False, None, None]
    gold, wanted = (spark.createDataFrame(x, "pos int, id string") for x in ([(1, "a"), (2, "c"), (4, "d")], [(1, "a"), (2, "b"), (3, "c")]))
    assert sorted((r.pos, r.expected or "", r.found or "") for r in E.order_violations(gold, wanted).collect()) == [(2, "b", "c"), (3, "c", ""), (4, "", "d")]
    part, whole = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, q string"), spark.createDataFrame([(1, "b"), (2, None)], "id int, question string")
    assert sorted((r.id, r.problem) for r in E.set_violations(part, whole, {"q": "question"}).collect()) == [(1, "q differs"), (3, "missing")]
