"""Null and repeated keys among linked vectors; near lines of every length."""

import random
import time

from pyspark.sql import functions as F

from granary.llm import ego_join, line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], DOCS)


def test_null_and_repeated_keys_of_vectors(spark):
    rows = [(None, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.02]), (7, [-1.0, 0.0]), (None, None), (9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("name", F.lit("clash")).withColumn("rep", F.lit(1))
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in ego_join.cosine_links(df).collect())
    assert got == sorted([
        (-1, 1, 2, False), (2, 1, 2, True), (-1, 1, -1, True), (-1, 1, -1, True), (7, 2, 7, True), (7, 2, 7, True), (7, 2, 7, True), (-1, 0, -1, True), (9, 0, 9, True),
    ])


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def test_segments_cut_again_lose_no_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_SEGMENT", 2)
    rng = random.Random(8)
    base = ["".join(rng.choice("abc ") for _ in range(n)) + "z" for n in (1, 2, 5, 33, 64, 65, 200, 331)]
    lines = []
    for _ in range(160):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(x))
            x[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "r"])
        lines.append("".join(x) or "z")
    got = [r.text for r in line_dedup.dedup_lines(docs(spark, lines)).orderBy("doc_id").collect()]
    for i, x in enumerate(lines):
        gone = x.strip() and any(x == y or near(x, y) for y in lines[:i] if y.strip())
        assert (got[i] == "") == bool(gone) or got[i] == x == "", (i, x)


def test_very_long_lines(spark):
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefgh ", k=1_000_000))
    texts = [line, line[:500_000] + "#" + line[500_001:], line[:10] + line[11:], line[:-2] + "??"]
    began = time.time()
    got = [r.text for r in line_dedup.dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == line and got[1] == got[2] == "" and got[3] == texts[3]
    assert time.time() - began < 120
