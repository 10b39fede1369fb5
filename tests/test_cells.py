"""Search over cells against all pairs."""

import numpy as np
import pytest

from granary.operators import cells as K

VECTOR = "chunk_id long, strategy string, embedding array<double>"


def brute(questions, rows, k):
    out = {}
    for q, e in questions:
        for s in {r[1] for r in rows}:
            held = []
            for c, own, v in rows:
                if own != s or e is None or v is None or len(v) != len(e) or None in v or None in e:
                    continue
                a, b = np.array(e), np.array(v)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                if np.isfinite(size) and size > 0:
                    held.append((round(1 - float(a @ b) / size, 9), c))
            out |= {(q, s, c, rank): x for rank, (x, c) in enumerate(sorted(held)[:k], 1)}
    return out


def found(hits):
    return {(r.question_id, r.strategy, r.chunk_id, r.vector_rank): r.distance for r in hits.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_clustered_vectors_skip_most_cells_and_lose_nothing(spark, seed, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)  # several slices a cell and several blocks of questions
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 8)) * 10
    # a third of the rows lies in one cell
    owner = np.where(rng.random(900) < 0.35, 0, rng.integers(0, 12, 900))
    rows = [(i, "ab"[i % 2], (middle[c] + rng.normal(size=8)).tolist()) for i, c in enumerate(owner)]
    asked = [(i, (middle[i % 12] + rng.normal(size=8)).tolist()) for i in range(150)]
    index = K.build_cells(spark.createDataFrame(rows, VECTOR), cells=24)
    questions = spark.createDataFrame(asked, "question_id long, embedding array<double>")
    hits, visits = K.search_cells(questions, index, 5)
    got, want = found(hits), brute(asked, rows, 5)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)
    report = {r.strategy: r for r in K.cell_report(questions, index, visits).collect()}
    assert sum(r.vectors for r in report.values()) == 900
    assert all(r.pairs_read < 0.6 * r.vectors * r.questions for r in report.values())
    assert visits.count() == visits.distinct().count()


def test_vectors_that_match_nothing_ties_and_null_strategies(spark):
    inf = float("inf")
    rows = [
        (1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (2, "a", [2.0, 0.0]), (3, None, [0.0, 1.0]), (4, "a", [0.0, 0.0]), (5, "a", None), (6, "a", [1.0, None]),
        (7, "a", [inf, 1.0]), (8, "a", [1.0, 2.0, 3.0]), (9, "a", []), (10, "b", None),
    ]
    asked = [(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [0.0, 1.0])]
    questions = spark.createDataFrame(asked, "question_id long, embedding array<double>")
    hits = K.nearest_in_cells(questions, spark.createDataFrame(rows, VECTOR).selectExpr("*", "1 as place", "2 as question_id"), 2)
    assert sorted((r.question_id, r.strategy or "", r.vector_rank, r.chunk_id, r.distance) for r in hits.collect()) == [
        (1, "", 1, 3, 1.0), (1, "a", 1, 1, 0.0), (1, "a", 2, 2, 0.0), (5, "", 1, 3, 0.0), (5, "a", 1, 1, 1.0), (5, "a", 2, 2, 1.0)]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], VECTOR), spark.createDataFrame([(1, "a", [1.0, 0.0])], VECTOR)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, embedding array<double>")
    assert K.nearest_in_cells(asked, none, 3).count() == 0
    assert K.nearest_in_cells(asked.limit(0), some, 3).count() == 0
