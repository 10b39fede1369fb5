"""Repeated strings against brute force on all windows, with nulls, short and long texts, overlaps, copies and hot strings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import repeats


def brute(texts, width):
    data = [(x or "").encode() for x in texts]
    seen = Counter(d[k : k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        runs = [k for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((sum(gone), len(runs), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def result(spark, texts, width):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = repeats.remove_repeats(df, width).orderBy("doc_id").collect()
    return [(sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows]


def texts_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(130), prose(70)
    out = [None, "", "short", "x" * 399, "x" * 400, "x" * 401, "y" * 900, "ab" * 700, prose(2000), prose(2000)]
    for _ in range(40):
        out.append(prose(rng.randrange(60)) + " " + passage[: rng.randrange(300, len(passage))] + prose(rng.randrange(60)))
        near = list(passage + prose(30))
        near[rng.randrange(len(near))] = "#"
        out.append("".join(near))
        out.append(prose(20) + line + prose(20))
    twice = prose(200)
    return out + [twice, twice, twice + prose(50) + twice, passage, passage]


@pytest.mark.parametrize("most", [4096, 8])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    texts = texts_of(most)
    assert result(spark, texts, 400) == brute(texts, 400)


@pytest.mark.parametrize("width", [7, 50, 333])
def test_other_widths(spark, width):
    texts = texts_of(width)[:40]
    assert result(spark, texts, width) == brute(texts, width)


def test_suffixes_alike_equal_brute_force():
    rng = random.Random(5)
    for width in (8, 21, 64):
        data = bytes(rng.choice(b"ab") for _ in range(3000)) + bytes(range(64)) * 8
        starts = np.array(rng.sample(range(len(data) - width), 1500))
        bucket = np.array([rng.randrange(3) for _ in starts])
        seen = Counter((b, data[s : s + width]) for s, b in zip(starts.tolist(), bucket.tolist()))
        want = [seen[b, data[s : s + width]] > 1 for s, b in zip(starts.tolist(), bucket.tolist())]
        assert repeats.alike(np.frombuffer(data, np.uint8), starts, bucket, width).tolist() == want


def test_long_texts_are_cut_into_tiles_without_loss(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    (a, n), (b, m) = (1_048_000, 1500), (300, 700)
    texts = [long, "start " + long[a : a + n] + " end", long[b : b + m]]
    got = result(spark, texts, 400)
    assert [g[:2] for g in got] == [(n + m, 2), (n, 1), (m, 1)] and got[1][2] == b"start  end"


def test_clashing_names_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "z" * 500), (1, "z" * 500), (None, "q")], "doc_id long, text string")
    clash = df.withColumns({n: F.lit(n) for n in ["row", "mid", "bits", "los", "ws", "gram", "spans", "kept"]}).withColumn("a.b", F.lit(1))
    got = repeats.remove_repeats(clash).collect()
    assert len(got) == 3 and sorted(len(r.kept) for r in got) == [0, 0, 1] and all(r.row == "row" and r["a.b"] == 1 for r in got)
    assert repeats.remove_repeats(df.limit(0)).count() == 0
