"""Collocations against a count of every phrase, with few and many rounds, nulls, ties, covered phrases and very long words."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import collocations as c

DOCS = "doc_id long, lang string, text string"


def brute(rows, top, least):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        kept = []
        for p, a in f.items():
            if p[0] != lang or len(p) < 3 or a < least:
                continue
            ws = p[1:]
            longer = [q for q in f if q[0] == lang and len(q) > len(p) and f[q] >= least and any(q[i : i + len(ws)] == ws for i in range(1, len(q)))]
            if any(100 * f[q] >= 80 * a for q in longer):
                continue
            cuts = [(2_000_000 * a // (f[(lang, *ws[:k])] + f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
            s, k = min(cuts)
            kept.append((-s, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    fixed = ["New York city hall", "in spite of", "É à la carte", "x y", "Machine learning model"]
    rows = []
    for i in range(150):
        words = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice("alpha beta gamma delta the of a b c".split()) for _ in range(60)]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\r\n", "!?"]) for w in words)
        rows.append((i, rng.choice(["en", "en", "de", None, "und"]), text))
    return rows + [(None, "en", None), (1, "fr", ""), (2, "fr", "..."), (3, "en", "w" * 200_000 + " the end"), rows[0], rows[0]]


@pytest.mark.parametrize("top,first_round", [(2000, 4000), (3, 2)])
def test_equals_brute_force(spark, top, first_round):
    rows = corpus(top)
    got = c.collocations(spark.createDataFrame(rows, DOCS).repartition(3), top=top, least=20, first_round=first_round).collect()
    assert sorted(map(tuple, got)) == brute(rows, top, 20)


def test_passes_of_few_phrases_equal_one_pass(spark, monkeypatch):
    rows = corpus(9)
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(c, "PHRASES", 10)
    monkeypatch.setattr(c, "HELD", 500)
    assert sorted(map(tuple, c.collocations(df, top=20, least=25).collect())) == brute(rows, 20, 25)


def test_bounds_prune_what_cannot_reach_the_last_place(spark, monkeypatch):
    seen = []
    whole = c._expanded
    monkeypatch.setattr(c, "_expanded", lambda s, t, now, *a: seen.append(now.count()) or whole(s, t, now, *a))
    rows = [(i, "en", " . ".join(f"w{k} v{k}" for k in range(40)) + " . " + " . ".join(f"the n{k}" for k in range(200))) for i in range(40)]
    got = c.collocations(spark.createDataFrame(rows, DOCS), top=10, first_round=10).collect()
    assert len(got) == 10 and {r.score for r in got} == {1_000_000} and sum(seen) == 40  # none of the 200 pairs behind `the`


def test_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "en", "a b. " * 40)], DOCS)
    clash = df.withColumns({n: F.lit(n) for n in ["p", "a", "l", "r", "n", "score", "h", "word", "f", "bits"]}).withColumn("a.b", F.lit(1))
    assert [tuple(r) for r in c.collocations(clash).collect()] == [("en", 1, "a b", 40, 40, 40, 80, 1_000_000)]
    assert c.collocations(df.limit(0)).count() == 0
    odd = df.toDF("doc_id", "x.lang", "x.text")
    assert c.collocations(odd, lang="x.lang", text="x.text").count() == 1


def test_scores_stay_exact_past_64_bits(spark):
    one = spark.createDataFrame([(4_000_000_000_000_000_000, 4_000_000_000_000_000_001)], "a long, b long")
    a, b = 4_000_000_000_000_000_000, 4_000_000_000_000_000_001
    assert one.select(c._floor(F.col("a"), F.col("b") + F.lit(b - 2))).first()[0] == 2_000_000 * a // (2 * b - 2)
