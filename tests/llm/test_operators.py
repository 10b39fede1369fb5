"""The ten operators against brute force, exact round trips and planted cases, with nulls, ties and empty tables."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import ego_join, jaccard_join, line_dedup, lm, packing, reputation, sharding, sp_codec, topk, toxicity
from granary.llm import queries as q
from tests.compare import differences

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = q.tokenizer_file("word_bpe_49k.json")
PIECES = q.tokenizer_file("piece_bpe_32k.model")


def docs(spark, texts):
    return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, name, q.QUERIES[name], q.ORACLE_SQL[name], FOLDER) == ""


# --- sharding ---


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(1)
    texts = ["same text"] * 150 + ["x" * rng.randrange(1, 60) for _ in range(300)] + [None, "", "é" * 10]
    df = docs(spark, texts).withColumn("size", F.lit("clash"))
    got = sharding.histogram_shards(df, 4, piece_bytes=1000).collect()
    assert len(got) == len(texts) and all(r.size == len((r.text or "").encode()) + 1 for r in got)
    byte = [sum(r.size for r in got if r.shard == k) for k in range(4)]
    assert max(byte) - min(byte) <= 2 * 60 + 4
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_shards_of_repeated_rows_and_of_none(spark):
    one = docs(spark, ["a"]).crossJoin(spark.range(50)).drop("id")
    got = sharding.histogram_shards(one, 4, piece_bytes=10).collect()
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        assert 12 <= sum(r.shard == k for r in got) <= 13
    nulls = spark.createDataFrame([(None, "same", "a.b")] * 40, "doc_id long, text string, `a.b` string")
    names = ["row", "h", "i", "s", "piece", "first", "_h", "_i", "_p"]
    got = sharding.histogram_shards(nulls.withColumns({n: F.lit(n) for n in names}), 4).collect()
    assert all(9 <= sum(r.shard == k for r in got) <= 11 for k in range(4)) and all([r[n] for n in names] == names for r in got)
    assert sharding.histogram_shards(docs(spark, ["a"]).limit(0), 4).count() == 0


# --- language model ---


def test_unigram_base_and_normalised_classes(spark):
    texts = ["the cat sat", "The dog sat down", "", None, "new words only", "the cat"] * 5
    df = docs(spark, texts)
    held = F.col("doc_id") % 5 == 4
    got = {r.doc_id: r for r in lm.language_model_scores(df, held).collect()}
    tokens = lambda x: [*(x or "").lower().split(), None]
    train = [t for i, x in enumerate(texts) if i % 5 != 4 for t in tokens(x)]
    n, v = len(train), len(set(train))
    for i, x in enumerate(texts):
        want = sum(np.log10((train.count(t) + 1) / (n + v + 1)) for t in tokens(x))
        assert abs(got[i].base_score - want) < 1e-9 and got[i].n_tokens == len(tokens(x)) and got[i].train_tokens == n
        assert got[i].n_known == sum(t in train for t in tokens(x)) and got[i].score < 0
    model = lm.start(np.full(lm.OWN + lm.SHARED, 1 / (lm.OWN + lm.SHARED)))
    one, two, norm = lm._tables(model)
    assert abs(np.exp(one[3] + two[5] - norm[3, 5]).sum() - 1) < 1e-5


def test_contrastive_estimation_learns_what_follows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a b", "c d"]) for _ in range(400)) for _ in range(60)]
    got = lm.language_model_scores(docs(spark, texts), F.col("doc_id") % 5 == 0).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 100


def test_language_model_without_rows(spark):
    assert lm.language_model_scores(docs(spark, ["a"]).limit(0), F.lit(False)).count() == 0
    assert lm.language_model_scores(docs(spark, ["a b"]), F.lit(True)).first().n_known == 0


# --- toxicity ---


def test_toxic_words_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(200)]
    texts = []
    for i in range(400):
        x = [rng.choice(common) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                x[rng.randrange(60)] = rng.choice(["zzvile", "qqrotten"])
        texts.append(" ".join(x))
    df = docs(spark, texts)
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(df.filter("doc_id < 300"), labels.filter("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert min(got[i] for i in range(300, 400, 4)) > max(got[i] for i in range(300, 400) if i % 4)
    edge = toxicity.score(docs(spark, [None, "", "zzvile " * 50_000]).withColumn("score", F.lit("clash")), model).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 for r in edge) and edge[2].score > 0.7
    assert toxicity.score(df.limit(0), model).count() == 0


def test_every_toxic_word_that_passes_is_used(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    common, bad = [word("abcdefghij") for _ in range(200)], [word("klmnopqrst") for _ in range(150)]
    texts = []
    for i in range(1200):
        x = [rng.choice(common) for _ in range(60)]
        if i % 4 == 0:
            x[3:60:6] = [bad[(10 * (i // 4) + j) % 150] for j in range(10)]
        texts.append(" ".join(x))
    df = docs(spark, texts)
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert all(f" {w}".encode() in model.toxic for w in bad)
    alone = [" ".join(common[k : k + 30] + [w, common[0]] * 10 + common[k : k + 30]) for k, w in enumerate(bad)]
    assert min(r.score for r in toxicity.score(docs(spark, alone), model).collect()) > 0.7


def test_toxicity_of_one_class_only(spark):
    df = docs(spark, ["a", "b"])
    model = toxicity.fit(df, df.select("doc_id", F.lit(0).alias("toxic")))
    assert all(r.score < 0.5 for r in toxicity.score(df, model).collect())


# --- reputation ---


def test_rules_hosts_and_nulls(spark):
    rows = [(1, "http://A.Example.com/en/7?x"), (2, "https://x.net/de/1#f"), (3, None), (4, "no scheme"), (5, "http://notnet/de/"), (6, "http://b.example.net/de/88")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in reputation.host_reputation(pages, none, [reputation.rule(x) for x in q.HOST_RULES]).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/de/", "block") and got[5].rule is None
    assert (got[3].host, got[3].path, got[4].host) == ("", "", "") and got[6].rule == "example.net/de/8"


def test_registered_domains(spark):
    lines = ("co.uk", "*.ck", "!www.ck", "com", "a.b.com")
    cases = {
        "x.y.co.uk:80": ("y.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "me@shop.example.com.": ("example.com", "com"),
        "example.com.:443": ("example.com", "com"),
        "p.q.r.ck": ("q.r.ck", "r.ck"),
        "p.www.ck": ("www.ck", "ck"),
        "ck": ("ck", "ck"),
        "z.a.b.com": ("z.a.b.com", "a.b.com"),
        "one.two.three": ("two.three", "three"),
        "10.0.0.1:8080": ("10.0.0.1", reputation.ADDRESS),
        "[::1]:80": ("[::1]", reputation.ADDRESS),
        "": ("", ""),
        ".": ("", ""),
    }
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    got = hosts.select("host", *reputation.domain_parts(F.col("host"), lines)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases


def test_no_pages_and_repeated_ones(spark):
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 200_000), (1, "http://a.com/" + "x" * 200_000), (None, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (None, 1)], "page_id long, bad int")
    got = reputation.host_reputation(pages, outcomes, []).collect()
    assert sorted((r.page_id or 0, r.host, r.n_labelled) for r in got) == [(0, "", 0), (1, "a.com", 2), (1, "a.com", 2)]
    assert reputation.host_reputation(pages.limit(0), outcomes, []).count() == 0


def test_bad_host_is_blocked_and_rare_one_is_shrunk(spark):
    hosts = ["bad.a.com"] * 60 + ["once.a.com"] + [f"ok{k}.a.com" for k in range(20) for _ in range(10)]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    outcomes = pages.select("page_id", F.contains("url", F.lit("bad")).cast("int").alias("bad")).withColumn("bad", F.when(F.contains(F.lit("x"), F.lit("y")), 0).otherwise(F.col("bad")))
    outcomes = outcomes.withColumn("bad", F.when(F.col("page_id") == 60, 1).otherwise(F.col("bad")))
    got = {r.host: r for r in reputation.host_reputation(pages, outcomes, []).collect()}
    assert got["bad.a.com"].verdict == "block" and got["ok3.a.com"].verdict == "allow"
    assert got["once.a.com"].bound < got["bad.a.com"].bound


# --- vectors ---


def brute_links(rows, least):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for a, b in itertools.combinations(good, 2):
        if good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= least:
            links[a].add(b)
            links[b].add(a)
    return links


def reach(links):
    out = {}
    for i in sorted(links):
        if i in out:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return out


def test_cosine_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK", 40)
    monkeypatch.setattr(ego_join, "LEAF", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(scale=0.12, size=8)).astype("f4").tolist()) for i in range(150)]
    rows += [(150 + k, rows[0][1]) for k in range(40)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] + [1.0] * 7)]
    got = {r.vec_id: r for r in ego_join.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    links = brute_links(rows, 0.9)
    comp = reach(links)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def test_vector_operators_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ego_join.cosine_links(none).count() == 0 and topk.exact_top_k(none, F.col("vec_id") % 2 == 0, 5).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(size=6) * (rng.random(6) < 0.5), 1).tolist()) for i in range(120)]
    rows += [(120 + k, rows[3][1]) for k in range(20)] + [(200, None), (210, [float("inf")] * 6)]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5).collect()
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v and np.isfinite(v).all()}
    for i in (k for k in good if k % 10 == 0):
        want = sorted(((-int(good[i] @ good[j]), j) for j in good if j != i))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


# --- sentencepiece ---


def test_pieces_equal_the_library_and_come_back(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    texts = [r.text for r in q.table(spark, FOLDER, "documents").limit(60).collect()]
    texts += ["".join(rng.choice(" aàbcdeT.\n\t😀1é  ßinger") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " ", "  a", "x" * 5000, "▁a▁▁b"]
    got = sp_codec.decode(sp_codec.encode(docs(spark, [*texts, None]), PIECES), PIECES).orderBy("doc_id").collect()
    for r, x in zip(got, texts):
        assert r.ids == model.encode(x) and (r.decoded == x or "▁" in x)
    assert got[-1].ids == [] and got[-1].decoded == ""
    assert sp_codec.encode(docs(spark, ["a"]).limit(0), PIECES).count() == 0


def test_unigram_walk_equals_all_segmentations():
    voc = sp_codec.Vocabulary.__new__(sp_codec.Vocabulary)
    voc.kind = "unigram"
    voc.load({p: (k, -float(s)) for k, (p, s) in enumerate({"▁": 3, "▁a": 2, "a": 4, "b": 4, "ab": 3.5, "▁ab": 5, "ba": 3, "bb": 9}.items())})
    words = sorted("▁" + "".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n))

    def best(w):
        if not w:
            return 0.0
        return max(voc.pieces[w[:k]][1] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in voc.pieces)

    for w, parts in zip(words, sp_codec.walk(words, voc)):
        assert "".join(parts) == w and abs(sum(voc.pieces[p][1] for p in parts) - best(w)) < 1e-9


# --- near copies ---


def shingles(x, n=5):
    w = (x or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_jaccard_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 10)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    texts, hot = [], [rng.choice(words) for _ in range(120)]
    for k in range(160):
        if k < 60:  # one large group of near copies
            x = list(hot)
            x[rng.randrange(120)] = f"new{k}"
        elif k % 3:
            x = texts[-1].split()
            x[rng.randrange(len(x))] = f"v{k}"
        else:
            x = [rng.choice(words) for _ in range(rng.randrange(3, 80))]
        texts.append(" ".join(x))
    texts += [texts[0]] * 30 + ["", None, "one two", "One  two", "\n"]
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(docs(spark, texts)).collect()}
    sets = [shingles(x) for x in texts]
    links = {i: set() for i in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    comp = reach(links)
    assert {i: (r.n_links, r.class_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def test_jaccard_without_rows(spark):
    assert jaccard_join.jaccard_links(docs(spark, ["a"]).limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.9999, 0.8) >= jaccard_join.runs_for(0.99, 0.8) >= 2


# --- packing ---


def test_pieces_equal_the_tokenizer_and_fill_sequences(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [r.text for r in q.table(spark, FOLDER, "documents").collect()] + [None, "", "İı ß don't 12,3. <|endoftext|> A,b.", "word " * 9000]
    cut = packing.pieces(docs(spark, texts), WORDS, 512, 1, with_ids=True)
    got = packing.pack(cut.withColumn("offset", F.lit("clash")), 512).cache()
    rows = got.collect()
    for i, x in enumerate(texts):
        ids = tokenizer.encode(x or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [k for r in own for k in r.ids] == ids and [r.start for r in own] == list(range(0, len(ids), 512))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(held)))
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(by) <= -(-sum(r.length for r in rows) // 512) * 1.02 + 1
    assert sorted(len(s.ids) for s in packing.sequences(got).collect()) == sorted(sum(n for _, n in h) for h in by.values())


def test_plan_uses_exact_complements():
    made = packing.plan({60: 3, 40: 3, 50: 2, 30: 2, 20: 2, 25: 3, 100: 1}, 100)
    assert sum(t for _, t in made) == 7
    used = {}
    for pattern, times in made:
        assert sum(n * k for n, k in pattern) <= 100
        for n, k in pattern:
            used[n] = used.get(n, 0) + k * times
    assert used == {60: 3, 40: 3, 50: 2, 30: 2, 20: 2, 25: 3, 100: 1}


def test_packing_keeps_columns_of_any_name(spark):
    names = ["row", "n", "salt", "k", "base", "rank", "at", "_salt", "_base", "_length", "_rank", "_at", "a.b"]
    df = spark.createDataFrame([(k % 3, 5, *names) for k in range(9)], ["doc_id", "length", *names])
    got = packing.pack(df, 10).collect()
    assert len(got) == 9 and all([r[n] for n in names] == names for r in got) and len({r.sequence_id for r in got}) == 5


def test_packing_edges(spark):
    assert packing.pack(packing.pieces(docs(spark, ["a"]).limit(0), WORDS, 64, 1), 64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 65)], "doc_id long, length long"), 64)
    same = packing.pack(spark.createDataFrame([(1, 10)] * 1000, "doc_id long, length long"), 64).collect()
    assert len({(r.sequence_id, r.offset) for r in same}) == 1000 and len({r.sequence_id for r in same}) == 167


# --- lines ---


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    lines, texts = ["short", "short", "", "  "], []
    for k in range(120):
        x = "".join(rng.choice("abcé ") for _ in range(rng.choice([12, 25, 40, 90])))
        lines.append(x)
        p = rng.randrange(len(x))
        lines.append(rng.choice([x, x[:p] + "z" + x[p:], x[:p] + x[p + 1 :], x[:p] + "z" + x[p + 1 :], x[:p] + "zz" + x[p + 2 :]]))
    rng.shuffle(lines)
    while lines:
        n = rng.randrange(1, 6)
        texts.append("\n".join(lines[:n]))
        lines = lines[n:]
    texts += [None, "", texts[0]]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts).withColumn("n_lines", F.lit("clash"))).collect()}
    seen = []
    for i, x in enumerate(texts):
        if x is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        keep = []
        for line in x.split("\n"):
            if not line.strip():
                keep.append(line)
                continue
            if not any(near(line, y) for y in seen):
                keep.append(line)
            seen.append(line)
        assert (got[i].text, got[i].n_removed) == ("\n".join(keep), len(x.split("\n")) - len(keep)), i


def kept_lines(rows):
    """[(id, text without repeated lines)] of rows (id, text) in the order that the operator states; rows are distinct."""
    seen, out = [], []
    for i, x in rows:
        left = []
        for line in x.split("\n"):
            if not line.strip():
                left.append(line)
                continue
            if not any(near(line, y) for y in seen):
                left.append(line)
            seen.append(line)
        out.append((i, "\n".join(left)))
    return out


def test_lines_of_repeated_and_null_ids(spark):
    rng = random.Random(21)
    pool = ["".join(rng.choice("abc d") for _ in range(rng.choice([1, 2, 3, 6, 22]))) for _ in range(60)]
    rows = {(rng.choice([1, 1, 2, None, None]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 4)))) for _ in range(40)}
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    order = df.orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")).collect()
    got = line_dedup.dedup_lines(df.withColumn("before", F.col("text"))).collect()
    want = dict(zip([(r.doc_id, r.text) for r in order], [t for _, t in kept_lines([(r.doc_id, r.text) for r in order])]))
    assert {(r.doc_id, r.before): r.text for r in got} == want
    unique = spark.createDataFrame([(1, "foo bar\nunique one"), (1, "unique two\nother")], "doc_id long, text string")
    assert {r.text for r in line_dedup.dedup_lines(unique).collect()} == {"foo bar\nunique one", "unique two\nother"}
    twice = spark.createDataFrame([(1, "a long line\na long line")] * 3 + [(2, "a long line")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(twice).collect()) == ["", "a long line", "a long line", "a long line"]


def test_lines_keep_columns_of_any_name_and_long_texts(spark):
    names = ["id", "th", "no", "at", "h", "g", "row", "parts", "line", "gone", "gone_id", "first", "near", "a.b", "c`d"]
    long = "\n".join(f"line {k} of a very long text with number {k * k}" for k in range(20_000))
    df = spark.createDataFrame([(1, long, *names), (2, "line 7 of a very long text with number 49\nnew", *names)], ["doc_id", "text", *names])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert [got[2][n] for n in names] == names and got[2].text == "new"
    assert got[1].n_lines == 20_000 and got[1].n_removed == long.count("\n") + 1 - len(got[1].text.split("\n"))


def test_lines_without_rows(spark):
    assert line_dedup.dedup_lines(docs(spark, ["a"]).limit(0)).count() == 0
