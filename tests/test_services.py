"""Duplicate groups, rule tables, term lists, fingerprints, and pages and lines that are very long, against brute force."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import analytics as A
from granary.operators import chunking as C
from granary.operators import rules as Y
from granary.operators import web as W
from granary.sources import fingerprints as H


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def W_(text):
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def test_connected(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 130)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(300, 299), (299, 300), (7, 7)]
    got = {r.id: r.group for r in W.connected(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == components(pairs)


@pytest.mark.parametrize("light", [2])
def test_near_groups_equal_the_pairs_components(spark, light):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(200))
    base = [[word() for _ in range(80)] for _ in range(4)]
    texts = []
    for k in range(90):
        w = list(base[k % 4])
        for _ in range(rng.randrange(0, 3)):  # chains of small edits: not all of a group are alike
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += texts[:5] + ["", "one two", "One, two!", "x " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "url long, text string")
    pairs = [(r.left, r.right) for r in W.near_duplicates(df).collect()]
    members, links = W.near_groups(df, light=light)
    got = members.collect()
    assert {r.url: r.group for r in got} == components(pairs)
    assert {(r.left, r.right) for r in links.collect()} <= set(pairs)
    assert sum(r.copies for r in got) == sum(1 for x in texts if any(W_(x) == W_(texts[r.url]) for r in got))


def test_a_group_of_near_copies_gives_as_many_links_as_members(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(k, f"{text} tail{k}") for k in range(150)], "url long, text string")
    members, links = W.near_groups(df)
    assert members.count() == 150 and {r.group for r in members.collect()} == {0} and links.count() == 149


def test_near_copies_side_by_side_are_moved_once(spark, tmp_path, monkeypatch):
    rows = [(10 * d + k, " ".join(f"w{d}x{j}" for j in range(400)) + f" extra{k}" * k) for d in range(40) for k in range(4)]
    records = spark.createDataFrame(rows, "url long, text string").coalesce(1)
    written = []

    def kept(df, name):
        df.write.parquet(path := str(tmp_path / f"{name}-{len(written)}"))
        written.append(sum(f.stat().st_size for f in tmp_path.glob(f"{name}-{len(written)}/*.parquet")))
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(W, "snapshot", kept)
    members, links = W.near_groups(records)
    assert {(r.url, r.group, r.copies) for r in members.collect()} == {(i, i // 10 * 10, 1) for i, _ in rows}
    assert sorted((r.left // 10, r.right // 10) for r in links.collect()) == sorted((d, d) for d in range(40) for _ in range(3))
    # a text has some 400 runs of 8 bytes: no text's were written whole, let alone those of its copies
    assert sum(written) < 40 * 400 * 8


def test_near_groups_are_the_same_however_rows_lie(spark):
    rng = random.Random(7)
    text = lambda d: [f"w{d}x{k}" for k in range(rng.choice([5, 20, 25, 30, 60]))]
    rows = []
    for d in range(25):
        words = text(d)
        for k in range(4):
            rows.append((f"d{len(rows)}", " ".join(words + [f"extra{k}"] * k)))
        if d % 3 == 0:  # a chain of edits, and copies of it elsewhere
            for k in range(5):
                words = [*words]
                words[rng.randrange(len(words))] = f"e{d}x{k}"
                rows.append((f"d{len(rows)}", " ".join(words)))
    rows += [(f"c{k}", rng.choice(rows)[1].upper()) for k in range(40)] + [(None, rows[0][1]), (None, "only without a key"), ("x0", ""), ("x1", None), ("x2", "!")]
    rows += [(f"y{k}", " ".join(f"hot{j}" for j in range(80)) + f" tail{k % 90}") for k in range(150)]  # more than a bundle holds, with copies
    records = spark.createDataFrame(rows, "url string, text string")
    plain = {i: W_(x) for i, x in rows if i is not None and x is not None and W_(x)}
    least = {n: min(i for i, m in plain.items() if m == n) for n in plain.values()}
    copies = {least[n]: sum(x is not None and W_(x) == n for _, x in rows) for n in least}
    found = [(r.left, r.right) for r in W.near_duplicates(records.filter("url is not null")).collect()]
    group = components(found)
    want = {(i, g, copies[i]) for i, g in group.items()}
    dealt = [records.coalesce(1), records.repartition(7, "text"), records.orderBy(F.xxhash64("url")).repartition(5)]
    for df, light in zip(dealt, (32, 32, 2)):
        members, links = W.near_groups(df, light=light)
        assert {tuple(r) for r in members.collect()} == want
        given = {(r.left, r.right) for r in links.collect()}
        assert given <= set(found) and components(given) == group


def test_bundles_are_told_apart_by_whole_sets():
    from granary.operators import bundles as B

    words = np.random.default_rng(3).integers(0, 2**63, 500)
    ends = np.array([0, 3, 11, 11, 500])
    got = B.runs(words, ends, 8)
    assert [len(g) for g in got] == [0, 1, 1, 0, 482] and all((np.diff(g) > 0).all() for g in got)
    assert len({int(B.runs(np.full(n, 5), np.array([n]), 8)[0][0]) for n in range(1, 9)}) == 8
    sets = [np.arange(100), np.arange(3, 103), np.arange(200, 300)]
    none = np.zeros(0, np.int64)
    x = B._Members([b"a", b"b"], sets[0], [none, np.setdiff1d(sets[1], sets[0])], [none, np.setdiff1d(sets[0], sets[1])])
    y = B._Members([b"c", b"d"], sets[2], [none, np.arange(3, 109)], [none, sets[2]])
    assert B.first_alike(x, y, 0.95) is None and B.first_alike(x, y, 0.9) == (b"b", b"d", 100 / 106)


def test_large_rule_tables_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = [f"h{k}.example.{x}" for k in range(40) for x in ("com", "org")] + ["example.com", "com", "h1.example.com:8080"]
    rules = [(n, rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4))), rng.choice(["allow", "block"])) for n in range(2000)]
    urls = [f"https://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts).upper()}/{''.join(rng.choice('ab/') for _ in range(5))}?q#f" for _ in range(150)] + [None, "", "mailto:x"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id long, url string")
    table = spark.createDataFrame(rules, "ord long, host string, prefix string, verdict string")

    def fits(u):
        if not u or "://" not in u:
            return []
        host, _, path = u.split("://")[1].partition("/")
        host, path = host.lower(), "/" + path.split("?")[0].split("#")[0]
        return [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]

    longest = {r.id: (r.rule_ord, r.rule_verdict) for r in Y.longest_rule(df, table).collect()}
    first = {r.id: (r.rule_ord, r.rule_verdict) for r in Y.first_rule(df, table).collect()}
    for k, u in enumerate(urls):
        hit = fits(u)
        best = max(hit, key=lambda r: (len(r[1]) + len(r[2]), -r[0]), default=(None,) * 4)
        assert longest[k] == (best[0], best[3])
        least = min(hit, default=(None,) * 4)
        assert first[k] == (least[0], least[3])
    domains = spark.createDataFrame([("h1.example.com",), ("EXAMPLE.org",), ("",)], "domain string")
    want = {u for u in urls if u and "://" in u and any(u.split("://")[1].split("/")[0].lower().endswith(x) for x in ("h1.example.com", "example.org"))}
    want = {u for u in want if (h := u.split("://")[1].split("/")[0].lower()) in ("h1.example.com", "example.org") or h.endswith((".h1.example.com", ".example.org"))}
    assert {r.url for r in Y.allowed_domains(df, domains).collect()} == want


def test_terms_in_one_reading_equal_a_chain_of_contains(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    rules = [(f"r{k}", [some(rng.randrange(2, 6)) for _ in range(5)]) for k in range(30)]
    texts = [some(rng.randrange(12)).upper() for _ in range(300)] + [None, "", "Größe ABBA"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id long, `q` string")
    got = Y.categorise_by_terms(df, "q", rules).select("id", "category").collect()
    want = df.select("id", A.categorise(F.col("q"), rules).alias("category")).collect()
    assert sorted(got) == sorted(want)
    groups = [ts for _, ts in rules]
    for r in Y.covered_groups(df, "q", groups).collect():
        assert r.covered == [k for k, ts in enumerate(groups) if r.q is not None and any(t in r.q.lower() for t in ts)]


def test_ten_thousand_terms(spark):
    terms = [f"term{k}x" for k in range(10_000)]
    texts = [f"a term{k}x and term{k + 1}x" for k in range(0, 10_000, 100)]
    df = spark.createDataFrame([(x,) for x in texts], "q string").coalesce(1)
    got = Y.found_terms(df, "q", terms).collect()
    assert [r.terms for r in got] == [[k, k + 1] for k in range(0, 10_000, 100)]
    assert Y.found_terms(df.limit(0), "q", terms).count() == 0 and Y.found_terms(df, "q", []).first().terms == []


def test_fingerprints_find_one_row(spark, tmp_path):
    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("v")).union(spark.createDataFrame([(None, "x"), (5, None)], "id long, v string"))
    other = df.withColumn("v", F.when(F.col("id") == 1234, "new").otherwise(F.col("v")))
    trees = [H.hash_tree(x, "id", 1) for x in (df, other)]
    assert H.fingerprint(df, "id") == H.fingerprint(df.orderBy(F.desc("v")).repartition(5), "id") != H.fingerprint(other, "id")
    assert H.fingerprint(df.union(df.limit(1)), "id") != H.fingerprint(df, "id") and H.fingerprint(df.limit(0), "id") == ""
    ranges = H.differing_ranges(*trees, 1)
    assert ranges.count() == 1 and H.differing_ranges(trees[0], trees[0], 1).count() == 0
    read = []
    for name, x in (("a", df), ("b", other)):
        H.write_ranged(x, str(tmp_path / name), "id", 1)
        read.append(spark.read.schema(df.schema.add("range", "string")).parquet(str(tmp_path / name)))
    changed = H.changed_rows(*read, "id", ranges)
    assert [(r.key, r.change) for r in changed.collect()] == [(1234, "changed")]
    plan = changed._jdf.queryExecution().toString()
    assert "(range#" in plan.split("PartitionFilters: [")[-1].split("]")[0] and f"= {ranges.first()[0]})" in plan


def test_one_line_of_very_many_words(spark):
    words = [f"w{k}" for k in range(60_000)]
    df = spark.createDataFrame([("d", 1, "d.pdf", "/d", " ".join(words)), ("d", 2, "d.pdf", "/d", "tail words")], "doc_id string, page_num int, file_name string, source_path string, clean_text string")
    got = C.fixed_size_chunks(df).orderBy("piece_index").collect()
    whole = [*words, "tail", "words"]
    assert [r.text for r in got] == [" ".join(whole[k : k + 320]) for k in range(0, len(whole) - 320 + 260, 260)]
    assert [r.word_count for r in got] == [len(r.text.split()) for r in got]


def test_many_unclosed_tags_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        title, text, links = W.page_parts("<nav><a href='x'>" * n + "text", "http://a/")
        assert (title, text, len(links)) == ("", "", n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 10 * seconds(4_000)
