"""The prefix trie against brute force, over one range and over many, with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, every=20, spread=4):
    words = lambda x: len((x or "").replace("\t", " ").split())
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            role, text = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % spread
        built[c] = tuple(own.get(c - c % every, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    out = set()
    for p, who in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(z[: len(q)] == q and len(z) == len(q) + 1 for z in below)]
        saved = sum((len(nodes[q]) - 1) * words(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(who) if built[c] == p)
        up = min(nodes[p[:-1]]) if p else None
        out.add((min(who), len(p), up, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(df, **how):
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(df))
    ends = prefix_trie.member_digests(prefix_trie.members(seqs))
    rows = prefix_trie.trie(seqs, **how).join(ends, "node", "left").withColumn("sha", F.coalesce("sha256", prefix_trie.empty_digest())).collect()
    out = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.sha) for r in rows]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("part_bytes", [1 << 20, 400])
def test_equals_brute_force(spark, part_bytes):
    rng = random.Random(part_bytes)
    rows = []
    for c in [*range(60), 85, 86, 10**12]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]) if t == 0 else t, rng.choice(["user", "user", None]), rng.choice(["a b", "c", "", None])))
    rows += rows[:7] + [(None, 1, "user", "lost")] * 5  # repeated rows are turns; rows without a conversation take no part
    assert result(spark.createDataFrame(rows, TURNS).repartition(3), part_bytes=part_bytes) == brute(rows)


def test_many_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"word{t} more") for c in range(0, 800, 20) for t in range(4)]
    rows += [(7, t, "user", f"turn {t}") for t in range(600)] + [(8, t, "user", f"turn {t}" if t < 590 else "else") for t in range(600)]
    got = result(spark.createDataFrame(rows, TURNS), part_bytes=16384)
    assert max(g[1] for g in got) == 600 and (0, 0, None, 42) in {g[:4] for g in got}
    assert {g[3] for g in got if g[0] == 0 and g[1] == 4} == {40}


def test_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b")], TURNS)
    names = ["conv", "turns", "h", "of", "head", "s", "n", "words", "node", "a.b", "one"]
    clash = df.withColumns({x: F.lit(x) for x in names if x != "a.b"}).withColumn("a.b", F.lit(1))
    assert result(clash) == brute([(1, 0, "user", "a b")])
    assert result(df.limit(0)) == set()
    odd = df.toDF("a.conv", "a.turn", "a.role", "a.text")
    assert prefix_trie.sequences(odd, "a.conv", "a.turn", "a.role", "a.text").first().turns[0].words == 2
