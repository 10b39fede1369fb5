"""Set-similarity self-join on word shingles by chosen paths (Christiani, Pagh and Sivertsen, 2018), verified exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import components, dropped, maybe_among, quoted, stored
from granary.llm.ego_join import Forest
from granary.llm.words import in_groups, released, shingle_sets

SKETCH = 128
PICKS = 3
SMALL = 16
DEPTH = 6
#: Sets of a bucket whose tokens are looked at for those that many of its sets hold, and that share of them.
SAMPLE, COMMON = 16, 0.4
#: Most sets and shingles in a chunk of a group that is verified.
CHUNK, CHUNK_SHINGLES = 2048, 1 << 20


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold was in one small bucket with probability recall or more.

    A run's paths through a shared bucket are a branching process with threshold * PICKS children on average;
    its chance to live on at any depth is the fixed point of q = 1 - exp(-threshold * PICKS * q).
    """
    q = 1.0
    for _ in range(100):
        q = 1 - math.exp(-threshold * PICKS * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def _sets(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """key, text hash, set size, hash of the set, and its SKETCH smallest shingles as ints."""

    def run(batches):
        for whole in batches:
            for batch in in_groups(whole, 1):
                sets = shingle_sets(batch.column(1), size)
                with np.errstate(over="ignore"):
                    named = [int((x * np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(29))).sum(dtype=np.uint64)) ^ len(x) for x in sets]
                small = [(x[:SKETCH] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array([len(x) for x in sets], pa.int32()),
                        pa.array(np.array(named, np.uint64).view(np.int64)),
                        pa.array(small, pa.list_(pa.int32())),
                    ],
                    ["id", "th", "n", "c", "sketch"],
                )

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(quoted(key).alias("id"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("th"))
    return slim.mapInArrow(released(run), f"id {kind}, th long, n int, c long, sketch array<int>")


def _picked(path: Column, tokens: Column) -> Column:
    """Child paths: about PICKS of the tokens, the same ones for every set that holds them at this path."""
    chance = lambda t: F.shiftrightunsigned(F.xxhash64(path, t), 33) * F.size(tokens) < PICKS * 2**31
    return F.transform(F.filter(tokens, chance), lambda t: F.xxhash64(path, t, F.lit(1)))


def _alike(a: str, b: str) -> Column:
    """Share of the smallest tokens that two sketches have in common; 0.8 or more, on average, for Jaccard 0.8."""
    return F.size(F.array_intersect(f"{a}.sketch", f"{b}.sketch")) / F.least(F.lit(SKETCH), F.greatest(f"{a}.n", f"{b}.n"))


def _close(a: str, b: str, threshold: float) -> Column:
    """No pair at the threshold fails, but for one in millions whose sketches stray by over five deviations."""
    return (_alike(a, b) >= threshold - 0.18) & (F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n"))


def _commons(rows: DataFrame) -> DataFrame:
    """(path, common): tokens that at least COMMON of a bucket's sets hold, judged by about SAMPLE of them."""
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(3), "path", "c"), "size") < SAMPLE).groupBy("path")
    held = drawn.agg(F.count("*").alias("k"), F.sort_array(F.flatten(F.collect_list("sketch"))).alias("t"))
    often = F.greatest(F.ceil(F.col("k") * COMMON), F.lit(2)).cast("int") - 1
    # a token that often + 1 sets hold stands at that many places of the sorted list
    return held.select("path", F.array_distinct(F.filter("t", lambda x, i: F.get("t", i + often) == x)).alias("common"))


def _split(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """(links, children) of buckets (path, c, n, size, sketch) with over SMALL sets.

    A bucket's pivot is a set at random. Sets alike enough that a common neighbour with the pivot is possible link with it;
    those so close to it that all their neighbours do are done with. What most sets hold tells nothing: the others
    split by tokens that are not common in the bucket. Sets that consist of common tokens for the most part
    cannot be split so; they are alike, link with the least of them, and are done with where all their neighbours
    link there too. At the last depth everything that is left links with the pivot. Links only say in which groups to
    look, so one too many costs time and no wrong result.
    """
    pivot = rows.groupBy("path").agg(F.min(F.struct(F.xxhash64("path", "c").alias("r"), "c")).alias("p")).select("path", F.col("p.c").alias("p"))
    lead = rows.join(pivot, "path").filter("c = p").select("path", "p", F.struct("n", "sketch").alias("lead"))
    common = _commons(rows)
    tied = rows.join(lead, "path").join(common, "path", "left").withColumn("own", F.struct("n", "sketch"))
    rest = F.array_except("sketch", F.coalesce("common", F.array().cast("array<int>")))
    judged = tied.select("path", "c", "n", "p", _alike("own", "lead").alias("near"), rest.alias("rest"), F.size("sketch").alias("all"))
    judged = judged.withColumn("share", F.size("rest") / F.col("all"))
    goes_on = F.lit(not last) & (F.col("c") != F.col("p")) & (F.col("near") < 0.9) & (F.col("share") > 0.4)
    judged = stored(judged.select("path", "c", "n", "p", "near", "share", F.when(goes_on, F.col("rest")).alias("rest")), "judged")
    star = judged.filter((F.col("near") >= (0.0 if last else 0.4)) & (F.col("c") != F.col("p"))).select(F.col("p").alias("u"), F.col("c").alias("v"))
    core = judged.filter("share <= 0.6").select("path", "c")
    least = core.groupBy("path").agg(F.min("c").alias("u"))
    links = stored(star.unionByName(core.join(least, "path").filter("c <> u").select("u", F.col("c").alias("v"))).distinct(), "star")
    children = judged.filter("rest is not null").select("c", "n", F.explode(_picked(F.col("path"), F.col("rest"))).alias("path"))
    children = stored(children, "paths")
    dropped(judged)
    return links, children


def candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(u, v): links such that, but for a share 1 - recall, sets at the threshold are connected by them.

    Each level's buckets are counted first. One set alone goes; up to SMALL sets are paired; larger buckets
    split by further tokens, see _split. A set takes part in a bounded number of buckets a level, and no bucket
    is held in one task.
    """
    links: list[DataFrame] = []
    level = classes.select("c", "n", "sketch", F.explode(F.sequence(F.lit(1), F.lit(runs_for(recall, threshold)))).alias("run"))
    level = stored(level.select("c", "n", F.explode(_picked(F.col("run").cast("long"), F.col("sketch"))).alias("path")), "paths")
    for depth in range(1, DEPTH + 1):
        size = level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        held = stored(level.join(size, "path"), "held")
        dropped(level)
        some = held.filter(F.col("size") <= SMALL).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("cs"))
        like = lambda x, y: F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])
        mates = lambda x, i: F.filter(F.slice("cs", i + 2, SMALL), lambda y: like(x, y))
        pair = F.flatten(F.transform("cs", lambda x, i: F.transform(mates(x, i), lambda y: F.struct(x["c"].alias("u"), y["c"].alias("v")))))
        pairs = stored(some.select(F.explode(pair).alias("p")).select("p.*").distinct(), "pairs")
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("k"))
        named = maybe_among(classes.select("c", F.struct("n", "sketch").alias("s")), F.col("c"), nodes)
        close = pairs
        for side in "uv":
            close = close.join(named.select(F.col("c").alias(side), F.col("s").alias(f"s{side}")), side)
        links.append(stored(close.filter(_close("su", "sv", threshold)).select("u", "v"), "close"))
        large = held.filter(F.col("size") > SMALL).select("path", "c", "n", "size")
        sketched = maybe_among(classes.select("c", "sketch"), F.col("c"), large.select(F.col("c").alias("k")))
        rows = stored(large.join(sketched, "c"), "large")
        dropped(held)
        dropped(pairs)
        if rows.isEmpty():
            break
        more, level = _split(rows, depth == DEPTH)
        dropped(rows)
        links.append(more)
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Numbers of shingles that sets before split (rows) share with those from split on (columns).

    Shingles that few sets hold add up pair by pair, others by products of blocks of them.
    """
    n = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(codes, kind="stable")  # rows ascend within a code
    codes, row = codes[order], row[order]
    rows, columns = split, len(n) - split
    on_left = np.bincount(codes[row < split], minlength=codes[-1] + 1)
    on_right = np.bincount(codes[row >= split], minlength=codes[-1] + 1)
    first = np.cumsum(on_left + on_right) - on_left - on_right
    shared = np.zeros(rows * columns, np.float32)
    few = on_left * on_right
    # pair by pair: every place on the left meets the places on the right of its code
    at = np.flatnonzero((row < split) & (few[codes] > 0) & (few[codes] <= 64))
    for low in range(0, len(at), 1 << 16):
        a = at[low : low + (1 << 16)]
        times = on_right[codes[a]]
        ends = np.cumsum(times)
        b = np.arange(ends[-1]) + np.repeat(first[codes[a]] + on_left[codes[a]] - (ends - times), times)
        np.add.at(shared, np.repeat(row[a], times) * columns + row[b] - split, np.float32(1))
    shared = shared.reshape(rows, columns)
    # in blocks
    many = np.flatnonzero(few > 64)
    place = np.full(len(few), -1)
    place[many] = np.arange(len(many))
    keep = place[codes] >= 0
    codes, row = place[codes[keep]], row[keep]
    for low in range(0, len(many), 1024):
        p, q = np.searchsorted(codes, [low, low + 1024])
        block = np.zeros((len(n), 1024), np.float32)
        block[row[p:q], codes[p:q] - low] = 1
        shared += block[:split] @ block[split:].T
    return shared


def _unit(side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], one: bool, threshold: float):
    """Number of links of each set of a unit, copies counted, and a spanning forest of the links."""
    n = np.array([len(x) for x in sets])
    split = len(n) if one else int((~side).sum())
    shared = _shared(sets + sets, split) if one else _shared(sets, split)
    other = n if one else n[split:]
    x, y = np.nonzero(shared * np.float64(1 + threshold) >= threshold * (n[:split, None] + other[None, :]) - 1e-6)
    y = y + (0 if one else split)
    keep = x < y
    x, y = x[keep], y[keep]
    links = np.bincount(x, copies[y], len(n)) + np.bincount(y, copies[x], len(n))
    return links.astype(np.int64), Forest(len(n)).unite(x, y)


def _verified(members: DataFrame, threshold: float, size: int) -> DataFrame:
    """Exact links inside groups of candidates: (c, other, links), other null for counts and set for a forest link.

    members has comp, chunks, c, copies and text. Groups are cut into chunks; each pair of chunks is a unit that
    counts shared shingles, so no group stands in one task. A group of one chunk is a unit of its own.
    """
    own = F.pmod(F.xxhash64("c"), "chunks")
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    units = members.withColumn("own", own).withColumn("u", F.explode(pair))
    units = units.select("comp", "u.i", "u.j", (F.col("own") != F.col("u.i")).alias("side"), "c", "copies", "text")
    units = units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side")
    keys = ("comp", "i", "j")

    def judge(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        sets = [x for b in t.to_batches() for g in in_groups(b, 6) for x in shingle_sets(g.column(6), size)]
        comp, i, j = (t[k].to_numpy() for k in keys)
        side, c, copies = t["side"].to_numpy(zero_copy_only=False), t["c"].to_numpy(), t["copies"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        out: list[tuple] = []
        for a, b in zip(edges, edges[1:]):
            if b - a < 2 or i[a] != j[a] and side[a:b].all() == side[a:b].any():
                continue
            links, tree = _unit(side[a:b], copies[a:b], sets[a:b], i[a] == j[a], threshold)
            out += [(int(c[a + k]), None, int(links[k])) for k in np.flatnonzero(links)]
            out += [(int(c[a + x]), int(c[a + y]), 0) for x, y in tree]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["c", "other", "links"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = [[x.column(k)[at].as_py() for k in range(3)] for x, at in ((b, 0), (b, -1), (held[-1] if held else b, -1))]
            same = np.logical_and.reduce([b.column(k).to_numpy() == x for k, x in enumerate(key[1])])
            cut = b.num_rows - int(same.sum())
            if held and (cut or key[0] != key[2]):
                # the unit that was held ends here, or before
                yield judge([*held, b.slice(0, cut)])
                held = []
            elif cut:
                yield judge([b.slice(0, cut)])
            held.append(b.slice(cut))
        if held:
            yield judge(held)

    return units.mapInArrow(released(run), "c long, other long, links long")


def jaccard_links(df: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.9999, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of df: key, th, class_id, copies_id, n_links and kept.

    Rows link where the Jaccard similarity of their sets of size-word shingles (words split at ASCII white space,
    A-Z lower-cased) is threshold or more. class_id is the smallest key that links reach, copies_id the smallest
    with the same set, n_links the number of other rows linked directly, th the text's xxhash64. Every link
    counted is verified on whole sets; chosen paths only find the groups in which to look, with the given
    recall for a pair at the threshold and more above it.

    Rows with equal sets fold into one with a count before anything is paired. Fewer words than size are one
    shingle. Null and empty texts, and those without words, link with nothing. Rows that repeat link as copies
    and are all kept or not; a null key comes last. Other columns are left out; an empty table gives an empty one.
    """
    rows = stored(_sets(df, text, key, size), "sets")
    filled = rows.filter("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")
    classes = stored(filled.groupBy("c", "n").agg(F.count("*").alias("copies"), first, F.any_value("sketch").alias("sketch")), "classes")
    found = candidates(classes.select("c", "n", "sketch"), threshold, recall)
    named = components(found, "u", "v").select(F.col("node").alias("c"), F.col("component").alias("comp"))
    named = stored(named.join(classes.select("c", "n", "copies", "first.id", "first.th"), "c"), "groups")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).alias("chunks")
    wanted = stored(named.join(named.groupBy("comp").agg(chunks), "comp").select("comp", "chunks", "c", "copies", "id", "th"), "wanted")
    dropped(named)
    where = F.xxhash64("id", "th")
    texts = df.select(quoted(key).alias("id"), F.xxhash64(quoted(text)).alias("th"), quoted(text).alias("text"))
    texts = maybe_among(texts, where, wanted.select(where.alias("k")))
    same = texts["id"].eqNullSafe(wanted["id"]) & (texts["th"] == wanted["th"])
    members = texts.join(wanted, same).select("comp", "chunks", "c", "copies", "text").dropDuplicates(["c"])
    exact = stored(_verified(members, threshold, size), "links")
    counts = exact.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(exact.filter("other is not null"), "c", "other").withColumnRenamed("node", "c")
    joined = classes.select("c", "copies", F.col("first.none").alias("none"), F.col("first.id").alias("id")).join(counts, "c", "left").join(groups, "c", "left")
    joined = joined.withColumn("component", F.coalesce("component", "c"))
    least = joined.groupBy("component").agg(F.min(F.struct("none", "id")).alias("least"))
    info = joined.join(least, "component").select(
        "c", F.col("least.id").alias("class_id"), F.col("id").alias("copies_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    linked = filled.join(info, "c").select("id", "th", "class_id", "copies_id", "n_links")
    alone = rows.filter("n = 0").select("id", "th", F.col("id").alias("class_id"), F.col("id").alias("copies_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "th", "class_id", "copies_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
