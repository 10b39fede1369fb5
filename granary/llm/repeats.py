"""Repeated byte strings inside and across texts: suffixes grouped by their minimizer, then sorted deep and shallow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import boxed, dropped, quoted, stored, unboxed
from granary.llm.words import STEP, mixed, released

#: Bytes whose hash decides a window's minimizer, of strings long enough; window starts looked at together in a task.
GRAM, TILE = 128, 1 << 20
#: Contexts of one minimizer that one task sorts together at most; bytes of contexts that a task sorts at a time.
MOST_CONTEXTS, SORT_BYTES = 4096, 4 << 20
#: Words of eight bytes that the quicksort looks at before the tries take over.
SHALLOW = 4

RECORD = "gram long, c1 long, c2 long, mid long, lo long, w int, at int"
INTERVAL = "mid long, lo long, w int"


def _kinds(schema: str) -> pa.Schema:
    return pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}[k]) for n, k in (c.split() for c in schema.split(", "))])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, modulo 2**64."""

    def of(x: int) -> np.ndarray:
        p = np.full(n, x, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return of(STEP), of(pow(STEP, -1, 2**64))


def minimizers(data: np.ndarray, live: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, place, first start, last start) of runs of window starts that share their minimizer; live marks starts that count.

    A window is width bytes, its minimizer the place in it whose gram has the smallest hash, the first of several: equal
    windows have it at the same place, with the same gram.
    """
    gram = min(GRAM, width)
    step = width - gram + 1
    power, inverse = _powers(TILE + width + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = np.full(-(-len(key) // step) * step, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(key)] = key
    rows = rows.reshape(-1, step)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    n = len(data) - width + 1
    low = np.minimum(behind[:n], ahead[step - 1 : step - 1 + n])
    starts = np.flatnonzero(live[:n])
    place = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(starts) != 1)]) if len(starts) else starts
    return h[place[at]], place[at], starts[at], starts[np.r_[at[1:], len(starts)] - 1] if len(at) else at


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """(bytes, pieces as (row id, place in its text, length)) of about TILE bytes; a long text is cut, with width - 1 bytes in common."""
    parts: list[bytes] = []
    pieces: list[tuple[int, int, int]] = []
    size = 0
    for b in batches:
        for mid, text in zip(b.column(0).to_pylist(), b.column(1)):
            whole = memoryview(text.as_buffer()) if text.is_valid else b""
            for at in range(0, max(len(whole) - width + 1, 0), TILE):
                part = whole[at : at + TILE + width - 1]
                if size + len(part) > TILE and parts:
                    yield b"".join(parts), pieces
                    parts, pieces, size = [], [], 0
                parts.append(part)
                pieces.append((mid, at, len(part)))
                size += len(part)
    if parts:
        yield b"".join(parts), pieces


def _records(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts: the bytes of all windows of a run that share a minimizer, by their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for data, pieces in _tiles(batches, width):
            mids, places, sizes = (np.array(x) for x in zip(*pieces))
            ends = np.cumsum(sizes)
            live = np.ones(len(data), bool)
            for e in ends.tolist():
                live[e - width + 1 : e] = False
            gram, place, lo, hi = minimizers(np.frombuffer(data, np.uint8), live, width)
            view, digest = memoryview(data), xxhash.xxh3_128_digest
            both = np.frombuffer(b"".join([digest(view[a:z]) for a, z in zip(lo.tolist(), (hi + width).tolist())]), np.int64).reshape(-1, 2)
            of = np.searchsorted(ends, lo, "right")
            columns = [gram.view(np.int64), both[:, 0], both[:, 1], mids[of], lo - (ends - sizes)[of] + places[of], hi - lo + 1, place - lo]
            yield pa.record_batch([pa.array(c, f.type, safe=False) for c, f in zip(columns, _kinds(RECORD))], schema=_kinds(RECORD))

    return run


def _halves(order: np.ndarray, group: np.ndarray, word: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of each group apart by whether their word is less than, equal to or more than its pivot."""
    side = group * 3 + (word >= pivot) + (word > pivot)
    by = np.argsort(side, kind="stable")
    return order[by], side[by]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each group, its size, a member's group) of sorted keys."""
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return at, np.diff(np.r_[at, len(key)]), np.cumsum(first) - 1


def alike(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """Which of the suffixes at starts agree in width bytes with another one of their bucket.

    Multikey quicksort by words of eight bytes orders a bucket's suffixes to a shallow depth. Groups that are still
    together there have long prefixes in common and go into blind tries: a node branches at the first word in which its
    suffixes differ, words in common above it are never split by. What ends in one leaf agrees in all width bytes.
    """
    found = np.zeros(len(starts), bool)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    # the last word may overlap the one before it, so that the words cover width bytes and none beyond
    places = np.array([*range(0, width - 7, 8), *[width - 8] * (width % 8 > 0)] if width >= 8 else [0])
    if width < 8:
        words >>= np.uint64(8 * (8 - width))
    order = np.argsort(bucket, kind="stable")
    key = bucket[order]
    depth = None
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    n_deep, most = 0, min(SHALLOW, len(places))
    while len(order):
        at, size, group = _counted(key)
        depth = np.zeros(len(at), np.int64) if depth is None else depth[at]
        rest, stop = (size > 1) & (depth < most), (size > 1) & (depth >= most)
        member = stop[group]
        deep.append((order[member], group[member] + n_deep))
        n_deep += len(at)
        member = rest[group]
        order, group = order[member], (np.cumsum(rest) - 1)[group[member]]
        size, depth = size[rest], depth[rest]
        if not len(order):
            break
        word = words[starts[order] + places[depth][group]]
        pivot = word[np.cumsum(size) - size + size // 2]
        order, key = _halves(order, group, word, pivot[group])
        depth = depth[key // 3] + (key % 3 == 1)
    order, key = (np.concatenate(x) for x in zip(*deep)) if deep else (order, order)
    while len(order):
        at, size, group = _counted(key)
        order, group = order[(size > 1)[group]], group[(size > 1)[group]]
        if not len(order):
            break
        at, size, group = _counted(group)
        shared = np.full(len(order), len(places))  # words in common with the member before it
        for a in range(0, len(order), 1 << 15):
            rows = words[starts[order[max(a - 1, 0) : a + (1 << 15)]][:, None] + places]
            other = rows[1:] != rows[:-1]
            shared[max(a, 1) : max(a, 1) + len(other)] = np.where(other.any(1), other.argmax(1), len(places))
        shared[at] = len(places)
        branch = np.minimum.reduceat(shared, at)
        leaf = branch[group] == len(places)
        found[order[leaf]] = True
        order, group = order[~leaf], group[~leaf]
        if not len(order):
            break
        word = words[starts[order] + places[branch[group]]]
        by = np.lexsort((word, group))
        order, group, word = order[by], group[by], word[by]
        key = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
    return found


def _windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, number of the window in it) of all windows of contexts with w each."""
    of = np.repeat(np.arange(len(w)), w)
    return of, np.arange(len(of)) - (np.cumsum(w) - w)[of]


def _sorted_groups(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Intervals of windows that another context of the same minimizer has too; rows come in order of gram."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        gram, n, mid, lo, w, at = (t[c].to_numpy() for c in ("gram", "n", "mid", "lo", "w", "at"))
        bits = t["bits"].to_pylist()
        size = np.array([len(x) for x in bits])
        of, k = _windows(w)
        # equal windows have their minimizer at the same place, so only windows that agree in it can be equal
        group = np.cumsum(np.r_[True, gram[1:] != gram[:-1]])
        found = alike(np.frombuffer(b"".join(bits), np.uint8), (np.cumsum(size) - size)[of] + k, (group[of] << 32) + at[of] - k, width)
        found &= n[of] == 1
        hit = np.flatnonzero(found)
        first = np.r_[True, (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]])] if len(hit) else np.zeros(0, bool)
        a = np.flatnonzero(first)
        c = of[hit[a]]
        columns = [mid[c], lo[c] + k[hit[a]], np.diff(np.r_[a, len(hit)])]
        return pa.record_batch([pa.array(x, f.type, safe=False) for x, f in zip(columns, _kinds(INTERVAL))], schema=_kinds(INTERVAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            gram = b.column("gram").to_numpy()
            cuts = np.flatnonzero(np.r_[len(gram) > 0 and gram[0] != last, gram[1:] != gram[:-1]]).tolist()
            last = gram[-1] if len(gram) else last
            done = 0
            each = np.cumsum(np.r_[0, b.column("w").to_numpy().astype(np.int64) + width])
            for cut in cuts:  # a group is whole where the next one begins
                if size + each[cut] - each[done] >= SORT_BYTES:
                    held.append(b.slice(done, cut - done))
                    yield judged(pa.Table.from_batches(held))
                    held, size, done = [], 0, cut
            held.append(b.slice(done))
            size += each[-1] - each[done]
        if held:
            yield judged(pa.Table.from_batches(held))

    return run


def _window_digests(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                n, mid, lo, w = (part.column(c).to_numpy() for c in ("n", "mid", "lo", "w"))
                of, k = _windows(w)
                bits = [memoryview(x) for x in part.column("bits").to_pylist()]
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(bits[c][i : i + width]) for c, i in zip(of.tolist(), k.tolist())]), np.int64)
                yield pa.record_batch([both[::2], both[1::2], mid[of], lo[of] + k, n[of]], ["d1", "d2", "mid", "lo", "n"])

    return run


def _cut(text: bytes, los: list[int], ws: list[int], width: int) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal runs of bytes covered by the windows, the bytes left)."""
    spans: list[tuple[int, int]] = []
    for a, z in sorted((lo, lo + w + width - 1) for lo, w in zip(los, ws)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
        else:
            spans.append((a, z))
    ends = [0, *(z for _, z in spans)]
    return spans, b"".join([text[a:z] for a, z in zip(ends, [*(a for a, _ in spans), len(text)])])


def remove_repeats(df: DataFrame, width: int = 400, text: str = "text", spans: str = "spans", kept: str = "kept") -> DataFrame:
    """df with the byte spans of each text that are covered by strings of width bytes that start elsewhere too, and what is left.

    spans is an array of (start, end) in bytes of the UTF-8 text, maximal runs in order; kept holds the other bytes, one after
    another (binary: a span may begin inside a character). Strings are judged on the input, never across texts; a string
    repeated within one text, overlapping itself, counts. Null texts are empty. Equal rows are rows of their own, so texts
    of width bytes or more that occur twice go whole. Other columns stay whatever their names (columns named like spans or
    kept are replaced); texts of any length are read in tiles; an empty table gives an empty one.

    Every window of width bytes belongs to its minimizer, the place in it with the smallest hash of 128 bytes. Windows that
    follow one another with one minimizer make a context; contexts whose minimizer occurs nowhere else hold no repeat, equal
    ones fold to one with a count, and the different ones of one minimizer are sorted together, window by window. A minimizer
    with more than MOST_CONTEXTS of them is cut by the digests of its windows instead.
    """
    names = [c for c in df.columns if c not in (spans, kept)]
    rows = stored(df.select(boxed(df.select(*map(quoted, names))).alias("row"), F.monotonically_increasing_id().alias("mid")), "texts")
    bits = F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary").alias("bits")
    seen = stored(rows.select("mid", bits).mapInArrow(released(_records(width)), RECORD), "records")
    contexts = stored(seen.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("mid", "lo", "w", "at")).alias("one")), "contexts")
    unlike = contexts.groupBy("gram").agg(F.count("*").alias("n_contexts"), F.min("n").alias("least")).filter("n_contexts > 1 and least = 1")
    wanted = contexts.join(unlike, "gram").select("gram", "n", "n_contexts", "one.*")
    slices = rows.select("mid", bits).join(wanted, "mid")
    piece = F.substring("bits", (F.col("lo") + 1).cast("int"), (F.col("w") + (width - 1)).cast("int")).alias("bits")
    slices = stored(slices.select("gram", "n", "n_contexts", "mid", "lo", "w", "at", piece), "slices")

    few = slices.filter(F.col("n_contexts") <= MOST_CONTEXTS).repartition("gram").sortWithinPartitions("gram", "mid", "lo")
    by_sort = few.mapInArrow(released(_sorted_groups(width)), INTERVAL)
    digests = slices.filter(F.col("n_contexts") > MOST_CONTEXTS).mapInArrow(released(_window_digests(width)), "d1 long, d2 long, mid long, lo long, n long")
    again = digests.groupBy("d1", "d2").agg(F.count("*").alias("n_windows")).filter("n_windows > 1")
    by_digest = digests.filter("n = 1").join(again, ["d1", "d2"], "left_semi").select("mid", "lo", F.lit(1).alias("w"))
    folded = seen.join(contexts.filter("n > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi").select("mid", "lo", "w")
    hits = folded.unionByName(by_sort).unionByName(by_digest)
    hits = stored(hits.groupBy("mid").agg(F.collect_list("lo").alias("los"), F.collect_list("w").alias("ws")), "hits")
    for t in (seen, contexts, slices):
        dropped(t)

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    row = T.StructField("row", rows.schema["row"].dataType)
    schema = T.StructType([row, T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    column = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            made = []
            for x, los, ws in zip(b.column("row").field(column), b.column("los").to_pylist(), b.column("ws").to_pylist()):
                made.append(_cut(x.as_buffer().to_pybytes() if x.is_valid else b"", los or [], ws or [], width))
            ends = [[{"start": a, "end": z} for a, z in s] for s, _ in made]
            yield pa.record_batch([b.column("row"), pa.array(ends, kind), pa.array([k for _, k in made], pa.binary())], ["row", "spans", "kept"])

    done = rows.join(hits, "mid", "left").select("row", "los", "ws").mapInArrow(released(run), schema)
    return done.select(*unboxed("row", names), F.col("spans").alias(spans), F.col("kept").alias(kept))
