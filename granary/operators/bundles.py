"""Bundles: near copies that lie side by side, linked before anything of them is shuffled, and tests of bundles against one another."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a task's Python holds as runs at a time, members of a bundle, and texts that a text is compared with before the shuffle. These bound
#: memory and work; what a bundle leaves out meets it in the shuffle.
WORDS_AT_ONCE = 1 << 20
MEMBERS = 64
TRIES = 4

_MIX = 0x9E3779B97F4A7C15
#: Below this, differences of similarities come from rounding.
TINY = 1e-9


def runs(words: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct hashes, sorted, of each text's runs of size words (hashes; ends: where texts end); a shorter text is one run."""
    words = words.view(np.uint64)
    many = max(len(words) - size + 1, 0)
    rolled = np.zeros(many, np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(_MIX) + words[j : many + j]
    out, low = [], 0
    for end in ends.tolist():
        if end - low >= size:
            out.append(np.unique(rolled[low : end - size + 1].view(np.int64)))
        else:
            short = end - low
            for w in words[low:end].tolist():
                short = (short * _MIX + w) % 2**64
            out.append(np.array([short] if end > low else [], np.uint64).view(np.int64))
        low = end
    return out


def sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with a column w of word hashes, some WORDS_AT_ONCE words at a time, with their texts' runs."""
    for batch in batches:
        lists = batch.column("w")
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        words, low = lists.flatten().to_numpy(), 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(int(np.searchsorted(ends, before + WORDS_AT_ONCE, "right")), low + 1)
            yield batch.slice(low, high - low), runs(words[before : ends[high - 1]], ends[low:high] - before, size)
            low = high
        pa.default_memory_pool().release_unused()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _parents(sets: list[np.ndarray], prefixes: list[np.ndarray], threshold: float) -> tuple[list[int], list[float]]:
    """For each text an earlier one that is alike, or -1, with their similarity: the partners that share most of its prefix are tried."""
    up, near, n = [-1] * len(sets), [0.0] * len(sets), len(sets)
    tokens, of = np.concatenate(prefixes), np.repeat(np.arange(n), [len(p) for p in prefixes])
    if not len(tokens):
        return up, near
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    again = np.flatnonzero(tokens[1:] == tokens[:-1]) + 1
    first = np.maximum.accumulate(np.where(np.r_[True, tokens[1:] != tokens[:-1]], np.arange(len(tokens)), 0))
    pairs, shared = np.unique(np.concatenate([of[again] * n + of[again - 1], of[again] * n + of[first[again]]]), return_counts=True)
    tried = [0] * n
    for at in np.lexsort((-shared, pairs // n)).tolist():
        right, left = divmod(int(pairs[at]), n)
        if up[right] < 0 and tried[right] < TRIES:
            small, large = sorted((len(sets[left]), len(sets[right])))
            if small >= threshold * large - TINY:
                tried[right] += 1
                if (alike := similarity(sets[left], sets[right])) >= threshold:
                    up[right], near[right] = left, alike
    return up, near


def bundler(level: Callable[[], np.ndarray], threshold: float, size: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, h, w) to rows of schema(): each a text with texts of its slice that are alike, chained; equal texts are one member.

    Which texts a bundle takes in depends on how rows lie; that its members are linked does not. Records without an id
    are counted only.
    """

    def bundles(ids: list, digests: list[bytes], found: list[np.ndarray], order: np.ndarray) -> Iterator[tuple]:
        at: dict[bytes, int] = {}
        names, copies, hs, sets = [], [], [], []
        for name, h, g in zip(ids, digests, found):
            if not len(g):
                continue  # no words
            if (k := at.setdefault(h, len(hs))) == len(hs):
                names.append(name), copies.append(1), hs.append(h), sets.append(g)
            else:
                copies[k] += 1
                if name is not None:
                    names[k] = name if names[k] is None else min(name, names[k])
        if not hs:
            return
        prefixes = []
        for name, g in zip(names, sets):
            few = 0 if name is None else len(g) - math.ceil(len(g) * threshold - TINY) + 1
            prefixes.append(g[np.lexsort((g, order[g & (len(order) - 1)]))[:few]])
        up, near = _parents(sets, prefixes, threshold)
        groups: dict[int, list[int]] = {}
        root = list(range(len(hs)))
        for k in range(len(hs)):
            if up[k] >= 0 and len(groups[root[up[k]]]) < MEMBERS:
                root[k] = root[up[k]]
            groups.setdefault(root[k], []).append(k)
        for top, held in groups.items():
            place = {k: i for i, k in enumerate(held)}
            sizes = [len(sets[k]) for k in held]
            own = hashlib.blake2b(b"".join(sorted(hs[k] for k in held)), digest_size=8).digest()
            row = (names[top], int.from_bytes(own, "little", signed=True), min(sizes), max(sizes), np.unique(np.concatenate([prefixes[k] for k in held])))
            row += ([names[k] for k in held], [hs[k] for k in held], [copies[k] for k in held], [-1, *(place[up[k]] for k in held[1:])], [near[k] for k in held])
            if whole:
                more = [np.setdiff1d(sets[k], sets[top], assume_unique=True) for k in held]
                less = [np.setdiff1d(sets[top], sets[k], assume_unique=True) for k in held]
                row += (sets[top], more, less)
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = level()
        for few, found in sliced(batches, size):
            kind = few.column("id").type
            kind = pa.string() if pa.types.is_large_string(kind) else kind
            longs = pa.list_(pa.int64())
            types = [kind, pa.int64(), pa.int32(), pa.int32(), longs, pa.list_(kind), pa.list_(pa.binary()), longs, pa.list_(pa.int32()), pa.list_(pa.float64())]
            types += [longs, pa.list_(longs), pa.list_(longs)] if whole else []
            rows = list(bundles(few.column("id").to_pylist(), few.column("h").to_pylist(), found, order))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)], NAMES[: len(types)])

    return run


NAMES = ["rep", "sig", "lo", "hi", "p", "ids", "hs", "copies", "up", "near", "g", "more", "less"]


def schema(kind: str, whole: bool) -> str:
    """A bundle's name (the id of its first text), its members' digest, least and largest set, prefixes, members (ids, digests, numbers of copies, the
    member each was linked to and how alike they are) and, if whole, the first set and what each member has more and less than it."""
    own = f"rep {kind}, sig long, lo int, hi int, p array<bigint>, ids array<{kind}>, hs array<binary>, copies array<bigint>, up array<int>, near array<double>"
    return own + (", g array<bigint>, more array<array<bigint>>, less array<array<bigint>>" if whole else "")


def fits(a: str, b: str, threshold: float) -> Column:
    """Whether some sets of the bundles a and b have sizes that let them be alike."""
    return (F.col(f"{a}.hi") >= (threshold - TINY) * F.col(f"{b}.lo")) & (F.col(f"{b}.hi") >= (threshold - TINY) * F.col(f"{a}.lo"))


def enough(shared: Column, a: str, b: str, threshold: float) -> Column:
    """Whether bundles that share so many tokens of their prefixes can be alike; their sizes are columns lo and hi after a and b.

    Of two sets, the one whose prefix ends first shares with the other what the prefixes share and some of its n -
    (n - ceil(threshold * n) + 1) later tokens at most; alike sets share threshold / (1 + threshold) of both sizes together.
    """
    later = F.ceil((F.greatest(f"{a}hi", f"{b}hi")) * threshold - TINY) - 1
    return shared + later >= threshold / (1 + threshold) * (F.col(f"{a}lo") + F.col(f"{b}lo")) - TINY


class _Members:
    """The members' sets of a bundle, made when they are asked for."""

    def __init__(self, hs: list[bytes], g: np.ndarray, more: list[np.ndarray], less: list[np.ndarray]):
        self.hs, self.g, self.more, self.less = hs, g, more, less
        self.sizes = [len(g) + len(m) - len(n) for m, n in zip(more, less)]
        self._made: dict[int, np.ndarray] = {}

    def __getitem__(self, k: int) -> np.ndarray:
        if k not in self._made:
            self._made[k] = np.union1d(np.setdiff1d(self.g, self.less[k], assume_unique=True), self.more[k])
        return self._made[k]


def first_alike(x: _Members, y: _Members, threshold: float) -> tuple[bytes, bytes, float] | None:
    """The first members of two bundles that are alike; only sets that the first sets' common part lets be alike are compared."""
    common = len(np.intersect1d(x.g, y.g, assume_unique=True))
    for i, n in enumerate(x.sizes):
        for j, m in enumerate(y.sizes):
            most = min(common + len(x.more[i]) + len(y.more[j]), n, m)
            if most / (n + m - most) >= threshold and (alike := similarity(x[i], y[j])) >= threshold:
                return x.hs[i], y.hs[j], alike
    return None


def alike(pairs: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(left, right, a, b, similarity) of pairs of bundles (left, right, and hs, g, more, less of each after x and y): digests of two members alike."""

    def members(batch: pa.RecordBatch, side: str, i: int) -> _Members:
        lists = (batch.column(f"{side}_{name}")[i] for name in ("g", "more", "less"))
        g, more, less = (c.values for c in lists)
        each = lambda c: [x.values.to_numpy() for x in c]
        return _Members(batch.column(f"{side}_hs")[i].as_py(), g.to_numpy(), each(more), each(less))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i in range(batch.num_rows):
                if (found := first_alike(members(batch, "x", i), members(batch, "y", i), threshold)) is not None:
                    rows.append(found), at.append(i)
            if rows:
                ends = [batch.column(c).take(pa.array(at)) for c in ("left", "right")]
                ends = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in ends]
                a, b, s = map(list, zip(*rows))
                yield pa.record_batch([*ends, pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], ["left", "right", "a", "b", "similarity"])
            del batch
            pa.default_memory_pool().release_unused()

    return pairs.mapInArrow(run, f"left {kind}, right {kind}, a binary, b binary, similarity double")


#: Bitmaps of 4 KB that ids are dealt to: 2^26 bits, whatever the number of ids.
MAPS = 2048


def perhaps_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose key is in ids (id), and a few others where there are many ids: no row is shuffled for it."""
    part = lambda c: (F.pmod(F.xxhash64(c), F.lit(MAPS)), F.pmod(F.shiftright(F.xxhash64(c), 11), F.lit(32768)))
    of, bit = part("id")
    maps = ids.select(of.alias("_of"), bit.alias("_bit")).groupBy("_of").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    of, bit = part(key)
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return rows.withColumns({"_of": of, "_bit": bit}).join(F.broadcast(maps), "_of").filter(hit).select(*rows.columns)
