"""Byte-balanced sharding by histogram sort (splitter refinement as in Solomonik and Kale, 2010)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import boxed, dropped, quoted, stored, unboxed

OFFSET = 1 << 63
KEY = ("h", "i", "s")
KEY_BYTES = 8 * len(KEY)
#: Text that one task is to sort into slots.
TASK_BYTES = 64 << 20


def _as_bytes(b: pd.DataFrame) -> np.ndarray:
    """The signed longs of each key as one string that sorts as the key does."""
    parts = np.stack([b[k].to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(OFFSET) for k in KEY], 1)
    return np.frombuffer(parts.astype(">u8").tobytes(), dtype=f"S{KEY_BYTES}")


def _longs(key: int) -> list[int]:
    """The signed longs of a key number; a number past the last key becomes the last."""
    key = min(key, (1 << 8 * KEY_BYTES) - 1)
    return [((key >> 64 * k) & (2 * OFFSET - 1)) - OFFSET for k in reversed(range(len(KEY)))]


def _probe_bytes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(KEY_BYTES, "big") for k in keys), dtype=f"S{KEY_BYTES}")


def _cells(keys: DataFrame, probes: list[int]) -> dict[int, tuple]:
    """Exact bytes and rows, least and greatest key of each cell; cell c holds keys in [probe c-1, probe c)."""
    edges = _probe_bytes(probes)

    def count(batches):
        for b in batches:
            if not len(b):
                continue
            k = _as_bytes(b)
            cell = np.searchsorted(edges, k, side="right")
            out = pd.DataFrame({"cell": cell, "size": b["size"], "k": [x.ljust(KEY_BYTES, b"\0") for x in k.tolist()]})
            yield out.groupby("cell").agg(bytes=("size", "sum"), low=("k", "min"), high=("k", "max")).reset_index()

    made = keys.mapInPandas(count, "cell int, bytes long, low binary, high binary")
    found = made.groupBy("cell").agg(F.sum("bytes"), F.min("low"), F.max("high")).collect()
    return {r[0]: (r[1], int.from_bytes(r[2], "big"), int.from_bytes(r[3], "big")) for r in found}


def splitters(keys: DataFrame, shards: int, tolerance: float, fan: int = 16) -> list[int]:
    """Boundaries that cut keys (h, i, s, size) into shards of equal bytes.

    Every round counts the exact bytes below all probes over all partitions and puts new probes only inside
    the cells that hold a wanted boundary, until the bytes below a boundary are within tolerance (a share of
    one shard) of the target or its cell holds one key. The driver sees at most fan probes a boundary, whatever the
    number of keys.
    """
    total, low, high = _cells(keys, []).get(0, (0, 0, 0))
    targets = [total * p // shards for p in range(1, shards)]
    if not total or not targets:
        return []
    # for each boundary: least and greatest key of the cell that holds it, and bytes below the cell
    state = [(low, high, 0)] * len(targets)
    done: dict[int, int] = {}
    slack = tolerance * total / shards
    while len(done) < len(targets):
        probes: set[int] = set()
        for t, (lo, hi, _) in enumerate(state):
            if t not in done:
                probes |= {lo + (hi + 1 - lo) * j // fan for j in range(fan + 1)}
        edges = sorted(probes)
        cells = _cells(keys, edges)
        below = np.cumsum([cells.get(c, (0,))[0] for c in range(len(edges) + 1)]).tolist()
        for t, want in enumerate(targets):
            if t in done:
                continue
            # the cell after the last edge with no more than the wanted bytes below it
            c = max(1, int(np.searchsorted(below, want, side="right")))
            c = min(c, len(edges))
            under = below[c - 1]
            size, lo, hi = cells.get(c, (0, edges[c - 1], edges[c - 1]))
            if want - under <= slack or not size:
                done[t] = edges[c - 1]
            elif under + size - want <= slack or lo == hi and under + size - want < want - under:
                done[t] = hi + 1
            elif lo == hi:
                done[t] = lo
            else:
                state[t] = (lo, hi, under)
    return [done[t] for t in range(len(targets))]


def _shard(edges: list[int]) -> Column:
    """How many edges are at or below the key: at most shards - 1 comparisons of three longs."""
    key, out = F.struct(*KEY), F.lit(0)
    for e in edges:
        at = F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(KEY, _longs(e))])
        out = out + (key >= at).cast("int")
    return out


def histogram_shards(
    df: DataFrame, shards: int, text: str = "text", order: str = "doc_id", tolerance: float = 0.001, piece_bytes: int = 4 << 20
) -> DataFrame:
    """All columns of df, with size (UTF-8 bytes of the text plus 1), shard (0 to shards-1) and slot.

    Rows sort by (hash of the text, order column): copies of a text stand together and are cut only where a
    shard boundary falls among them. A shard's rows are dealt to pieces of about piece_bytes by a hash of their key, so
    that no task holds a shard; exact counts give every piece its first slot, and the rows move once. slot counts
    from 0 without gaps within a shard. Only the shards' boundaries and their probes pass the driver.

    Nulls: a null text has size 1 and hashes as null; a null order value sorts as the smallest long. Where rows repeat
    text and order value, rows are numbered and written first, so that these are keys of their own and may be cut
    apart like any others. Very long texts are one row each. An empty table gives an empty one. Other columns may have
    any name; those named size, shard or slot are replaced.
    """
    names = [c for c in df.columns if c not in ("size", "shard", "slot")]
    held = df.select(*map(quoted, names))
    sized = held.select(
        boxed(held).alias("row"),
        (F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.xxhash64(F.coalesce(quoted(text), F.lit("")), quoted(text).isNull()).alias("h"),
        F.coalesce(quoted(order).cast("long"), F.lit(-OFFSET)).alias("i"),
    )
    keys = stored(sized.select("h", "i", F.lit(0).cast("long").alias("s"), "size"), "keys")
    if keys.groupBy("h", "i").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows = sized.withColumn("s", F.lit(0).cast("long"))
    else:
        dropped(keys)
        rows = stored(sized.withColumn("s", F.monotonically_increasing_id()), "rows")
        keys = rows.select(*KEY, "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    shard = _shard(splitters(keys, shards, tolerance)).alias("shard")
    piece = F.pmod(F.xxhash64(*KEY), F.lit(max(1, -(-total // (shards * piece_bytes))))).alias("piece")
    counts = stored(keys.select(shard, piece).groupBy("shard", "piece").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("first"))
    # as many partitions as the bytes need, so that a task's share does not grow with the table
    moved = rows.select("row", "size", *KEY, shard, piece).repartition(max(1, -(-total // TASK_BYTES)), "shard", "piece")
    dealt = moved.join(first, ["shard", "piece"])
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*KEY)) - 1
    return dealt.select(*unboxed("row", names), "size", "shard", (within + F.col("first")).cast("long").alias("slot"))
