"""Similarity self-join of vectors by epsilon grid order (Boehm et al., 2001)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import components, dropped, quoted, stored
from granary.llm.vectors import finite, matrix, unit_rows
from granary.llm.words import give_back, released

BLOCK, LEAF, GRID = 16_384, 256, 6


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def unite(self, i: np.ndarray, j: np.ndarray, sure=lambda x, y: True) -> list[tuple[int, int]]:
        """Joins the pairs (i, j) that are sure; those that joined two trees."""
        used = []
        nodes = np.unique(np.r_[i, j])
        while len(i):
            root = np.array([self.root(x) for x in nodes.tolist()])
            ri, rj = root[np.searchsorted(nodes, i)], root[np.searchsorted(nodes, j)]
            apart = ri != rj
            i, j = i[apart], j[apart]
            _, first = np.unique(ri[apart], return_index=True)
            used += [(x, y) for x, y in zip(i[first].tolist(), j[first].tolist()) if sure(x, y) and self.join(x, y)]
            i, j = np.delete(i, first), np.delete(j, first)
        return used


def join_intervals(v: np.ndarray, p: np.ndarray, a: tuple[int, int], b: tuple[int, int], eps: float, least: float, found) -> None:
    """Calls found(i, j) with index arrays of the pairs of rows i of a and j of b, i < j, with dot product >= least.

    v are unit vectors in epsilon grid order and p their leading coordinates. Two intervals of the sequence whose
    boxes lie more than eps apart hold no pair; else the longer is halved until both are short.
    """
    (a0, a1), (b0, b1) = a, b
    if a0 >= a1 or b0 >= b1:
        return
    if a != b:
        gap = np.maximum(0, np.maximum(p[a0:a1].min(0) - p[b0:b1].max(0), p[b0:b1].min(0) - p[a0:a1].max(0)))
        if float(gap @ gap) > eps * eps + 1e-9:
            return
    if max(a1 - a0, b1 - b0) <= LEAF:
        i, j = np.nonzero(v[a0:a1] @ v[b0:b1].T >= least)
        i, j = i + a0, j + b0
        keep = i < j
        found(i[keep], j[keep])
    elif a == b:
        m = (a0 + a1) // 2
        for x, y in (((a0, m), (a0, m)), ((a0, m), (m, a1)), ((m, a1), (m, a1))):
            join_intervals(v, p, x, y, eps, least, found)
    elif a1 - a0 >= b1 - b0:
        m = (a0 + a1) // 2
        join_intervals(v, p, (a0, m), b, eps, least, found)
        join_intervals(v, p, (m, a1), b, eps, least, found)
    else:
        m = (b0 + b1) // 2
        join_intervals(v, p, a, (b0, m), eps, least, found)
        join_intervals(v, p, a, (m, b1), eps, least, found)


def principal_axes(rows: DataFrame, width: int, count: int) -> np.ndarray:
    """The leading eigenvectors of the covariance of vectors v at length 1: partitions send sums, width * width numbers."""

    def sums(batches):
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            m = np.c_[np.ones(b.num_rows), unit_rows(matrix(b.column(0), width))]
            total += m.T @ m
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "x"])

    got = rows.select("v").mapInArrow(released(sums), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width + 1, width + 1))
    for r in got:
        total[r[0], r[1]] = r[2]
    n = max(total[0, 0], 1)
    mean = total[0, 1:] / n
    _, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :count].copy()


def cosine_links(df: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of df: key, n_links, component_id and kept; links join vectors with cosine >= least.

    Equal vectors fold into one row with a count, so copies are never paired. The distinct unit vectors sort by
    their cells of side eps on the leading principal axes and are cut into blocks of the sequence; a pair of
    blocks is dropped when the boxes of their leading coordinates lie over eps apart, else it is one unit of
    work that joins the two intervals recursively. A unit returns a link count a vector and a spanning forest of
    its links, never the links themselves. Blocks hold BLOCK vectors, however they are partitioned. Per block its
    box (2 * GRID numbers) passes the driver and is sent to the tasks that list the pairs.

    Vectors that are null, zero or hold null or non-finite components link with nothing: n_links 0, own component.
    Keys should be unique (rows that repeat a key link like any others). A null key is a row like any other; a component
    has a null name, and keeps its rows of null key, only where none of its rows has a key. Shorter vectors end in zeros.
    Other columns are left out, whatever their names; an empty table gives an empty one.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    some = F.exists(quoted(vector), lambda x: x != 0)
    value = F.transform(quoted(vector), lambda x: x.cast("double") + F.lit(0.0))
    all_rows = df.select(quoted(key).alias("id"), value.alias("v"), (finite(quoted(vector)) & some).alias("ok"))
    valid = all_rows.filter("ok")
    width = valid.agg(F.max(F.size("v"))).first()[0] or 1
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    # copies fold: name is the copies' smallest key, rep a number of the vector's own
    folded = valid.groupBy("v").agg(F.min("id").alias("name"), F.count("*").alias("copies"))
    folded = stored(folded.withColumn("rep", F.monotonically_increasing_id()), "folded")
    axes = principal_axes(folded, width, min(GRID, width))
    depth = axes.shape[1]

    def project(batches):
        for b in batches:
            v = unit_rows(matrix(b.column(1), width))
            p = v @ axes
            cells = np.floor(p / eps).astype(np.int64)
            columns = [b.column(0), pa.array(list(v), pa.list_(pa.float64())), b.column(2), pa.array(list(p), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "v", "copies", "p", "cells"])

    shape = "rep long, v array<double>, copies long, p array<double>, cells array<long>"
    placed = folded.select("rep", "v", "copies").mapInArrow(released(project), shape)
    blocks = max(1, -(-folded.count() // BLOCK))
    dealt = placed.repartitionByRange(blocks, "cells", F.xxhash64("rep")).sortWithinPartitions("cells", "rep")
    dealt = stored(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).drop("cells"), "dealt")
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias("start"))
    ordered = dealt.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("row")).withColumn("block", F.floor(F.col("at") / BLOCK))
    ordered = ordered.select("block", "at", "rep", "v", "copies", "p")
    corner = [f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(depth)]
    boxes = stored(ordered.groupBy("block").agg(*corner), "boxes")
    sides = np.array([tuple(r) for r in boxes.orderBy("block").collect()], float).reshape(-1, 1 + 2 * depth)
    held = boxes.sparkSession.sparkContext.broadcast(sides)

    def near(batches):
        every = held.value
        for b in batches:
            out = []
            for block in b.column(0).to_pylist():
                own, others = every[block], every[block:]
                gap = np.maximum(0, np.maximum(own[1 : 1 + depth] - others[:, 1 + depth :], others[:, 1 : 1 + depth] - own[1 + depth :]))
                for other in (np.flatnonzero((gap * gap).sum(1) <= eps * eps + 1e-9) + block).tolist():
                    out += [(block, block, other, 0), (other, block, other, 1)][: 1 + (other != block)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 4)], ["block", "one", "two", "side"])

    units = boxes.select("block").repartition(min(blocks, 1024)).mapInArrow(near, "block long, one long, two long, side long")
    parts = ordered.join(units, "block").select("one", "two", "side", "at", "rep", "v", "copies", "p")

    def join(key_: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("at", "ascending")]).combine_chunks()
        v, p = matrix(t["v"].combine_chunks(), width), matrix(t["p"].combine_chunks(), depth)
        rep, copies = t["rep"], t["copies"].to_numpy()
        split = pc.sum(pc.equal(t["side"], 0)).as_py()
        both = split == len(copies)
        links, forest, tree = np.zeros(len(copies), np.int64), Forest(len(copies)), []

        def found(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            tree.extend(forest.unite(i, j))

        join_intervals(v, p, (0, split), (0, split) if both else (split, len(copies)), eps, least, found)
        give_back()
        some = np.flatnonzero(links)
        i = pa.array(np.r_[some, [x for x, _ in tree]].astype(np.int64))
        other = rep.take(pa.array([y for _, y in tree], pa.int64())).to_pylist()
        return pa.table({
            "rep": rep.take(i), "other": pa.array([None] * len(some) + other, rep.type), "links": pa.array(np.r_[links[some], np.zeros(len(tree), np.int64)]),
        })

    joined = stored(parts.groupBy("one", "two").applyInArrow(join, "rep long, other long, links long"), "joined")
    counts = joined.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(joined.filter("other is not null"), "rep", "other")
    groups = folded.join(counts, "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
    groups = groups.select("v", "name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    names = groups.groupBy("component").agg(F.min("name").alias("component_id"))
    linked = valid.join(groups.join(names, "component"), "v").select("id", "n_links", "component_id")
    alone = all_rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
