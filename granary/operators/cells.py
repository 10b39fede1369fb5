"""Exact cosine retrieval that skips cells: vectors lie in cells around centres, and the triangle inequality rules cells out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources.tables import snapshot

#: Rows and questions that meet in one task; distances between unit vectors are exact to SLACK.
BLOCK, SLACK, DIGITS = 2048, 1e-6, 12
MOST_CELLS, MOST_PLACES = 1024, 65_536


@dataclass(frozen=True)
class CellIndex:
    """centres are unit vectors; rows (chunk_id, strategy, embedding, place) hold every vector that can match.

    A place is a cell of a strategy. places has one row for each: strategy, cell, n, and the least and greatest distance
    of its vectors from the centre; it is checked to be at most MOST_PLACES rows.
    """

    centres: np.ndarray
    rows: DataFrame
    places: pd.DataFrame


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a column of lists; NaN for rows that are null, of another width, without direction or not finite."""
    held = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width
    out = np.full((len(column), width), np.nan)
    if held.any():
        flat = column.filter(pa.array(held)).flatten().cast(pa.float64())
        out[held] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(all="ignore"):
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(np.isfinite(size) & (size > 0), out / size, np.nan)


def _away(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from centres."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (units @ centres.T)))


def fit_centres(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of at most sample vectors, chosen by a hash of chunk_id; about the root of the row count, at most MOST_CELLS.

    The commonest width of the sample is the index's. Without vectors that have a direction there is one centre of width 1.
    """
    held = vectors.filter("embedding is not null").select("chunk_id", "embedding")
    count = held.count()
    keep = min(1.0, 1.1 * sample / max(1, count))
    few = held.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(keep * (1 << 30))).limit(sample).select("embedding").toArrow()
    column = few.column(0).combine_chunks() if few.num_rows else pa.array([], pa.list_(pa.float64()))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(int)
    width = int(np.bincount(sizes).argmax()) if len(sizes) and sizes.max() > 0 else 1
    units = unit_rows(column, width)
    units = np.unique(units[~np.isnan(units[:, 0])], axis=0)
    if not len(units):
        return np.eye(1)
    wanted = min(len(units), cells or int(np.clip(round(count**0.5), 1, MOST_CELLS)))
    rng = np.random.default_rng(7)
    centres = units[rng.choice(len(units), wanted, replace=False)]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, np.divide(sums, size, out=np.zeros_like(sums), where=size > 1e-9), centres)
    return centres


def build_cells(vectors: DataFrame, cells: int | None = None, sample: int = 20_000) -> CellIndex:
    """Index of all vectors (chunk_id, strategy, embedding); extra columns are left out.

    Every vector lies in the cell of its nearest centre, of whatever size cells become. Vectors that are null, without
    direction, with null or non-finite components or of another width than the index's match nothing and are left out.
    """
    centres = fit_centres(vectors, cells, sample)
    plain = vectors.select("chunk_id", "strategy", "embedding")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = unit_rows(b.column("embedding"), centres.shape[1])
            good = ~np.isnan(units).any(axis=1)
            away = _away(units[good], centres)
            cell = away.argmin(axis=1) if len(away) else np.zeros(0, int)
            held = b.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [*held.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell], pa.float64())], names=[*held.schema.names, "cell", "away"])

    dealt = snapshot(plain.mapInArrow(deal, T.StructType([*plain.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])), "dealt")
    found = dealt.groupBy("strategy", "cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
    places = found.limit(MOST_PLACES + 1).toPandas()
    if len(places) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} cells over all strategies")
    places = places.sort_values(["strategy", "cell"], ignore_index=True)
    places["place"] = np.arange(len(places))
    spark = vectors.sparkSession
    small = spark.createDataFrame(
        [(r.strategy, int(r.cell), int(r.place), -(-int(r.n) // BLOCK)) for r in places.itertuples()],
        T.StructType([T.StructField("_s", vectors.schema["strategy"].dataType), T.StructField("_c", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("slices", T.IntegerType())]))
    rows = dealt.join(F.broadcast(small), F.col("strategy").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
    slice_ = F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int")
    return CellIndex(centres, rows.select("chunk_id", "strategy", "embedding", "place", "slices", slice_.alias("slice")), places)


def _visits(questions: DataFrame, index: CellIndex, k: int, later: bool) -> DataFrame:
    """(question_id, embedding, place): the nearest cells that hold k vectors of a strategy, or else all others that may hold nearer ones.

    Later ones need the columns done, places visited already, and bounds, the k-th distance so far by strategy.
    """
    centres, places = index.centres, index.places
    groups = [g for _, g in places.groupby(places["strategy"].map(repr), sort=True)]
    # each strategy's places, with how many vectors they hold and between which distances from the centre they lie
    known = [(g["place"].to_numpy(), g["cell"].to_numpy(), g["n"].to_numpy(), g["least"].to_numpy(), g["most"].to_numpy()) for g in groups]
    first_place = [int(g["place"].min()) for g in groups]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = unit_rows(b.column("embedding"), centres.shape[1])
            good = np.flatnonzero(~np.isnan(units).any(axis=1))
            away = _away(units[good], centres)
            at, to = [], []
            done = b.column("done").to_pylist() if later else None
            bounds = b.column("bounds").to_pylist() if later else None
            for i, own in zip(good, away):
                for first, (place, cell, n, least, most) in zip(first_place, known):
                    d = own[cell]
                    if later:
                        bound = dict(bounds[i] or ()).get(first)
                        gap = np.maximum(0.0, np.maximum(d - most, least - d) - SLACK)
                        near = np.ones(len(place), bool) if bound is None else gap * gap / 2 <= bound + SLACK * SLACK
                        go = place[near & ~np.isin(place, done[i] or [])]
                    else:
                        order = np.argsort(d, kind="stable")
                        go = place[order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]]
                    at += [i] * len(go)
                    to += go.tolist()
            held = b.select(["question_id", "embedding"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(to, pa.int32())], names=["question_id", "embedding", "place"])

    fields = [questions.schema["question_id"], questions.schema["embedding"], T.StructField("place", T.IntegerType())]
    return snapshot(questions.mapInArrow(visit, T.StructType(fields)), "visits")


def _hits(visits: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """(question_id, strategy, chunk_id, distance): the k nearest of each visited slice; a task holds BLOCK rows and questions or so."""
    width = index.centres.shape[1]
    blocks = visits.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    slices = index.rows.sparkSession.createDataFrame([(int(r.place), -(-int(r.n) // BLOCK)) for r in index.places.itertuples()], "place int, slices int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    small = F.broadcast(blocks)  # one row a place, at most MOST_PLACES
    asked = visits.join(small, "place").withColumn("block", F.pmod(F.xxhash64("question_id"), F.col("blocks")).cast("int"))
    asked = asked.join(F.broadcast(slices), "place").select("question_id", "embedding", "place", "block", each("slices").alias("slice"))
    rows = index.rows.join(small, "place").select("chunk_id", "strategy", "embedding", "place", "slice", each("blocks").alias("block"))
    out = T.StructType([visits.schema["question_id"], index.rows.schema["strategy"], index.rows.schema["chunk_id"], T.StructField("distance", T.DoubleType())])

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        names = ["question_id", "strategy", "chunk_id", "distance"]
        types = [q.schema.field("question_id").type, r.schema.field("strategy").type, r.schema.field("chunk_id").type, pa.float64()]
        empty = pa.table([pa.array([], t) for t in types], names=names)
        if not q.num_rows or not r.num_rows:
            return empty
        r = r.sort_by("chunk_id")
        near = 1 - unit_rows(q.column("embedding").combine_chunks(), width) @ unit_rows(r.column("embedding").combine_chunks(), width).T
        near = np.round(near, DIGITS)
        few = min(k, r.num_rows)
        most = np.partition(near, few - 1, axis=1)[:, few - 1]
        at, to = [], []
        for i, own in enumerate(near):
            held = np.flatnonzero(own <= most[i])
            best = held[np.argsort(own[held], kind="stable")[:k]]
            at += [i] * len(best)
            to += best.tolist()
        a, b = pa.array(at, pa.int64()), pa.array(to, pa.int64())
        return pa.table([q.column("question_id").take(a), r.column("strategy").take(b), r.column("chunk_id").take(b), pa.array(near[at, to])], names=names)

    keys = ["place", "slice", "block"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, out)


def search_cells(questions: DataFrame, index: CellIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest vectors of each strategy, as `retrieval.nearest` gives them, and the visits (question_id, place).

    A question first reads the cells nearest to it until they hold k vectors of a strategy; the k-th distance found there
    rules out every cell whose vectors all lie farther, and it reads the rest. question_id is unique and not null;
    questions whose vector is null, without direction, not finite or of another width get no hits. Distances are
    compared to 12 decimals, ties go to the smaller chunk_id; equal chunk_ids are rows of their own.
    """
    plain = questions.select("question_id", "embedding")
    first = _visits(plain, index, k, False)
    found = snapshot(_hits(first, index, k), "hits")
    order = Window.partitionBy("question_id", "strategy").orderBy("distance", "chunk_id")
    ranked = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k)
    start = index.places.groupby(index.places["strategy"].map(repr))["place"].min()
    named = {repr(s): s for s in index.places["strategy"]}
    lead = plain.sparkSession.createDataFrame([(named[s], int(p)) for s, p in start.items()], T.StructType([T.StructField("_s", found.schema["strategy"].dataType), T.StructField("lead", T.IntegerType())]))
    kth = ranked.join(F.broadcast(lead), F.col("strategy").eqNullSafe(F.col("_s")))
    kth = kth.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("lead", "distance"))).alias("bounds"))
    done = first.groupBy("question_id").agg(F.collect_list("place").alias("done"))
    again = plain.join(done, "question_id").join(kth, "question_id", "left")
    rest = _visits(again, index, k, True)
    every = found.unionByName(_hits(rest, index, k))
    hits = every.withColumn("vector_rank", F.row_number().over(order)).filter(F.col("vector_rank") <= k)
    return hits, first.select("question_id", "place").unionByName(rest.select("question_id", "place"))


def nearest_in_cells(questions: DataFrame, vectors: DataFrame, k: int, cells: int | None = None) -> DataFrame:
    """`retrieval.nearest` by way of an index made for the call."""
    return search_cells(questions, build_cells(vectors, cells), k)[0]


def cell_report(questions: DataFrame, index: CellIndex, visits: DataFrame) -> DataFrame:
    """A row per strategy: its vectors, its cells, the questions, and how many pairs of question and vector were read."""
    schema = T.StructType([T.StructField("strategy", index.rows.schema["strategy"].dataType), T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType())])
    known = visits.sparkSession.createDataFrame([(r.strategy, int(r.place), int(r.n)) for r in index.places.itertuples()], schema)
    times = visits.groupBy("place").agg(F.count("*").alias("times"))
    each = known.join(times, "place", "left").groupBy("strategy").agg(
        F.sum("n").alias("vectors"), F.count("*").alias("cells"), F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("pairs_read"))
    return each.withColumn("questions", questions.agg(F.count("*")).scalar())
