"""Exact top-k by inner product: term-at-a-time accumulation over blocks of queries and candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import quoted, stored
from granary.llm.vectors import finite, matrix
from granary.llm.words import give_back

QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def top_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row id, score) of each query's k best rows, ties to smaller ids, own id left out.

    rows must be in order of ids. Each dimension is a term with a posting list of the rows where it is not
    zero; the queries' weights of a term are scattered into their dense score arrays, one term after another.
    """
    scores = np.zeros((len(queries), len(ids)), np.int64)
    for t in range(queries.shape[1]):
        posting = np.flatnonzero(rows[:, t])
        holders = np.flatnonzero(queries[:, t])
        if not len(posting) or not len(holders):
            continue
        weight = rows[posting, t]
        for q in holders:
            if len(posting) == len(ids):
                scores[q] += queries[q, t] * weight
            else:
                scores[q, posting] += queries[q, t] * weight
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(len(queries)):
        other = np.flatnonzero(ids != query_ids[q])
        own = scores[q, other]
        if len(own) > k:
            least = np.partition(own, len(own) - k)[len(own) - k]
            over, even = np.flatnonzero(own > least), np.flatnonzero(own == least)
            best = np.r_[over, even[: k - len(over)]]  # rows are in order of ids, so the first are the smallest
        else:
            best = np.arange(len(own))
        found.append((np.full(len(best), q), ids[other[best]], own[best]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def exact_top_k(df: DataFrame, is_query: Column, k: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the row's key and score: every query's k best rows of df, by integer inner product.

    Components are floor(scale * x). Queries are the rows of df where is_query holds; candidates are all rows with
    another key. Queries and candidates are dealt into blocks of bounded size; each pair of blocks is one unit of
    work that keeps k rows a query, so a pair of blocks is all that a task holds, and the units' results merge by
    a ranked window. Rows shuffled grow with (queries / 1024) times rows: the search is exhaustive.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null key. Shorter
    vectors end in zeros. Components so large that a score may not fit 64 bits (width times the largest integer squared) raise
    an error before anything is searched. Ties go to the smaller key. Keys should be unique; rows that repeat a key each count, and
    a query that repeats is asked once. Other columns are left out; an empty table gives an empty one.
    """
    terms = F.transform(quoted(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    valid = df.filter(finite(quoted(vector)) & quoted(key).isNotNull())
    slim = stored(valid.select(quoted(key).alias("id"), terms.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "terms")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    n, width, n_queries, top = slim.agg(F.count("*"), F.max(F.size("v")), F.count_if("q"), largest).first()
    if (width or 0) * (top or 0.0) ** 2 >= 2.0**63:
        raise ValueError("components so large that a score may pass 64 bits")
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    asked = slim.filter("q").dropDuplicates(["id"])
    deal = lambda blocks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks).cast("long"))
    copies = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = slim.select(deal(row_blocks, 1).alias("rb"), F.lit(False).alias("q"), "id", "v").withColumn("qb", copies(query_blocks))
    questions = asked.select(deal(query_blocks, 2).alias("qb"), F.lit(True).alias("q"), "id", "v").withColumn("rb", copies(row_blocks))
    width = width or 1

    def search(key_: tuple, unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("id").combine_chunks()
        is_q = unit["q"].combine_chunks().to_numpy(zero_copy_only=False)
        ids = unit["id"].to_numpy()
        m = matrix(unit["v"].combine_chunks(), width).astype(np.int64)
        at, found, score = top_of_block(ids[is_q], m[is_q], ids[~is_q], np.ascontiguousarray(m[~is_q]), k)
        give_back()
        return pa.table({"query_id": ids[is_q][at], "id": found, "score": score})

    kind = df.schema[key].dataType.simpleString()
    units = rows.unionByName(questions).groupBy("rb", "qb").applyInArrow(search, f"query_id {kind}, id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = units.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")
