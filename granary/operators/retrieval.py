"""Cosine retrieval for many questions at once, metadata reranking and the merge of two strategies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERFETCH, TITLE_BOOST, SECTION_BOOST = 4, 0.22, 0.08
REFUSE_BELOW = 0.18
#: Words that carry no meaning in a title or question (fixed values).
STOP_WORDS = (
    "a an and are about by does for from how in is it of on or say says the to what when where which who why with".split()
)
#: Questions of a block, components of a slice of vectors (and distances held at a time), and what two ways to add up a cosine may differ by.
BLOCK, SLICE, ROUNDING = 4096, 1 << 21, 1e-12


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays, in double precision inside the JVM; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """question_id, strategy, chunk_id and distance of the k nearest vectors of each strategy.

    questions (question_id, embedding) are cut into blocks of about BLOCK rows, vectors (chunk_id, strategy, embedding) into
    slices of about SLICE components. Each pair of a block and a slice is a group of its own, dealt to as many tasks as there
    are pairs, so a task holds a few of them however large the tables are; a pair keeps k rows for a question and strategy. Vectors
    without direction, null or of another width than the question's never match; ties go to the smaller chunk_id.
    """
    spark = questions.sparkSession
    asked, held = questions.filter("embedding is not null"), vectors.filter("embedding is not null")
    count, (rows, width) = asked.count(), held.agg(F.count("*"), F.max(F.size("embedding"))).first()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-count // BLOCK))
    slices = max(1, -(-rows * (width or 1) // SLICE), min(cores, -(-rows // BLOCK)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair, tasks = ["block", "slice"], 2 * blocks * slices
    qs = asked.select(deal("question_id", blocks).alias("block"), "question_id", "embedding").withColumn("slice", all_of(slices))
    vs = held.select(deal("chunk_id", slices).alias("slice"), "chunk_id", "strategy", "embedding").withColumn("block", all_of(blocks))
    qid, cid = questions.schema["question_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()

    def units(t: pa.Table, width: int) -> tuple[pa.Table, np.ndarray]:
        """The rows of that width that have a direction, and their vectors at length 1."""
        t = t.filter(pc.equal(pc.list_value_length(t["embedding"]), width))
        flat = t["embedding"].combine_chunks().flatten().cast(pa.float64(), safe=False)
        m = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
        size = np.sqrt((m * m).sum(1))
        good = np.isfinite(m).all(1) & (size > 0)
        return t.select([n for n in t.column_names if n != "embedding"]).filter(pa.array(good)), m[good] / size[good, None]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("chunk_id")
        names = ["question_id", "strategy", "chunk_id", "distance"]
        made = [pa.table([left["question_id"][:0], right["strategy"][:0], right["chunk_id"][:0], pa.array([], pa.float64())], names)]
        for width in pc.unique(pc.list_value_length(left["embedding"])).to_pylist() if right.num_rows else []:
            if not width:
                continue
            q, a = units(left, width)
            for strategy in pc.unique(right["strategy"]).to_pylist():
                v, b = units(right.filter(pc.is_null(right["strategy"]) if strategy is None else pc.equal(right["strategy"], strategy)), width)
                if not len(a) or not len(b):
                    continue
                few = min(k, len(b))
                step = max(1, SLICE // len(b))
                for at in range(0, len(a), step):
                    part = a[at : at + step]
                    distance = 1 - part @ b.T
                    # the k-th smallest bounds the few that need sorting; what a product's rounding may part from its ties stays in
                    bound = np.partition(distance, few - 1, axis=1)[:, few - 1] + ROUNDING
                    best, own = [], []
                    for x, near, most in zip(part, distance, bound):
                        some = np.flatnonzero(near <= most)
                        exact = 1 - (b[some] * x).sum(1)  # a matrix product rounds equal vectors differently by their place in it
                        first = np.argsort(exact, kind="stable")[:few]
                        best.append(some[first])
                        own.append(exact[first])
                    asks = q["question_id"].take(pa.array(np.repeat(np.arange(at, at + len(part)), few)))
                    ids = v["chunk_id"].take(pa.array(np.concatenate(best)))
                    made.append(pa.table([asks, pa.array([strategy] * len(ids), right["strategy"].type), ids, pa.array(np.concatenate(own))], names))
        out = pa.concat_tables(made)
        # Spark takes plain strings back, whatever kind it sent
        return out.cast(pa.schema([(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in out.schema]))

    both = qs.repartition(tasks, *pair).groupBy(*pair).cogroup(vs.repartition(tasks, *pair).groupBy(*pair))
    found = both.applyInArrow(search, f"question_id {qid}, strategy string, chunk_id {cid}, distance double")
    # as many tasks as the rows need: a pair has BLOCK * k of each strategy
    dealt = found.repartition(max(cores, tasks), "question_id", "strategy")
    order = Window.partitionBy("question_id", "strategy").orderBy("distance", "chunk_id")
    return dealt.withColumn("vector_rank", F.row_number().over(order)).filter(F.col("vector_rank") <= k)


def tokens(c: Column) -> Column:
    """Normalised words of a title or question, stop words left out before plural endings go."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.pdf$", "")
    words = F.regexp_extract_all(F.lower(plain), F.lit("([a-z0-9]+)"))
    stop = F.array(*map(F.lit, STOP_WORDS))
    many = lambda w: (F.length(w) > 4) & w.endswith("ies")
    one = lambda w: F.when(many(w), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.transform(F.filter(words, lambda w: ~F.array_contains(stop, w)), one)


def overlap(query: Column, metadata: Column) -> Column:
    """Share of the distinct metadata tokens that the query has; 0 if either is empty."""
    both = F.size(F.array_intersect(query, metadata)) / F.size(F.array_distinct(metadata))
    return F.when((F.size(query) == 0) | (F.size(metadata) == 0), 0.0).otherwise(both)


def metadata_boost(question: Column, title: Column, section: Column) -> Column:
    """Boost by the title's and section's overlap with the question; a whole title in it counts in full."""
    q, t = tokens(question), tokens(title)
    phrase = F.array_join(t, " ")
    exact = (phrase != "") & F.contains(F.array_join(q, " "), phrase)
    by_title = F.when(exact, F.lit(TITLE_BOOST)).otherwise(TITLE_BOOST * overlap(q, t))
    return F.least(F.lit(TITLE_BOOST + SECTION_BOOST), by_title + SECTION_BOOST * overlap(q, tokens(section)))


def scored(hits: DataFrame) -> DataFrame:
    """Adds vector_score, metadata_boost and score to hits that carry question, file_name and section_title."""
    vector = F.greatest(F.lit(0.0), 1 - F.col("distance"))
    boost = metadata_boost(F.col("question"), F.col("file_name"), F.col("section_title"))
    return hits.withColumns({"vector_score": vector, "metadata_boost": boost}).withColumn("score", F.least(F.lit(1.0), F.col("vector_score") + F.col("metadata_boost")))


def retrieve(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, rerank: bool = True) -> DataFrame:
    """The k best chunks of each strategy for each question: OVERFETCH * k by cosine, then reranked by metadata.

    questions has question_id, question, embedding; chunks the metadata by chunk_id. A strategy without vectors
    gives no hits.
    """
    near = nearest(questions, vectors, k * OVERFETCH if rerank else k)
    held = near.join(chunks.drop("strategy"), "chunk_id").join(questions.select("question_id", "question"), "question_id")
    made = scored(held) if rerank else scored(held).withColumns({"metadata_boost": F.lit(0.0), "score": F.col("vector_score")})
    rank = F.row_number().over(Window.partitionBy("question_id", "strategy").orderBy(F.desc("score"), "distance", "chunk_id"))
    return made.withColumn("rank", rank).filter(F.col("rank") <= k)


def dedupe_key(file_name: Column, section: Column, start: Column, end: Column, text: Column) -> Column:
    flat = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""))
    return F.struct(
        F.coalesce(file_name, F.lit("")).alias("f"), F.coalesce(section, F.lit("")).alias("s"), F.coalesce(start, F.lit(0)).alias("a"),
        F.coalesce(end, F.lit(0)).alias("b"), F.substring(flat, 1, 700).alias("t"),
    )


def hybrid(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """2k hits of each strategy, the best of each text, cut to the k best; fixed-size goes first among equals."""
    hits = retrieve(questions, vectors, chunks, 2 * k).withColumnRenamed("strategy", "source_strategy")
    key = dedupe_key(*[F.col(c) for c in ("file_name", "section_title", "page_start", "page_end", "text")])
    order = [F.desc("score"), F.desc("metadata_boost"), F.desc("vector_score"), "source_strategy", "rank"]
    first = F.row_number().over(Window.partitionBy("question_id", "_key").orderBy(F.desc("score"), "source_strategy", "rank"))
    one = hits.withColumn("_key", key).withColumn("_first", first).filter("_first = 1").drop("_key", "_first")
    best = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return one.withColumn("rank", best).filter(F.col("rank") <= k).withColumn("strategy", F.lit("hybrid"))


def search(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, strategy: str) -> DataFrame:
    if strategy == "hybrid":
        return hybrid(questions, vectors, chunks, k)
    if strategy not in ("fixed_size", "structure_aware"):
        raise ValueError(f"unknown strategy: {strategy}")
    return retrieve(questions, vectors.filter(F.col("strategy") == strategy), chunks, k)


def refusals(questions: DataFrame, hits: DataFrame, least: float = REFUSE_BELOW) -> DataFrame:
    """question_id, best_score and refused: no hits at all, or none with a score of least."""
    best = hits.groupBy("question_id").agg(F.max("score").alias("best_score"))
    return questions.select("question_id").join(best, "question_id", "left").withColumn("refused", F.coalesce(F.col("best_score") < least, F.lit(True)))


def says_refusal(answer: Column) -> Column:
    return F.startswith(F.lower(F.trim(answer)), F.lit("i cannot find"))
