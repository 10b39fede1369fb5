"""Registered queries of the exact search that skips cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import cells as K
from granary.plans.queries import ORACLE_SQL, VECTORS, query, vectors


@query(ORACLE_SQL["nearest_chunks"])
def nearest_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """The rows of nearest_chunks by way of cells."""
    q, v, _ = vectors(spark, d)
    return K.nearest_in_cells(q, v, 20).withColumn("distance", F.round("distance", 9))


_TOPIC = "list_transform(embedding, lambda x, i: x::double + case when (i - 1) % 8 = label % 8 then 6.0 else 0.0 end) as v"


def topic_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The questions and vectors of `vectors`, each drawn towards the direction of its label, so that cells lie apart."""
    q, v, c = vectors(spark, d)
    drawn = lambda x: F.transform(x, lambda y, i: y.cast("double") + F.when(i % 8 == F.col("label") % 8, 6.0).otherwise(0.0))
    label = c.select("chunk_id", F.regexp_extract("doc_id", r"\d+", 0).cast("int").alias("label"))
    return q.withColumn("embedding", drawn("embedding")), v.join(label, "chunk_id").withColumn("embedding", drawn("embedding"))


@query(f"""with {VECTORS.replace("list_transform(embedding, lambda x: x::double) as v", _TOPIC)}
select question_id, strategy, chunk_id, round(distance, 9) as distance, vector_rank::int as vector_rank from near where vector_rank <= 3""")
def topic_neighbours(spark: SparkSession, d: str) -> DataFrame:
    q, v = topic_vectors(spark, d)
    return K.nearest_in_cells(q, v, 3).withColumn("distance", F.round("distance", 9))


@query("""select case when vec_id % 2 = 0 then 'fixed_size' else 'structure_aware' end as strategy, count(*) as vectors, (select count(*) from embeddings where vec_id % 100 = 0) as questions,
 true as skips_half from embeddings group by all""")
def topic_search_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each strategy, how many vectors and questions there are, and whether at least half of all pairs go unread."""
    q, v = topic_vectors(spark, d)
    index = K.build_cells(v)
    report = K.cell_report(q, index, K.search_cells(q, index, 3)[1])
    return report.select("strategy", "vectors", "questions", (F.col("pairs_read") * 2 <= F.col("vectors") * F.col("questions")).alias("skips_half"))
