"""Dense vectors: local hash embeddings and exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.lexical import ranked, term_frequency


def hash_components(docs: DataFrame, dims: int, key: str = "doc_id") -> DataFrame:
    """(key, dim, value) of hash embeddings in long form, each document of unit length.

    Tokens are hashed once per distinct token and document.
    """
    n = max(8, dims)
    tf = term_frequency(docs, key)
    h = F.sha2("token", 256)
    little = F.concat(*[F.substring("h", 15 - 2 * k, 2) for k in range(8)])
    slot = (F.conv(little, 16, 10).cast("decimal(20,0)") % n).cast("int")
    sign = F.when(F.conv(F.substring("h", 17, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    parts = tf.withColumn("h", h).select(key, slot.alias("dim"), (sign * F.col("tf")).alias("v")).groupBy(key, "dim").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return parts.where("v <> 0").select(key, "dim", (F.col("v") / norm).alias("value"))


def hash_embeddings(docs: DataFrame, dims: int, key: str = "doc_id") -> DataFrame:
    """(key, vector) with all ``dims`` components."""
    n = max(8, dims)
    packed = hash_components(docs, dims, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return docs.select(key).join(packed, key, "left").select(key, F.coalesce(full, F.array_repeat(F.lit(0.0), n)).alias("vector"))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str, vector: str, digits: int = 6) -> DataFrame:
    """(key, score, rank): the ``k`` best positive inner products with one query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(text.dot(F.col(vector), q), digits).alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank) for a stated table of queries (query_id, q); queries are few."""
    scored = vectors.join(F.broadcast(queries)).select("query_id", key, F.round(text.dot(F.col(vector), F.col("q")), digits).alias("score")).where("score > 0")
    return ranked(scored, k, "query_id", key)
