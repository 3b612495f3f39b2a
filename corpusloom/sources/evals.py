"""Evaluation data: retrieval collections and saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def retrieval_collection(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, query, doc_id, text) of the first ``limit`` judgements, and their corpus rows."""
    q = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id")).orderBy("query_id", "doc_id").limit(limit)
    rows = q.join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("query")), "query_id").join(corpus.select(F.col("id").alias("doc_id"), "text"), "doc_id")
    return rows.select("query_id", "query", "doc_id", "text"), corpus


def saved_results(spark: SparkSession, folder: str) -> DataFrame:
    """(file, modified, kind, records) of saved JSON results, newest first; kind is benchmark, eval, json or invalid."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    body = F.try_parse_json(F.decode("content", "utf-8"))
    has = lambda p: F.try_variant_get(body, p, "variant").isNotNull()
    kind = F.when(body.isNull(), "invalid").when(has("$.records"), "benchmark").when(has("$.cases") | has("$.metrics"), "eval").otherwise("json")
    record = "array<struct<operation:string,iterations:int,p50_ms:double,p95_ms:double,min_ms:double,max_ms:double>>"
    return raw.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), kind.alias("kind"), F.try_variant_get(body, "$.records", record).alias("records")).orderBy(F.desc("modified"), "file")
