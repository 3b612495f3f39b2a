"""Lexical search: TF-IDF, BM25 with phrases, and grep."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def token_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, n) whose sums by token are the counts of ``code_tokens``.

    A plain word is a token twice, as a whole and as its only piece, so it needs no cutting; only
    words with ``_``, ``$`` or an inner capital go through array functions.
    """
    w = F.col("w")
    words = docs.select(key, F.explode(F.regexp_extract_all(text.ascii_lower(F.col("text")), F.lit(r"[\p{L}\p{N}_$]+"), F.lit(0))).alias("w")).where(F.length(w) >= 2)
    compound = w.rlike(r"[_$]|\p{Ll}\p{Lu}")
    rows = words.select(key, F.explode(F.when(compound, text.code_tokens(w)).otherwise(F.array(w))).alias("token"), F.when(compound, 1).otherwise(2).alias("n"))
    return rows.where(~F.col("token").isin(text.CODE_STOP_WORDS))


def term_frequency(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, tf) of (key, text); counting is map-side first."""
    return token_rows(docs, key).groupBy(key, "token").agg(F.sum("n").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def unit_vectors(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, w): term frequencies, of unit length per document; they aren't weighted by rarity."""
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key)))
    return tf.select(key, "token", (F.col("tf") / norm).alias("w"))


def query_weights(queries: DataFrame, df: DataFrame, n_docs: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, token, wq): sqrt(tf) * (ln((N + 1) / (df + 1)) + 1), of unit length; unseen tokens count."""
    q = term_frequency(queries, query).join(F.broadcast(n_docs)).join(df, "token", "left")
    w = F.sqrt("tf") * (F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    q = q.select(query, "token", w.alias("w"))
    return q.select(query, "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(query)))).alias("wq"))


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank): the ``k`` best documents of each query, score rounded to 6 places.

    Only tokens of queries are counted; a document's length comes from one more aggregate of the
    same counts, so postings of other tokens are never joined.
    """
    tf = term_frequency(docs, key)
    wanted = token_rows(queries, query).select("token").distinct()
    norms = tf.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    hits = tf.join(wanted, "token", "left_semi")
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    q = query_weights(queries, document_frequency(hits), n_docs, query)
    scored = hits.join(q, "token").groupBy(query, key).agg(F.sum(F.col("tf") * F.col("wq")).alias("s")).join(norms, key)
    scored = scored.select(query, key, F.round(F.col("s") / F.col("norm"), 6).alias("score")).where("score > 0")
    return ranked(scored, k, query, key)


def ranked(scored: DataFrame, k: int, query: str, *ties: str | Column) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fts_phrases(query: str) -> list[list[str]]:
    """Each word of the query as the phrase of index words it stands for: ``a_b`` is a then b."""
    return [[w.lower() for w in re.findall(r"[^\W_]+", t)] for t in text.fts_terms(query)]


def _matches(phrases: list[list[str]], columns: list[Column]) -> Column:
    """Array with the number of hits of each phrase in lines of words, then the number of words; hits don't cross columns.

    Counted by patterns on the line, so no array of words is made.
    """

    def counted(line: Column) -> Column:
        hits = [F.regexp_count(line, F.lit(f"(?<= ){p[0]}(?={''.join(f' {w}' for w in p[1:])} )")).cast("long") for p in phrases]
        return F.array(*hits, F.regexp_count(line, F.lit("[^ ]+")).cast("long"))

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [text.let(c, counted) for c in columns])


def bm25_search(docs: DataFrame, query: str, k: int, columns: list[str] = ("text",), key: str = "doc_id", ties: list[str] = ()) -> DataFrame:
    """(key, score, fts_score, rank): Okapi BM25 of phrases over text columns, best first.

    One pass over the documents counts hits and lengths; statistics are one row.  Only documents
    with a hit are scored.
    """
    phrases = [p for p in fts_phrases(query) if p]
    if not phrases:
        return docs.select(key).limit(0).select(key, F.lit(0.0).alias("score"), F.lit(0.0).alias("fts_score"), F.lit(0).alias("rank"))
    words = [F.array_join(c, " ") if dict(docs.dtypes)[c].startswith("array") else F.coalesce(F.col(c), F.lit("")) for c in columns]
    counted = docs.select(key, *ties, _matches(phrases, [text.fts_line(w) for w in words]).alias("f"))
    counted = counted.select(key, *ties, F.slice("f", 1, len(phrases)).alias("f"), F.element_at("f", -1).alias("len"))
    flags = [F.sum((F.get("f", F.lit(i)) > 0).cast("long")).alias(f"n{i}") for i in range(len(phrases))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *flags)
    row = counted.where(F.exists("f", lambda x: x > 0)).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        n, f = F.col(f"n{i}"), F.get("f", F.lit(i)).cast("double")
        idf = F.log((F.col("n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(IDF_FLOOR)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = row.select(key, *ties, F.round(score, 6).alias("score"))
    out = out.withColumn("fts_score", F.round(F.col("score") / (F.col("score") + 1), 6))
    top = out.orderBy(F.desc("score"), *(ties or [key])).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *(ties or [key]))))


def grep_many(lines: DataFrame, patterns: list[str], limit: int, order: list[str | Column]) -> DataFrame:
    """The first ``limit`` rows of each pattern, in one pass; ``pattern`` is its number."""
    which = F.array_compact(F.array(*[F.when(F.col("line").rlike(f"(?i){_usable(p)}"), i) for i, p in enumerate(patterns)]))
    hits = lines.withColumn("pattern", F.explode(which))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy(*order))).where(F.col("r") <= limit).drop("r")


def _usable(pattern: str) -> str:
    """The pattern, escaped if it is no expression."""
    try:
        re.compile(pattern)
    except re.error:
        return re.escape(pattern)
    return pattern


def grep(lines: DataFrame, pattern: str, limit: int, order: list[str | Column]) -> DataFrame:
    """The first ``limit`` rows of (…, line) that match without case; a pattern that is no expression is literal."""
    return lines.where(F.col("line").rlike(f"(?i){_usable(pattern)}")).orderBy(*order).limit(limit)
