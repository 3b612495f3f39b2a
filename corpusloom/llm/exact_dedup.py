"""Exact dedup by content sort, in DataFrame functions only.

Normalised texts are dealt by sampled range splitters, sorted externally in each
partition so that equal texts are neighbours, and compared in full with the
neighbour; of each run of equal texts one row stays.

Splitters are drawn on the first ``PREFIX`` characters, then a 64-bit hash of the
whole text, then a salt: the sample on the driver holds no long texts, and texts
that begin alike still spread.  A text with more copies than a task should take
is salted by identifier; such texts number at most ``rows / limit`` (a few per
partition), so their list can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, partitions, pick, rows_of, with_row

PREFIX = 24


def _marked(d: DataFrame, keep: str) -> DataFrame:
    """``d`` (doc_id, norm and any more) without norm, with keep_id, group_size, kept and text_sha256."""
    n = partitions(d.sparkSession)
    more = [c for c in d.columns if c not in ("doc_id", "norm")]
    limit = max(16, d.count() // (8 * n) + 1)
    d = d.withColumn("h", F.xxhash64("norm"))
    copies = d.groupBy("h").agg(F.count("*").alias("copies")).where(F.col("copies") > limit)
    hot = copies.select("h", F.ceil(F.col("copies") / limit).cast("int").alias("salts"))  # rows / limit entries at most
    d = d.join(F.broadcast(hot), "h", "left")
    d = d.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int"))
    d = d.withColumn("start", F.substring("norm", 1, PREFIX))
    # The runs of a salted text meet again here: a row per hot text, found before the sort.
    best = (F.max if keep == "largest" else F.min)("doc_id")
    whole = d.where(F.col("salts").isNotNull()).groupBy("h", F.sha2("norm", 256).alias("text_sha256")).agg(best.alias("best"), F.count("*").alias("all_size")).drop("h")
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    run = ["start", "h", "norm", "salt"]
    d = d.repartitionByRange(n, "start", "h", "salt").sortWithinPartitions(*run, order)
    w = Window.partitionBy(*run).orderBy(order)
    rows = d.select(
        "doc_id", *more, F.sha2("norm", 256).alias("text_sha256"), F.first("doc_id").over(w).alias("first_id"),
        F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("run_size"),
        F.row_number().over(w).alias("n"),
    )
    rows = rows.join(F.broadcast(whole), "text_sha256", "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("first_id")).otherwise(F.col("best"))
    return rows.select(
        "doc_id", *more, keep_id.alias("keep_id"), F.coalesce("all_size", "run_size").cast("long").alias("group_size"),
        ((F.col("n") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"), "text_sha256",
    )


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(text_col, F.lit("")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    ``keep`` says whether the largest or smallest identifier of equal texts stays.
    Rows that repeat an identifier and text form one group, of which one row stays.
    Null identifiers come last, so such a row stays only if its group has no other.
    An empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", _norm("text").alias("norm"))
    return _marked(d, keep)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of equal texts, null and empty ones being one group.

    Of equal texts under one identifier one row stays; an identifier that is null stays only where its group has no
    other.  An empty table gives an empty result.
    """
    d = with_row(docs, doc_id=id_col, text=text_col).select("doc_id", _norm("text").alias("norm"), "row")
    return rows_of(_marked(d, keep).where("kept"), docs.columns)
