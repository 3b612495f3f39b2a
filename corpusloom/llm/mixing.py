"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash of the identifier and queued up to
``epochs`` times; a copy's virtual finish time is the source's words up to and
with it, divided by the source's target.  All copies are put in order of finish
time and taken while their words fit the budget.

No queue is ever in one task.  Running sums go over hash buckets: sums per
(source, bucket), offsets over those, then positions within a bucket.  The
global order is a range sort by finish time with sampled splitters: each partition's words are added up, and the one in which
the budget ends is cut copy by copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bucket_bits, partitions, pick, rows_of, with_row, word_count
from corpusloom.sources.scratch import staged

WEIGHTS = (5, 2, 1)
EPOCHS = 3
KEY_BITS = 60
#: Tables of sources of up to so many rows are broadcast, after a count; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Copies that a partition of the sorted queue holds at most, about.
SORTED_ROWS = 1_000_000


def _key():
    """60 uniform bits from the identifier, which order a source's documents."""
    digest = F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def queue_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, skey, size, k) of each row; skey names the source and is never null."""
    d = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return d.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), word_count(F.col("text")).alias("size"), _key().alias("k"))


def source_targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(skey, source_size, weight, target) from (skey, source, source_size).

    Sources in code point order, null last, take ``weights`` in turn.  Targets
    share the words of all sources by weight; one that would pass ``epochs`` times
    its source's size stops there and its excess goes to the others by weight.
    Sorted by limit per weight, the sources that stop are a prefix.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = sums.select("skey", "source", "source_size", w.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("limit"))
    rank = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weight_left).withColumn("r", F.row_number().over(rank))
    open_ = F.col("limit") > F.col("weight") * F.col("level")
    first = F.min(F.when(open_, F.struct("r", "level"))).over(whole)
    s = s.withColumn("cut", first)
    target = F.when(F.col("cut").isNull() | (F.col("r") < F.col("cut.r")), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("cut.level"))
    return s.select("skey", "source_size", "weight", target.alias("target"))


def _with_sources(df: DataFrame, sources: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources, "skey", how)


def plan(entries: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """Per source, how far its queue is taken, and the number of sources.

    Columns: skey, source_size, target, full (whole passes), last_k and last_id (the
    last document of the pass after those, null if none of it is taken).
    """
    bits = bucket_bits(entries.count())
    e = entries.withColumn("b", F.shiftright("k", KEY_BITS - bits) if bits else F.lit(0).cast("long"))
    sums = staged(e.groupBy("skey", "source", "b").agg(F.sum("size").alias("words")), "mix-sums")
    targets = staged(source_targets(sums.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights, epochs), "mix-targets")
    n_sources = targets.count()
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("v")).first().v
    start = F.sum("words").over(Window.partitionBy("skey").orderBy("b")) - F.col("words")
    offsets = sums.select("skey", "b", start.alias("start"))
    inside = Window.partitionBy("skey", "b").orderBy("k", "doc_id")  # rows that repeat an identifier count as one
    c = e.join(offsets, ["skey", "b"]).select("skey", "doc_id", "k", "size", (F.col("start") + F.sum("size").over(inside)).alias("upto"))
    c = _with_sources(c, targets, n_sources).where(F.col("target") > 0)
    c = c.select("skey", "doc_id", "k", "size", "target", "source_size", "upto", F.explode(F.array(*map(F.lit, range(epochs)))).alias("pass"))
    c = c.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
    order = ["finish", "skey", "k", "doc_id", "pass"]
    n = max(partitions(entries.sparkSession), -(-c.count() // SORTED_ROWS))
    c = c.select("skey", "doc_id", "k", "pass", "size", "finish").repartitionByRange(n, *order).sortWithinPartitions(*order)
    c = staged(c.withColumn("part", F.spark_partition_id()), "mix-queue")
    # The partition in which the budget ends, then its copies one by one.  A row per partition comes together here.
    sums = c.groupBy("part").agg(F.sum("size").alias("words"))
    ends = sums.select("part", F.sum("words").over(Window.orderBy("part")).alias("upto"), "words").where(F.col("upto") > budget)
    end = ends.orderBy("part").select("part", (F.col("upto") - F.col("words")).alias("before")).first()
    if end is None:
        taken = c
    else:
        last = c.where(F.col("part") == end.part).withColumn("upto", F.lit(end.before) + F.sum("size").over(Window.orderBy(*order))).where(F.col("upto") <= budget)
        taken = c.where(F.col("part") < end.part).select("skey", "doc_id", "k", "pass").unionByName(last.select("skey", "doc_id", "k", "pass"))
    reach = taken.groupBy("skey").agg(F.max(F.struct("pass", "k", "doc_id")).alias("m"))
    cut = targets.join(reach, "skey", "left").select("skey", "source_size", "target", F.coalesce("m.pass", F.lit(0)).alias("full"), F.col("m.k").alias("last_k"), F.col("m.doc_id").alias("last_id"))
    return staged(cut, "mix-cut"), n_sources


def passes(entries: DataFrame, cut: DataFrame, n_sources: int) -> DataFrame:
    """``entries`` with source_size, target and copies: how often each document is taken.

    Within a source, finish times follow (pass, k, doc_id), so one cut per source says
    it all and texts need no shuffle.
    """
    d = _with_sources(entries, cut, n_sources, "left")
    within = (F.col("k") < F.col("last_k")) | ((F.col("k") == F.col("last_k")) & ~(F.col("doc_id") > F.col("last_id")))
    more = F.when(F.coalesce(within, F.col("last_k").isNotNull() & (F.col("k") == F.col("last_k"))), 1).otherwise(0)
    return d.withColumn("copies", (F.col("full") + more).cast("long"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    ``size`` is the number of words (0 for null or blank text), ``taken`` is size
    times the copies taken.  A null source is a source of its own, the last.
    Reruns agree; rows that repeat an identifier move together.  An empty table
    gives an empty result; further columns are ignored.
    """
    e = staged(queue_entries(docs, id_col, text_col, source_col), "mix-entries")
    cut, n = plan(e, weights, epochs)
    return passes(e, cut, n).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    A document without words, also one whose text is null, has size 0; it is taken with its neighbours in the queue.  A null source is
    the last; rows that repeat an identifier are taken equally often.  An empty table gives an empty result.
    """
    e = queue_entries(docs, id_col, text_col, source_col)
    cut, n = plan(staged(e, "mix-entries"), weights, epochs)
    held = with_row(docs, doc_id=id_col, source=source_col).withColumns({"skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "k": _key()})
    held = passes(held, cut, n).where(F.col("copies") > 0)
    return rows_of(held.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns)
