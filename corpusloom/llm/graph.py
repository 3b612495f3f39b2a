"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import staged


def components(edges: DataFrame, a: str = "a", b: str = "b", count: list[int] | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    In each round nodes get a new random order by a hash, every node points at the least of itself and its
    neighbours, pointers are followed twice over (four hops), and edges are contracted.  Of two
    neighbours one points away, so in a random order at most half of the nodes are expected to
    be pointed at by themselves, and chains of pointers are short: a path or a chain of revisions
    needs a number of rounds that grows with the logarithm of its length, a star needs two.  Tables are written
    between rounds; ``count`` gets a number per round, the edges left.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = staged(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while True:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = e.union(e.select("b", "a"))
        # Two columns, not a struct, so that the aggregate is one of hash tables.
        least = both.groupBy("a").agg(F.min(F.xxhash64("b", F.lit(turn))).alias("h"), F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("m"))
        step = staged(least.select(F.col("a").alias("node"), F.when(rank("a") < F.struct(F.col("h"), F.col("m").alias("v")), F.col("a")).otherwise(F.col("m")).alias("to")), "step")
        hop = lambda s: s.join(s.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
        step = staged(hop(hop(step)), "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = staged(labels, "labels")
        sa, sb = step.select(F.col("node").alias("a"), F.col("to").alias("a2")), step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        e = e.join(sa, "a").join(sb, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        e = staged(e, "edges")
        turn += 1
        if count is not None:
            count.append(e.count())
        if e.isEmpty():
            least = labels.groupBy("component").agg(F.min("node").alias("least"))
            return labels.join(least, "component").select("node", F.col("least").alias("component"))
