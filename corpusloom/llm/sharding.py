"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A document descends the tree; at each node every child draws an exponential
variate from a hash of (identifier, child), divided by the child's weight, and
the least draw wins.  A child's draw depends only on itself, so when a weight
changes, documents move only into or out of subtrees whose weights change.

Shards fill a fixed grid: ``rack_size`` shards a rack, ``racks`` racks a region.
Once the regions are full, as with 24 shards, one more shard opens a region of
its own, so documents move into that shard and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bucket_bits, pick

REGION, RACK, SHARD, SLOT = 1, 2, 3, 4


@dataclass(frozen=True)
class Layout:
    """Shards 0 to ``n_shards`` - 1 on a grid; ``weights`` default to 1 each."""

    n_shards: int
    rack_size: int = 4
    racks: int = 3
    weights: tuple[float, ...] = ()

    def tree(self) -> dict[int, dict[int, dict[int, float]]]:
        """Region to rack to shard to weight; racks are numbered over all regions."""
        if self.n_shards < 1:
            raise ValueError("at least one shard is needed")
        out: dict[int, dict[int, dict[int, float]]] = {}
        for i in range(self.n_shards):
            rack = i // self.rack_size
            out.setdefault(rack // self.racks, {}).setdefault(rack, {})[i] = self.weights[i] if self.weights else 1.0
        return out


def _draw(doc_id: Column, level: int, child: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(level), F.lit(child)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _least(doc_id: Column, level: int, children: dict[int, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(doc_id, level, c, w).alias("draw"), F.lit(c).alias("child")) for c, w in children.items()]
    return F.array_min(F.array(*draws)).getField("child")


def _chosen(key: Column, level: int, nodes: dict[int, dict[int, float]], doc_id: Column) -> Column:
    out = F.lit(None).cast("int")
    for node, children in nodes.items():
        out = F.when(key == node, _least(doc_id, level, children)).otherwise(out)
    return out


def place(df: DataFrame, layout: Layout, id_col: str, out: str) -> DataFrame:
    """``df`` with the shard of each row in ``out``."""
    tree = layout.tree()
    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    doc_id = F.col(id_col)
    df = df.withColumn("_region", _least(doc_id, REGION, {r: total(racks) for r, racks in tree.items()}))
    df = df.withColumn("_rack", _chosen(F.col("_region"), RACK, {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}, doc_id))
    df = df.withColumn(out, _chosen(F.col("_rack"), SHARD, {k: s for racks in tree.values() for k, s in racks.items()}, doc_id).cast("int"))
    return df.drop("_region", "_rack")


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; a null text has no bytes and the crc32 of
    the empty text.  Identifier and shard count alone decide the shard (law ``key``);
    rows with the same or a null identifier share one.  ``slot`` numbers a shard's rows
    from 0 without gaps, in the order of a hash; it is counted in hash buckets, so no
    task holds a whole shard.  ``grown_shard`` is the shard with one shard more.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    d = place(d, Layout(n_shards), "doc_id", "shard")
    d = place(d, Layout(n_shards + 1), "doc_id", "grown_shard")
    bits = bucket_bits(docs.count() // n_shards)
    h = F.xxhash64("doc_id", F.lit(SLOT))
    d = d.withColumn("h", h).withColumn("b", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = place(pick(docs, doc_id=id_col), Layout(n_shards), "doc_id", "shard").withColumn("h", h)
    counts = counts.withColumn("b", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")).groupBy("shard", "b").agg(F.count("*").alias("rows"))
    start = F.sum("rows").over(Window.partitionBy("shard").orderBy("b")) - F.col("rows")
    offsets = counts.select("shard", "b", start.alias("start"))
    d = d.join(offsets, ["shard", "b"])
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "b").orderBy("h", "doc_id", "size", "text_crc32")) - 1
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")
