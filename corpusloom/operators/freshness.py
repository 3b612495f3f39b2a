"""Differences between an indexed and the current state, and what they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compared(current: DataFrame, indexed: DataFrame, key: str, same: Column) -> DataFrame:
    """(key, status) of every row whose status isn't fresh: missing in the index, extra in it, or changed.

    ``same`` compares the columns of aliases c and i.
    """
    both = current.alias("c").join(indexed.alias("i"), F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    status = F.when(F.col(f"i.{key}").isNull(), "missing").when(F.col(f"c.{key}").isNull(), "extra").when(~same, "changed")
    return both.select(F.coalesce(f"c.{key}", f"i.{key}").alias(key), status.alias("status")).where("status IS NOT NULL")


def files_changed(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Freshness of (path, size_bytes, modified_unix, sha256): equal size and time count as equal, else the hash decides."""
    c, i = (lambda n: F.col(f"c.{n}")), (lambda n: F.col(f"i.{n}"))
    same = (c("size_bytes") == i("size_bytes")) & ((c("modified_unix") == i("modified_unix")) | F.coalesce(c("sha256") == i("sha256"), F.lit(False)))
    return compared(current, indexed, "path", same)


def hashes_changed(current: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """Freshness of (key, text_hash)."""
    return compared(current, indexed, key, F.col("c.text_hash") == F.col("i.text_hash"))


def touched_paths(changed: DataFrame, current: DataFrame, indexed: DataFrame, key: str = "id", path: str = "file_path") -> DataFrame:
    """(path) of all rows, now or before, whose key changed."""
    both = current.select(key, path).union(indexed.select(key, path))
    return both.join(changed.select(key), key, "left_semi").select(F.col(path).alias("path")).distinct()
