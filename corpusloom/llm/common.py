"""Small pieces that several operators of this package share."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and \t \n \v \f \r, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it was.

    ``lower`` has a fast path for ASCII; ``translate`` serves the other texts.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(rows: int, per_bucket: int = 4096, most: int = 20) -> int:
    """Bits of a uniform hash that cut ``rows`` into buckets of about ``per_bucket``."""
    return min(most, max(0, math.ceil(math.log2(max(rows, 1) / per_bucket)))) if rows > per_bucket else 0


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``n``; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def column(df: DataFrame, name: str) -> int:
    """Position of the column ``name``: the one of that spelling, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    near = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(near) != 1:
        raise ValueError(f"no column {name} among {df.columns}")
    return near[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under fixed names, so that extra columns, also such as differ in case only, can't clash."""
    at = {k: column(df, c) for k, c in columns.items()}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(k) for k, i in at.items()])


def with_row(df: DataFrame, **columns: str) -> DataFrame:
    """``pick`` and the column ``row``, a struct of all columns by position, for ``rows_of``."""
    at = {k: column(df, c) for k, c in columns.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(F.struct(*plain.columns).alias("row"), *[F.col(f"c{i}").alias(k) for k, i in at.items()])


def rows_of(held: DataFrame, names: list[str]) -> DataFrame:
    """The columns kept in ``row``, under their names."""
    return held.select(*[F.col("row").getField(f"c{i}") for i in range(len(names))]).toDF(*names)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], deal: Column) -> DataFrame:
    """``rows`` joined with ``table``, which has a row per key and the number of its rows in ``copies``.

    Keys with more rows than a share of a task are cut into parts, to which rows are dealt by ``deal``; ``table``
    is repeated for each part.  There are at most 8 such keys a partition, so their list can be broadcast.
    """
    total = table.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    limit = max(64, total // (8 * partitions(rows.sparkSession)) + 1)
    parts = F.ceil(F.col("copies") / limit).cast("int")
    hot = table.where(F.col("copies") > limit).select(*on, parts.alias("parts"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(deal, F.col("parts"))).cast("int")).drop("parts")
    each = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > limit, parts - 1).otherwise(0))))
    return salted.join(each.drop("copies").hint("shuffle_merge"), [*on, "salt"]).drop("salt")


#: Rows and bytes of a batch that goes to Python or comes from there.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends texts to Python in small batches.

    By default a batch is 10,000 rows, which of long documents is more than a worker should
    hold.  Batches are cut when a plan runs, so the settings stay; smaller ones are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = re.sub(r"\D", "", conf.get(key)) or "0"
        if not 0 < int(held) <= most:
            conf.set(key, str(most))
    return df
