"""Reading of named Parquet tables below one folder, whatever file system it is on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table is dealt to all cores, whatever row groups its files have: a shuffle of that much costs next to
#: nothing, while a file of one row group is read, and all narrow work on it done, by one task.
SMALL = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``; the path only ever goes to Spark."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 << 20 < size <= SMALL and cores > 1 else df
