"""Arrays of fixed size that every partition fills and that are merged in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.pieces import tidy

#: Parts of an array that are merged apart from each other.
BLOCKS = 64


def merged(df: DataFrame, length: int, dtype: type, fill: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all partitions of an array that ``fill`` adds each batch to.

    Partitions send their blocks to the tasks that add them up one by one, so
    memory is that of the array; the driver gets the sum only.
    """
    part = length // BLOCKS

    def make(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(length, dtype)
        some = False
        for batch in batches:
            fill(total, batch)
            some = True
        for k in range(BLOCKS if some else 0):
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "data": pa.array([total[k * part : (k + 1) * part].tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype)
                sums[k] = sums[k] + x if k in sums else x.copy()
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros(length, dtype)
    schema = "block int, data binary"
    for r in df.mapInArrow(tidy(make), schema).repartition(BLOCKS, "block").mapInArrow(tidy(add), schema).collect():
        out[r.block * part : (r.block + 1) * part] = np.frombuffer(r.data, dtype)
    return out
