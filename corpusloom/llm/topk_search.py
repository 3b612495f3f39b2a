"""Exact top-k search by inner product over norm-sorted blocks.

Vectors are turned into integers and dealt, longest first, into blocks of similar
length.  A rotation by the singular vectors of all vectors puts most of an inner product
into the first coordinates.  A block of queries meets a block of candidates like this:

* queries whose length times the block's greatest length can't reach their k-th best score are done;
* partial sums over the first coordinates plus the Cauchy-Schwarz bound of the rest are compared with it, in
  steps of ``STEP`` coordinates: each step goes on with the pairs that may still reach it;
* what is left after the last step is scored exactly, in integers.

The k-th best scores, the floors, start from the block of longest vectors.  Queries are then dealt anew by the length that a
candidate needs to reach their floor, so that a block of queries needs a prefix of the blocks only: the
others are left out before any vector is sent.  Blocks meet in a grid of tasks of fixed size; per query and block, k rows leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, pick
from corpusloom.llm.fixed import BLOCKS, merged
from corpusloom.llm.pieces import tidy
from corpusloom.sources.scratch import staged

QUERY_ROWS, BLOCK_ROWS = 4096, 8192
#: Coordinates that a step of the partial sums adds, and the share of pairs left from which a step computes them all at once.
STEP, DENSE = 16, 0.05
#: Candidates that a task looks at at once; the first of a block are fewer, as floors may be unknown.
FIRST, TILE = 128, 1024
NONE = int(np.iinfo(np.int64).min)
#: Numbers and lengths of up to so many blocks are broadcast; of more, the grid's cells are found by a plain join.
MOST_BLOCKS = 100_000


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of every component, x as double; ``row`` numbers rows, for a table to be written.

    Rows without identifier or vector, or with a null or non-finite component, are left out.  Rows
    that repeat an identifier all take part.  Values beyond 64 bits are the nearest of these.
    """
    d = pick(vectors, vec_id=id_col, v=vec_col).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return d.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for k, n in enumerate(lengths):
        out[k, :n] = flat[starts[k] : starts[k + 1]]
    return out


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    top = int(np.abs(m).max(initial=0))
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return np.dtype(kind).itemsize, m.astype(kind).tobytes()


def _unpacked(width: int, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(-1, dim).astype(np.int64)


BLOCK = "block int, rows binary, ids binary, width int, data binary, longest double"


def _blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Each partition of (row, vec_id, v), packed into rows of up to ``size`` vectors; block is the partition's number."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = TaskContext.get().partitionId()

        def out():
            rows, ids, m = (np.concatenate(x) for x in zip(*held, strict=True))
            width, data = _packed(m)
            longest = float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max(initial=0))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int32()), "rows": pa.array([rows.tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()),
                "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary()), "longest": pa.array([longest]),
            })

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if held and sum(len(x) for x, _, _ in held) + piece.num_rows > size:
                    yield out()
                    held.clear()
                held.append((piece.column("row").to_numpy().astype(np.int64), piece.column("vec_id").to_numpy().astype(np.int64), _matrix(piece.column("v"), dim)))
        if held:
            yield out()

    return rows.select("row", "vec_id", "v").mapInArrow(tidy(run), BLOCK)


class Best:
    """The k best candidates of each query so far, as (query, score, identifier, row) by query and rank."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.low = k, np.where(floor == NONE, -np.inf, floor.astype(float))
        self.query, self.score, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        query, score, ids, rows = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[rank < self.k]
        self.query, self.score, self.ids, self.rows = query[order], score[order], ids[order], rows[order]
        last = rank[rank < self.k] == self.k - 1
        self.low[self.query[last]] = np.maximum(self.low[self.query[last]], self.score[last])


def _exact(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray, small: bool) -> np.ndarray:
    """The integer inner products of the pairs; ``small`` ones are exact in doubles."""
    if not small:
        value = [max(-(1 << 63) + 1, min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True)))) for i, j in zip(row, col, strict=True)]
        return np.array(value, np.int64)
    out = np.zeros(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", q[row[part]].astype(float), c[col[part]].astype(float)).astype(np.int64)
    return out


def block_topk(q_rows, q, c_rows, cid, c, floor, rotation, k, count=None):
    """The k best of ``c`` that reach its floor for each query; its own row is left out.

    ``count`` gets the pairs in all, those that had a partial sum and those that were scored.
    """
    dim = q.shape[1]
    small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1) < 2.0**52
    qf, cf = q.astype(float), c.astype(float)
    qn, cn = np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)
    slack = 1e-9 * (1 + qn.max(initial=0) * cn.max(initial=0))
    order = np.argsort(-cn, kind="stable")
    c_rows, cid, c, cn = c_rows[order], cid[order], c[order], cn[order]
    qr, cr = qf @ rotation, cf[order] @ rotation
    steps = [*range(STEP, dim, STEP), dim]
    rest = lambda x, n: [np.sqrt(np.maximum(n**2 - (x[:, :e] ** 2).sum(1), 0)) for e in steps]
    q_rest, c_rest = rest(qr, qn), rest(cr, cn)
    best = Best(floor, k)
    seen = [len(q) * len(c), 0, 0]
    tiles = [(at, min(at + (FIRST if not at else TILE), len(c))) for at in ([0, *range(FIRST, len(c), TILE)] if len(c) else [])]
    for at, end in tiles:
        every = np.flatnonzero(qn * cn[at] + slack >= best.low)  # lengths only fall from here
        if not len(every):
            break
        for part in range(0, len(every), TILE):
            live = every[part : part + TILE]
            low, partial, row, col = best.low[live], None, None, None
            seen[1] += len(live) * (end - at)
            for n, e in enumerate(steps):
                s = e - (e - 1) % STEP - 1
                bound = lambda i, j: q_rest[n][live[i]] * c_rest[n][at + j] + slack  # noqa: B023, E731
                if row is None:
                    more = qr[live, s:e] @ cr[at:end, s:e].T
                    partial = more if partial is None else partial + more
                    may = partial + q_rest[n][live, None] * c_rest[n][None, at:end] + slack >= low[:, None]
                    if e == dim or np.count_nonzero(may) <= DENSE * may.size:
                        row, col = np.nonzero(may)
                        partial = partial[row, col]
                else:
                    partial = partial + np.einsum("ij,ij->i", qr[live[row], s:e], cr[at + col, s:e])
                    may = partial + bound(row, col) >= low[row]
                    row, col, partial = row[may], col[may], partial[may]
            seen[2] += len(row)
            own = c_rows[at + col] == q_rows[live[row]]
            row, col = row[~own], col[~own]
            best.add(live[row], _exact(q, c[at:end], live[row], col, small), cid[at + col], c_rows[at + col])
    if count is not None:
        for i, x in enumerate(seen):
            count[i] += x
    return best


FOUND = "q_row long, query_id long, vec_id long, c_row long, score long"


def _searched(cells: DataFrame, rotation, dim: int, k: int) -> DataFrame:
    """Each cell's best; floors is binary, a number per query, or null."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                q_rows, qid, rows, cid = (np.frombuffer(r[c], np.int64) for c in ("q_rows", "q_ids", "rows", "ids"))
                floor = np.full(len(qid), NONE) if r["floors"] is None else np.frombuffer(r["floors"], np.int64)
                best = block_topk(q_rows, _unpacked(r["q_width"], r["q_data"], dim), rows, cid, _unpacked(r["width"], r["data"], dim), floor, rotation.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_rows[best.query], qid[best.query], best.ids, best.rows, best.score)], names=["q_row", "query_id", "vec_id", "c_row", "score"])

    return cells.select("q_rows", "q_ids", "q_width", "q_data", "floors", "rows", "ids", "width", "data").mapInArrow(tidy(run), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best candidates of each query, all if there are fewer.

    Queries are the rows whose identifier is divisible by ``every``, candidates all rows but the query's own;
    the score is the inner product of the integer vectors (of different lengths: shorter ones end in zeros).
    Ties go to the smaller vec_id.  Rows that repeat an identifier are rows of their own, as queries and as candidates.
    See ``integer_vectors`` for rows that take no part.  An empty table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    base = staged(integer_vectors(vectors, id_col, vec_col), "topk-vectors")
    facts = base.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, facts.dim)
    length = -(-dim * dim // BLOCKS) * BLOCKS

    def gram(total: np.ndarray, batch: pa.RecordBatch) -> None:
        m = _matrix(batch.column("v"), dim).astype(float)
        total[: dim * dim] += (m.T @ m).reshape(-1)

    _, turned = np.linalg.eigh(merged(base.select("v"), length, np.float64, gram)[: dim * dim].reshape(dim, dim))
    rotation = spark.sparkContext.broadcast(np.ascontiguousarray(turned[:, ::-1]))  # dim x dim
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest_first = base.withColumn("norm", -norm).repartitionByRange(max(1, -(-facts.n // BLOCK_ROWS)), "norm", "row").sortWithinPartitions("norm", "row")
    blocks = staged(_blocks(longest_first, dim, BLOCK_ROWS), "topk-blocks")
    wanted = base.where(F.col("vec_id") % every == 0)
    n_q = max(1, -(-wanted.count() // QUERY_ROWS))
    tasks = partitions(spark)

    def query_blocks(rows: DataFrame) -> DataFrame:
        """(q, q_rows, q_ids, q_width, q_data) of queries already dealt."""
        b = _blocks(rows, dim, QUERY_ROWS).select(F.monotonically_increasing_id().alias("q"), *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "width", "data")])
        return staged(b, "topk-queries")

    def grid(cells: DataFrame) -> DataFrame:
        return _searched(cells.join(blocks.hint("shuffle_merge"), "block").repartition(tasks, "q", "block"), rotation, dim, k)

    first = blocks.agg(F.min("block").alias("b")).first().b
    start = query_blocks(wanted.repartition(n_q, "row"))
    head = staged(_ranked(grid(start.withColumns({"block": F.lit(first), "floors": F.lit(None).cast("binary")})), k), "topk-head")
    # A query's floor is its k-th best so far; none of shorter candidates than ``reach`` gets there.
    floor = head.where(F.col("rank") == k).select(F.col("q_row").alias("row"), F.col("score").alias("floor"))
    q = wanted.withColumn("norm", norm).join(floor, "row", "left")
    q = q.withColumn("reach", F.when(F.col("floor").isNull() | (F.col("norm") == 0), -1.0).otherwise(F.col("floor") / F.col("norm")))
    q = staged(q.select("row", "vec_id", "v", "floor", "reach"), "topk-reach")
    queries = query_blocks(q.repartitionByRange(n_q, "reach", "row").sortWithinPartitions("reach", "row"))
    # What a block of queries needs beside its vectors: the floors in its order, and the least reach.
    members = queries.select("q", "q_rows").mapInArrow(tidy(_members), "q long, at int, row long").join(q.select("row", "floor", "reach"), "row")
    of_block = members.groupBy("q").agg(F.min("reach").alias("reach"), F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("floor", F.lit(NONE)).alias("floor")))), lambda x: x["floor"]).alias("floors"))  # QUERY_ROWS at most
    # Cells are pairs of numbers until they are known to be needed.
    near = F.col("longest") + 1e-6 * (1 + F.abs("reach")) >= F.col("reach")
    last = blocks.where(F.col("block") != first).select("block", "longest")
    cells = of_block.select("q", "reach").join(F.broadcast(last), near).select("q", "block") if facts.n <= BLOCK_ROWS * MOST_BLOCKS else of_block.select("q", "reach").join(last, near).select("q", "block")
    ready = queries.join(of_block.select("q", "floors").mapInArrow(tidy(_packed_floors), "q long, floors binary"), "q")
    found = head.drop("rank").unionByName(grid(cells.join(ready.hint("shuffle_merge"), "q")))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _members(batches):
    for batch in batches:
        for q, rows in zip(batch.column("q").to_pylist(), batch.column("q_rows").to_pylist(), strict=True):
            x = np.frombuffer(rows, np.int64)
            yield pa.RecordBatch.from_pydict({"q": pa.array([q] * len(x), pa.int64()), "at": pa.array(np.arange(len(x)), pa.int32()), "row": pa.array(x)})


def _packed_floors(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"q": batch.column("q"), "floors": pa.array([np.array(x, np.int64).tobytes() for x in batch.column("floors").to_pylist()], pa.binary())})
