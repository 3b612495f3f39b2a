"""Versioned Parquet index: full builds, incremental refresh, summaries and snapshots.

Every build writes a version folder; a new, higher numbered pointer file names it, in one rename
after all tables are written, so readers see whole versions only.  Files are read once and
tables are written at the same time.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from corpusloom.operators import chunks as chunk_ops
from corpusloom.operators import freshness, graph, references, scan, symbols
from corpusloom.sources.scratch import staged

SCHEMA_VERSION, VECTOR_VERSION = 2, 1
REFRESH_LIMIT = 128
TABLES = {
    "files": "path string, language string, size_bytes bigint, modified_unix bigint, sha256 string, is_source boolean, is_config boolean, is_entry boolean",
    "symbols": symbols.SCHEMA,
    "refs": "file_path string, symbol_name string, line_number int, column_start int, kind string, snippet string",
    "chunks": "id string, file_path string, line_start int, line_end int, chunk_type string, signature string, source string, docs string, symbols array<string>, imports array<string>, module_path array<string>, text_hash string",
    "graph_nodes": "id string, kind string, label string, path string",
    "graph_edges": "from_id string, to_id string, kind string, evidence string",
}


@dataclass
class Refreshed:
    mode: str  # Unchanged, Incremental or Rebuilt
    touched: int
    counts: dict[str, int]


def derived(files: DataFrame) -> dict[str, DataFrame]:
    """All index tables of (path, size_bytes, modified_unix, sha256, text)."""
    f = scan.classified(files.where("text IS NOT NULL")).where("is_source OR is_config")
    code = f.where("is_source")
    s = staged(symbols.extract_symbols(code), "index-symbols")  # read by four tables
    nodes, edges = graph.build(f, s)
    every = scan.classified(files)
    names = [c.split()[0] for c in TABLES["files"].split(", ")]
    return {"files": every.select(*names), "symbols": s, "refs": references.references(code, s), "chunks": chunk_ops.chunk_files(f, s), "graph_nodes": nodes, "graph_edges": edges}


class IndexStore:
    """The index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[str]:
        """Names of the numbered pointers, the newest last."""
        fs, path = self._fs()
        top = path(self.path)
        return sorted(x.getPath().getName() for x in fs.listStatus(top) if x.getPath().getName().startswith("CURRENT-")) if fs.exists(top) else []

    def version(self) -> str | None:
        """The current version's folder, null without an index."""
        fs, path = self._fs()
        found = self._pointers()
        if not found:
            return None
        stream = fs.open(path(f"{self.path}/{found[-1]}"))
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _point(self, version: str) -> None:
        """Name ``version`` in a new pointer, which takes its place by one rename; a reader finds the one before until then.

        What pointers before the last two name is removed: a reader of the last version but one can go on.
        """
        fs, path = self._fs()
        held = self._pointers()
        number = int(held[-1].split("-")[1]) + 1 if held else 0
        new = path(f"{self.path}/.pointer-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        if not fs.rename(new, path(f"{self.path}/CURRENT-{number:012}")):
            raise OSError(f"another writer has made version {number} of {self.path}")
        for name in held[:-1]:
            stream = fs.open(path(f"{self.path}/{name}"))
            old = bytes(stream.readAllBytes()).decode().strip()
            stream.close()
            fs.delete(path(f"{self.path}/{old}"), True)
            fs.delete(path(f"{self.path}/{name}"), False)

    def _write(self, tables: dict[str, DataFrame], meta: dict[str, str]) -> dict[str, int]:
        version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        every = tables | {"meta": self.spark.createDataFrame(list(meta.items()), "key string, value string").coalesce(1)}

        def write(name: str) -> int:
            every[name].write.parquet(f"{self.path}/{version}/{name}")
            return self.spark.read.parquet(f"{self.path}/{version}/{name}").count()

        with ThreadPoolExecutor(len(every)) as pool:  # jobs of small tables share the cluster
            counts = dict(zip(every, pool.map(write, every), strict=True))
        self._point(version)
        return {name: counts[name] for name in tables}

    def read(self, name: str) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"no index in {self.path}")
        df = self.spark.read
        return (df.schema(TABLES[name]) if name in TABLES else df).parquet(f"{self.path}/{version}/{name}")

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.read("meta").collect()} if self.version() else {}

    def build(self, files: DataFrame) -> dict[str, int]:
        """Write all tables anew; rows by table."""
        return self._write(derived(staged(files, "index-files")), {"schema_version": str(SCHEMA_VERSION), "built_unix": str(int(time.time()))})

    def changed(self, files: DataFrame) -> DataFrame:
        """(path, status) of the files that differ from the index."""
        return freshness.files_changed(files, self.read("files"))

    def usable(self) -> bool:
        return self.meta().get("schema_version") == str(SCHEMA_VERSION)

    def is_fresh(self, files: DataFrame) -> bool:
        return self.usable() and self.changed(files).isEmpty()

    def refresh(self, files: DataFrame, limit: int = REFRESH_LIMIT) -> Refreshed:
        """Bring the index up to date: nothing, the touched files, or all if there are too many or no usable index.

        Text is parsed anew only in touched files.  References and the graph are joins over
        all files and are derived again, so that a refresh gives what a rebuild gives.
        """
        if not self.usable():
            return Refreshed("Rebuilt", 0, self.build(files))
        changed = staged(self.changed(files).select("path"), "index-changed")
        touched = changed.limit(limit + 1).count()
        if touched == 0:
            return Refreshed("Unchanged", 0, {})
        if touched > limit:
            return Refreshed("Rebuilt", touched, self.build(files))
        files = staged(files, "index-files")
        f = scan.classified(files.where("text IS NOT NULL")).where("is_source OR is_config")
        new = f.join(F.broadcast(changed), "path", "left_semi")  # REFRESH_LIMIT rows at most
        new_symbols = staged(symbols.extract_symbols(new.where("is_source")), "index-symbols")
        s = symbols.replaced(self.read("symbols"), changed, new_symbols)
        c = symbols.replaced(self.read("chunks"), changed, chunk_ops.chunk_files(new, new_symbols))
        nodes, edges = graph.build(f, s)
        names = [x.split()[0] for x in TABLES["files"].split(", ")]
        tables = {"files": scan.classified(files).select(*names), "symbols": s, "refs": references.references(f.where("is_source"), s), "chunks": c, "graph_nodes": nodes, "graph_edges": edges}
        return Refreshed("Incremental", touched, self._write(tables, {"schema_version": str(SCHEMA_VERSION), "built_unix": str(int(time.time()))}))

    def summary(self) -> dict[str, int | str]:
        return {name: self.read(name).count() for name in TABLES} | self.meta()


class VectorStore(IndexStore):
    """Chunks with their embeddings, refreshed by the paths whose chunks changed."""

    def _meta(self, backend: str, model: str, dims: int) -> dict[str, str]:
        return {"schema_version": str(VECTOR_VERSION), "backend": backend, "model": model, "dimensions": str(dims)}

    def embedded(self, chunks: DataFrame, dims: int, embed=None) -> DataFrame:
        """Chunks with a vector; ``embed`` is a function of (id, text) to (id, vector), by default the local hash."""
        from corpusloom.operators.dense import hash_embeddings

        ready = chunks.withColumn("text", chunk_ops.embed_text())
        vectors = (embed or (lambda df: hash_embeddings(df, dims, "id")))(ready.select("id", "text"))
        return chunks.join(vectors.withColumn("vector", F.col("vector").cast("array<float>")), "id")

    def rebuild(self, chunks: DataFrame, dims: int = 256, backend: str = "local_hash", model: str = "local-hash", embed=None) -> Refreshed:
        counts = self._write({"vectors": self.embedded(chunks, dims, embed)}, self._meta(backend, model, dims))
        return Refreshed("Rebuilt", counts["vectors"], counts)

    def refresh(self, chunks: DataFrame, dims: int = 256, backend: str = "local_hash", model: str = "local-hash", embed=None, limit: int = REFRESH_LIMIT) -> Refreshed:
        if self.meta() != self._meta(backend, model, dims):
            return self.rebuild(chunks, dims, backend, model, embed)
        old = self.read("vectors")
        touched = freshness.touched_paths(freshness.hashes_changed(chunks, old), chunks, old)
        n = touched.limit(limit + 1).count()
        if n == 0:
            return Refreshed("Unchanged", 0, {})
        if n > limit:
            return self.rebuild(chunks, dims, backend, model, embed)
        new = chunks.join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        rows = symbols.replaced(old, touched, self.embedded(new, dims, embed).select(*old.columns))
        return Refreshed("Incremental", n, self._write({"vectors": rows}, self._meta(backend, model, dims)))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """The ``k`` best chunks by inner product with the query's hash embedding."""
        dims = int(self.meta()["dimensions"])
        q = self.spark.createDataFrame([(query,)], "t string").select(text.hash_embedding(text.code_tokens(F.col("t")), dims).alias("v")).first().v
        score = F.round(text.dot(F.col("vector"), F.array(*map(F.lit, q))), 6)
        return self.read("vectors").withColumn("score", score).where("score > 0").orderBy(F.desc("score"), paths.parts(F.col("file_path")), "line_start").limit(k)
