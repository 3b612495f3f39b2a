"""The engine: one project's tables and the questions that can be asked of them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from corpusloom.operators import budget, confidence, dense, graph, lexical, references, scan, symbols
from corpusloom.operators import retrieval as r
from corpusloom.operators.chunks import embed_text
from corpusloom.operators.memory import WorkingMemory
from corpusloom.operators.skeleton import Skeleton
from corpusloom.plans.store import IndexStore, Refreshed, VectorStore, derived
from corpusloom.sources import git
from corpusloom.sources.scratch import staged
from corpusloom.sources.tree import guarded, read_tree, rules_for

DIMENSIONS = 256


@dataclass(frozen=True)
class Result:
    analysis: r.Analysis
    chunks: list[Row]
    report: confidence.Report
    plan: list[str]
    skeleton: str

    def render(self) -> str:
        a = self.analysis
        head = [f"Query: {a.raw}", f"Intent: {a.intent}; symbols: {', '.join(a.symbols) or 'none'}; terms: {', '.join(a.terms) or 'none'}", f"Confidence: {self.report.confidence:.2f} ({self.report.strategy})"]
        rows = [f"{i}. {c.path}:{c.line_start}-{c.line_end} [{c.final_score:.2f}] {', '.join(c.reasons)}\n" + "\n".join(f"    {x}" for x in c.preview.splitlines()) for i, c in enumerate(self.chunks, 1)]
        return "\n".join([*head, *rows, *(f"- {p}" for p in self.plan)]) + "\n"

    def panel(self, width: int = 58) -> str:
        """A box with the strategy, the first hits and the reasons."""
        rows = [f"Intent: {self.analysis.intent}", f"Confidence: {self.report.confidence:.2f} {self.report.strategy}", *(f"{c.path}:{c.line_start} {c.final_score:.2f}" for c in self.chunks[:5]), *(x[2] for x in self.report.reasons)]
        return "\n".join(["┌" + "─" * (width - 2) + "┐", *(f"│ {x[: width - 4]:<{width - 4}} │" for x in rows), "└" + "─" * (width - 2) + "┘"]) + "\n"


@dataclass
class Engine:
    """Tables of a corpus and the queries on them.

    ``files`` is (path, size_bytes, modified_unix, sha256, text).  Tables come from ``tables`` where given,
    as from a stored index, and are derived from the files otherwise.
    """

    spark: SparkSession
    files: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    recent: list[str] = field(default_factory=list)
    memory: WorkingMemory = field(default_factory=WorkingMemory)
    vectors: VectorStore | None = None
    root: str | None = None

    @staticmethod
    def open(spark: SparkSession, root: str, index: str | None = None) -> Engine:
        """A project folder, with its stored index if that is fresh."""
        root = os.path.abspath(root)
        files = staged(read_tree(spark, root), "engine-tree")
        tables: dict[str, DataFrame] = {}
        vectors = None
        if index:
            store = IndexStore(spark, f"{index}/index")
            if store.is_fresh(files):
                tables = {n: store.read(n) for n in ("symbols", "refs", "chunks", "graph_nodes", "graph_edges")}
            vectors = VectorStore(spark, f"{index}/vectors")
            vectors = vectors if vectors.version() else None
        return Engine(spark, files, tables, git.recent_changes(root, rules_for(root)), vectors=vectors, root=root)

    @cached_property
    def classified(self) -> DataFrame:
        return scan.classified(self.files.where("text IS NOT NULL"))

    @cached_property
    def _derived(self) -> dict[str, DataFrame]:
        # Written once: the hybrid query uses each table several times, and plans over scans stay small.
        return {k: self.tables[k] if k in self.tables else staged(v, f"engine-{k}") for k, v in derived(self.files).items()}

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self._derived[name]

    @cached_property
    def skeleton(self) -> Skeleton:
        return Skeleton.build(self.classified, self.table("symbols"), self.recent)

    # Single operators

    def scan(self) -> str:
        return scan.report(scan.classified(self.files))

    def find_symbols(self, query: str) -> DataFrame:
        return symbols.lookup(self.table("symbols"), query)

    def find_references(self, name: str, limit: int = 100) -> DataFrame:
        return references.find_any(self.table("refs"), [name], limit)

    @cached_property
    def lines(self) -> DataFrame:
        return references.numbered_lines(self.classified.where("is_text"))

    def grep(self, pattern: str, limit: int = 30) -> DataFrame:
        return lexical.grep(self.lines, pattern, limit, [paths.parts(F.col("path")), F.col("line_number")])

    def excerpt(self, path: str, line: int, context: int = 4) -> str:
        row = self.files.where(F.col("path") == path).select(text.excerpt(F.col("text"), line, context).alias("x")).first()
        return row.x if row else ""

    def read_file(self, path: str) -> str:
        if self.root is None:
            raise ValueError("the engine has no folder")
        with open(guarded(self.root, path), encoding="utf-8") as f:
            return f.read()

    def index_search(self, query: str, limit: int = 10) -> DataFrame:
        """Chunks by BM25 over symbols, signature, source and docs."""
        c = self.table("chunks")
        found = lexical.bm25_search(c, query, limit, ["symbols", "signature", "source", "docs"], "id", ["file_path", "line_start"])
        return found.drop("file_path", "line_start").join(c, "id").orderBy("rank")

    def vector_search(self, query: str, limit: int = 30) -> DataFrame:
        """Chunks by TF-IDF."""
        c = self.table("chunks")
        one = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        found = lexical.tfidf_search(c.select("id", embed_text().alias("text")), one, limit, "id")
        return found.select("id", "score", "rank").join(c, "id").orderBy("rank")

    def embed_search(self, query: str, limit: int = 10) -> DataFrame:
        if self.vectors is not None:
            return self.vectors.search(query, limit)
        c = self.table("chunks")
        v = dense.hash_embeddings(c.select("id", embed_text().alias("text")), DIMENSIONS, "id")
        q = self.spark.createDataFrame([(query,)], "t string").select(text.hash_embedding(text.code_tokens(F.col("t")), DIMENSIONS).alias("v")).first().v
        return dense.top_k(v, q, limit, "id", "vector").join(c, "id").orderBy("rank")

    def graph_summary(self) -> str:
        rows = graph.summary(self.table("graph_nodes"), self.table("graph_edges")).orderBy("part", "kind").collect()
        return "# Graph\n" + "\n".join(f"{x.part} {x.kind}: {x.n}" for x in rows) + "\n"

    # The hybrid query

    def candidates(self, a: r.Analysis) -> DataFrame:
        """Merged candidates of all sources."""
        spark, files = self.spark, self.classified.select("path", "text", "is_text")
        found: list[DataFrame] = []
        table = lambda names: spark.createDataFrame([(n,) for n in names], "query string")
        # Sources that point at lines get their previews in one join.
        pointed: list[DataFrame] = []

        def point(df: DataFrame, src: int, context: int, end: str, name, symbol: float = 0.0, near: float = 0.0, grep: int = 0) -> None:
            names = F.array(name) if name is not None else F.array().cast("array<string>")
            pointed.append(df.select("path", "line_start", F.col(end).alias("line_end"), names.alias("names"), F.lit(symbol).alias("symbol"), F.lit(near).alias("graph"), F.lit(grep).alias("grep"), F.lit(context).alias("context"), F.lit(src).alias("src")))

        hits = symbols.lookup_many(self.table("symbols"), table(a.symbols), 8) if a.symbols else None
        if a.intent == "FindSymbol" and a.terms and (hits is None or hits.isEmpty()):
            hits = symbols.lookup_many(self.table("symbols"), table(a.terms), 5)
        if hits is not None:
            point(hits.select(F.col("file_path").alias("path"), "line_start", "line_end", "name"), 0, 4, "line_end", F.col("name"), symbol=1.0)
        names = sorted({*a.symbols, *(a.terms if a.intent in ("FindSymbol", "FixBug") else [])})
        if names:
            refs = references.find_any(self.table("refs"), names, 12).select(F.col("file_path").alias("path"), F.col("line_number").alias("line_start"), "symbol_name")
            point(refs, 1, 2, "line_start", F.col("symbol_name"), symbol=0.75, near=0.35)
        if a.terms:
            rows = lexical.grep_many(self.lines, a.terms[: r.GREP_TERMS], r.GREP_LIMIT, [paths.parts(F.col("path")), F.col("line_number")])
            point(rows.withColumnRenamed("line_number", "line_start"), 3, 2, "line_start", None, grep=1)
        if pointed:
            rows = reduce(DataFrame.unionByName, pointed).join(files.select("path", "text"), "path")
            shown = text.excerpt(F.col("text"), F.col("line_start"), F.col("context"))
            found.append(r.source(rows, None, **{c: F.col(c) for c in ("path", "line_start", "line_end", "names", "symbol", "graph", "grep")}, preview=shown))
        by_chunk = dict(path=F.col("file_path"), line_start=F.col("line_start"), line_end=F.col("line_end"), preview=F.col("source"), names=F.col("symbols"))
        found.append(r.source(self.index_search(a.raw, r.SEARCH_LIMIT), 2, fts=F.col("fts_score"), **by_chunk))
        found.append(r.source(self.vector_search(a.raw, r.SEARCH_LIMIT), 4, semantic=F.least("score", F.lit(1.0)), **by_chunk))
        if self.vectors is not None:
            found.append(r.source(self.embed_search(a.raw, r.SEARCH_LIMIT), 5, semantic=F.least("score", F.lit(1.0)), **by_chunk))
        context = self.skeleton.context_paths(a.intent, a.hints)
        head = lambda n: F.array_join(F.slice(text.lines(F.col("text")), 1, n), "\n")
        if context:
            rows = files.where(F.col("is_text") & F.col("path").isin(context))
            found.append(r.source(rows, 6, path=F.col("path"), line_start=1, line_end=30, preview=head(30), graph=0.35))
        every = staged(reduce(DataFrame.unionByName, found), "engine-candidates")
        seeds = every.where("symbol > 0 OR semantic > 0.10").select("path")
        nodes, edges = self.table("graph_nodes"), self.table("graph_edges")
        if a.symbols:
            seeds = seeds.union(graph.related_to_symbols(nodes, edges, a.symbols, r.DEPTH))
        if a.intent == "BuildError":
            native = edges.where("kind = 'NativeBinding'").select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
            seeds = seeds.union(nodes.join(native, "id", "left_semi").where("path IS NOT NULL").select("path"))
        fixed = {"BuildError": self.skeleton.configs + self.skeleton.entries, "ArchitectureQuestion": self.skeleton.entries}.get(a.intent, [])
        if fixed:
            seeds = seeds.union(spark.createDataFrame([(p,) for p in fixed], "path string"))
        near = files.join(graph.expand_files(nodes, edges, seeds, r.DEPTH), "path", "left_semi").where("is_text")
        grown = r.source(near, 7, path=F.col("path"), line_start=1, line_end=40, preview=head(40), graph=0.55)
        return r.merged(every.unionByName(grown))

    def retrieve(self, query: str) -> Result:
        """The best chunks for a query, how far to trust them and what to do next."""
        a = r.analyze(query)
        best = r.top(r.scored(self.candidates(a), a, self.memory.files, self.recent)).collect()  # RESULTS rows
        score = [c.final_score for c in best] + [0.0, 0.0]
        exact = bool(a.symbols) and not self.table("symbols").where(F.col("name").isin(a.symbols)).isEmpty()
        among = any("recent_change" in c.reasons for c in best)
        report = confidence.calculate(score[0], score[0] - score[1], exact, any(c.module_match for c in best), len(best) >= 2, among, len(best), confidence.INTENT_PROFILE.get(a.intent, "Generic"))
        return Result(a, best, report, confidence.fallback_plan(report.strategy, a.terms), self.skeleton.prompt())

    def remember(self, result: Result) -> Engine:
        """An engine whose memory holds the result's files and symbols."""
        return replace(self, memory=self.memory.remember(result.analysis.raw, [c.path for c in result.chunks], [s for c in result.chunks for s in c.symbols]))

    def context(self, task: str, tokens: int = budget.DEFAULT_TOKENS) -> tuple[str, int, list[budget.Section]]:
        result = self.retrieve(task)
        shown = [budget.render_chunk(c, i) for i, c in enumerate(result.chunks, 1)]
        return budget.build_context(task, result.skeleton, self.memory.render(), shown, self.graph_summary(), tokens)

    # Maintenance

    def refresh_index(self, index: str, limit: int = 128) -> Refreshed:
        return IndexStore(self.spark, f"{index}/index").refresh(self.files, limit)

    def refresh_vectors(self, index: str, dims: int = DIMENSIONS) -> Refreshed:
        return VectorStore(self.spark, f"{index}/vectors").refresh(IndexStore(self.spark, f"{index}/index").read("chunks"), dims)
