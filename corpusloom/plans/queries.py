"""The registered queries: each operator over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from corpusloom.operators import budget, chunks, confidence, dense, evaluation, freshness, graph, lexical, memory, references, retrieval, scan, skeleton, symbols
from corpusloom.plans import fixture
from corpusloom.plans.engine import Engine
from corpusloom.sources.tables import table
from corpusloom.streaming import changes

SEARCH, PHRASE, GREP = "thanedble attion worthless haing", "of_the to_and", "PATHETIC|worthless"
DIMS = 64


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _one(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id long, text string")


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus_counts(spark, d):
    docs = _docs(spark, d)
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


def path_classes(spark, d):
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".rs").when(F.col("lang") == "fr", ".TS").otherwise(".md")
    docs = _docs(spark, d).select(F.concat("source", F.lit("/"), "lang", F.lit("/file"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("n_chars").alias("size_bytes"))
    return scan.classified(docs).groupBy("language", "is_source", "is_text", "depth").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def project_mode(spark, d):
    docs = _docs(spark, d).select(F.concat("source", F.lit("/x"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("n_chars").alias("size_bytes"))
    c = scan.complexity(scan.classified(docs))
    return c.select("files", "source_files", "bytes", "estimated_tokens", "max_depth", "mode")


def file_lines(spark, d):
    return references.numbered_lines(_docs(spark, d).select(F.col("doc_id").alias("path"), "text")).withColumnRenamed("path", "doc_id")


def chunk_windows(spark, d):
    return chunks.line_windows(_docs(spark, d), 10, 2).select("doc_id", "line_start", "line_end", F.sha2("source", 256).alias("source_sha256"))


def code_tokens(spark, d):
    tokens = _docs(spark, d).select("doc_id", text.code_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def term_freq(spark, d):
    return lexical.term_frequency(_docs(spark, d))


def unit_vectors(spark, d):
    return lexical.unit_vectors(lexical.term_frequency(_docs(spark, d))).select("doc_id", "token", F.round("w", 6).alias("w"))


def doc_freq(spark, d):
    return lexical.document_frequency(lexical.term_frequency(_docs(spark, d)))


def tfidf_search(spark, d):
    return lexical.tfidf_search(_docs(spark, d), _one(spark, SEARCH), 30).select("doc_id", "score", "rank")


def tfidf_batch(spark, d):
    return lexical.tfidf_search(_docs(spark, d), _bench(spark, d), 10).select("query_id", "doc_id", "score", "rank")


def bm25_search(spark, d):
    return lexical.bm25_search(_docs(spark, d), SEARCH, 30)


def bm25_phrase(spark, d):
    return lexical.bm25_search(_docs(spark, d), PHRASE, 30)


def grep_ci(spark, d):
    return lexical.grep(file_lines(spark, d), GREP, 40, ["doc_id", "line_number"])


def excerpts(spark, d):
    middle = F.ceil(text.line_count(F.col("text")) / 2).cast("int")
    return _docs(spark, d).select("doc_id", F.sha2(text.excerpt(F.col("text"), middle, 2), 256).alias("excerpt_sha256"))


def hash_embed_long(spark, d):
    return dense.hash_components(_docs(spark, d), DIMS).select("doc_id", "dim", F.round("value", 6).alias("value"))


def hash_search(spark, d):
    docs = dense.hash_components(_docs(spark, d), DIMS)
    q = dense.hash_components(_one(spark, SEARCH), DIMS, "query_id").select("dim", F.col("value").alias("q"))
    s = docs.join(F.broadcast(q), "dim").groupBy("doc_id").agg(F.round(F.sum(F.col("value") * F.col("q")), 6).alias("score")).where("score > 0")  # q: DIMS rows
    top = s.orderBy(F.desc("score"), "doc_id").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.join(F.broadcast(q)).select("vec_id", F.round(text.dot(F.col("embedding"), F.col("q")), 5).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "vec_id").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))


def dense_labels(spark, d):
    """The mean vector of each label as a query: a few queries against all rows."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    q = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))
    return dense.batch_top_k(e.select("vec_id", "embedding"), q.select(F.col("label").alias("query_id"), "q"), 5, "vec_id", "embedding", 5)


def text_hash_groups(spark, d):
    return _docs(spark, d).groupBy(text.text_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def _snapshots(spark, d):
    docs = _docs(spark, d)
    indexed = docs.where("source <> 'src7'").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), text.text_hash(F.col("text")).alias("text_hash"))
    now = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("source <> 'src3'").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), text.text_hash(now).alias("text_hash")), indexed


def freshness_diff(spark, d):
    return freshness.hashes_changed(*_snapshots(spark, d))


def touched_paths(spark, d):
    current, indexed = _snapshots(spark, d)
    return freshness.touched_paths(freshness.hashes_changed(current, indexed), current, indexed)


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"))


def symbol_exact(spark, d):
    return symbols.lookup(_parts(spark, d), "red widget").groupBy("name", "file_path", "score").agg(F.count("*").alias("n"))


def symbol_contains(spark, d):
    return symbols.lookup(_parts(spark, d), "RING").groupBy("name", "file_path", "score").agg(F.count("*").alias("n"))


def symbol_subsequence(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("file_path"))
    return symbols.lookup(c, "cmr#99")


def public_api(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.when(F.col("p_type") == "ECONOMY", "Class").otherwise("Function").alias("kind"), F.when(F.col("p_size") > 25, "Public").otherwise("Unknown").alias("visibility"))
    return symbols.public_api(s).select("name", "file_path", "kind")


def _mentions(spark, d):
    names = references.identifiers(_bench(spark, d).select(F.col("query_id").alias("path"), "text")).where(F.length("name") >= 10).select("name").distinct()
    return references.identifiers(_docs(spark, d).select(F.col("doc_id").alias("path"), "text"), lambda rows: rows.join(names, "name", "left_semi"))


def mention_refs(spark, d):
    return _mentions(spark, d).select(F.col("path").alias("doc_id"), F.col("name").alias("symbol_name"), "line_number", "column_start", "kind")


def refs_limit_per_name(spark, d):
    w = Window.partitionBy("symbol_name").orderBy("doc_id", "line_number", "column_start")
    return mention_refs(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 12").drop("r")


def ref_counts(spark, d):
    return references.counts(mention_refs(spark, d))


def _links(spark, d):
    p = table(spark, d, "pages")
    rows = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    return rows.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("from_id"), F.concat(F.lit("link:"), "href").alias("to_id"))


def link_edges(spark, d):
    return _links(spark, d)


def link_degree(spark, d):
    return graph.degrees(_links(spark, d))


def link_bfs2(spark, d):
    return graph.reach(_links(spark, d), spark.createDataFrame([("page:0",)], "id string"), 2)


def link_neighbours(spark, d):
    return graph.top_neighbours(_links(spark, d), 3).select("a", "b", "degree", "r")


def module_buckets(spark, d):
    path = F.regexp_replace("url", r"^https?://([^?#]*).*$", "$1")
    return skeleton.modules(table(spark, d, "pages").select(path.alias("path"))).select("bucket", "files", F.array_join("key_files", ",").alias("key_files"))


def _questions(spark, d):
    return table(spark, d, "conversations").where("role = 'user'")


def intent_classify(spark, d):
    return _questions(spark, d).select("conv_id", "turn", retrieval.intent_column(F.col("text")).alias("intent"))


def query_terms(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.array_join(retrieval.terms_column(F.col("text")), " ").alias("terms"))


def score_fusion(spark, d):
    """Two sources for each benchmark text, merged and weighted: TF-IDF, and common words over words + 1."""
    docs, q = _docs(spark, d), _bench(spark, d)
    dense_hits = lexical.tfidf_search(docs, q, 30)
    words = lambda df, k: df.select(k, F.explode(F.array_distinct(text.words(F.col("text")))).alias("w"))
    common = words(docs, "doc_id").join(words(q, "query_id"), "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    lex_hits = lexical.ranked(common.withColumn("score", F.round(F.col("n") / (F.col("n") + 1), 6)), 30, "query_id", "doc_id")
    path = F.concat(F.col("query_id").cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    shape = dict(path=path, line_start=1, line_end=1, preview="")
    both = retrieval.source(lex_hits, 2, fts=F.col("score"), **shape).unionByName(retrieval.source(dense_hits, 4, semantic=F.least("score", F.lit(1.0)), **shape))
    m = retrieval.merged(both)
    w = retrieval.OTHER_WEIGHTS
    total = F.round(w[1] * F.col("lexical_score") + w[2] * F.col("semantic_score"), 8)  # no ties between 6-place scores
    ids = F.split("path", "/")
    return m.select(F.get(ids, F.lit(0)).cast("long").alias("query_id"), F.get(ids, F.lit(1)).cast("long").alias("doc_id"), total.alias("score"), F.array_join("reasons", ",").alias("reasons"))


def top12_per_query(spark, d):
    return lexical.ranked(score_fusion(spark, d), 12, "query_id", "doc_id")


def _features(spark, d):
    t = top12_per_query(spark, d)
    f = t.groupBy("query_id").agg(F.max("score").alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count("*").alias("result_count"))
    return f.select("query_id", "top_score", (F.col("top_score") - F.coalesce("second", F.lit(0.0))).alias("score_gap"), F.lit(False).alias("exact_symbol"), F.lit(False).alias("module_match"), (F.col("result_count") >= 2).alias("graph_connection"), F.lit(False).alias("recent_change"), "result_count")


def result_confidence(spark, d):
    return confidence.scored(_features(spark, d), F.lit("Generic")).select("query_id", F.round("confidence", 6).alias("confidence"), "strategy")


def fallback_plan(spark, d):
    return result_confidence(spark, d).groupBy("strategy").agg(F.count("*").alias("queries"), F.max(confidence.plan_steps(F.col("strategy"))).alias("steps"))


def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def budget_pack(spark, d):
    """The beginning of each author's documents that fits a context."""
    rows = _docs(spark, d).select("source", "doc_id", text.token_estimate(F.col("text")).alias("tokens"))
    return budget.packed(rows, budget.DEFAULT_TOKENS, ["doc_id"], group=["source"])


def recency_lru50(spark, d):
    return memory.recent(table(spark, d, "events"), "user_id", ["ts", "event_id"], memory.MOST_FILES).select("user_id", "event_id", "rank")


def debounce_batches(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    b = changes.debounced_globally(e, "ts", 300.0)
    return b.select(F.unix_micros("batch_start").alias("started_us"), F.unix_micros("batch_end").alias("ended_us"), "events")


def debounce_sessions(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    s = changes.debounced(e, "ts", "event_type", "6 hours", group=["user_id"])
    return s.select("user_id", F.unix_micros("started").alias("started_us"), "events", "items")


def ir_metrics(spark, d):
    q = _bench(spark, d)
    qrels = _docs(spark, d).select("doc_id", F.col("text").alias("body")).join(F.broadcast(q), F.col("body").contains(F.col("text"))).select("query_id", "doc_id")  # the stated query set
    return evaluation.ir_metrics(tfidf_batch(spark, d), qrels)


def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value")


def _project(spark):
    f = scan.classified(fixture.project(spark))
    return f, symbols.extract_symbols(f.where("is_source"))


def fixture_symbols(spark, d):
    return symbols.ordered(_project(spark)[1])


def fixture_references(spark, d):
    f, s = _project(spark)
    return references.references(f.where("is_source"), s)


def fixture_chunks(spark, d):
    f, s = _project(spark)
    return chunks.chunk_files(f, s)


def fixture_imports(spark, d):
    return graph.import_edges(_project(spark)[0].where("is_source"))


def fixture_graph(spark, d):
    return graph.build(*_project(spark))[1]


def fixture_api(spark, d):
    return symbols.public_api(_project(spark)[1])


def fixture_tree(spark, d):
    return scan.file_tree(_project(spark)[0])


def fixture_retrieve(spark, d):
    e = Engine(spark, fixture.project(spark))
    a = retrieval.analyze(fixture.QUESTION)
    return retrieval.top(retrieval.scored(e.candidates(a), a)).drop("symbols", "reasons")


QUERIES = {f.__name__: f for f in (
    corpus_counts, path_classes, project_mode, file_lines, chunk_windows, code_tokens, term_freq, unit_vectors, doc_freq, tfidf_search, tfidf_batch, bm25_search, bm25_phrase, grep_ci, excerpts,
    hash_embed_long, hash_search, dense_topk, dense_labels, text_hash_groups, freshness_diff, touched_paths, symbol_exact, symbol_contains, symbol_subsequence, public_api, mention_refs, refs_limit_per_name,
    ref_counts, link_edges, link_degree, link_bfs2, link_neighbours, module_buckets, intent_classify, query_terms, score_fusion, top12_per_query, result_confidence, fallback_plan, token_estimate, budget_pack,
    recency_lru50, debounce_batches, debounce_sessions, ir_metrics, latency_percentiles, fixture_symbols, fixture_references, fixture_chunks, fixture_imports, fixture_graph, fixture_api, fixture_tree, fixture_retrieve,
)}
