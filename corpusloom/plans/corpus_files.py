"""Registered queries that run the code operators over all documents as the files of a project, and their DuckDB SQL.

A document is a file ``source/lang/file<id>.py``, every 50th a ``package.json`` in a folder of its own, every 20th (remainder 1) the
test of the file before it.  Every third is said to declare its first long word on its second line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunks, graph, references, retrieval, scan, symbols
from corpusloom.sources.scratch import staged
from corpusloom.sources.tables import table

IDENT = "[A-Za-z_$][A-Za-z0-9_$]*"
QUESTION = "fix the worthless thanedble test"
OPENED, RECENT = "src3/en/file7.py", "src1/de/file9.py"


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 50 == 0, F.concat(F.lit("d"), i, F.lit("/package.json"))).when(i % 20 == 1, F.concat(F.lit("file"), i - 1, F.lit("_test.py"))).otherwise(F.concat(F.lit("file"), i, F.lit(".py")))
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    return scan.classified(docs.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "text"))


def declared(f: DataFrame) -> DataFrame:
    i, word = F.col("doc_id"), F.regexp_extract("text", "[A-Za-z]{9,}", 0)
    return f.where((i % 3 == 0) & F.col("is_source") & (word != "")).select(
        F.col("path").alias("file_path"), word.alias("name"), F.when(i % 2 == 0, "Function").otherwise("Component").alias("kind"), F.lit(2).alias("line_start"), (i % 7 + 2).cast("int").alias("line_end"),
        F.concat(F.lit("def "), word).alias("signature"), F.when(i % 4 == 0, "Public").otherwise("Unknown").alias("visibility"),
    )


def _both(spark, d):
    f = files(spark, d)
    return f, declared(f)


def _places(spark, d):
    f, s = _both(spark, d)
    return references.places(f.where("is_source"), staged(s, "document-symbols"))  # read for count, sieve and joins


def document_references(spark, d):
    return _places(spark, d)


def document_reference_counts(spark, d):
    return references.counts(_places(spark, d))


def document_reference_lookup(spark, d):
    refs = _places(spark, d)
    return references.find(refs, "worthless").unionByName(references.find(refs, "something")).groupBy("symbol_name", "kind").agg(F.count("*").alias("n"))


def document_chunks(spark, d):
    c = chunks.chunk_files(*_both(spark, d))
    return c.select("id", "file_path", "line_start", "line_end", "chunk_type", "signature", "docs", F.sha2("source", 256).alias("source_sha256"), F.array_join("symbols", ",").alias("symbols"), F.array_join("module_path", "/").alias("module_path"))


def document_graph_nodes(spark, d):
    return graph.build(*_both(spark, d))[0]


def document_graph_edges(spark, d):
    return graph.build(*_both(spark, d))[1].where("kind <> 'Imports'").drop("evidence")


def document_graph_summary(spark, d):
    nodes, edges = graph.build(*_both(spark, d))
    return graph.summary(nodes, edges.where("kind <> 'Imports'"))


def document_graph_expand(spark, d):
    nodes, edges = (staged(x, "document-graph") for x in graph.build(*_both(spark, d)))  # read for every hop
    seeds = files(spark, d).where("doc_id = 20").select("path")
    return graph.expand_files(nodes, edges.where("kind = 'Tests' OR kind = 'InModule'"), seeds, 2)


def document_test_edges(spark, d):
    return graph.test_edges(files(spark, d).where("is_source"))


def document_public_symbols(spark, d):
    return symbols.public(declared(files(spark, d)))


def document_symbol_kinds(spark, d):
    return symbols.kind_counts(declared(files(spark, d)))


def document_symbol_lookup(spark, d):
    q = spark.createDataFrame([("worthless",), ("Thing",), ("RING",)], "query string")
    return symbols.lookup_many(declared(files(spark, d)), q, 5).select("query", "name", "file_path", "score", "rank")


def document_candidates(spark, d):
    """Every file as a candidate of one source by its id, scored with memory, terms, hints and recency."""
    f = files(spark, d)
    a = retrieval.analyze(QUESTION)
    i = F.col("doc_id")
    fts = retrieval.source(f.where(i % 2 == 0), 2, path=F.col("path"), line_start=1, line_end=1, preview="", fts=(i % 10) / F.lit(20.0))
    grep = retrieval.source(f.where(i % 5 == 0), 3, path=F.col("path"), line_start=1, line_end=1, preview="", grep=F.lit(1))
    symbol = retrieval.source(f.where(i % 3 == 0), 0, path=F.col("path"), line_start=1, line_end=1, preview="", symbol=(i % 4) / F.lit(4.0))
    s = retrieval.scored(retrieval.merged(fts.unionByName(grep).unionByName(symbol)), a, [OPENED], [RECENT])
    return s.select("path", "symbol_score", "lexical_score", F.round("semantic_score", 9).alias("semantic_score"), "graph_score", "recency_score", "final_score", "module_match", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (
    document_references, document_reference_counts, document_reference_lookup, document_chunks, document_graph_nodes, document_graph_edges, document_graph_summary, document_graph_expand, document_test_edges,
    document_public_symbols, document_symbol_kinds, document_symbol_lookup, document_candidates,
)}


def oracle(lines: str, line_count: str) -> dict[str, str]:
    """SQL by query; ``lines`` and ``line_count`` are SQL for a text ``{t}``."""
    base = f"""f AS (
  SELECT doc_id, source || '/' || lang || '/' || CASE WHEN doc_id % 50 = 0 THEN 'd' || doc_id || '/package.json' WHEN doc_id % 20 = 1 THEN 'file' || (doc_id - 1) || '_test.py' ELSE 'file' || doc_id || '.py' END AS path,
    doc_id % 50 <> 0 AS is_source, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
s AS (
  SELECT path AS file_path, regexp_extract(text, '[A-Za-z]{{9,}}') AS name, CASE WHEN doc_id % 2 = 0 THEN 'Function' ELSE 'Component' END AS kind, 2 AS line_start, (doc_id % 7 + 2)::INT AS line_end,
    'def ' || regexp_extract(text, '[A-Za-z]{{9,}}') AS signature, CASE WHEN doc_id % 4 = 0 THEN 'Public' ELSE 'Unknown' END AS visibility
  FROM f WHERE doc_id % 3 = 0 AND is_source AND regexp_extract(text, '[A-Za-z]{{9,}}') <> '')"""
    refs = f"""{base},
names AS (SELECT DISTINCT name FROM s),
fl AS (SELECT path, unnest(generate_series(1, len(l))) AS line_number, unnest(l) AS line FROM (SELECT path, {lines.format(t='text')} AS l FROM f WHERE is_source)),
cut AS (SELECT path, line_number, regexp_extract_all(line, '{IDENT}') AS ns, string_split_regex(line, '{IDENT}') AS gaps FROM fl),
ids AS (SELECT *, unnest(generate_series(1, len(ns))) AS i FROM cut),
refs AS (
  SELECT DISTINCT path AS file_path, ns[i] AS symbol_name, line_number::INT AS line_number,
    (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ns[1:i - 1], lambda x: length(x))), 0) + 1)::INT AS column_start,
    CASE WHEN rtrim(gaps[i]) LIKE '%<' THEN 'ComponentUse' WHEN ltrim(gaps[i + 1]) LIKE '(%' THEN 'Call' ELSE 'Identifier' END AS kind
  FROM ids WHERE ns[i] IN (SELECT name FROM names) AND NOT EXISTS (SELECT 1 FROM s WHERE s.name = ns[i] AND s.file_path = path AND line_number = 2))"""
    low = "lower(file_path)"
    file_type = f"CASE WHEN contains({low}, 'test') OR contains({low}, 'spec') THEN 'Test' WHEN contains({low}, 'native') OR contains({low}, 'napi') OR contains({low}, 'cpp') THEN 'NativeBinding' ELSE 'Module' END"
    both = "lower(file_path || ' ' || name)"
    symbol_type = f"""CASE WHEN kind = 'Component' THEN 'Component' WHEN contains({both}, 'route') OR contains({both}, 'handler') THEN 'Route' WHEN contains({both}, 'native') OR contains({both}, 'napi') OR contains({both}, 'ffi') THEN 'NativeBinding'
    WHEN contains({both}, 'test') OR contains({both}, 'spec') THEN 'Test' ELSE 'Function' END"""
    windows = lambda a, b: f"generate_series(0, greatest(0, ceil(({b} - {a} + 1 - 120) / 100.0))::INT)"
    graph_sql = f"""{base},
src AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, text FROM f WHERE is_source), cfg AS (SELECT path FROM f WHERE NOT is_source),
nodes AS (
  SELECT 'file:' || path AS id, 'File' AS kind, path AS label, path FROM src UNION SELECT 'module:' || folder, 'Module', folder, folder FROM src UNION SELECT 'config:' || path, 'Config', path, path FROM cfg
  UNION SELECT 'symbol:' || file_path || ':' || name || ':2', 'Symbol', name, file_path FROM s),
tests AS (
  SELECT t.path, o.path AS target FROM (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)\\.py$', 1), '_test|\\.test|\\.spec', '', 'g') AS stem FROM src WHERE contains(lower(path), 'test') OR contains(lower(path), 'spec')) t
  JOIN (SELECT path, regexp_extract(path, '([^/]*)\\.py$', 1) AS stem FROM src) o USING (stem) WHERE t.path <> o.path),
named AS (SELECT path, unnest(list_distinct(list_concat(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*[({{]', 1), regexp_extract_all(text, '<([A-Za-z_$][A-Za-z0-9_$]*)', 1)))) AS name, list_distinct(regexp_extract_all(text, '<([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS tags FROM src),
marks AS (SELECT path FROM src WHERE contains(lower(text), 'napi') OR contains(lower(text), 'extern "c"') OR contains(lower(text), 'hilog')),
edges AS (
  SELECT 'module:' || folder AS from_id, 'file:' || path AS to_id, 'InModule' AS kind FROM src
  UNION SELECT 'config:' || cfg.path, 'module:' || split_part(src.path, '/', 1), 'Configures' FROM cfg, src
  UNION SELECT 'file:' || file_path, 'symbol:' || file_path || ':' || name || ':2', 'Contains' FROM s
  UNION SELECT 'file:' || path, 'file:' || target, 'Tests' FROM tests
  UNION SELECT 'file:' || path, 'symbol:' || file_path || ':' || s.name || ':2', CASE WHEN s.kind = 'Component' OR list_contains(tags, s.name) THEN 'UsesComponent' ELSE 'Calls' END FROM named JOIN s USING (name) WHERE path <> file_path
  UNION SELECT 'file:' || marks.path, 'config:' || cfg.path, 'NativeBinding' FROM marks, cfg)"""
    a = retrieval.analyze(QUESTION)
    w = retrieval.WEIGHTS.get(a.intent, retrieval.OTHER_WEIGHTS)
    terms = " + ".join(f"contains(lower(path || chr(10)), '{t.lower()}')::INT" for t in a.terms)
    hinted = " OR ".join(f"contains(lower(path), '{h}')" for h in a.hints) or "FALSE"
    same = lambda p: f"(path = '{p}' OR path LIKE '%/{p}' OR '{p}' LIKE '%/' || path)"
    found = f"CASE lower(name) = lower(query) WHEN TRUE THEN CASE WHEN name = query THEN 4 ELSE 3 END ELSE CASE WHEN contains(lower(name), lower(query)) THEN 2 WHEN regexp_matches(lower(name), array_to_string(string_split(lower(query), ''), '.*')) THEN 1 ELSE 0 END END"
    return {
        "document_references": f"WITH {refs} SELECT * FROM refs",
        "document_reference_counts": f"WITH {refs} SELECT count(DISTINCT symbol_name) AS symbols, count(*) AS \"references\" FROM refs",
        "document_reference_lookup": f"WITH {refs} SELECT symbol_name, kind, count(*) AS n FROM refs WHERE symbol_name IN ('worthless', 'something') GROUP BY ALL",
        "document_chunks": f"""WITH {base}, l AS (SELECT path AS file_path, text, is_source, {lines.format(t='text')} AS l, {line_count.format(t='text')} AS n FROM f),
w AS (
  SELECT l.*, s.name, s.kind, s.signature, 2 AS a, greatest(least(s.line_end, n), 2) AS b FROM l JOIN s USING (file_path)
  UNION ALL SELECT l.*, NULL, NULL, NULL, 1, n FROM l WHERE is_source AND file_path NOT IN (SELECT file_path FROM s)),
c AS (SELECT *, unnest(CASE WHEN name IS NULL THEN {windows(1, 'n')} ELSE {windows('a', 'b')} END) AS k FROM w),
p AS (SELECT *, (a + k * 100)::INT AS x, least(a + k * 100 + 119, b)::INT AS y FROM c),
folder AS (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS module_path FROM p)
SELECT file_path || CASE WHEN name IS NULL THEN '::file::whole:' ELSE '::symbol::' || name || ':' END || x || '-' || y AS id, file_path, x AS line_start, y AS line_end, CASE WHEN name IS NULL THEN {file_type} ELSE {symbol_type} END AS chunk_type, signature,
  CASE WHEN name IS NOT NULL AND k = 0 AND regexp_matches(trim(l[1]), '^(///|//!|//|\\*|/\\*\\*|#)') THEN trim(l[1]) END AS docs, sha256(array_to_string(l[x:y], chr(10))) AS source_sha256, coalesce(name, '') AS symbols, module_path FROM folder
UNION ALL SELECT file_path || '::config::whole:1-' || n, file_path, 1, n::INT, 'Config', NULL, NULL, sha256(text), '', regexp_replace(file_path, '/[^/]*$', '') FROM l WHERE NOT is_source""",
        "document_graph_nodes": f"WITH {graph_sql} SELECT * FROM nodes",
        "document_graph_edges": f"WITH {graph_sql} SELECT * FROM edges",
        "document_graph_summary": f"WITH {graph_sql} SELECT 'nodes' AS part, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind",
        "document_graph_expand": f"""WITH {graph_sql}, e AS (SELECT from_id AS a, to_id AS b FROM edges WHERE kind IN ('Tests', 'InModule') UNION SELECT to_id, from_id FROM edges WHERE kind IN ('Tests', 'InModule')),
h0 AS (SELECT 'file:' || path AS id FROM f WHERE doc_id = 20), h1 AS (SELECT b AS id FROM h0 JOIN e ON a = id), h2 AS (SELECT b AS id FROM h1 JOIN e ON a = id)
SELECT path FROM nodes WHERE kind = 'File' AND id IN (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2)""",
        "document_test_edges": f"WITH {graph_sql} SELECT * FROM tests",
        "document_public_symbols": f"WITH {base} SELECT * FROM s WHERE visibility = 'Public'",
        "document_symbol_kinds": f"WITH {base} SELECT kind, count(*) AS symbols FROM s GROUP BY kind",
        "document_symbol_lookup": f"""WITH {base}, q(query) AS (VALUES ('worthless'), ('Thing'), ('RING')), h AS (SELECT query, name, file_path, {found} AS score FROM s, q),
best AS (SELECT * FROM h WHERE score > 0 QUALIFY max(score) OVER (PARTITION BY query) < 4 OR score = 4)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name, string_split(file_path, '/'))::INT AS rank FROM best QUALIFY rank <= 5""",
        "document_candidates": f"""WITH {base}, c AS (
  SELECT path, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 4) / 4.0::DOUBLE ELSE 0 END AS symbol_score, least(1.0, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 10) / 20.0::DOUBLE ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0.2::DOUBLE ELSE 0 END) AS lex,
    ({terms}) / {len(a.terms)}::DOUBLE AS semantic, CASE WHEN {same(OPENED)} THEN 0.25::DOUBLE ELSE 0 END AS graph_score, CASE WHEN {same(RECENT)} THEN 1::DOUBLE ELSE 0 END AS recency_score, {hinted} AS module_match,
    concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'symbol' END, CASE WHEN doc_id % 2 = 0 THEN 'bm25' END, CASE WHEN doc_id % 5 = 0 THEN 'grep' END, CASE WHEN {same(OPENED)} THEN 'working_memory' END, CASE WHEN {hinted} THEN 'module_hint' END, CASE WHEN {same(RECENT)} THEN 'recent_change' END) AS reasons
  FROM f WHERE doc_id % 2 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0),
d AS (SELECT *, CASE WHEN module_match THEN least(1.0, lex + 0.25) ELSE lex END AS lexical_score FROM c)
SELECT path, symbol_score, lexical_score, round(semantic, 9) AS semantic_score, graph_score, recency_score, module_match, reasons,
  round(0.0 + {w[0]} * symbol_score + {w[1]} * lexical_score + {w[2]} * semantic + {w[3]} * graph_score + {w[4]} * recency_score, 6) AS final_score FROM d""",
    }
