"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from corpusloom.functions.text import CODE_STOP_WORDS
from corpusloom.operators import confidence, retrieval
from corpusloom.plans import queries as q


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
LINES = r"(CASE WHEN regexp_split_to_array({t}, '\r?\n')[-1] = '' THEN regexp_split_to_array({t}, '\r?\n')[:-2] ELSE regexp_split_to_array({t}, '\r?\n') END)"
WORDS = rf"list_filter(regexp_extract_all(translate({{t}}, {UP}, {LOW}), '[\p{{{{L}}}}\p{{{{N}}}}_$]+'), lambda w: length(w) >= 2)"
PIECES = rf"list_transform(list_filter(string_split_regex(regexp_replace(w, '(\p{{{{Ll}}}})(\p{{{{Lu}}}})', '\1_\2', 'g'), '[_$]'), lambda p: strlen(p) >= 2), lambda p: translate(p, {UP}, {LOW}))"
TOKENS = f"list_filter(flatten(list_transform({WORDS}, lambda w: list_concat([w], {PIECES}))), lambda x: NOT list_contains({_list(CODE_STOP_WORDS)}, x))"
ESTIMATE = r"(CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(length(regexp_replace({t}, '[^\x00-\x7F]', '', 'g')) // 4 + (length({t}) - length(regexp_replace({t}, '[^\x00-\x7F]', '', 'g'))) // 2, 1) END)::BIGINT"
LINE_COUNT = f"greatest(len({LINES}), 1)"


def _tf(table: str, key: str, source: str = "doc_id") -> str:
    return f"SELECT {key}, token, count(*) AS tf FROM (SELECT {source} AS {key}, unnest({TOKENS.format(t='text')}) AS token FROM {table}) GROUP BY ALL"


def _tfidf(queries: str, k: int) -> str:
    """Common tables up to r(query_id, doc_id, score, rank)."""
    return f"""
tf AS ({_tf('documents', 'doc_id')}), qs AS ({queries}), qtf AS ({_tf('qs', 'query_id', 'query_id')}),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), norms AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY doc_id),
qw AS (SELECT query_id, token, sqrt(tf) * (ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM qtf LEFT JOIN df USING (token)),
qn AS (SELECT query_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS wq FROM qw),
s AS (SELECT query_id, doc_id, round(sum(tf * wq) / any_value(norm), 6) AS score FROM tf JOIN qn USING (token) JOIN norms USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= {k})"""


def _bm25(query: str, k: int) -> str:
    from corpusloom.operators.lexical import fts_phrases

    phrases = fts_phrases(query)
    hits = []
    for p in phrases:
        n = len(p)
        hits.append(f"len(list_filter(range(1, greatest(len(w) - {n} + 1, 1) + 1), lambda i: w[i : i + {n - 1}] = {_list(p)}))::BIGINT")
    idf = [f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i}::DOUBLE * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))" for i in range(len(phrases))]
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS len, {', '.join(f'{h} AS f{i}' for i, h in enumerate(hits))} FROM w),
st AS (SELECT count(*) AS n, avg(len) AS avg_len, {', '.join(f'sum((f{i} > 0)::INT) AS n{i}' for i in range(len(hits)))} FROM c),
sc AS (SELECT doc_id, round({' + '.join(idf)}, 6) AS score FROM c, st WHERE {' OR '.join(f'f{i} > 0' for i in range(len(hits)))})
SELECT doc_id, score, round(score / (score + 1), 6) AS fts_score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM sc ORDER BY score DESC, doc_id LIMIT {k}"""


def _hash(table: str, key: str) -> str:
    pairs = " || ".join(f"substr(h, {15 - 2 * k}, 2)" for k in range(8))
    return f"""SELECT {key}, dim, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM (
  SELECT {key}, (('0x' || {pairs})::UBIGINT % {q.DIMS})::INT AS dim, sum(CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN tf ELSE -tf END) AS v
  FROM (SELECT {key}, tf, sha256(token) AS h FROM ({_tf(table, key, key)})) GROUP BY ALL) WHERE v <> 0"""


_ONE = f"SELECT 0 AS query_id, '{q.SEARCH}' AS text"
_BENCH = "SELECT item_id AS query_id, text FROM benchmark"
_IDENT = "[A-Za-z_$][A-Za-z0-9_$]*"
_FILE_LINES = f"SELECT doc_id, unnest(generate_series(1, len(l))) AS line_number, unnest(l) AS line FROM (SELECT doc_id, {LINES.format(t='text')} AS l FROM documents)"
_MENTIONS = f"""
names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_IDENT}')) AS name FROM benchmark),
fl AS (SELECT *, regexp_extract_all(line, '{_IDENT}') AS ns, string_split_regex(line, '{_IDENT}') AS gaps FROM ({_FILE_LINES})),
ids AS (SELECT doc_id, line_number, ns, gaps, unnest(generate_series(1, len(ns))) AS i FROM fl),
refs AS (
  SELECT doc_id, ns[i] AS symbol_name, line_number::INT AS line_number,
    (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ns[1:i - 1], lambda x: length(x))), 0) + 1)::INT AS column_start,
    CASE WHEN rtrim(gaps[i]) LIKE '%<' THEN 'ComponentUse' WHEN ltrim(gaps[i + 1]) LIKE '(%' THEN 'Call' ELSE 'Identifier' END AS kind
  FROM ids WHERE ns[i] IN (SELECT name FROM names WHERE length(name) >= 10))"""
_LINKS = """links AS (SELECT DISTINCT 'page:' || page_id AS from_id, 'link:' || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS to_id FROM pages),
und AS (SELECT from_id AS a, to_id AS b FROM links UNION SELECT to_id, from_id FROM links)"""
_INTENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in retrieval.INTENTS) + " ELSE 'Unknown' END"
_TERMS = rf"""list_sort(list_distinct(list_concat(
  list_filter(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{{2,}}'), lambda w: NOT list_contains({_list(retrieval.STOP_WORDS)}, lower(w))),
  list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]{{3,}}'), lambda w: NOT list_contains({_list(retrieval.STOP_WORDS)}, w)))))"""
_SNAP = """i AS (SELECT doc_id AS id, source AS file_path, sha256(text) AS text_hash FROM documents WHERE source <> 'src7'),
c AS (SELECT doc_id AS id, source AS file_path, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS text_hash FROM documents WHERE source <> 'src3'),
ch AS (SELECT coalesce(c.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'missing' WHEN c.id IS NULL THEN 'extra' ELSE 'changed' END AS status
  FROM c FULL JOIN i ON c.id = i.id WHERE i.id IS NULL OR c.id IS NULL OR c.text_hash <> i.text_hash)"""
_W = WORDS.format(t="text")
_FUSION = f"""
WITH {_tfidf(_BENCH, 30)},
dw AS (SELECT doc_id, unnest(list_distinct({_W})) AS w FROM documents), qwd AS (SELECT query_id, unnest(list_distinct({_W})) AS w FROM qs),
common AS (SELECT query_id, doc_id, count(*) AS n FROM dw JOIN qwd USING (w) GROUP BY ALL),
lex AS (SELECT query_id, doc_id, round(n / (n + 1), 6) AS score FROM common QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(n / (n + 1), 6) DESC, doc_id) <= 30),
fused AS (
  SELECT query_id, doc_id, round(0.25 * coalesce(l.score, 0) + 0.20 * CASE WHEN t.score IS NULL THEN 0 ELSE least(t.score, 1.0) END, 8) AS score,
    concat_ws(',', CASE WHEN l.score IS NOT NULL THEN 'bm25' END, CASE WHEN t.score IS NOT NULL THEN 'tfidf' END) AS reasons
  FROM lex l FULL JOIN r t USING (query_id, doc_id)),
top12 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM fused QUALIFY rank <= 12)"""
_G = confidence.PROFILES["Generic"]
_CONF = f"""{_FUSION},
f AS (SELECT query_id, max(score) AS top_score, max(score) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0.0) AS gap, count(*) AS n FROM top12 GROUP BY query_id),
conf AS (SELECT query_id, 1 / (1 + exp(-6.0 * ({_G[0]} * least(greatest(top_score, 0.0), 1.0) + {_G[1]} * least(greatest(gap / 0.5, 0.0), 1.0) + {_G[4]} * (n >= 2)::INT + {_G[6]} * least(n / 12.0, 1.0) - 0.5))) AS c FROM f),
result AS (SELECT query_id, round(c, 6) AS confidence, CASE WHEN c >= {_G[7]} THEN 'RagOnly' WHEN c >= {_G[8]} THEN 'Hybrid' ELSE 'FallbackExplore' END AS strategy FROM conf)"""
_EXT = "CASE lang WHEN 'en' THEN 'Python' WHEN 'de' THEN 'Rust' WHEN 'fr' THEN 'TypeScript' END"
_BUCKET = "CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END"

ORACLE: dict[str, str] = {
    "corpus_counts": f"SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars, sum({ESTIMATE.format(t='text')})::BIGINT AS tokens FROM documents GROUP BY lang",
    "path_classes": f"SELECT {_EXT} AS language, {_EXT} IS NOT NULL AS is_source, TRUE AS is_text, 2 AS depth, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ALL",
    "project_mode": "SELECT count(*) AS files, count(*) AS source_files, sum(n_chars)::BIGINT AS bytes, (sum(n_chars) // 4)::BIGINT AS estimated_tokens, 1 AS max_depth, CASE WHEN count(*) <= 80 AND sum(n_chars) // 4 <= 120000 THEN 'Full' WHEN count(*) <= 1000 AND sum(n_chars) // 4 <= 1500000 THEN 'Hybrid' ELSE 'Rag' END AS mode FROM documents",
    "file_lines": f"SELECT doc_id, line_number::INT AS line_number, line FROM ({_FILE_LINES})",
    "chunk_windows": f"""WITH d AS (SELECT doc_id, {LINES.format(t='text')} AS l, {LINE_COUNT.format(t='text')} AS n FROM documents),
k AS (SELECT *, unnest(generate_series(0, greatest(0, ceil((n - 10) / 8)::INT))) AS k FROM d)
SELECT doc_id, (1 + 8 * k)::INT AS line_start, least(10 + 8 * k, n)::INT AS line_end, sha256(array_to_string(l[1 + 8 * k : least(10 + 8 * k, n)], chr(10))) AS source_sha256 FROM k""",
    "code_tokens": f"SELECT doc_id, len(t)::INT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {TOKENS.format(t='text')} AS t FROM documents)",
    "term_freq": _tf("documents", "doc_id"),
    "unit_vectors": f"SELECT doc_id, token, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS w FROM ({_tf('documents', 'doc_id')})",
    "doc_freq": f"SELECT token, count(*) AS df FROM ({_tf('documents', 'doc_id')}) GROUP BY token",
    "tfidf_search": f"WITH {_tfidf(_ONE, 30)} SELECT doc_id, score, rank FROM r",
    "tfidf_batch": f"WITH {_tfidf(_BENCH, 10)} SELECT query_id, doc_id, score, rank FROM r",
    "bm25_search": _bm25(q.SEARCH, 30),
    "bm25_phrase": _bm25(q.PHRASE, 30),
    "grep_ci": f"SELECT doc_id, line_number::INT AS line_number, line FROM ({_FILE_LINES}) WHERE regexp_matches(line, '(?i){q.GREP}') ORDER BY doc_id, line_number LIMIT 40",
    "excerpts": f"""WITH d AS (SELECT doc_id, {LINES.format(t='text')} AS l, ceil({LINE_COUNT.format(t='text')} / 2)::INT AS m FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(l, lambda x, i: printf('%5d: %s', i, x) || chr(10))[greatest(m - 2, 1) : m + 2], '')) AS excerpt_sha256 FROM d""",
    "hash_embed_long": f"SELECT doc_id, dim, round(value, 6) AS value FROM ({_hash('documents', 'doc_id')})",
    "hash_search": f"""WITH qs AS ({_ONE}), d AS ({_hash('documents', 'doc_id')}), qv AS ({_hash('qs', 'query_id')}),
s AS (SELECT doc_id, round(sum(d.value * qv.value), 6) AS score FROM d JOIN qv USING (dim) GROUP BY doc_id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""",
    "dense_topk": """WITH s AS (SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 10""",
    "dense_labels": """WITH x AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, round(avg(x), 6) AS m FROM x GROUP BY ALL),
qv AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM m GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q), 5) AS score FROM embeddings, qv)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "text_hash_groups": "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "freshness_diff": f"WITH {_SNAP} SELECT id, status FROM ch",
    "touched_paths": f"WITH {_SNAP} SELECT DISTINCT file_path AS path FROM (SELECT * FROM c UNION ALL SELECT * FROM i) WHERE id IN (SELECT id FROM ch)",
    "symbol_exact": "SELECT p_name AS name, p_brand AS file_path, 4 AS score, count(*) AS n FROM part WHERE p_name = 'red widget' GROUP BY ALL",
    "symbol_contains": """WITH s AS (SELECT p_name AS name, p_brand AS file_path, CASE WHEN lower(p_name) = 'ring' THEN 3 WHEN contains(lower(p_name), 'ring') THEN 2 WHEN regexp_matches(lower(p_name), 'r.*i.*n.*g') THEN 1 ELSE 0 END AS score FROM part)
SELECT name, file_path, score, count(*) AS n FROM s WHERE score > 0 GROUP BY ALL""",
    "symbol_subsequence": """SELECT c_name AS name, c_mktsegment AS file_path, 1 AS score FROM customer WHERE regexp_matches(lower(c_name), 'c.*m.*r.*#.*9.*9')""",
    "public_api": """WITH s AS (SELECT DISTINCT p_name AS name, p_brand AS file_path, CASE WHEN p_type = 'ECONOMY' THEN 'Class' ELSE 'Function' END AS kind FROM part WHERE p_size > 25 OR p_type = 'ECONOMY')
SELECT * FROM s ORDER BY string_split(file_path, '/'), name, kind LIMIT 80""",
    "mention_refs": f"WITH {_MENTIONS} SELECT * FROM refs",
    "refs_limit_per_name": f"WITH {_MENTIONS} SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY symbol_name ORDER BY doc_id, line_number, column_start) <= 12",
    "ref_counts": f'WITH {_MENTIONS} SELECT count(DISTINCT symbol_name) AS symbols, count(*) AS "references" FROM refs',
    "link_edges": f"WITH {_LINKS} SELECT * FROM links",
    "link_degree": f"WITH {_LINKS} SELECT a AS id, count(*) AS degree FROM und GROUP BY a",
    "link_bfs2": f"""WITH {_LINKS}, h1 AS (SELECT b AS id FROM und WHERE a = 'page:0'), h2 AS (SELECT DISTINCT b AS id FROM und WHERE a IN (SELECT id FROM h1) AND b <> 'page:0' AND b NOT IN (SELECT id FROM h1))
SELECT 'page:0' AS id, 0 AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
    "link_neighbours": f"""WITH {_LINKS}, dg AS (SELECT a AS id, count(*) AS degree FROM und GROUP BY a)
SELECT a, b, degree, row_number() OVER (PARTITION BY a ORDER BY degree DESC, b)::INT AS r FROM und JOIN dg ON dg.id = b QUALIFY r <= 3""",
    "module_buckets": rf"""WITH u AS (SELECT regexp_replace(url, '^https?://([^?#]*).*$', '\1') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS p FROM u), b AS (SELECT {_BUCKET} AS bucket, path FROM s),
f AS (SELECT bucket, path, row_number() OVER (PARTITION BY bucket ORDER BY path) AS r FROM b)
SELECT bucket, count(*) AS files, string_agg(path, ',' ORDER BY path) FILTER (r <= 5) AS key_files FROM f GROUP BY bucket""",
    "intent_classify": f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations WHERE role = 'user'",
    "query_terms": f"SELECT conv_id, turn, array_to_string({_TERMS}, ' ') AS terms FROM conversations WHERE role = 'user'",
    "score_fusion": f"{_FUSION} SELECT * FROM fused",
    "top12_per_query": f"{_FUSION} SELECT * FROM top12",
    "result_confidence": f"{_CONF} SELECT * FROM result",
    "fallback_plan": f"{_CONF} SELECT strategy, count(*) AS queries, max(CASE strategy WHEN 'FallbackExplore' THEN 4 WHEN 'Hybrid' THEN 2 ELSE 0 END)::INT AS steps FROM result GROUP BY strategy",
    "token_estimate": f"SELECT doc_id, {ESTIMATE.format(t='text')} AS tokens FROM documents",
    "budget_pack": f"SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM (SELECT source, doc_id, {ESTIMATE.format(t='text')} AS tokens FROM documents) QUALIFY used <= 32000",
    "recency_lru50": """WITH l AS (SELECT user_id, max((ts, event_id)) AS m FROM events GROUP BY user_id)
SELECT user_id, m[2] AS event_id, row_number() OVER (ORDER BY m DESC, user_id)::INT AS rank FROM l QUALIFY rank <= 50""",
    "debounce_batches": """WITH e AS (SELECT epoch_us(ts) AS t FROM events), n AS (SELECT t, coalesce(t - lag(t) OVER (ORDER BY t) > 300000000, TRUE)::INT AS new FROM e), b AS (SELECT t, sum(new) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS id FROM n)
SELECT min(t) AS started_us, max(t) AS ended_us, count(*) AS events FROM b GROUP BY id""",
    "debounce_sessions": """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), n AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600000000, TRUE)::INT AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS id FROM n)
SELECT user_id, min(t) AS started_us, count(*) AS events, count(DISTINCT event_type) AS items FROM b GROUP BY user_id, id""",
    "ir_metrics": f"""WITH {_tfidf(_BENCH, 10)}, qrels AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)),
h AS (SELECT query_id, min(rank) AS rank FROM r JOIN qrels USING (query_id, doc_id) GROUP BY query_id), a AS (SELECT query_id, rank FROM (SELECT DISTINCT query_id FROM qrels) LEFT JOIN h USING (query_id))
SELECT count(*) AS queries, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1 / rank, 0.0)), 6) AS mrr,
  round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg_10 FROM a""",
    "latency_percentiles": "SELECT event_type, count(value) AS iterations, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
}
