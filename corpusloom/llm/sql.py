"""DuckDB SQL for those queries of this package that SQL can express."""

OP3 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n AS q_row, q.vec_id AS query_id, c.n AS c_row, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id, c_row)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP4 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""

#: Common tables that end in cut(skey, source_size, target, full_passes, last_k, last_id); input: e(doc_id, source, skey, size, k).
MIX_CUT = r"""
sums AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM e GROUP BY ALL),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS lim FROM sums),
levels AS (
  SELECT *, row_number() OVER s AS r,
    (sum(source_size) OVER () - coalesce(sum(lim) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE AS lev
  FROM ranked WINDOW s AS (ORDER BY lim::DOUBLE / weight::DOUBLE, skey)),
first_open AS (SELECT min(r) AS r0, arg_min(lev, r) AS lev0 FROM levels WHERE lim > weight * lev),
targets AS (
  SELECT skey, source_size, CASE WHEN r0 IS NULL OR r < r0 THEN lim::DOUBLE ELSE weight * lev0 END AS target FROM levels, first_open),
upto AS (
  SELECT e.*, target, source_size, sum(size) OVER (PARTITION BY e.skey ORDER BY k, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM e JOIN targets USING (skey) WHERE target > 0),
copies AS (SELECT *, (p * source_size + upto)::DOUBLE / target AS finish FROM upto, (SELECT unnest([0, 1, 2]) AS p)),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, k, doc_id, p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copies),
reach AS (SELECT skey, max((p, k, doc_id)) AS m FROM queue WHERE total <= (SELECT sum(source_size) FROM sums) GROUP BY skey),
cut AS (SELECT t.skey, source_size, target, coalesce(m[1], 0) AS full_passes, m[2] AS last_k, m[3] AS last_id FROM targets t LEFT JOIN reach USING (skey))
"""
MIX_ENTRY = r"""doc_id, source, coalesce('s' || source, 'n') AS skey, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
 ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k"""
MIX_COPIES = "full_passes + CASE WHEN (k, doc_id) <= (last_k, last_id) THEN 1 ELSE 0 END"

OP6 = f"""
WITH e AS (SELECT {MIX_ENTRY} FROM documents), {MIX_CUT}
SELECT doc_id, size, source_size, target, (size * ({MIX_COPIES}))::BIGINT AS taken, source FROM e JOIN cut USING (skey)
"""

ORACLE: dict[str, str] = {"op3_topk_search": OP3, "op4_exact_dedup": OP4, "op6_mixing": OP6}
