import math
import sqlite3

import pytest

from corpusloom.operators import dense, evaluation, freshness, lexical, memory, symbols

DOCS = [(1, "validate token auth"), (2, "token token garden"), (3, "the école of auth_token"), (4, "nothing here"), (5, None)]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_tfidf_finds_the_closest(spark):
    q = spark.createDataFrame([(0, "validate token auth")], "query_id long, text string")
    got = lexical.tfidf_search(docs(spark), q, 3).orderBy("rank").collect()
    assert got[0].doc_id == 1 and got[0].score == pytest.approx(1.0, abs=0.05)
    assert lexical.tfidf_search(docs(spark).limit(0), q, 3).count() == 0


@pytest.mark.parametrize("query", ["token", "auth token", "auth_token", "ecole garden", "missing"])
def test_bm25_agrees_with_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    for i, t in DOCS:
        db.execute("INSERT INTO t(rowid, text) VALUES (?, ?)", (i, t or ""))
    match = " OR ".join(f'"{t}"' for t in sorted(set(query.split())))
    want = {r: round(-s, 6) for r, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {r.doc_id: r.score for r in lexical.bm25_search(docs(spark), query, 10).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_grep_takes_bad_patterns_literally(spark):
    lines = spark.createDataFrame([(1, "a(b"), (2, "xyz"), (3, "A(B")], "n int, line string")
    assert [r.n for r in lexical.grep(lines, "a(b", 5, ["n"]).collect()] == [1, 3]
    assert [r.n for r in lexical.grep(lines, "X.Z", 5, ["n"]).collect()] == [2]


def test_dense_top_k(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [1.0])], "id int, v array<double>")
    assert [(r.id, r.score) for r in dense.top_k(v, [1.0, 0.0], 5, "id", "v").collect()] == [(1, 1.0), (4, 1.0), (2, 0.6)]


def test_symbol_lookup_prefers_exact(spark):
    s = spark.createDataFrame([("login", "b"), ("Login", "a"), ("loginUser", "a"), ("lxoxgxixn", "a")], "name string, file_path string")
    assert [r.name for r in symbols.lookup(s, "login").collect()] == ["login"]
    assert [(r.name, r.score) for r in symbols.lookup(s, "LOGIN").collect()] == [("Login", 3), ("login", 3), ("loginUser", 2), ("lxoxgxixn", 1)]
    q = spark.createDataFrame([("login",), ("LOGIN",)], "query string")
    many = symbols.lookup_many(s.selectExpr("*", "1 line_start"), q, 2).collect()
    assert sorted((r.query, r.name) for r in many) == [("LOGIN", "Login"), ("LOGIN", "login"), ("login", "login")]
    assert symbols.lookup(s, " ").count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 2), (3, 30, 1)], "query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "query_id int, doc_id int")
    m = evaluation.ir_metrics(ranked, qrels).first()
    assert (m.queries, m.recall_1, m.recall_3) == (3, round(1 / 3, 6), round(2 / 3, 6))
    assert m.mrr == 0.5 and m.ndcg_10 == round((1 + 1 / math.log2(3)) / 3, 6)


def test_freshness(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, size_bytes long, modified_unix long, sha256 string")
    now = f([("same", 1, 1, "x"), ("touched", 1, 2, "x"), ("edited", 1, 2, "y"), ("grown", 2, 1, "x"), ("new", 1, 1, "x")])
    old = f([("same", 1, 1, "x"), ("touched", 1, 1, "x"), ("edited", 1, 1, "x"), ("grown", 1, 1, "x"), ("gone", 1, 1, "x")])
    assert {r.path: r.status for r in freshness.files_changed(now, old).collect()} == {"edited": "changed", "grown": "changed", "new": "missing", "gone": "extra"}


def test_recent_keeps_the_latest(spark):
    uses = spark.createDataFrame([(f"f{i}", i) for i in range(60)] + [("f0", 99)], "item string, at int")
    got = [r.item for r in memory.recent(uses, "item", ["at"], 50).orderBy("rank").collect()]
    assert got[:2] == ["f0", "f59"] and len(got) == 50 and "f5" not in got
    m = memory.WorkingMemory()
    for i in range(60):
        m = m.remember("t", [f"f{i}"], [])
    assert len(m.files) == 50 and m.files[-1] == "f59" and "f9" not in m.files
