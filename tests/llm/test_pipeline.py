import collections
import hashlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import sql
from corpusloom.llm.queries import QUERIES

from .test_copies import LOWER, brute

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    """All of these documents have a language, so the first stage keeps every one."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    last = {}
    for i, t, s in docs:
        k = t.translate(LOWER)
        last[k] = max(last.get(k, (i, t, s)), (i, t, s))
    one = {i: (t, s) for i, t, s in last.values()}
    comp = brute([(i, t) for i, (t, _) in one.items()], 5, 80, 100)
    kept = [(i, *one[i]) for i in one if comp[i][1] == i]
    c = duckdb.connect()
    c.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    copies = dict(c.sql(f"WITH e AS (SELECT {sql.MIX_ENTRY} FROM documents), {sql.MIX_CUT} SELECT doc_id, {sql.MIX_COPIES} FROM e JOIN cut USING (skey)").fetchall())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, text, _ in kept:
        ids = t.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += copies[i]
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        d = docs
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
            assert d.columns == docs.columns or name == "bpe"
        assert d.count() == 0 or docs is odd


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.sql(sql.ORACLE[name]), QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    place = [want.columns.index(n) for n in names]
    assert sorted(repr([r[n] for n in names]) for r in got.collect()) == sorted(repr([r[i] for i in place]) for r in want.fetchall())
