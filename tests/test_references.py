import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusloom.operators import references
from corpusloom.plans.registry import ORACLE, QUERIES

WORD = re.compile(references.IDENTIFIER)


def places(path, line):
    found = list(WORD.finditer(line))
    ends, starts = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(line)]
    for k, m in enumerate(found):
        before, after = line[ends[k] : m.start()], line[m.end() : starts[k + 1]]
        yield path, m.group(), m.start() + 1, "ComponentUse" if before.rstrip(" ").endswith("<") else "Call" if after.lstrip(" ").startswith("(") else "Identifier"


def shuffled(df):
    """Bytes that went to the exchanges of ``df``, and its rows."""
    rows, seen = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            seen += node.metrics().apply("dataSize").value()
        todo += [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    return seen, rows


@pytest.fixture
def texts():
    rng = random.Random(7)
    gaps = [" ", "  < ", " (", "é1", "\U0001f600", " ( <", "1 ", "<", "(", "\t", "."]
    sizes = [n for k in range(4) for n in (k * references.PIECE - 1, k * references.PIECE, k * references.PIECE + 1) if n >= 0]
    return [(f"p{n}", rng.choice(["", "< ", "1"]) + "".join(rng.choice(["ab", "x1", "_", "$q", "C"]) + rng.choice(gaps) for _ in range(n))) for n in sizes]


def test_identifiers_of_long_lines(spark, texts):
    got = references.identifiers(spark.createDataFrame(texts, "path string, text string")).collect()
    assert sorted((r.path, r.name, r.column_start, r.kind) for r in got) == sorted(x for p, t in texts for x in places(p, t))


@pytest.mark.parametrize("few", [0, references.FEW_NAMES])
def test_places(spark, texts, few, monkeypatch):
    monkeypatch.setattr(references, "FEW_NAMES", few)
    s = spark.createDataFrame([("p31", "ab", 1), ("p33", "x1", 1), ("p33", "x1", 1), ("p64", "C", 2)], "file_path string, name string, line_start int")
    got = references.places(spark.createDataFrame(texts, "path string, text string"), s).collect()
    want = [x for p, t in texts for x in places(p, t) if x[1] in ("ab", "x1", "C") and x[:2] not in (("p31", "ab"), ("p33", "x1"))]
    assert sorted((r.file_path, r.symbol_name, r.column_start, r.kind) for r in got) == sorted(want)


def test_sieve(spark):
    names, others = (spark.range(a, a + 20_000).selectExpr("concat('n', id) AS name") for a in (0, 20_000))
    passes = references.sieve(names, 20_000)
    assert names.where(passes(names.name)).count() == 20_000
    assert others.where(passes(others.name)).count() < 1000


@pytest.mark.parametrize("few", [0, 10_000])
def test_only_uses_of_symbols_are_shuffled(spark, few, monkeypatch):
    """A line of 1000 words used to be shuffled with each of its words."""
    monkeypatch.setattr(references, "FEW_NAMES", few, raising=False)
    line = " ".join(f"word{i}" for i in range(1000))
    s = spark.createDataFrame([("b.py", "word7", 1), ("b.py", "word999", 1)], "file_path string, name string, line_start int")
    size, rows = shuffled(references.references(spark.createDataFrame([("a.py", line)], "path string, text string"), s))
    assert sorted((r.symbol_name, r.column_start) for r in rows) == [("word7", 1 + 7 * 6), ("word999", 1 + line.index("word999"))]
    assert size < 1_000_000


@pytest.mark.parametrize("name", ["document_references", "document_reference_counts", "document_reference_lookup"])
def test_documents_of_one_path(spark, name, tmp_path):
    """A place of two texts of one path is one place, whatever else is on its line."""
    docs = [(3, "worthless"), (5, "a worthless b"), (5, "c worthless d"), (5, "a worthless b"), (7, "worthless\r\n< worthless (\n")]
    pq.write_table(pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "source": ["s"] * len(docs), "lang": ["en"] * len(docs)}), f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), db.sql(ORACLE[name])
    assert sorted(map(repr, ([r[c] for c in want.columns] for r in got.collect()))) == sorted(repr(list(r)) for r in want.fetchall())
