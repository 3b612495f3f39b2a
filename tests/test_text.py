import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import budget
from corpusloom.operators.lexical import fts_phrases


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("a\nb", ["a", "b"]), ("a\r\nb\n", ["a", "b"]), ("", []), ("\n\n", ["", ""]), ("x", ["x"]), (None, None)])
def test_lines(spark, value, want):
    assert column(spark, value, text.lines) == want


@pytest.mark.parametrize(("end", "want"), [(260, [(1, 120), (101, 220), (201, 260)]), (120, [(1, 120)]), (121, [(1, 120), (101, 121)]), (1, [(1, 1)])])
def test_windows(spark, end, want):
    got = spark.range(1).select(text.windows(F.lit(1), F.lit(end), 120, 20).alias("w")).first().w
    assert [(w.start, w.end) for w in got] == want


def reference_tokens(value):
    out = []
    lower = "".join(c.lower() if c.isascii() else c for c in value)
    for w in re.findall(r"(?:[^\W]|\$)+", lower):
        if len(w) >= 2:
            out += [w, *(p for p in re.split(r"[_$]", w) if len(p.encode()) >= 2)]
    return [t for t in out if t not in text.CODE_STOP_WORDS]


@pytest.mark.parametrize("value", ["validateToken auth_middleware", "a_b fn return_value $x$yy", "", "x", "ünï_cödé 42", "if else"])
def test_code_tokens(spark, value):
    assert column(spark, value, text.code_tokens) == reference_tokens(value)


def test_imports(spark):
    source = "import { A } from './a';\nexport * from \"../b\"\nuse crate::auth;\nmod session;\n#include <x.h>\nfrom os.path import join\n"
    assert column(spark, source, text.imports) == ["../b", "./a", "crate::auth", "os.path", "session", "x.h"]


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=60), st.integers(0, 20))
def test_truncation_fits(value, tokens):
    cut = budget.truncated(value, tokens)
    assert budget.estimate(cut) <= tokens
    assert budget.estimate(value) > tokens or tokens == 0 or cut == value


@pytest.mark.parametrize("value", ["", "abc", "abcdefgh", "éééé", "ab é" * 9])
def test_token_estimate(spark, value):
    assert column(spark, value, text.token_estimate) == budget.estimate(value)


def test_excerpt(spark):
    assert column(spark, "a\nb\nc\nd", lambda c: text.excerpt(c, 2, 1)) == "    1: a\n    2: b\n    3: c\n"


def test_hash_embedding_is_a_unit_vector(spark):
    import hashlib
    import math

    v = column(spark, "alpha beta beta", lambda c: text.hash_embedding(text.code_tokens(c), 16))
    want = [0.0] * 16
    for t in reference_tokens("alpha beta beta"):
        h = hashlib.sha256(t.encode()).digest()
        want[int.from_bytes(h[:8], "little") % 16] += 1 if h[8] % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in want))
    assert v == pytest.approx([x / norm for x in want])


def test_phrases_follow_index_words():
    assert fts_phrases("Validate_token a bc") == [["bc"], ["validate", "token"]]
