import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000
#: Null and repeated identifiers, null, empty and blank texts, ties, long texts; columns whose names the operators use inside.
ODD = [
    (None, "no identifier here", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "de", "b"), (4, "The Quick brown fox jumps", "en", None), (5, "the quick BROWN fox jumps", "en", "a"),
    (5, "the quick BROWN fox jumps", "en", "a"), (6, LONG, "la", "b"), (7, LONG.upper(), "la", "b"), (8, LONG + "end", None, "c"), (9, "ÄÖÜ straße Σας ½ 漢字 😀", "de", "a"), (10, "12 34 !!", "en", ""), (11, "x", "en", "a"), (None, None, None, None),
]
CLASHING = "h n salt k size b row kept digest norm start copies skey target upto finish step place run gid rep token lang_pred score slot shard entities tries taken".split()


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def some(spark):
    """Whole documents of the smallest test tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
