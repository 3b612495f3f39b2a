from pyspark.sql import functions as F

from corpusloom.llm import bpe, exact_dedup, jaccard_join, langid, mixing, pii, sharding, substring_dedup, toxicity


def test_columns_that_differ_in_case_only(spark):
    """Extra columns named like the operators' own but for case neither clash nor are taken for them."""
    rows = [(1, "the same words here, a@b.example", "en", "a"), (2, "the same words here, a@b.example", "en", "b"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", F.lit("other").alias("TEXT"), F.lit(7).alias("Doc_ID"), F.lit("x").alias("Source"), F.lit("zz").alias("LANG"), F.lit(1).alias("Row"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int").select("*", F.lit(0).alias("TOXIC"))
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_dedup(docs).collect()} == {1: 2, 2: 2, 3: 1}
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [2, 3]
    assert {r.doc_id: r.size for r in mixing.mix_sizes(docs).collect()} == {1: 5, 2: 5, 3: 0}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and all(tuple(r)[4:] == ("other", 7, "x", "zz", 1) for r in mixed.collect())
    near = jaccard_join.one_of_each(docs)
    assert near.columns == docs.columns and sorted(r[0] for r in near.collect()) == [1, 3]
    assert langid.known_language(docs, 0.0).columns == docs.columns
    assert langid.identify(docs).count() == substring_dedup.without_repeats(docs).count() == sharding.shard_documents(docs).count() == 3
    assert toxicity.score_documents(docs, labels).count() == pii.surrogate_documents(docs, "key").count() == 3
    import public_tokenizers

    assert bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 3
