"""The pipeline's language stage: the network's score decides, and a table without labels is kept."""

import random
import string

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_without_labels_lettered_documents_stay(spark):
    rows = [(1, "one two", None), (2, None, None), (3, "12 !", None), (4, "тест", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 4]


def test_low_confidence_goes_and_prose_stays(spark):
    rng = random.Random(1)
    junk = [(10_000_000 + i, "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(500))) for i in range(60)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    both = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, SF).select("doc_id").collect()}
    assert sum(i in kept for i, _ in junk) < 45
    assert sum(i < 10_000_000 for i in kept) >= 0.998 * docs.count()
