"""The queries of this subpackage, each over its whole table, and the SQL that they must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, covertree, decontaminate, langid, licences, maintext, packing, simhash, tokenfile, urls
from .common import dropped, new_path, table, written_for_later


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=1)
    return packing.packed(tokens, 2048).drop("ids").withColumnRenamed("key", "doc_id")


#: Host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page shows the document that its path names last; it is bad if that one is of low quality or toxic."""
    shown = pages.select("page_id", F.regexp_extract(urls.path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long").alias("doc_id"))
    said = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return shown.join(said, "doc_id").select("page_id", "bad")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, page_labels(pages, table(spark, sf_dir, "labels")), RULES)


def op5_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.with_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, ngram=3, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, F.coalesce(~held_out(), F.lit(False)))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), new_path(spark, "warc")
    shards = [(r.shard,) for r in archive.write(pages, folder).collect()]
    files = spark.createDataFrame(shards, "shard long")
    records = written_for_later(archive.read(files.repartition(max(1, len(shards)), "shard"), folder), "records")
    dropped(spark, folder)
    kept = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").cast("long").alias("refers_to")).distinct()
    return records.join(kept, "refers_to_id", "left").select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "tokenfile")
    sizes = [(r.shard, r.n_tokens) for r in tokenfile.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end=2).collect()]
    found = written_for_later(tokenfile.read(spark, folder, sizes).withColumnRenamed("key", "doc_id"), "tokenfile-read")
    dropped(spark, folder)
    return found


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_covertree, op3_packing, op4_urls, op5_maintext, op6_simhash, op7_langid, op8_licences, op9_archive, op10_tokenfile, pipeline)}


OP9_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS leader, count(*) AS c FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
CASE WHEN c > 1 AND leader IS NOT NULL AND page_id IS DISTINCT FROM leader AND n >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN c > 1 AND page_id IS DISTINCT FROM leader AND n >= 1000 THEN leader END AS refers_to
FROM d LEFT JOIN g USING (digest)"""


OP2_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT id AS vec_id, min(reached) AS component_id FROM r GROUP BY id)"""
PAGE_LABELS_SQL = "SELECT page_id, quality = 0 OR toxic = 1 AS bad FROM (SELECT page_id, try_cast(regexp_extract(coalesce(regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '^[^/?#]*([^?#]*)', 1), ''), '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT) AS doc_id FROM pages) JOIN labels USING (doc_id)"


def oracle_sql() -> dict[str, str]:
    return {"op2_covertree": OP2_SQL, "op4_urls": urls.oracle(RULES, PAGE_LABELS_SQL), "op8_licences": licences.oracle(), "op9_archive": OP9_SQL}
