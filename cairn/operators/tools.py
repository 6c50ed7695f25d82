"""Tool queries over the chunk store: regex search with its reports, listings, and multi-query search."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import regex_snippet
from cairn.operators.merge import dedup_sequential
from cairn.operators.rerank import mmr

#: Rows fetched, returned and diversified above, documents reported.
FETCH, RETURN, DIVERSE, DOCUMENTS = 500, 30, 10, 20


def checked(pattern: str) -> str:
    """The pattern for Spark, without regard to case, over lines, by Unicode classes; ValueError if the executors' engine refuses it."""
    ready = f"(?imU){pattern}"
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(ready)
    except (IllegalArgumentException, Py4JJavaError) as e:
        raise ValueError(f"invalid pattern: {e}") from e
    return ready


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of any target of scope (tenant_id, kb_id, knowledge_id; a null knowledge_id means the whole base)."""
    s = scope.select(F.col("tenant_id").alias("_t"), F.col("kb_id").alias("_k"), F.col("knowledge_id").alias("_d"))
    return rows.join(s, (rows["tenant_id"] == s["_t"]) & (rows["kb_id"] == s["_k"]) & (s["_d"].isNull() | (rows["knowledge_id"] == s["_d"])), "left_semi")


def narrowed(scope: DataFrame, wanted: list[str], column: str = "knowledge_id") -> DataFrame:
    """A caller may ask for part of the scope and never for more."""
    return scope.where(F.col(column).isin(wanted)) if wanted else scope


def match_score(content: Column, title: Column, patterns: list[str]) -> tuple[Column, Column, Column]:
    """score, patterns matched and title match: the share of patterns found and up to .1 for an early place, at most 1."""
    hit = [content.rlike(p) for p in patterns]
    found = sum((h.cast("int") for h in hit), F.lit(0))
    before = [F.when(h, F.length(F.element_at(F.split(content, p, 2), 1))) for h, p in zip(hit, patterns, strict=True)]
    early = F.least(*before) if len(before) > 1 else before[0]
    own = F.when(found > 0, F.least(found / len(patterns) + F.when(early < F.length(content), 0.1 * (1 - early / F.length(content))).otherwise(0.0), F.lit(1.0))).otherwise(F.lit(0.0))
    in_title = F.coalesce(F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.rlike(title, p)), F.lit(False))
    return F.when(in_title, F.least(own + 0.5, F.lit(1.0))).otherwise(own), F.when(in_title & (found == 0), 1).otherwise(found), in_title


def matches(chunks: DataFrame, patterns: list[str], titles: DataFrame | None = None, fetch: int = FETCH) -> DataFrame:
    """Enabled live chunks whose text or title matches any pattern, the newest ``fetch``: score, matched, title_match, total_chunks."""
    ready = [checked(p) for p in patterns]
    rows = chunks.where(F.col("is_enabled") & F.col("deleted_at").isNull())
    totals = rows.groupBy("tenant_id", "kb_id", "knowledge_id").agg(F.count("*").alias("total_chunks"))
    named = rows.join(titles, "knowledge_id", "left") if titles is not None else rows.withColumn("title", F.lit(None).cast("string"))
    title = F.coalesce("title", F.lit(""))
    any_of = lambda c: F.array_contains(F.array(*[c.rlike(p) for p in ready]), True)
    newest = named.where(any_of(F.col("content")) | any_of(title)).orderBy(F.desc("created_at"), F.desc("seq_id")).limit(fetch)
    score, matched, in_title = match_score(F.col("content"), title, ready)
    return newest.withColumn("score", score).withColumn("matched", matched.cast("int")).withColumn("title_match", in_title).join(totals, ["tenant_id", "kb_id", "knowledge_id"], "left")


def grep(chunks: DataFrame, patterns: list[str], titles: DataFrame | None = None) -> DataFrame:
    """matches without repeated chunks and texts, made diverse if they are many, best first, at most RETURN."""
    order = [F.desc("title_match"), F.desc("matched"), F.desc("score"), F.asc("chunk_index"), F.asc("chunk_id")]
    found = matches(chunks, patterns, titles).withColumn("query_id", F.lit("grep")).withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("seq_id"))))
    unique = dedup_sequential(found, ids=("chunk_id",))
    if unique.limit(DIVERSE + 1).count() > DIVERSE:
        unique = mmr(unique, RETURN, swap=True).drop("mmr_rank")
    return unique.drop("query_id", "ordinal").orderBy(*order).limit(RETURN)


def grep_documents(found: DataFrame, patterns: list[str]) -> DataFrame:
    """Per document of the matches: title, hits, title match, hits of each pattern and of all, patterns met, best score,
    the newest chunk's first snippet and question; at most DOCUMENTS."""
    ready = [checked(p) for p in patterns]
    counts = [F.sum(F.regexp_count("content", F.lit(p))).alias(f"hits_{i}") for i, p in enumerate(ready)]
    newest = F.struct("created_at", "seq_id")
    said = regex_snippet(F.col("content"), ready)
    question = F.get_json_object("metadata", "$.standard_question") if "metadata" in found.columns else F.lit(None).cast("string")
    by = found.withColumn("_snippet", F.nullif(said, F.lit(""))).withColumn("_question", F.nullif(question, F.lit(""))).groupBy("tenant_id", "kb_id", "knowledge_id").agg(
        F.max(F.coalesce(F.trim("title"), F.lit(""))).alias("title"), F.count("*").alias("chunk_hits"), F.max("title_match").alias("title_match"), F.max("score").alias("score"), F.max("total_chunks").alias("total_chunks"),
        F.max_by("_snippet", F.when(F.col("_snippet").isNotNull(), newest)).alias("snippet"), F.max_by("_question", F.when(F.col("_question").isNotNull(), newest)).alias("faq_question"), *counts,
    )
    each = [F.col(f"hits_{i}") for i in range(len(patterns))]
    met, total = sum(((c > 0).cast("int") for c in each), F.lit(0)), sum(each, F.lit(0))
    named = by.withColumn("title", F.when(F.col("title") == "", F.lit("Untitled")).otherwise(F.col("title"))).withColumn("distinct_patterns", met).withColumn("total_hits", total)
    return named.orderBy(F.desc("title_match"), F.desc("distinct_patterns"), F.desc("total_hits"), F.desc("chunk_hits"), "title", "knowledge_id", "kb_id").limit(DOCUMENTS)


def knowledge_search(hits: DataFrame, k: int = 5) -> DataFrame:
    """Hits of all queries of a request as one list: unique by chunk, parent, place and text, best first, k in all.

    hits: request_id, chunk_id, parent_chunk_id, knowledge_id, chunk_index, content, score, ordinal.
    """
    place = F.concat_ws("#", "knowledge_id", "chunk_index")
    keyed = hits.withColumn("_place", place)
    unique = dedup_sequential(keyed, "request_id", ("chunk_id", "parent_chunk_id", "_place")).drop("_place")
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "knowledge_id", "chunk_id")
    return unique.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
