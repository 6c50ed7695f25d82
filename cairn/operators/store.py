"""The chunk store as tables: ids, links, soft deletes, upserts, copies and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import clean_utf8, stripped


def chunk_key(*parts: Column) -> Column:
    """A chunk's id from what it is, equal on every run."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def with_links(chunks: DataFrame, per: str = "knowledge_id", order: str = "chunk_index") -> DataFrame:
    """prev and next ids: over text chunks, or over parents only where a document has parents."""
    w = Window.partitionBy(per)
    parents = F.max((F.col("chunk_type") == "parent_text").cast("int")).over(w) == 1
    linked = chunks.withColumn("_linked", F.when(parents, F.col("chunk_type") == "parent_text").otherwise(F.col("chunk_type") == "text"))
    o = Window.partitionBy(per, "_linked").orderBy(order)
    return linked.withColumn("pre_chunk_id", F.when(F.col("_linked"), F.lag("chunk_id").over(o))).withColumn("next_chunk_id", F.when(F.col("_linked"), F.lead("chunk_id").over(o))).drop("_linked")


#: Rows that one task sums up, and buckets at most.
BUCKET_ROWS, BUCKETS = 100_000, 1000


def prefix_sums(rows: DataFrame, order: list[str], value: str, to: str) -> DataFrame:
    """rows with the sum of value over all rows before them in a unique order.

    The order is cut into buckets at sampled keys (at most BUCKETS, so the driver and each row hold few); sums within a
    bucket and over the buckets before it add up. Where the cuts fall changes no result.
    """
    key = F.struct(*order)
    n = rows.count()
    buckets = min(BUCKETS, n // BUCKET_ROWS + 1)
    bucket = F.lit(0)
    if buckets > 1:
        every = max(1, n // (buckets * 20))
        picked = rows.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(*order).orderBy(*order)
        keys = picked.withColumn("_n", F.ntile(buckets).over(Window.orderBy(*order))).groupBy("_n").agg(F.min(key).alias("k")).select("k.*").orderBy(*order).collect()
        bounds = [F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, k, strict=True)]) for k in keys[1:]]
        bucket = F.size(F.filter(F.array(*bounds), lambda b: b <= key))
    cut = rows.withColumn("_bucket", bucket)
    inner = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = cut.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    before = totals.select("_bucket", F.coalesce(F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return cut.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(before), "_bucket").withColumn(to, F.col("_inner") + F.col("_before")).drop("_bucket", "_inner", "_before")


def with_seq(chunks: DataFrame, last: int, per: list[str], order: str = "chunk_index") -> DataFrame:
    """seq_id after last: documents in order of ``per``, their chunks by index, parents before children.

    Two passes: rows are numbered within their document, and documents start where those before them end, so that no
    task sorts all chunks.
    """
    parent_first = F.when(F.col("chunk_type") == "parent_text", 0).otherwise(1)
    inner = chunks.withColumn("_i", F.row_number().over(Window.partitionBy(*per).orderBy(order, parent_first, "chunk_id")))
    sizes = chunks.groupBy(*per).count()
    before = prefix_sums(sizes, per, "count", "_offset").select(*per, F.col("_offset").alias("_before"))
    return inner.join(before, per).withColumn("seq_id", F.col("_i") + F.col("_before") + last).drop("_i", "_before")


def live(chunks: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return chunks.where(F.col(deleted).isNull())


def soft_delete(chunks: DataFrame, documents: DataFrame, at: Column, key: str = "knowledge_id") -> DataFrame:
    """Live chunks of the given documents with their time of deletion."""
    hit = documents.select(key).distinct().withColumn("_hit", F.lit(True))
    return chunks.join(hit, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_hit"), at))).drop("_hit").select(*chunks.columns)


def insert_ignore(index: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "source_type"), order: str = "ordinal") -> DataFrame:
    """index with those new rows whose key it lacks, the first of each."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return index.unionByName(first.join(index.select(*keys), list(keys), "left_anti").select(*index.columns))


def insert_stats(index: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "source_type")) -> DataFrame:
    """saved and skipped counts of insert_ignore, as one row."""
    distinct = new.select(*keys).distinct()
    saved = distinct.join(index.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("saved"))
    return new.agg(F.count("*").alias("asked")).join(saved).select("saved", (F.col("asked") - F.col("saved")).alias("skipped"))


def delete(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti").select(*index.columns)


def copy_index(index: DataFrame, moves: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows of the target chunks that moves (chunk_id, target_chunk_id, target_kb, target_knowledge) name; of several source rows the lowest id."""
    first = index.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(row_id))).where("_n = 1").drop("_n")
    j = first.join(moves, "chunk_id")
    fresh = {"chunk_id": F.col("target_chunk_id"), "source_id": F.col("target_chunk_id"), "kb_id": F.col("target_kb"), "knowledge_id": F.col("target_knowledge")}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in index.columns if c != row_id])


def update_by_chunk(index: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """column from changes (chunk_id, value) where they name the chunk."""
    c = changes.select("chunk_id", F.col("value").alias("_new"))
    return index.join(c, "chunk_id", "left").withColumn(column, F.coalesce("_new", column)).select(*index.columns)


def without_blank(chunks: DataFrame, text: str = "content") -> DataFrame:
    return chunks.where(stripped(F.col(text)) != "")


def cleaned(chunks: DataFrame, text: str = "content") -> DataFrame:
    return chunks.withColumn(text, clean_utf8(F.col(text)))


def page(chunks: DataFrame, offset: int = 0, limit: int = 100, order: tuple[str, ...] = ("chunk_index", "seq_id")) -> DataFrame:
    """A window of a listing: offset from 0, limit within 1 and 200."""
    return chunks.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def document_info(chunks: DataFrame, per: str = "knowledge_id") -> DataFrame:
    return chunks.groupBy(per).agg(F.count("*").alias("chunk_count"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"))


def base_counts(chunks: DataFrame) -> DataFrame:
    """kb_id, documents and chunks of each base."""
    return chunks.groupBy("kb_id").agg(F.countDistinct("knowledge_id").alias("documents"), F.count("*").alias("chunks"))


def storage_estimate(rows: DataFrame, text: str = "content") -> DataFrame:
    return rows.agg(F.sum(F.octet_length(text) + 200).alias("bytes"))
