"""Images of chunks: their JSON lists, and which of them a hit's range shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import image_urls, stripped
from cairn.operators.merge import image_info, slice_of

INFO = "array<map<string,string>>"
#: An inline image of Markdown.
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
IMAGE_KINDS = ("image_ocr", "image_caption")


def as_json(infos: Column) -> Column:
    """The list as JSON; empty for an empty list."""
    return F.when(F.size(infos) > 0, F.to_json(infos)).otherwise(F.lit(""))


def shown_in(content: Column, info: Column) -> Column:
    """The images of a JSON list whose url or original url the content shows."""
    urls = image_urls(content)
    kept = F.filter(F.from_json(info, INFO), lambda i: F.array_contains(urls, i["url"]) | F.coalesce(F.array_contains(urls, i["original_url"]), F.lit(False)))
    return as_json(F.coalesce(kept, F.array().cast(INFO)))


def shown_in_range(content: Column, content_start: Column, start: Column, end: Column, info: Column) -> Column:
    return shown_in(slice_of(content, content_start, start, end), info)


def joined(target: Column, source: Column) -> Column:
    """Both lists as one, each url once, the first wins; entries without a url go."""
    none = F.array().cast(INFO)
    own, more = F.coalesce(F.from_json(target, INFO), none), F.coalesce(F.from_json(source, INFO), none)
    named = F.filter(F.concat(own, more), lambda i: F.coalesce(i["url"], F.lit("")) != "")
    unique = F.aggregate(named, none, lambda kept, i: F.when(F.exists(kept, lambda k: k["url"] == i["url"]), kept).otherwise(F.concat(kept, F.array(i))))
    return F.when(F.size(more) > 0, as_json(unique)).otherwise(target)


def pruned(content: Column, content_start: Column, start: Column, end: Column) -> Column:
    """The content without images that lie outside a range of the document, and without runs of blank lines."""
    images = F.regexp_extract_all(content, F.lit(IMAGE), 0)
    texts = F.split(content, IMAGE, -1)
    # text and image in turn; an image's place is the length of all before it
    size = F.size(images)
    before = lambda i: F.length(F.array_join(F.transform(F.slice(texts, 1, i + 1), lambda x, j: F.concat(x, F.when(j < i, F.get(images, j)).otherwise(F.lit("")))), ""))
    inside = lambda i: (content_start + before(i) < end) & (content_start + before(i) + F.length(F.get(images, i)) > start)
    kept = F.array_join(F.transform(texts, lambda x, i: F.concat(x, F.when((i < size) & inside(i), F.get(images, i)).otherwise(F.lit("")))), "")
    return F.when(size > 0, stripped(F.regexp_replace(kept, r"\n{3,}", "\n\n"))).otherwise(content)


def child_infos(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """(chunk_id, image_info) of chunks with images below them: those of their own image chunks, and of their text chunks'.

    Each url once, in order of first sight; a later text that is not empty replaces an earlier one.
    """
    shown = chunks.where(F.col("chunk_type").isin(*IMAGE_KINDS) & (F.coalesce("image_info", F.lit("")) != "")).select("parent_chunk_id", "image_info", order)
    texts = chunks.where((F.col("chunk_type") == "text") & F.col("parent_chunk_id").isNotNull()).select(F.col("chunk_id").alias("_t"), F.col("parent_chunk_id").alias("_g"))
    own = shown.where("parent_chunk_id is not null").select(F.col("parent_chunk_id").alias("chunk_id"), "image_info", order)
    below = shown.join(texts, F.col("parent_chunk_id") == F.col("_t")).select(F.col("_g").alias("chunk_id"), "image_info", order)
    return image_info(own.unionByName(below), "chunk_id", "image_info", order)


def resolve_image_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits on image texts as the part of the document around them.

    The image's parent is a text chunk; the part is that chunk's range of the chunk's own parent where there is one with
    a content, or else of the chunk itself. hits: parent_chunk_id, chunk_type, content, start_at, end_at, image_info.
    """
    c = chunks.select("chunk_id", "parent_chunk_id", "chunk_type", "content", "start_at", "end_at")
    text = c.where("chunk_type = 'text' and content <> ''").select(F.col("chunk_id").alias("parent_chunk_id"), F.col("parent_chunk_id").alias("_g"), F.col("content").alias("_c"), F.col("start_at").alias("_s"), F.col("end_at").alias("_e"))
    grand = c.where("chunk_type = 'parent_text' and content <> ''").select(F.col("chunk_id").alias("_g"), F.col("content").alias("_gc"), F.col("start_at").alias("_gs"))
    j = hits.join(text, "parent_chunk_id", "left").join(grand, "_g", "left")
    cut = slice_of(F.coalesce("_gc", "_c"), F.coalesce("_gs", "_s"), F.col("_s"), F.col("_e"))
    found = F.col("chunk_type").isin(*IMAGE_KINDS) & F.col("_c").isNotNull()
    body = F.when(cut == "", F.col("_c")).otherwise(cut)
    new = {"content": F.when(found, body).otherwise(F.col("content")), "start_at": F.when(found, F.col("_s")).otherwise(F.col("start_at")), "end_at": F.when(found, F.col("_e")).otherwise(F.col("end_at"))}
    if "image_info" in hits.columns:
        new["image_info"] = F.when(found, shown_in(body, F.col("image_info"))).otherwise(F.col("image_info"))
    return j.select(*[new.get(x, F.col(x)).alias(x) for x in hits.columns])
