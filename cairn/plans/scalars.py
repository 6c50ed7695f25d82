"""Scalar and text function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import clients, images, merge, pages, rerank, store
from cairn.plans.registry import Tables, query
from cairn.plans.search import norm_sql, tokens_sql
from cairn.sources import documents as sources


@query(f"SELECT doc_id, CASE WHEN {norm_sql('text')} = '' THEN '' ELSE md5({norm_sql('text')}) END AS signature FROM documents")
def content_signature(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.signature(F.col("text")).alias("signature"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, md5({norm_sql('text')})")
def dedup_by_signature(t: Tables) -> DataFrame:
    return merge.first_by_signature(t.documents, ["lang"], "text", "doc_id").select("doc_id")


@query(f"SELECT doc_id, len({tokens_sql('text')})::INTEGER AS n_tokens FROM documents")
def token_set_size(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.token_set(F.col("text"))).alias("n_tokens"))


@query("SELECT doc_id, list_transform(range(1, 4 + doc_id % 3), lambda i: substr('中国人民大学生', i, 2)) || [source] AS terms FROM documents")
def cjk_terms(t: Tables) -> DataFrame:
    text = F.concat(F.substring(F.lit("中国人民大学生"), F.lit(1), (4 + F.col("doc_id") % 3).cast("int")), F.lit("，"), F.col("source"))
    return t.documents.select("doc_id", T.cjk_terms(text).alias("terms"))


def clean_sql(x: str) -> str:
    step = lambda x, a, b: f"regexp_replace({x}, '{a}', '{b.replace('$', chr(92))}', 'g')".replace(chr(10), "' || chr(10) || '")
    for a, b in T.CLEAN:
        x = step(x, a, b)
    row = r"array_to_string(list_filter(list_transform(string_split(regexp_extract(l, '^[ \t]*\|(.+?)\|[ \t]*$', 1), '|'), lambda c: trim(c, ' ')), lambda c: c <> ''), ', ')"
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^[ \\t]*\\|.+?\\|[ \\t]*$') THEN {row} ELSE l END), chr(10))"
    for a, b in T.CLEAN_LAST:
        x = step(x, a, b)
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, md5({clean_sql('html')}) AS digest, length({clean_sql('html')})::INTEGER AS n FROM pages")
def clean_passage_html(t: Tables) -> DataFrame:
    c = t.pages.select("page_id", T.clean_passage(F.col("html")).alias("c"))
    return c.select("page_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


@query(r"""SELECT doc_id, md5(substr(regexp_replace(text, '(?i)tion', 'x', 'g') || '[image] and [image]', 1, 20000)) AS digest FROM documents""")
def sanitize_base64(t: Tables) -> DataFrame:
    text = F.concat(F.regexp_replace("text", "(?i)tion", "x"), F.lit('<img alt="a" src="data:image/png;base64,' + "A" * 230 + '"> and ![b](data:image/gif;base64,' + "B" * 10 + ")"))
    return t.documents.select("doc_id", F.md5(T.sanitised_for_embedding(text)).alias("digest"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.xml_escape(F.col("html")).alias("escaped"))


@query("SELECT doc_id, CASE WHEN s >= 0.8 THEN 'High Relevance' WHEN s >= 0.6 THEN 'Medium Relevance' WHEN s >= 0.4 THEN 'Low Relevance' ELSE 'Weak Relevance' END AS level, CASE doc_id % 9 WHEN 0 THEN 'Vector Match' WHEN 1 THEN 'Keyword Match' WHEN 2 THEN 'Adjacent Chunk Match' WHEN 3 THEN 'History Match' WHEN 4 THEN 'Parent Chunk Match' WHEN 5 THEN 'Relation Chunk Match' WHEN 6 THEN 'Graph Match' ELSE 'Unknown Type(' || (doc_id % 9) || ')' END AS kind FROM (SELECT doc_id, (n_chars % 100) / 100 AS s FROM documents)")
def relevance_labels(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.relevance_level((F.col("n_chars") % 100) / 100).alias("level"), T.match_type_name((F.col("doc_id") % 9).cast("int")).alias("kind"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 47) || '...' END AS short,
md5(CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 700) || chr(10) || chr(10) || '... [output truncated: ' || length(text) || ' → 1200 chars, showing first 700 + last 300] ...' || chr(10) || chr(10) || right(text, 300) END) AS digest FROM documents""")
def truncation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncated(F.col("text"), 50).alias("short"), F.md5(T.head_and_tail(F.col("text"), 1200)).alias("digest"))


@query("SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.2f', s / 1024) || ' KB' WHEN s < 1073741824 THEN printf('%.2f', s / 1048576) || ' MB' ELSE printf('%.2f', s / 1073741824) || ' GB' END AS size FROM (SELECT doc_id, n_chars * n_chars AS s FROM documents)")
def file_sizes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.file_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query(r"SELECT doc_id, CASE WHEN length(l) <= 60 THEN l ELSE trim(substr(l, 1, 60), ' ') || '...' END AS line FROM (SELECT doc_id, regexp_replace(replace(trim(text, ' '), chr(10), ' '), '\s+', ' ', 'g') AS l FROM documents)")
def summaries(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.summary(F.col("text"), 60).alias("line"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents), p AS (SELECT *, strpos(lower(body), 'the') AS a, strpos(lower(body), 'tion') AS c, strpos(lower(body), 'lich') AS d FROM b),
e AS (SELECT *, list_min(list_filter([a, c, d], lambda x: x > 0)) AS pos FROM p), f AS (SELECT *, CASE pos WHEN a THEN 3 ELSE 4 END AS n, greatest(pos - 40, 1) AS s FROM e)
SELECT doc_id, CASE WHEN pos IS NOT NULL THEN '... ' || regexp_replace(regexp_replace(replace(substr(body, s, pos - s + n + 40), chr(10), ' '), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') || ' ...'
 WHEN length(body) > 80 THEN regexp_replace(substr(body, 1, 80), '^\s+|\s+$', '', 'g') || ' ...' ELSE body END AS snippet FROM f""")
def snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.snippet(F.col("text"), T.query_words(F.lit("The tion, lich")), 40).alias("snippet"))


@query("SELECT doc_id, source || chr(10) || '# ' || lang || chr(10) || chr(10) || trim(text, ' ') AS text FROM documents")
def embedding_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.embedding_text(F.col("source"), F.concat(F.lit("# "), "lang"), F.col("text")).alias("text"))


@query("SELECT doc_id, 'Q: ' || source || chr(10) || 'Answer:' || chr(10) || '- ' || lang || chr(10) || '- ' || n_chars AS answer FROM documents")
def faq_answers(t: Tables) -> DataFrame:
    meta = F.to_json(F.struct(F.col("source").alias("standard_question"), F.array("lang", F.col("n_chars").cast("string")).alias("answers")))
    return t.documents.select("doc_id", merge.faq_answer(meta).alias("answer"))


@query("""WITH i AS (SELECT source, doc_id, 'u' || (doc_id % 3) AS url, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS caption FROM documents),
one AS (SELECT source, url, min(doc_id) AS first, coalesce(max_by(caption, doc_id) FILTER (WHERE caption <> ''), '-') AS caption FROM i GROUP BY ALL) SELECT source, string_agg(url || '=' || caption, ',' ORDER BY first) AS images FROM one GROUP BY source""")
def image_info(t: Tables) -> DataFrame:
    info = F.to_json(F.array(F.struct(F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string")).alias("url"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("caption"), F.lit("").alias("ocr_text"))))
    rows = merge.image_info(t.documents.select("source", "doc_id", info.alias("info")), "source", "info", "doc_id")
    parsed = F.from_json("image_info", "array<struct<url: string, caption: string>>")
    return rows.select("source", F.array_join(F.transform(parsed, lambda x: F.concat(x["url"], F.lit("="), F.coalesce(x["caption"], F.lit("-")))), ",").alias("images"))


@query(f"SELECT doc_id, {tokens_sql('lower(source)')} AS tokens, regexp_extract_all(lower(source), '[a-z0-9]+') AS terms FROM documents")
def local_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_set(F.col("source")).alias("tokens"), rerank.local_terms(F.col("source")).alias("terms"))


@query("SELECT doc_id, CASE WHEN r >= 2.0 THEN 1 WHEN r >= 1.6 THEN 2 WHEN r >= 1.35 THEN 3 ELSE 0 END AS level FROM (SELECT doc_id, (n_chars % 30) / 12.0 AS r FROM documents)")
def heading_levels(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", pages.heading_level(F.col("n_chars") % 30, F.lit(12.0)).alias("level"))


@query("SELECT source, median(n_chars) AS median_height, median(doc_id) AS median_width FROM documents GROUP BY source")
def median_heights(t: Tables) -> DataFrame:
    return pages.median_heights(t.documents.select("source", F.col("n_chars").alias("height"), F.col("doc_id").alias("width")), ["source"])


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' END AS kind FROM pages")
def file_kinds(t: Tables) -> DataFrame:
    name = F.concat(F.lit("a/b."), F.element_at(F.array(F.lit("MD"), F.lit("docx"), F.lit("pdf"), F.lit("exe")), (F.col("page_id") % 4 + 1).cast("int")))
    return t.pages.select("page_id", sources.kind_of(name).alias("kind"))


@query("SELECT doc_id, md5('| a | ' || source || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | x |' || chr(10) || 'end') AS digest FROM documents")
def markdown_tables(t: Tables) -> DataFrame:
    text = F.concat(F.lit("|a |  "), "source", F.lit("|\n|"), "lang", F.lit("|x|\nend"))
    return t.documents.select("doc_id", F.md5(sources.with_tables(text)).alias("digest"))


@query("SELECT doc_id, '![' || lang || '](images/' || md5('AAA') || '.png) and ' || source AS text FROM documents")
def inline_images(t: Tables) -> DataFrame:
    text = F.concat(F.lit("!["), "lang", F.lit("](data:image/png;base64,QUFB) and "), "source")
    return t.documents.select("doc_id", sources.image_paths(text).alias("text"))


@query("SELECT doc_id, lang || ' ' || source AS text FROM documents")
def decoded_bytes(t: Tables) -> DataFrame:
    """Text through bytes with a NUL, decoded and cleaned."""
    raw = F.encode(F.concat("lang", F.lit("\0 "), "source"), "UTF-8")
    return t.documents.select("doc_id", T.clean_utf8(sources.decoded(raw)).alias("text"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([^a-zA-Z0-9.,)>]) +([^ ])', '\1\2', 'g'), '([^ ]) +([^a-zA-Z0-9.,(<])', '\1\2', 'g')) AS digest FROM documents")
def closed_up(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.closed_up(F.col("text"))).alias("digest"))


@query("SELECT event_type, greatest(coalesce(max(CASE WHEN line <> 'nan' THEN line END), ''), '1970-01-01 00:00:00') AS latest, greatest(coalesce(max(event_id), 0), 0) AS number FROM (SELECT event_type, event_id, CASE WHEN event_id % 3 = 0 THEN 'nan' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS line FROM events) GROUP BY event_type")
def newest_lines(t: Tables) -> DataFrame:
    line = F.when(F.col("event_id") % 3 == 0, "nan").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.groupBy("event_type").agg(T.newest(line).alias("latest"), T.newest(F.col("event_id").cast("string"), number=True).alias("number"))


@query("SELECT event_type AS tool, count(*) AS runs, sum((user_id % 3 = 0)::INT)::BIGINT AS failures FROM events GROUP BY event_type")
def tool_counts(t: Tables) -> DataFrame:
    return clients.tool_counts(t.events.select(F.col("event_type").alias("tool"), (F.col("user_id") % 3 != 0).alias("success")))


@query("SELECT lang AS kb_id, count(DISTINCT source) AS documents, count(*) AS chunks FROM documents GROUP BY lang")
def kb_counts(t: Tables) -> DataFrame:
    return store.base_counts(t.documents.select(F.col("lang").alias("kb_id"), F.col("source").alias("knowledge_id")))


@query("""WITH c AS (SELECT doc_id, source, doc_id - CASE doc_id % 4 WHEN 3 THEN 3 ELSE 1 END AS parent FROM documents), t AS (SELECT parent AS target, doc_id, source FROM c WHERE doc_id % 4 IN (2, 3) UNION ALL
 SELECT x.parent, c.doc_id, c.source FROM c JOIN c x ON x.doc_id = c.parent AND x.doc_id % 4 = 1 WHERE c.doc_id % 4 = 2),
u AS (SELECT target, 'u' || (doc_id % 5) AS url, min(doc_id) AS first, arg_max(source, doc_id) AS caption FROM t GROUP BY ALL) SELECT target::VARCHAR AS chunk_id, string_agg(url || '=' || caption, ',' ORDER BY first) AS shown FROM u GROUP BY target""")
def child_images(t: Tables) -> DataFrame:
    """Every fourth document is a parent, the next its text, then the text's image and the parent's."""
    kind = F.when(F.col("doc_id") % 4 == 0, "parent_text").when(F.col("doc_id") % 4 == 1, "text").when(F.col("doc_id") % 4 == 2, "image_ocr").otherwise("image_caption")
    parent = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") - F.when(F.col("doc_id") % 4 == 3, 3).otherwise(1))
    info = F.to_json(F.array(F.struct(F.concat(F.lit("u"), (F.col("doc_id") % 5).cast("string")).alias("url"), F.col("source").alias("caption"), F.lit("").alias("ocr_text"))))
    chunks = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), parent.cast("string").alias("parent_chunk_id"), kind.alias("chunk_type"), info.alias("image_info"), F.col("doc_id").alias("chunk_index"))
    parsed = F.from_json("image_info", "array<struct<url: string, caption: string>>")
    return images.child_infos(chunks).select("chunk_id", F.array_join(F.transform(parsed, lambda x: F.concat(x["url"], F.lit("="), x["caption"])), ",").alias("shown"))
