"""Chunk queries: splitting, profiles, the chunk store, intervals, and page operators; a document's lines serve as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import chunking, merge, pages, store
from cairn.plans.registry import Tables, query

LINES = """raw AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents),
lc AS (SELECT doc_id AS knowledge_id, source AS kb_id, lang AS tag_id, i - 1 AS chunk_index, parts[i] AS content, doc_id || '-' || (i - 1) AS chunk_id,
 (CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(parts[1:i-1], chr(10))) + 1 END)::BIGINT AS start_at FROM raw, unnest(range(1, len(parts) + 1)) AS u(i)),
ch AS (SELECT *, start_at + length(content) AS end_at FROM lc)"""


def line_chunks(t: Tables) -> DataFrame:
    """knowledge_id, kb_id, tag_id, chunk_index, content, chunk_id, start_at, end_at, chunk_type, seq_id-free."""
    d = t.documents.select(F.col("doc_id").alias("knowledge_id"), F.col("source").alias("kb_id"), F.col("lang").alias("tag_id"), F.posexplode(F.split("text", "\n")).alias("n", "content"))
    size = F.length("content")
    before = F.coalesce(F.sum(size + 1).over(Window.partitionBy("knowledge_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.select("knowledge_id", "kb_id", "tag_id", F.col("n").cast("long").alias("chunk_index"), "content", F.concat_ws("-", "knowledge_id", "n").alias("chunk_id"), before.cast("long").alias("start_at"), (before + size).cast("long").alias("end_at"), F.lit("text").alias("chunk_type"))


@query(f"WITH {LINES} SELECT chunk_id, start_at, end_at, substr(text, (start_at + 1)::BIGINT, (end_at - start_at)::BIGINT) = content AS exact FROM ch JOIN documents ON doc_id = knowledge_id")
def chunk_offsets(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("knowledge_id"), "text")
    c = line_chunks(t).join(docs, "knowledge_id")
    return c.select("chunk_id", "start_at", "end_at", (F.substring("text", (F.col("start_at") + 1).cast("int"), (F.col("end_at") - F.col("start_at")).cast("int")) == F.col("content")).alias("exact"))


@query(f"WITH {LINES} SELECT chunk_id, lag(chunk_id) OVER w AS pre_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM ch WINDOW w AS (PARTITION BY knowledge_id ORDER BY chunk_index)")
def prev_next_links(t: Tables) -> DataFrame:
    return store.with_links(line_chunks(t)).select("chunk_id", "pre_chunk_id", "next_chunk_id")


@query(f"WITH {LINES} SELECT chunk_id, 100 + row_number() OVER (ORDER BY knowledge_id, chunk_index) AS seq_id FROM ch")
def seq_ids(t: Tables) -> DataFrame:
    return store.with_seq(line_chunks(t), 100, ["knowledge_id"]).select("chunk_id", "seq_id")


@query(f"WITH {LINES} SELECT kb_id, max(chunk_index) AS max_index FROM ch GROUP BY kb_id")
def max_seq(t: Tables) -> DataFrame:
    return line_chunks(t).groupBy("kb_id").agg(F.max("chunk_index").alias("max_index"))


@query(f"WITH {LINES} SELECT kb_id, count(*) AS live FROM ch WHERE knowledge_id % 10 <> 3 GROUP BY kb_id")
def soft_delete_live(t: Tables) -> DataFrame:
    c = line_chunks(t).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    gone = t.documents.where("doc_id % 10 = 3").select(F.col("doc_id").alias("knowledge_id"))
    return store.live(store.soft_delete(c, gone, F.lit("2024-01-01 00:00:00").cast("timestamp"))).groupBy("kb_id").agg(F.count("*").alias("live"))


INDEX = f"{LINES}, ix AS (SELECT chunk_id AS source_id, chunk_index % 2 AS source_type, chunk_id, knowledge_id, kb_id, tag_id, content, start_at FROM ch)"


def index_rows(t: Tables) -> DataFrame:
    return line_chunks(t).select(F.col("chunk_id").alias("source_id"), (F.col("chunk_index") % 2).alias("source_type"), "chunk_id", "knowledge_id", "kb_id", "tag_id", "content", "start_at")


@query(f"WITH {INDEX} SELECT kb_id, count(*) AS n_rows, sum(length(content))::BIGINT AS chars FROM ix GROUP BY kb_id")
def upsert_ignore(t: Tables) -> DataFrame:
    """Half of the rows are there; all are offered twice, the second time with another content."""
    ix = index_rows(t)
    new = ix.withColumn("ordinal", F.lit(1)).unionByName(ix.withColumn("content", F.lit("again")).withColumn("ordinal", F.lit(2)))
    done = store.insert_ignore(ix.where("knowledge_id % 2 = 0"), new)
    return done.groupBy("kb_id").agg(F.count("*").alias("n_rows"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {INDEX} SELECT (SELECT count(*) FROM ix WHERE knowledge_id % 2 = 1) AS saved, (SELECT count(*) FROM ix) + (SELECT count(*) FROM ix WHERE knowledge_id % 2 = 0) AS skipped")
def insert_stats(t: Tables) -> DataFrame:
    ix = index_rows(t)
    return store.insert_stats(ix.where("knowledge_id % 2 = 0"), ix.unionByName(ix))


@query(f"WITH {INDEX} SELECT kb_id, count(*) AS n_rows FROM ix WHERE knowledge_id % 4 <> 1 GROUP BY kb_id")
def delete_by_knowledge(t: Tables) -> DataFrame:
    gone = t.documents.where("doc_id % 4 = 1").select(F.col("doc_id").alias("knowledge_id"))
    return store.delete(index_rows(t), gone, "knowledge_id").groupBy("kb_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {INDEX} SELECT chunk_id || '-copy' AS chunk_id, 'kb2' AS kb_id, knowledge_id + 1000000 AS knowledge_id, content FROM ix WHERE knowledge_id % 5 = 0")
def copy_indices(t: Tables) -> DataFrame:
    ix = index_rows(t)
    twice = ix.withColumn("row_id", F.lit(1)).unionByName(ix.withColumn("content", F.lit("late")).withColumn("row_id", F.lit(2)))
    moves = ix.where("knowledge_id % 5 = 0").select("chunk_id", F.concat("chunk_id", F.lit("-copy")).alias("target_chunk_id"), F.lit("kb2").alias("target_kb"), (F.col("knowledge_id") + 1000000).alias("target_knowledge"))
    return store.copy_index(twice, moves).select("chunk_id", "kb_id", "knowledge_id", "content")


@query(f"WITH {INDEX} SELECT kb_id, CASE WHEN knowledge_id % 6 = 0 THEN 'moved' ELSE tag_id END AS tag_id, count(*) AS n_rows FROM ix GROUP BY ALL")
def update_tags(t: Tables) -> DataFrame:
    ix = index_rows(t)
    changes = ix.where("knowledge_id % 6 = 0").select("chunk_id", F.lit("moved").alias("value"))
    return store.update_by_chunk(ix, changes, "tag_id").groupBy("kb_id", "tag_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {INDEX} SELECT kb_id, count(*) AS n_rows FROM ix WHERE knowledge_id % 3 <> 0 GROUP BY kb_id")
def enabled_filter(t: Tables) -> DataFrame:
    from cairn.operators.retrieval import enabled

    flag = F.when(F.col("knowledge_id") % 3 == 0, F.lit(False)).when(F.col("knowledge_id") % 3 == 1, F.lit(True))
    return enabled(index_rows(t).withColumn("is_enabled", flag)).groupBy("kb_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {INDEX} SELECT kb_id, tag_id, count(*) AS n_rows FROM ix WHERE kb_id IN ('src1', 'src2') AND tag_id IN ('en', 'fr') AND knowledge_id NOT IN (1, 2, 22) AND chunk_id NOT IN ('21-0', '41-1') GROUP BY ALL")
def metadata_filters(t: Tables) -> DataFrame:
    from cairn.operators.retrieval import scoped

    rows = scoped(index_rows(t), in_kb=["src1", "src2"], in_tag=["en", "fr"], not_knowledge=[1, 2, 22], not_chunk=["21-0", "41-1"])
    return rows.groupBy("kb_id", "tag_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {LINES} SELECT kb_id, count(*) AS n_rows FROM ch WHERE regexp_matches(content, '[^ ]') GROUP BY kb_id")
def blank_filter(t: Tables) -> DataFrame:
    return store.without_blank(line_chunks(t)).groupBy("kb_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {LINES} SELECT kb_id, sum(octet_length(encode(content)) + 200)::BIGINT AS bytes FROM ch GROUP BY kb_id")
def storage_estimate(t: Tables) -> DataFrame:
    from cairn.functions.text import storage_size

    return line_chunks(t).groupBy("kb_id").agg(F.sum(storage_size(F.col("content"))).cast("long").alias("bytes"))


@query(f"WITH {LINES} SELECT knowledge_id, count(*) AS chunk_count, min(chunk_index) AS first_index, max(chunk_index) AS last_index FROM ch GROUP BY knowledge_id")
def document_info(t: Tables) -> DataFrame:
    return store.document_info(line_chunks(t))


@query(f"WITH {LINES} SELECT chunk_id FROM ch ORDER BY knowledge_id, chunk_index LIMIT 50 OFFSET 120")
def list_offset_limit(t: Tables) -> DataFrame:
    return store.page(line_chunks(t), 120, 50, ("knowledge_id", "chunk_index")).select("chunk_id")


@query(f"""WITH {LINES}, o AS (SELECT knowledge_id, greatest(0, start_at - 10) AS s, end_at AS e FROM ch WHERE chunk_index % 3 <> 1),
r AS (SELECT *, max(e) OVER (PARTITION BY knowledge_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY knowledge_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT knowledge_id, island::BIGINT AS island, min(s) AS start_at, max(e) AS end_at, count(*) AS n FROM i GROUP BY knowledge_id, island""")
def interval_islands(t: Tables) -> DataFrame:
    spans = line_chunks(t).where("chunk_index % 3 <> 1").withColumn("start_at", F.greatest(F.lit(0), F.col("start_at") - 10))
    return merge.islands(spans, ["knowledge_id"]).groupBy("knowledge_id", "island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.count("*").alias("n"))


@query(f"""WITH {LINES} SELECT c.chunk_id, CASE WHEN p.chunk_id IS NULL THEN c.content ELSE p.content END AS content, CASE WHEN p.chunk_id IS NULL THEN c.start_at ELSE p.start_at END AS start_at
FROM ch c LEFT JOIN ch p ON p.chunk_id = c.knowledge_id || '-' || (c.chunk_index - 1) AND c.chunk_index % 2 = 1""")
def parent_resolve(t: Tables) -> DataFrame:
    c = line_chunks(t)
    parent = F.when(F.col("chunk_index") % 2 == 1, F.concat_ws("-", "knowledge_id", F.col("chunk_index") - 1))
    return merge.resolve_parents(c.withColumn("parent_chunk_id", parent), c).select("chunk_id", "content", "start_at")


@query(f"WITH {LINES} SELECT chunk_id, CASE WHEN greatest(20 - start_at, 0) < least(120 - start_at, length(content)) THEN substr(content, (greatest(20 - start_at, 0) + 1)::BIGINT, (least(120 - start_at, length(content)) - greatest(20 - start_at, 0))::BIGINT) ELSE '' END AS part FROM ch")
def range_slice(t: Tables) -> DataFrame:
    c = line_chunks(t)
    return c.select("chunk_id", merge.slice_of(F.col("content"), F.col("start_at").cast("int"), F.lit(20), F.lit(120)).alias("part"))


#: b after a without the longest end of a that b starts with, in DuckDB's SQL.
JOINED = "({a} || substr({b}, 1 + coalesce(list_max(list_filter(range(0, (least(length({a}), length({b})) + 1)::BIGINT), lambda k: right({a}, k) = left({b}, k))), 0)::BIGINT))"


def joined_sql(a: str, b: str) -> str:
    return JOINED.format(a=a, b=b)


@query(f"""WITH RECURSIVE {LINES}, pl AS (SELECT knowledge_id, chunk_id, content, start_at, end_at, row_number() OVER (PARTITION BY knowledge_id ORDER BY chunk_index) AS n, chunk_index FROM ch),
lst AS (SELECT knowledge_id, list(content ORDER BY n) AS c, count(*) AS top FROM pl GROUP BY knowledge_id),
h0 AS (SELECT chunk_id, knowledge_id, content AS base, start_at, n, n - 1 AS p, n + 1 AS f, CASE WHEN n > 1 THEN c[n - 1] ELSE '' END AS w, CASE WHEN n < top THEN c[n + 1] ELSE '' END AS y, top FROM pl JOIN lst USING (knowledge_id) WHERE chunk_index % 4 = 0 AND length(content) BETWEEN 1 AND 349),
h AS (SELECT chunk_id, knowledge_id, base, start_at, p, f, w, y, top, length(m) AS size, m, 0 AS step FROM (SELECT *, substr({joined_sql(joined_sql('w', 'base'), 'y')}, 1, 850) AS m FROM h0)
 UNION ALL SELECT chunk_id, knowledge_id, base, start_at, p2, f2, w2, y2, top, length(m), m, step + 1 FROM (SELECT *, substr({joined_sql(joined_sql('w2', 'base'), 'y2')}, 1, 850) AS m FROM
  (SELECT *, CASE WHEN length(m1) < 350 AND f < top THEN {joined_sql('y', 'c[f + 1]')} ELSE y END AS y2, CASE WHEN length(m1) < 350 AND f < top THEN f + 1 ELSE f END AS f2 FROM
   (SELECT *, substr({joined_sql(joined_sql('w2', 'base'), 'y')}, 1, 850) AS m1 FROM
    (SELECT h.* EXCLUDE (size, m), c, CASE WHEN p > 1 THEN {joined_sql('c[p - 1]', 'w')} ELSE w END AS w2, CASE WHEN p > 1 THEN p - 1 ELSE p END AS p2 FROM h JOIN lst USING (knowledge_id) WHERE h.size < 350 AND (p > 1 OR f < h.top)))))),
e AS (SELECT chunk_id, m, w, start_at FROM h QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY step DESC) = 1),
o AS (SELECT ch.chunk_id, coalesce(m, content) AS content, CASE WHEN w <> '' THEN greatest(e.start_at - length(w), 0) ELSE ch.start_at END AS start_at, m, ch.end_at AS old FROM ch LEFT JOIN e USING (chunk_id) WHERE chunk_index % 4 = 0)
SELECT chunk_id, content, start_at::BIGINT AS start_at, (CASE WHEN m IS NULL THEN old ELSE start_at + length(m) END)::BIGINT AS end_at FROM o""")
def neighbor_expand(t: Tables) -> DataFrame:
    c = line_chunks(t)
    return merge.expand_neighbours(c.where("chunk_index % 4 = 0"), c).select("chunk_id", "content", F.col("start_at").cast("long").alias("start_at"), F.col("end_at").cast("long").alias("end_at"))


@query(f"""WITH {LINES}, r AS (SELECT (knowledge_id % 16)::VARCHAR AS query_id, knowledge_id, chunk_id, greatest(0, start_at - 1) AS s, end_at AS e, 1 / (chunk_index + 1) AS score, chunk_index, content FROM ch),
g AS (SELECT *, max(e) OVER (PARTITION BY knowledge_id ORDER BY s, e, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY knowledge_id ORDER BY s, e, chunk_index ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT query_id, knowledge_id::VARCHAR AS knowledge_id, arg_min(chunk_id, chunk_index) AS chunk_id, min(s)::INTEGER AS start_at, max(e)::INTEGER AS end_at, (count(*) - 1)::INTEGER AS taken, max(score) AS score FROM i GROUP BY query_id, knowledge_id, island""")
def merge_overlaps(t: Tables) -> DataFrame:
    rows = line_chunks(t).select((F.col("knowledge_id") % 16).cast("string").alias("query_id"), F.col("knowledge_id").cast("string").alias("knowledge_id"), "chunk_type", "chunk_id", F.greatest(F.lit(0), F.col("start_at") - 1).cast("int").alias("start_at"), F.col("end_at").cast("int").alias("end_at"), "content", (1 / (F.col("chunk_index") + 1)).alias("score"), F.col("chunk_index").alias("ordinal"))
    return merge.merge_overlaps(rows).select("query_id", "knowledge_id", "chunk_id", "start_at", "end_at", F.size("sub_chunk_ids").alias("taken"), "score")


def markdown(t: Tables) -> DataFrame:
    """Documents as Markdown: a title, and every seventh line a heading, every fifth numbered, by their numbers."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x, i: F.when(i % 7 == 3, F.concat(F.repeat(F.lit("#"), (i % 3 + 2).cast("int")), F.lit(" "), F.substring(x, 1, 20))).when(i % 11 == 5, F.concat(i.cast("string"), F.lit(". "), x)).otherwise(x))
    return t.documents.select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.array_join(marked, "\n")).alias("text"))


MARKDOWN = """md AS (SELECT doc_id, '# ' || source || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, n: CASE WHEN (n - 1) % 7 = 3 THEN repeat('#', ((n - 1) % 3 + 2)::INT) || ' ' || substr(x, 1, 20)
 WHEN (n - 1) % 11 = 5 THEN (n - 1)::VARCHAR || '. ' || x ELSE x END), chr(10)) AS text FROM documents),
ml AS (SELECT doc_id, i AS n, parts[i] AS line, trim(parts[i], ' ') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM md), unnest(range(1, len(parts) + 1)) AS u(i))"""
PROFILE = (
    MARKDOWN
    + r""",
pc AS (SELECT doc_id, count(*) AS lines, sum((s <> '' AND regexp_matches(line, '^(#{1,6})\s+(.+?)\s*#*\s*$'))::INT)::BIGINT AS headings,
 sum(regexp_matches(s, '^[ \t]*(?:\d+(?:\.\d+){1,3}\.?|(?:\d+|[IVX]{1,5})\.)[ \t]+\S.{0,200}$')::INT)::BIGINT AS numbered,
 sum((length(s) BETWEEN 3 AND 80 AND length(regexp_replace(s, '\P{L}', '', 'g')) >= 3 AND NOT regexp_matches(s, '\p{Ll}'))::INT)::BIGINT AS caps,
 sum(regexp_matches(s, '\|[^|]*\|')::INT)::BIGINT AS rows FROM ml GROUP BY doc_id)"""
)


@query(f"WITH {PROFILE} SELECT doc_id, lines, headings, numbered, caps, rows FROM pc")
def profile_counts(t: Tables) -> DataFrame:
    return chunking.profile_columns(markdown(t), "doc_id", "text").select("doc_id", "lines", *[F.col(c).cast("long").alias(c) for c in ("headings", "numbered", "caps", "rows")])


@query(f"WITH {PROFILE} SELECT doc_id, (CASE WHEN headings >= 3 AND headings / lines > 0.005 THEN 'heading,' ELSE '' END) || (CASE WHEN numbered + caps >= 5 THEN 'heuristic,' ELSE '' END) || 'legacy' AS tiers FROM pc")
def tier_chain(t: Tables) -> DataFrame:
    p = chunking.profile_columns(markdown(t), "doc_id", "text")
    first = F.when((F.col("headings") >= 3) & (F.col("headings") / F.col("lines") > 0.005), "heading,").otherwise("")
    second = F.when(F.col("numbered") + F.col("caps") >= 5, "heuristic,").otherwise("")
    return p.select("doc_id", F.concat(first, second, F.lit("legacy")).alias("tiers"))


def heading_rows(t: Tables) -> DataFrame:
    rows = chunking.line_rows(markdown(t), "doc_id", "text").where(~F.col("fenced") & F.col("line").rlike(chunking.HEADING))
    return rows.select("doc_id", "n", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.concat(F.regexp_extract("line", "^(#+)", 1), F.lit(" "), F.trim(F.regexp_replace(F.regexp_extract("line", chunking.HEADING, 2), "^#+|#+$", ""))).alias("line"))


HEADS = (
    MARKDOWN
    + r""",
h AS (SELECT doc_id, n - 1 AS n, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_extract(line, '^(#+)', 1) || ' ' || trim(regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2), '^#+|#+$', '', 'g'), ' ') AS line FROM ml WHERE regexp_matches(line, '^(#{1,6})\s+(.+?)\s*#*\s*$'))"""
)


@query(f"""WITH {HEADS}, up AS (SELECT a.doc_id, a.n, b.n AS bn, b.level, b.line FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.n <= a.n),
seen AS (SELECT *, max(CASE WHEN TRUE THEN bn END) OVER (PARTITION BY doc_id, n, level) AS last FROM up),
vis AS (SELECT u.* FROM seen u WHERE bn = last AND NOT EXISTS (SELECT 1 FROM up x WHERE x.doc_id = u.doc_id AND x.n = u.n AND x.level < u.level AND x.bn > u.bn))
SELECT doc_id, n, string_agg(line, chr(10) ORDER BY level) AS breadcrumb FROM vis GROUP BY doc_id, n""")
def heading_breadcrumb(t: Tables) -> DataFrame:
    return chunking.breadcrumbs(heading_rows(t), "doc_id", "n").select("doc_id", F.col("n").cast("long").alias("n"), "breadcrumb")


@query(f"WITH {HEADS}, c AS (SELECT doc_id, level, count(*) AS k FROM h GROUP BY ALL) SELECT doc_id, coalesce(min(CASE WHEN k >= 3 THEN level END), max(level)) AS main_level FROM c GROUP BY doc_id")
def heading_main_level(t: Tables) -> DataFrame:
    c = heading_rows(t).groupBy("doc_id", "level").agg(F.count("*").alias("k"))
    return c.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("k") >= 3, F.col("level"))), F.max("level")).cast("long").alias("main_level"))


def split_with(t: Tables, **options) -> DataFrame:
    return chunking.chunks(markdown(t), "doc_id", "text", chunking.Plan(**options))


@query()
def chunk_legacy(t: Tables) -> DataFrame:
    return split_with(t, size=400, overlap=60)


@query()
def chunk_heading(t: Tables) -> DataFrame:
    return split_with(t, size=800, strategy="heading")


@query()
def chunk_heuristic(t: Tables) -> DataFrame:
    return split_with(t, size=800, strategy="heuristic")


@query()
def chunk_auto(t: Tables) -> DataFrame:
    return split_with(t, size=600, strategy="auto")


@query()
def chunk_parent_child(t: Tables) -> DataFrame:
    return split_with(t, parent_child=True, strategy="auto")


SOLID = "length(regexp_replace({x}, '[ \t\n\r]', '', 'g'))"


@query(f"WITH {MARKDOWN} SELECT strategy, doc_id, {SOLID.format(x='text')} AS solid FROM md, (VALUES ('auto'), ('heading'), ('heuristic'), ('legacy'), ('parent_child')) v(strategy)")
def chunk_cover(t: Tables) -> DataFrame:
    """Characters but white space that the chunks of a document hold, each once, by strategy: all of them.

    Chunks count where their range gives their text; what two chunks share is counted in the first.
    """
    md, out = markdown(t), None
    for name, f in (("auto", chunk_auto), ("heading", chunk_heading), ("heuristic", chunk_heuristic), ("legacy", chunk_legacy), ("parent_child", chunk_parent_child)):
        c = f(t).where("kind = 'text'").join(md, "doc_id").where(F.substring("text", F.col("start_at") + 1, F.col("end_at") - F.col("start_at")) == F.col("content"))
        reach = F.coalesce(F.max("end_at").over(Window.partitionBy("doc_id").orderBy("start_at", "end_at", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        new = F.substring("content", F.greatest(reach - F.col("start_at"), F.lit(0)) + 1, F.length("content"))
        one = c.select("doc_id", F.length(F.regexp_replace(new, r"[ \t\n\r]", "")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("solid")).select(F.lit(name).alias("strategy"), "doc_id", "solid")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {LINES}, e AS (SELECT *, trim(content, ' ') AS s, min(CASE WHEN trim(content, ' ') <> '' THEN chunk_index END) OVER w AS a, max(CASE WHEN trim(content, ' ') <> '' THEN chunk_index END) OVER w AS b FROM ch WINDOW w AS (PARTITION BY knowledge_id)),
pg AS (SELECT kb_id, count(DISTINCT knowledge_id) AS pages FROM e WHERE s <> '' GROUP BY kb_id),
o AS (SELECT kb_id, s, count(DISTINCT knowledge_id) AS c FROM e WHERE (chunk_index = a OR chunk_index = b) AND length(s) <= 80 GROUP BY ALL),
bad AS (SELECT kb_id, s FROM o JOIN pg USING (kb_id) WHERE pages >= 4 AND c >= greatest(2, floor(0.02 * pages)))
SELECT e.kb_id, count(*) AS lines FROM e LEFT JOIN bad ON bad.kb_id = e.kb_id AND bad.s = e.s AND (chunk_index = a OR chunk_index = b) WHERE bad.s IS NULL GROUP BY e.kb_id""")
def repeating_edge_lines(t: Tables) -> DataFrame:
    rows = line_chunks(t).select(F.col("kb_id").alias("doc_id"), F.col("knowledge_id").alias("page"), F.col("chunk_index").alias("n"), F.col("content").alias("line"))
    return pages.without_repeating_lines(rows, share=0.02).groupBy(F.col("doc_id").alias("kb_id")).agg(F.count("*").alias("lines"))


@query("SELECT page_id, CASE WHEN (length(html) % 100) / 100 >= 0.5 OR (page_id % 20 < 10 AND (length(html) % 100) / 100 >= 0.1) THEN 'scanned' ELSE 'text' END AS kind FROM pages")
def page_class(t: Tables) -> DataFrame:
    return t.pages.select("page_id", pages.page_class((F.length("html") % 100) / 100, F.col("page_id") % 20).alias("kind"))


@query("""WITH im AS (SELECT source AS doc_id, doc_id % 13 AS page, n_chars % 17 AS hash, n_chars % 300 AS width, n_chars % 200 AS height, doc_id AS ordinal FROM documents),
big AS (SELECT * FROM im WHERE width >= 50 AND height >= 50), ban AS (SELECT doc_id, hash FROM big GROUP BY ALL HAVING count(DISTINCT page) >= greatest(2, floor(0.3 * 13))),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, hash ORDER BY ordinal) AS k FROM big ANTI JOIN ban USING (doc_id, hash)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal) AS r FROM one WHERE k = 1) SELECT doc_id, page, hash, ordinal FROM n WHERE r <= 20""")
def selected_images(t: Tables) -> DataFrame:
    im = t.documents.select(F.col("source").alias("doc_id"), (F.col("doc_id") % 13).alias("page"), (F.col("n_chars") % 17).alias("hash"), (F.col("n_chars") % 300).alias("width"), (F.col("n_chars") % 200).alias("height"), F.col("doc_id").alias("ordinal"))
    per = im.select("doc_id").distinct().withColumn("pages", F.lit(13))
    return pages.selected_images(im, per, share=0.3, cap=20).select("doc_id", "page", "hash", "ordinal")


@query(f"""WITH {LINES}, d AS (SELECT *, length(trim(content, ' ')) <= 12 AND trim(content, ' ') <> '' AS deb FROM ch), g AS (SELECT *, sum((NOT deb)::INT) OVER (PARTITION BY knowledge_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS grp FROM d),
k AS (SELECT *, sum(deb::INT) OVER (PARTITION BY knowledge_id, grp) AS c FROM g) SELECT knowledge_id, count(*) AS lines FROM k WHERE NOT (deb AND c >= 2) AND NOT regexp_matches(trim(content, ' '), '^[0-9]{{1,3}}$') GROUP BY knowledge_id""")
def debris_lines(t: Tables) -> DataFrame:
    rows = line_chunks(t).select("knowledge_id", F.col("chunk_index").alias("n"), F.col("content").alias("line"))
    return pages.without_debris(rows, ["knowledge_id"], run=2, most_chars=12).groupBy("knowledge_id").agg(F.count("*").alias("lines"))
