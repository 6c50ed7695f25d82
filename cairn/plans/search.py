"""Retrieval queries: keyword, vector and hybrid search of benchmark items in documents, rerank, and grep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import merge, rerank, retrieval, tools
from cairn.plans.registry import Tables, query

TOKENS = r"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: length(w) > 1 and regexp_matches(w, '[\p{{L}}\p{{N}}]')))"
NORM = r"trim(lower(regexp_replace({x}, '\s+', ' ', 'g')))"
TERMS = r"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+')"


def tokens_sql(x: str) -> str:
    return TOKENS.format(x=x)


def norm_sql(x: str) -> str:
    return NORM.format(x=x)


POSTINGS = f"""t AS (SELECT doc_id, unnest({TERMS.format(x="text")}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lens AS (SELECT doc_id, len({TERMS.format(x="text")})::BIGINT AS len FROM documents)"""
BM25 = (
    POSTINGS
    + f""",
tot AS (SELECT count(*) AS n_rows, avg(len) AS avg_len FROM lens),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS.format(x="text")}) AS term FROM benchmark) GROUP BY ALL),
gains AS (SELECT item_id, doc_id, times * CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)) AS gain
  FROM asked JOIN post USING (term) JOIN df USING (term) JOIN lens USING (doc_id), tot),
kw AS (SELECT item_id, doc_id, sum(gain) * 1e6 AS score FROM gains GROUP BY ALL)"""
)


def ranked_sql(hits: str, k: int, where: str = "true", join: str = "") -> str:
    return f"(SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 2) DESC, doc_id) AS rank FROM {hits} h {join} WHERE {where}) WHERE rank <= {k})"


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def top_keyword(t: Tables, k: int, keep: Column | None = None) -> DataFrame:
    """The k best documents of each benchmark item: query_id, row_id, score (two decimals), rank."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25_top(asked, t.documents, "doc_id", "text", k, keep)


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def bm25_postings(t: Tables) -> DataFrame:
    return retrieval.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {POSTINGS} SELECT doc_id, len FROM lens")
def bm25_doc_stats(t: Tables) -> DataFrame:
    return retrieval.lengths(t.documents, "doc_id", "text").withColumnRenamed("row_id", "doc_id")


@query(f"WITH {BM25} SELECT item_id, doc_id, rank, round(score, 2) AS score FROM {ranked_sql('kw', 10)}")
def bm25_topk(t: Tables) -> DataFrame:
    return top_keyword(t, 10).select(F.col("query_id").alias("item_id"), F.col("row_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score")


@query(f"WITH {BM25} SELECT item_id, doc_id, rank FROM {ranked_sql('kw', 10, 'd.lang IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'de' + chr(39) + ') AND d.source NOT IN (' + chr(39) + 'src0' + chr(39) + ')', 'JOIN documents d USING (doc_id)')}")
def bm25_filtered(t: Tables) -> DataFrame:
    keep = retrieval.in_scopes(kb="lang", knowledge="source", in_kb=["en", "de"], not_knowledge=["src0"])
    return top_keyword(t, 10, keep).select(F.col("query_id").alias("item_id"), F.col("row_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


def nearest(t: Tables, k: int) -> DataFrame:
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return retrieval.top(retrieval.vector_hits(asked, t.embeddings, "vec_id", "embedding").withColumn("score", F.round("score", 6)), k)


NEAREST = f"""near AS (SELECT * FROM (SELECT q, v, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, v) AS rank FROM
 (SELECT a.vec_id AS q, b.vec_id AS v, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10)"""


@query(f"WITH {NEAREST} SELECT q AS query_id, v AS vec_id, rank, score FROM near")
def cosine_topk(t: Tables) -> DataFrame:
    return nearest(t, 10).select("query_id", F.col("row_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "score")


@query(f"WITH {NEAREST} SELECT q AS query_id, v AS vec_id, rank FROM near JOIN embeddings e ON e.vec_id = v WHERE label IN (1, 3, 5)")
def cosine_topk_postfilter(t: Tables) -> DataFrame:
    """Filters after the cut to k, so fewer than k may be left."""
    rows = retrieval.scoped(t.embeddings.select(F.col("vec_id").alias("row_id"), "label"), tag="label", in_tag=[1, 3, 5])
    return nearest(t, 10).join(rows, "row_id").select("query_id", F.col("row_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {NEAREST} SELECT q AS query_id, v AS vec_id, score FROM near WHERE score >= 0.3")
def score_threshold(t: Tables) -> DataFrame:
    return retrieval.over_threshold(nearest(t, 10), 0.3).select("query_id", F.col("row_id").alias("vec_id"), "score")


@query("SELECT lang, least(500, greatest(5 * 10, 50) * count(DISTINCT source))::INTEGER AS fetch FROM documents GROUP BY lang")
def overfetch_limit(t: Tables) -> DataFrame:
    n = t.documents.groupBy("lang").agg(F.countDistinct("source").alias("n"))
    return n.select("lang", F.least(F.lit(500), F.lit(retrieval.overfetch(10, 1)) * F.col("n")).cast("int").alias("fetch"))


def hybrid(t: Tables, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Vector and keyword lists: an item asks with its text, and with the vector of its number."""
    asked = t.benchmark.select(F.col("item_id").alias("vec_id")).join(t.embeddings, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    v = retrieval.top(retrieval.vector_hits(asked, t.embeddings, "vec_id", "embedding").withColumn("score", F.round("score", 6)), k)
    shape = lambda df: df.select("query_id", F.col("row_id").alias("chunk_id"), "score", "rank")
    return shape(v), shape(top_keyword(t, k))


HYBRID = f"""{BM25}, w AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(score, 2) AS score, rank FROM {ranked_sql('kw', 50)}),
v AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COS}, 6) AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b)) WHERE rank <= 50),
f AS (SELECT query_id, chunk_id, coalesce(0.7 / (60 + v.rank), 0) + coalesce(0.3 / (60 + w.rank), 0) AS score, CASE WHEN v.rank IS NULL THEN 1 ELSE 0 END AS match_type FROM v FULL JOIN w USING (query_id, chunk_id))"""


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, round(score, 9) AS score, match_type FROM f")
def rrf_fuse(t: Tables) -> DataFrame:
    return retrieval.rrf(*hybrid(t)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "match_type")


@query(f"""WITH {HYBRID} SELECT query_id, chunk_id, rank, round(score, 9) AS score, source, n_chars FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, match_type, chunk_id) AS rank FROM f) LEFT JOIN documents ON doc_id = chunk_id WHERE rank <= 10""")
def hybrid_topk(t: Tables) -> DataFrame:
    """Keyword and vector search, fusion, the ten best of each query, and their documents."""
    fused = retrieval.rrf(*hybrid(t)).withColumn("score", F.round("score", 9)).withColumn("tie", F.struct("match_type", "chunk_id"))
    best = retrieval.top(fused, 10, tie="tie")
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", "n_chars")
    return best.join(docs, "chunk_id", "left").select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score", "source", "n_chars")


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, score FROM v UNION ALL SELECT query_id, chunk_id, score FROM w) GROUP BY ALL")
def dedup_max_score(t: Tables) -> DataFrame:
    v, w = hybrid(t)
    both = v.unionByName(w).withColumn("ordinal", F.col("rank"))
    return retrieval.dedup_by_max(both, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "score")


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, greatest(0, least(1, CASE WHEN chunk_id % 2 = 0 THEN (score + 1) / 2 ELSE score END)) AS score FROM v UNION ALL SELECT query_id, chunk_id, score FROM w")
def normalize_scores(t: Tables) -> DataFrame:
    v, w = hybrid(t)
    v = v.withColumn("retriever", F.lit("vector")).withColumn("engine", F.when(F.col("chunk_id") % 2 == 0, "milvus").otherwise("sqlite"))
    w = w.withColumn("retriever", F.lit("keywords")).withColumn("engine", F.lit("sqlite"))
    return retrieval.normalise_scores(v.unionByName(w), mixed=True).select("query_id", "chunk_id", "score")


@query(f"""WITH {NEAREST} SELECT q AS query_id, v AS chunk_id, coalesce(d.text, 'vector ' || v) AS content, 0 AS start_at, coalesce(d.n_chars, length('vector ' || v))::INTEGER AS end_at FROM near LEFT JOIN documents d ON d.doc_id = v AND v % 3 <> 0""")
def hydrate_left_join(t: Tables) -> DataFrame:
    hits = nearest(t, 10).select("query_id", F.col("row_id").alias("chunk_id"), F.concat(F.lit("vector "), F.col("row_id").cast("string")).alias("content"))
    docs = t.documents.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit(0).alias("start_at"), F.col("n_chars").cast("int").alias("end_at"))
    return retrieval.hydrate(hits, docs)


def candidates(t: Tables, k: int = 10) -> DataFrame:
    """Items with their keyword hits: query_id, query, doc_id, content, score, ordinal, source, n_chars."""
    hits = top_keyword(t, k).select("query_id", F.col("row_id").alias("doc_id"), "score", (F.col("rank") - 1).alias("ordinal"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return hits.join(asked, "query_id").join(t.documents.withColumnRenamed("text", "content"), "doc_id")


CANDIDATES = f"{BM25}, c AS (SELECT item_id, doc_id, round(score, 2) AS score, rank - 1 AS ordinal, b.text AS query, d.text AS content, d.source, d.n_chars FROM {ranked_sql('kw', 10)} JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))"
LOCAL = r"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
LEX = f"(SELECT *, CASE WHEN len(p) > 0 AND len(qt) > 0 THEN least(1.0, 0.85 * len(list_intersect(qt, p)) / len(qt) + 0.15 * sqrt(len(list_intersect(qt, p)) / len(p))) ELSE 0.0 END AS model FROM (SELECT *, {LOCAL.format(x='query')} AS qt, {LOCAL.format(x='content')} AS p FROM c))"


def scored(t: Tables) -> DataFrame:
    c = candidates(t)
    return c.withColumn("model", rerank.lexical_score(F.array_distinct(rerank.local_terms(F.col("query"))), F.array_distinct(rerank.local_terms(F.col("content")))))


@query(f"WITH {CANDIDATES} SELECT item_id, doc_id, round(model, 9) AS model FROM {LEX}")
def lexical_rerank(t: Tables) -> DataFrame:
    return scored(t).select(F.col("query_id").alias("item_id"), "doc_id", F.round("model", 9).alias("model"))


@query(f"WITH {CANDIDATES} SELECT item_id, doc_id, round(least(1, greatest(0, (0.7 * model + 0.3 * 0.016) * (1 + greatest(-0.05, least(0.05, 1 - (n_chars % 400) / (n_chars + 1)))))), 9) AS score FROM {LEX}")
def composite_score(t: Tables) -> DataFrame:
    s = rerank.composite(F.col("model"), F.lit(0.016), F.col("n_chars") % 400, F.col("n_chars"))
    return scored(t).select(F.col("query_id").alias("item_id"), "doc_id", F.round(s, 9).alias("score"))


@query(f"WITH {CANDIDATES} SELECT item_id, doc_id, round(CASE WHEN source = 'src1' THEN least(1, model * 1.2) ELSE model END, 9) AS score FROM {LEX}")
def faq_boost(t: Tables) -> DataFrame:
    kind = F.when(F.col("source") == "src1", "faq").otherwise("text")
    return scored(t).select(F.col("query_id").alias("item_id"), "doc_id", F.round(rerank.faq_boost(F.col("model"), kind, 1.2), 9).alias("score"))


@query(f"""WITH {CANDIDATES}, m AS (SELECT item_id, doc_id, ordinal, round(model, 9) AS model FROM {LEX}),
a AS (SELECT *, max(model) OVER (PARTITION BY item_id) AS best, max(CASE WHEN ordinal = 0 THEN model END) OVER (PARTITION BY item_id) AS first FROM m),
k AS (SELECT *, model >= 0.8 OR (best < 0.8 AND ordinal = 0 AND model >= 0.15) AS once, max(CASE WHEN model >= 0.8 OR (best < 0.8 AND ordinal = 0 AND model >= 0.15) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id) AS kept FROM a)
SELECT item_id, doc_id FROM k WHERE once OR (kept = 0 AND (model >= 0.56 OR (best < 0.56 AND ordinal = 0 AND model >= 0.15)))""")
def rerank_threshold(t: Tables) -> DataFrame:
    ranked = scored(t).select("query_id", "doc_id", "ordinal", F.round("model", 9).alias("model_score"))
    return rerank.over_or_best(ranked, 0.8).select(F.col("query_id").alias("item_id"), "doc_id")


@query(f"WITH {CANDIDATES} SELECT item_id, doc_id, round(len(list_intersect(qt, p)) / greatest(1, len(qt) + len(p) - len(list_intersect(qt, p))), 9) AS jaccard, round(CASE WHEN least(len(qt), len(p)) > 0 THEN len(list_intersect(qt, p)) / least(len(qt), len(p)) ELSE 0 END, 9) AS overlap FROM (SELECT *, {tokens_sql('query')} AS qt, {tokens_sql('content')} AS p FROM c)")
def token_similarity(t: Tables) -> DataFrame:
    a, b = T.token_set(F.col("query")), T.token_set(F.col("content"))
    c = candidates(t).withColumn("a", a).withColumn("b", b)
    return c.select(F.col("query_id").alias("item_id"), "doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.round(T.overlap_ratio(F.col("a"), F.col("b")), 9).alias("overlap"))


@query(f"WITH {CANDIDATES} SELECT item_id, doc_id, {norm_sql('query')} <> '' AND contains({norm_sql('content')}, {norm_sql('query')}) AS contained FROM c")
def containment(t: Tables) -> DataFrame:
    return candidates(t).select(F.col("query_id").alias("item_id"), "doc_id", T.contained(T.normalised(F.col("query")), T.normalised(F.col("content"))).alias("contained"))


@query(f"""WITH {CANDIDATES}, h AS (SELECT item_id, doc_id, ordinal, content, {tokens_sql('query')} AS qt, {tokens_sql('content')} AS p FROM c),
j AS (SELECT item_id, doc_id, ordinal, len(list_intersect(qt, p)) / greatest(1, len(qt) + len(p) - len(list_intersect(qt, p))) AS s FROM h)
SELECT item_id, doc_id, round(s * 0.6, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS n FROM j WHERE s >= 0.02) WHERE n <= 3""")
def history_filter(t: Tables) -> DataFrame:
    """Earlier results that are near the query: the first three over a similarity, at six tenths of it."""
    c = candidates(t).withColumn("s", T.jaccard(T.token_set(F.col("query")), T.token_set(F.col("content")))).where("s >= 0.02")
    first = c.withColumn("neg", -F.col("ordinal"))
    return retrieval.top(first, 3, score="neg", tie="doc_id").select(F.col("query_id").alias("item_id"), "doc_id", F.round(F.col("s") * 0.6, 9).alias("score"))


def mmr_sql(rows: str, k: int) -> str:
    """CTEs that end in ``chosen`` (item_id, doc_id, mmr_rank) from rows (item_id, doc_id, ordinal, content, score)."""
    both = "len(list_intersect(t[i], t[j]))"
    value = f"0.7 * s[i] - 0.3 * coalesce(list_max(list_transform(picked, lambda j: {both} / greatest(1, len(t[i]) + len(t[j]) - {both}))), 0)"
    return f"""ml AS (SELECT item_id, list(doc_id ORDER BY ordinal) AS ids, list(score ORDER BY ordinal) AS s, list({tokens_sql("content")} ORDER BY ordinal) AS t, count(*)::BIGINT AS n FROM {rows} GROUP BY item_id),
mr(item_id, picked) AS (SELECT item_id, CAST([] AS BIGINT[]) FROM ml UNION ALL SELECT item_id, list_append(picked, list_position(v, list_max(v))::BIGINT) FROM
 (SELECT item_id, picked, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(picked, i) THEN -10 ELSE {value} END) AS v FROM mr JOIN ml USING (item_id) WHERE len(picked) < least({k}, n))),
mf AS (SELECT item_id, picked FROM mr QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY len(picked) DESC) = 1),
chosen AS (SELECT item_id, ids[picked[r]] AS doc_id, r::INTEGER AS mmr_rank FROM mf JOIN ml USING (item_id), unnest(range(1, len(picked) + 1)) AS u(r))"""


def overlaps_sql(rows: str) -> str:
    """CTEs that end in ``left_over`` (item_id, doc_id) from rows (item_id, doc_id, ordinal, content, score)."""
    return f"""po AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS i, {norm_sql("content")} AS n, {tokens_sql("content")} AS t FROM {rows}),
pp AS (SELECT a.item_id, a.i, b.i AS j, CASE WHEN length(a.n) > length(b.n) THEN b.i ELSE a.i END AS short, CASE WHEN length(a.n) > length(b.n) THEN a.i ELSE b.i END AS long,
 CASE WHEN length(a.n) > length(b.n) THEN b.n <> '' AND contains(a.n, b.n) ELSE a.n <> '' AND contains(b.n, a.n) END OR (least(len(a.t), len(b.t)) > 0 AND len(list_intersect(a.t, b.t)) / greatest(1, least(len(a.t), len(b.t))) >= 0.85) AS hit,
 CASE WHEN length(a.n) > length(b.n) THEN b.score > a.score ELSE a.score > b.score END AS short_wins FROM po a JOIN po b ON a.item_id = b.item_id AND a.i < b.i),
pn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i, j) AS step FROM pp),
pr(item_id, step, gone, off) AS (SELECT DISTINCT item_id, 0::BIGINT, CAST([] AS BIGINT[]), false FROM po UNION ALL
 SELECT item_id, step, CASE WHEN hit AND NOT off2 AND NOT list_contains(gone, j) THEN list_append(gone, CASE WHEN short_wins THEN long ELSE short END) ELSE gone END, off2 FROM
 (SELECT pr.item_id, pn.step, gone, i, j, hit, short, long, short_wins, CASE WHEN j = i + 1 THEN list_contains(gone, i) ELSE off END AS off2 FROM pr JOIN pn ON pn.item_id = pr.item_id AND pn.step = pr.step + 1)),
pl AS (SELECT item_id, gone FROM pr QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY step DESC) = 1),
left_over AS (SELECT item_id, doc_id FROM po JOIN pl USING (item_id) WHERE NOT list_contains(gone, i))"""


MODELS = f"{CANDIDATES}, m AS (SELECT item_id, doc_id, ordinal, content, source, n_chars, model FROM {LEX})"
SIGNED = f"CASE WHEN {norm_sql('content')} = '' THEN 'id' || doc_id ELSE md5({norm_sql('content')}) END"


@query(f"WITH RECURSIVE {MODELS}, r AS (SELECT item_id, doc_id, ordinal, content, model AS score FROM m), {mmr_sql('r', 5)} SELECT item_id AS query_id, doc_id, mmr_rank FROM chosen")
def mmr_select(t: Tables) -> DataFrame:
    c = scored(t).select("query_id", "doc_id", "content", F.col("model").alias("score"), "ordinal")
    return rerank.mmr(c, 5).select("query_id", "doc_id", "mmr_rank")


@query(f"WITH {CANDIDATES} SELECT item_id AS query_id, doc_id AS chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY item_id, {SIGNED} ORDER BY ordinal) = 1")
def dedup_sequential(t: Tables) -> DataFrame:
    return merge.dedup_sequential(candidates(t).select("query_id", F.col("doc_id").alias("chunk_id"), "content", "score", "ordinal")).select("query_id", "chunk_id")


@query(f"WITH RECURSIVE {CANDIDATES}, {overlaps_sql('c')} SELECT item_id AS query_id, doc_id AS chunk_id FROM left_over")
def partial_overlap_removed(t: Tables) -> DataFrame:
    c = candidates(t).select("query_id", F.col("doc_id").alias("chunk_id"), "content", "score", "ordinal")
    return merge.drop_partial_overlaps(c).select("query_id", "chunk_id")


@query()
def hash_embed(t: Tables) -> DataFrame:
    terms = t.documents.select("doc_id", rerank.local_terms(T.sanitised_for_embedding(F.col("text"))).alias("terms"))
    return rerank.hash_embed(terms, "terms", 64).select("doc_id", "embedding")


@query(f"""WITH {CANDIDATES}, u AS (SELECT item_id % 8 AS request_id, doc_id, score, source FROM c QUALIFY row_number() OVER (PARTITION BY item_id % 8, {SIGNED} ORDER BY item_id * 100 + ordinal) = 1)
SELECT request_id, doc_id::VARCHAR AS chunk_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, source, doc_id::VARCHAR) AS rank FROM u) WHERE rank <= 5""")
def knowledge_search(t: Tables) -> DataFrame:
    c = candidates(t)
    hits = c.select((F.col("query_id") % 8).alias("request_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"), F.col("source").alias("knowledge_id"), F.col("doc_id").alias("chunk_index"), "content", "score", (F.col("query_id") * 100 + F.col("ordinal")).alias("ordinal"))
    return tools.knowledge_search(hits, 5).select("request_id", "chunk_id", "rank")


@query(f"""WITH RECURSIVE {MODELS}, a AS (SELECT *, max(model) OVER (PARTITION BY item_id) AS best FROM m),
r AS (SELECT item_id, doc_id, ordinal, content, least(1, greatest(0, (0.7 * model + 0.3 * 0.016) * (1 + greatest(-0.05, least(0.05, 1 - 0 / (n_chars + 1)))))) AS score FROM a WHERE model >= 0.3 OR (best < 0.3 AND ordinal = 0 AND model >= 0.15)),
{mmr_sql('r', 5)}, d AS (SELECT r.item_id, r.doc_id, mmr_rank AS ordinal, content, score FROM r JOIN chosen USING (item_id, doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, {SIGNED.replace('doc_id', 'r.doc_id')} ORDER BY mmr_rank) = 1),
{overlaps_sql('d')} SELECT item_id AS query_id, doc_id AS chunk_id, round(score, 9) AS score, ordinal AS place FROM d JOIN left_over USING (item_id, doc_id)""")
def rag_search(t: Tables) -> DataFrame:
    """The whole search: keyword hits, model scores, composite, diversity, and removal of overlapping results."""
    s = rerank.composite(F.col("model"), F.lit(0.016), F.lit(0), F.col("n_chars"))
    ranked = scored(t).select("query_id", "doc_id", "content", s.alias("score"), "ordinal", F.col("model").alias("model_score"))
    chosen = rerank.mmr(rerank.over_or_best(ranked, 0.3), 5).withColumn("ordinal", F.col("mmr_rank"))
    unique = merge.drop_partial_overlaps(merge.dedup_sequential(chosen.select("query_id", F.col("doc_id").alias("chunk_id"), "content", "score", "ordinal")))
    return unique.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("ordinal").cast("int").alias("place"))


@query(f"""WITH {CANDIDATES}, h AS (SELECT *, {SIGNED} AS sig, {tokens_sql('query')} AS q, {tokens_sql('content')} AS p FROM c),
near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS n FROM (SELECT *, len(list_intersect(q, p)) / greatest(1, len(q) + len(p) - len(list_intersect(q, p))) AS s FROM h WHERE ordinal >= 5) WHERE s >= 0.15),
u AS (SELECT item_id, doc_id, sig, score, ordinal FROM h WHERE ordinal < 5 UNION ALL SELECT item_id, doc_id, sig, score * 0.6, n + 1000000 FROM near WHERE n <= 3)
SELECT item_id AS query_id, doc_id AS chunk_id, round(score, 2) AS score, ordinal >= 1000000 AS earlier FROM u QUALIFY row_number() OVER (PARTITION BY item_id, sig ORDER BY ordinal) = 1""")
def history_append(t: Tables) -> DataFrame:
    """The first five hits of an item, and after them what the next five would be as an earlier turn's results."""
    c = candidates(t).select("query_id", "query", F.col("doc_id").alias("chunk_id"), "content", "score", F.col("ordinal").cast("int").alias("ordinal"), F.lit(0).alias("match_type"))
    both = merge.with_history(merge.dedup_sequential(c.where("ordinal < 5")), c.where("ordinal >= 5"))
    return both.select("query_id", "chunk_id", F.round("score", 2).alias("score"), (F.col("ordinal") >= 1_000_000).alias("earlier"))


GREP = ["erth[a-z]*", "lich"]


def grep_chunks(t: Tables) -> DataFrame:
    """Documents as chunks of a store: newest first by id."""
    d = t.documents
    return d.select(F.lit(1).alias("tenant_id"), F.col("lang").alias("kb_id"), F.col("source").alias("knowledge_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.col("doc_id").alias("chunk_index"), (F.col("doc_id") % 7 != 0).alias("is_enabled"), F.when(F.col("doc_id") % 11 == 0, F.lit("2024-01-01 00:00:00")).cast("timestamp").alias("deleted_at"), F.timestamp_seconds(F.floor(F.col("doc_id") / 10)).alias("created_at"), F.col("doc_id").alias("seq_id"))


JACCARD = "(len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b}))))"
GREP_SQL = """store AS (SELECT doc_id, lang AS kb_id, source AS knowledge_id, text AS content FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0),
totals AS (SELECT kb_id, knowledge_id, count(*) AS total_chunks FROM store GROUP BY ALL),
title AS (SELECT DISTINCT source AS knowledge_id, CASE WHEN source = 'src3' THEN 'Erthal' ELSE source END AS title FROM documents),
hit AS (SELECT *, regexp_matches(content, 'erth[a-z]*', 'i') AS a, regexp_matches(content, 'lich', 'i') AS b, regexp_matches(title, 'erth[a-z]*|lich', 'i') AS tm,
 length(string_split_regex(content, '(?i)erth[a-z]*')[1]) AS pa, length(string_split_regex(content, '(?i)lich')[1]) AS pb FROM store JOIN title USING (knowledge_id)),
newest AS (SELECT * FROM hit WHERE a OR b OR tm ORDER BY doc_id // 10 DESC, doc_id DESC LIMIT 500),
own AS (SELECT *, a::INT + b::INT AS found, CASE WHEN a AND b THEN least(pa, pb) WHEN a THEN pa WHEN b THEN pb END AS early FROM newest),
sc AS (SELECT *, CASE WHEN found > 0 THEN least(1.0, found / 2 + 0.1 * (1 - early / length(content))) ELSE 0.0 END AS s FROM own),
g AS (SELECT doc_id, kb_id, knowledge_id, title, content, CASE WHEN tm THEN least(1.0, s + 0.5) ELSE s END AS raw, round(CASE WHEN tm THEN least(1.0, s + 0.5) ELSE s END, 9) AS score, CASE WHEN tm AND found = 0 THEN 1 ELSE found END AS matched, tm AS title_match, total_chunks FROM sc JOIN totals USING (kb_id, knowledge_id))"""


def titles(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("knowledge_id"), F.when(F.col("source") == "src3", "Erthal").otherwise(F.col("source")).alias("title")).distinct()


@query(f"WITH {GREP_SQL} SELECT doc_id::VARCHAR AS chunk_id, score, matched, title_match, total_chunks FROM g")
def grep_matches(t: Tables) -> DataFrame:
    return tools.matches(grep_chunks(t), GREP, titles(t)).select("chunk_id", F.round("score", 9).alias("score"), "matched", "title_match", "total_chunks")


#: The earliest match of either pattern in its line, in DuckDB's SQL: the place and the match are pa and ma, or pb and mb.
SNIPPET = """CASE WHEN a OR b THEN '... ' || (SELECT CASE WHEN length(x) > 800 THEN substr(x, 1, 800) || '...' ELSE x END FROM (SELECT trim(regexp_replace(replace(substr(content, greatest(pos - 200, 0) + 1, pos - greatest(pos - 200, 0))
 || CASE WHEN length(mm) > 200 THEN substr(mm, 1, 200) || '...' ELSE mm END || substr(content, pos + length(mm) + 1, 200), chr(10), ' '), ' {2,}', ' ', 'g')) AS x)) || ' ...' END"""


@query(f"""WITH {GREP_SQL}, f AS (SELECT newest.*, CASE WHEN a AND (NOT b OR pa <= pb) THEN pa ELSE pb END AS pos, CASE WHEN a AND (NOT b OR pa <= pb) THEN regexp_extract(content, '(?i)erth[a-z]*') ELSE regexp_extract(content, '(?i)lich') END AS mm FROM newest),
sn AS (SELECT kb_id, knowledge_id, arg_max(snippet, doc_id) AS snippet FROM (SELECT kb_id, knowledge_id, doc_id, {SNIPPET} AS snippet FROM f) WHERE snippet IS NOT NULL GROUP BY ALL),
k AS (SELECT kb_id, knowledge_id, any_value(title) AS title, count(*) AS chunk_hits, bool_or(title_match) AS title_match, max(score) AS score, sum(len(regexp_extract_all(content, '(?i)erth[a-z]*')))::BIGINT AS hits_0, sum(len(regexp_extract_all(content, '(?i)lich')))::BIGINT AS hits_1 FROM g GROUP BY kb_id, knowledge_id)
SELECT kb_id, knowledge_id, title, chunk_hits, title_match, score, hits_0, hits_1, (hits_0 > 0)::INT + (hits_1 > 0)::INT AS distinct_patterns, hits_0 + hits_1 AS total_hits, snippet FROM k LEFT JOIN sn USING (kb_id, knowledge_id) ORDER BY title_match DESC, distinct_patterns DESC, total_hits DESC, chunk_hits DESC, title, knowledge_id, kb_id LIMIT 20""")
def grep_documents(t: Tables) -> DataFrame:
    found = tools.matches(grep_chunks(t), GREP, titles(t)).withColumn("score", F.round("score", 9))
    return tools.grep_documents(found, GREP).select("kb_id", "knowledge_id", "title", "chunk_hits", "title_match", "score", "hits_0", "hits_1", "distinct_patterns", "total_hits", "snippet")


@query(f"""WITH RECURSIVE {GREP_SQL}, u AS (SELECT *, row_number() OVER (ORDER BY doc_id // 10 DESC, doc_id DESC) AS o, {SIGNED} AS sig FROM g), w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY sig ORDER BY o) = 1),
gl AS MATERIALIZED (SELECT list(doc_id ORDER BY o) AS ids, list(raw ORDER BY o) AS s, list({tokens_sql("content")} ORDER BY o) AS t, count(*)::BIGINT AS n FROM w),
gr(k, todo, near, picked) AS (SELECT 0::BIGINT, range(1, n + 1), list_transform(range(0, n), lambda i: 0.0::DOUBLE), CAST([] AS BIGINT[]) FROM gl UNION ALL
 SELECT k + 1, todo3, list_transform(todo3, lambda i, p: greatest(near3[p], {JACCARD.format(a="t[i]", b="t[one]")})), list_append(picked, one) FROM
 (SELECT k, picked, t, todo[spot] AS one, CASE WHEN spot = len(todo) THEN todo[1:len(todo) - 1] ELSE list_concat(list_append(todo[1:spot - 1], todo[len(todo)]), todo[spot + 1:len(todo) - 1]) END AS todo3,
  CASE WHEN spot = len(near) THEN near[1:len(near) - 1] ELSE list_concat(list_append(near[1:spot - 1], near[len(near)]), near[spot + 1:len(near) - 1]) END AS near3 FROM
  (SELECT k, todo, near, picked, t, list_position(v, list_max(v))::BIGINT AS spot FROM (SELECT gr.*, t, list_transform(todo, lambda i, p: 0.7 * s[i] - 0.3 * near[p]) AS v FROM gr, gl WHERE k < least(30, n))))),
fin AS (SELECT CASE WHEN n > 10 THEN picked ELSE range(1, n + 1) END AS picked, ids FROM gr, gl QUALIFY row_number() OVER (ORDER BY k DESC) = 1), fd AS (SELECT ids[p] AS doc_id FROM fin, unnest(picked) AS x(p))
SELECT doc_id::VARCHAR AS chunk_id, score FROM w JOIN fd USING (doc_id) ORDER BY title_match DESC, matched DESC, raw DESC, doc_id LIMIT 30""")
def grep_search(t: Tables) -> DataFrame:
    return tools.grep(grep_chunks(t), GREP, titles(t)).select("chunk_id", F.round("score", 9).alias("score"))


@query("SELECT source, count(*) AS docs, sum(len(regexp_extract_all(text, '(?i)tion')))::BIGINT AS hits FROM documents WHERE regexp_matches(text, 'tion', 'i') GROUP BY source")
def grep_group_by_source(t: Tables) -> DataFrame:
    p = tools.checked("tion")
    return t.documents.where(F.col("text").rlike(p)).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias("hits"))


@query("SELECT doc_id FROM documents WHERE (lang = 'en' AND source = 'src1') OR lang = 'de'")
def scope_filter(t: Tables) -> DataFrame:
    scope = t.spark.createDataFrame([(1, "en", "src1"), (1, "de", None)], "tenant_id int, kb_id string, knowledge_id string")
    rows = t.documents.select("doc_id", F.lit(1).alias("tenant_id"), F.col("lang").alias("kb_id"), F.col("source").alias("knowledge_id"))
    return tools.in_scope(rows, scope).select("doc_id")
