"""Keyword and vector retrieval for many queries at once, filters, and rank fusion.

Queries are a table, so one job answers all of them. A keyword index is two tables: postings (row_id, term, tf) and
lengths (row_id, len); ``bm25`` meets the postings of the asked terms by an equi-join. Without an index, ``bm25_top``
reads a corpus twice: for the counts of the asked terms, then for scores, of which each task keeps the k best of every
query, so that what is shuffled does not grow with queries times rows. Sides are broadcast only by what the planner knows
of their size (``BROADCAST_BYTES``), or where their rows were counted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of a side that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20
#: Scores (rows x queries) that a task holds at a time.
SCORES = 1 << 21
K1, B = 1.2, 0.75

#: Small Latin letters with a mark, and the plain letters that they decompose to.
_LATIN = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
MARKED, PLAIN = "".join(c for c, _ in _LATIN), "".join(d for _, d in _LATIN)


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def terms(text: Column) -> Column:
    """Index terms: folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the table has few rows, the planner's choice otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def planned_small(df: DataFrame, source: DataFrame) -> DataFrame:
    """df with a broadcast hint if the planner knows that the table it is made from is small; nothing is run."""
    return F.broadcast(df) if int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES else df


def postings(rows: DataFrame, row_id: str, *texts: str) -> DataFrame:
    """(row_id, term, tf) over all the given columns."""
    all_terms = F.flatten(F.array(*[terms(F.coalesce(F.col(t).cast("string"), F.lit(""))) for t in texts]))
    return rows.select(F.col(row_id).alias("row_id"), F.explode(all_terms).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("tf"))


def lengths(rows: DataFrame, row_id: str, *texts: str) -> DataFrame:
    """(row_id, len): terms of each row, rows without any too."""
    total = sum((F.size(terms(F.coalesce(F.col(t).cast("string"), F.lit("")))) for t in texts), F.lit(0))
    return rows.select(F.col(row_id).alias("row_id"), total.cast("long").alias("len"))


def bm25(queries: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, row_id, score) of all rows that share a term with a query.

    queries: query_id, query. A term that a query repeats counts as often. idf is ln((N - n + .5) / (n + .5)) and 1e-6
    where that is not positive; scores are scaled by a million.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    totals = sizes.agg(F.count("*").alias("rows"), F.avg("len").alias("avg_len"))
    # a posting's gain is the same for all queries, so lengths and counts are joined before queries multiply the rows
    matched = index.join(planned_small(asked.select("term").distinct(), queries), "term")
    df = matched.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    gain = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    gains = matched.join(sizes, "row_id").join(planned_small(df, queries), "term").join(F.broadcast(totals)).select("term", "row_id", gain.alias("gain"))
    return gains.join(planned_small(asked, queries), "term").groupBy("query_id", "row_id").agg((F.sum(F.col("times") * F.col("gain")) * 1e6).alias("score"))


def _counted(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, asked term and count of each pair of them that occurs, and the terms of each row."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    which = pc.fill_null(pc.index_in(lists.values, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[ends[0] : ends[-1]]
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    met = which >= 0
    pairs, tf = np.unique(row[met] * len(known) + which[met], return_counts=True)
    return pairs // max(1, len(known)), pairs % max(1, len(known)), tf, size


def bm25_top(queries: DataFrame, rows: DataFrame, row_id: str, text: str, k: int, keep: Column | None = None, digits: int = 2) -> DataFrame:
    """(query_id, row_id, score, rank): the k best rows of each query (query_id, query) over a whole corpus.

    Scores are those of ``bm25``, rounded; equal ones go by row_id. Counts and lengths are those of all rows, results only
    rows where ``keep`` holds. The queries are a stated set: their terms, and one count for each, come to the driver.
    Null texts have no terms; repeated rows are ranked each.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).collect()
    ids = sorted({r.query_id for r in asked})
    names = sorted({r.term for r in asked})
    place, at = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(names)}
    by_term = np.array(sorted((at[r.term], place[r.query_id], r.times) for r in asked), np.int64).reshape(-1, 3)
    first = np.searchsorted(by_term[:, 0], np.arange(len(names) + 1))
    source = rows.select(F.col(row_id).alias("row_id"), F.coalesce(terms(F.col(text).cast("string")), F.array().cast("array<string>")).alias("terms"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, total, found = pa.array(names, pa.string()), 0, 0, np.zeros(len(names), np.int64)
        for batch in batches:
            _, term, _, size = _counted(batch.column(0), known)
            found += np.bincount(term, minlength=len(names))
            n, total = n + len(size), total + int(size.sum())
        # term -1 has the rows and their terms
        yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(found)], pa.int64()), pa.array([n, *found[found > 0]], pa.int64()), pa.array([total, *[0] * int((found > 0).sum())], pa.int64())], ["term", "n", "total"])

    counts = {r.term: (r.n, r.total) for r in source.select("terms").mapInArrow(count, "term long, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n_rows, total = counts.get(-1, (0, 0))
    n = np.array([counts.get(i, (0, 0))[0] for i in range(len(names))], float)
    idf = np.log((n_rows - n + 0.5) / (n + 0.5))
    idf = np.where(idf <= 0, 1e-6, idf)
    mean = total / n_rows if n_rows else 1.0

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, least = pa.array(names, pa.string()), [], np.zeros(len(ids))
        step = max(1, SCORES // max(1, len(ids)))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            row, term, tf, size = _counted(batch.column(1), known)
            gain = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
            asking = first[term + 1] - first[term]
            ends = np.cumsum(asking)
            use = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[term] - ends + asking, asking)
            table = np.bincount(np.repeat(row, asking) * len(ids) + by_term[use, 1], weights=by_term[use, 2] * np.repeat(gain, asking), minlength=len(size) * len(ids)).reshape(len(size), len(ids))
            table = np.floor(table * 1e6 * 10**digits + 0.5) / 10**digits
            table[~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)] = 0
            if len(table) > k:  # what k rows of this batch outdo is not among the best
                least = np.maximum(least, np.partition(table, -k, axis=0)[-k])
            r, q = np.nonzero((table > 0) & (table >= least))
            best.append(pd.DataFrame({"q": q, "score": table[r, q], "row_id": batch.column(0).take(pa.array(r)).to_pandas()}))
            best = [pd.concat(best).sort_values(["q", "score", "row_id"], ascending=[True, False, True]).groupby("q").head(k)]
        for kept in best:
            columns = [ids[q] for q in kept["q"]], kept["row_id"].tolist(), kept["score"].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["query_id", "row_id", "score"])

    types = [queries.schema["query_id"].dataType, source.schema["row_id"].dataType]
    kinds = [*map(to_arrow_type, types), pa.float64()]
    return top(source.mapInArrow(score, f"query_id {types[0].simpleString()}, row_id {types[1].simpleString()}, score double"), k)


def top(hits: DataFrame, k: int, per: str = "query_id", score: str = "score", tie: str = "row_id") -> DataFrame:
    """The k best of each query, with their rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(F.desc(score), F.asc(tie)))).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine distance; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_hits(queries: DataFrame, vectors: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(query_id, row_id, score) of each query vector (query_id, query_vec) against each vector of its dimension.

    The queries are a stated set of checked size: every vector meets them where it lies, without a shuffle.
    """
    norm = lambda v: F.sqrt(dot(v, v))
    asked = queries.select("query_id", "query_vec", F.size("query_vec").alias("dim"), norm(F.col("query_vec")).alias("_qn"))
    rows = vectors.select(F.col(row_id).alias("row_id"), F.col(vector).alias("_v"), F.size(vector).alias("dim"), norm(F.col(vector)).alias("_vn"))
    score = F.try_divide(dot(F.col("_v"), F.col("query_vec")), F.col("_vn") * F.col("_qn"))
    return rows.join(small(asked), "dim").select("query_id", "row_id", score.alias("score"))


def in_scopes(kb: str = "kb_id", knowledge: str = "knowledge_id", tag: str = "tag_id", chunk: str = "chunk_id", in_kb: Iterable = (), in_knowledge: Iterable = (), in_tag: Iterable = (), not_knowledge: Iterable = (), not_chunk: Iterable = ()) -> Column:
    """Whether a row is within all stated scopes; an empty list is no filter, and a null never passes a NOT IN."""
    passes = F.lit(True)
    for column, values in ((kb, in_kb), (knowledge, in_knowledge), (tag, in_tag)):
        if values := list(values):
            passes = passes & F.col(column).isin(values)
    for column, values in ((knowledge, not_knowledge), (chunk, not_chunk)):
        if values := list(values):
            passes = passes & ~F.col(column).isin(values)
    return passes


def scoped(rows: DataFrame, **scopes) -> DataFrame:
    """Rows within all scopes of ``in_scopes``."""
    return rows.where(in_scopes(**scopes))


def enabled(rows: DataFrame, flag: str = "is_enabled") -> DataFrame:
    """Null counts as enabled."""
    return rows.where(F.coalesce(F.col(flag), F.lit(True)))


def over_threshold(hits: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Applied after the cut to k; no filter at 0 or less."""
    return hits.where(F.col(score) >= threshold) if threshold > 0 else hits


def overfetch(k: int, knowledge_bases: int) -> int:
    return min(500, max(5 * k, 50) * max(1, knowledge_bases))


def dedup_by_max(hits: DataFrame, per: list[str], score: str = "score", order: str = "ordinal") -> DataFrame:
    """The best row of each key, the earliest among equals."""
    first = Window.partitionBy(*per).orderBy(F.desc(score), F.asc(order))
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def rrf(vector: DataFrame, keyword: DataFrame, k: int = 60, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Weighted reciprocal ranks of two ranked lists (query_id, chunk_id, rank): query_id, chunk_id, score, match_type.

    Ranks count every row of a list, repeated ones too, and a chunk keeps its first. Match type is 0 if the vector list
    has the chunk, else 1.
    """
    k = k if k > 0 else 60
    if vector_weight <= 0 and keyword_weight <= 0:
        vector_weight, keyword_weight = 0.7, 0.3
    vector_weight, keyword_weight = vector_weight if vector_weight > 0 else 0.7, keyword_weight if keyword_weight > 0 else 0.3
    both = vector.select("query_id", "chunk_id", F.col("rank").alias("v"), F.lit(None).cast("int").alias("w")).unionByName(keyword.select("query_id", "chunk_id", F.lit(None).cast("int").alias("v"), F.col("rank").alias("w")))
    ranks = both.groupBy("query_id", "chunk_id").agg(F.min("v").alias("v"), F.min("w").alias("w"))
    share = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    return ranks.select("query_id", "chunk_id", (share("v", vector_weight) + share("w", keyword_weight)).alias("score"), F.when(F.col("v").isNotNull(), 0).otherwise(1).alias("match_type"), F.col("v").alias("vector_rank"), F.col("w").alias("keyword_rank"))


def fuse_or_dedup(vector: DataFrame, keyword: DataFrame, **options) -> DataFrame:
    """Per query: fused where both lists have rows, else the one list's best row per chunk with its own score."""
    fused = rrf(vector, keyword, **options)
    sides = fused.groupBy("query_id").agg((F.count("vector_rank") > 0).alias("has_v"), (F.count("keyword_rank") > 0).alias("has_w"))
    own = vector.unionByName(keyword).groupBy("query_id", "chunk_id").agg(F.max("score").alias("own"))
    return fused.join(sides, "query_id").join(own, ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.when(F.col("has_v") & F.col("has_w"), F.col("score")).otherwise(F.col("own")).alias("score"), "match_type", "vector_rank", "keyword_rank")


def normalise_scores(hits: DataFrame, mixed: bool) -> DataFrame:
    """Vector scores on 0 to 1 where engines are mixed (``milvus`` from -1 to 1), keyword scores as they are."""
    from cairn.functions.text import clamp01

    if not mixed:
        return hits
    x = F.when(F.col("engine") == "milvus", (F.col("score") + 1) / 2).otherwise(F.col("score"))
    return hits.withColumn("score", F.when(F.col("retriever") == "vector", clamp01(x)).otherwise(F.col("score")))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks; what is missing takes the index content at 0 to its length."""
    c = chunks.select("chunk_id", F.col("content").alias("_content"), F.col("start_at").alias("_s"), F.col("end_at").alias("_e"))
    return hits.join(c, "chunk_id", "left").select(*[x for x in hits.columns if x != "content"], F.coalesce("_content", "content").alias("content"), F.coalesce("_s", F.lit(0)).alias("start_at"), F.coalesce("_e", F.length("content")).alias("end_at"))
