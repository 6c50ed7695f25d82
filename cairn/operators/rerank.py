"""Rerank: lexical model scores, thresholds that give way, composite scores, and diversity selection."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from cairn.functions.text import clamp, clean_passage, enriched_passage, token_set


def lexical_score(query_terms: Column, passage_terms: Column) -> Column:
    """min(1, .85 shared/query + .15 sqrt(shared/passage)) over sets of terms; 0 if either is empty."""
    shared = F.size(F.array_intersect(query_terms, passage_terms))
    q, p = F.size(F.array_distinct(query_terms)), F.size(F.array_distinct(passage_terms))
    return F.when((q > 0) & (p > 0), F.least(F.lit(1.0), 0.85 * shared / q + 0.15 * F.sqrt(shared / p))).otherwise(F.lit(0.0))


def composite(model: Column, base: Column, start: Column, end: Column) -> Column:
    """(.7 model + .3 base), a twentieth more or less by the place in the document, within 0 and 1."""
    prior = F.when(start >= 0, 1 + clamp(1 - start.cast("double") / (end + 1), -0.05, 0.05)).otherwise(F.lit(1.0))
    return clamp((0.7 * model + 0.3 * base) * prior, 0.0, 1.0)


def faq_boost(score: Column, chunk_type: Column, boost: float, on: bool = True) -> Column:
    return F.when((chunk_type == "faq"), F.least(score * boost, F.lit(1.0))).otherwise(score) if on and boost > 1 else score


def over_or_best(ranked: DataFrame, threshold: float, floor: float = 0.15) -> DataFrame:
    """Per query the rows over the threshold; where there are none, the first returned one (ordinal) if it reaches floor.

    Where a threshold over .3 leaves a query empty, it is asked again at .7 of it, .3 at least.
    """
    w = Window.partitionBy("query_id")
    first = (F.col("ordinal") == 0) & (F.col("model_score") >= floor)

    def kept(t: float) -> Column:
        over = F.col("model_score") >= t
        return over | (~F.max(over).over(w) & first)

    if threshold <= 0.3:
        return ranked.withColumn("_keep", kept(threshold)).where("_keep").drop("_keep")
    both = ranked.withColumn("_once", kept(threshold)).withColumn("_again", kept(max(0.3, 0.7 * threshold)))
    return both.withColumn("_keep", F.when(F.max("_once").over(w), F.col("_once")).otherwise(F.col("_again"))).where("_keep").drop("_once", "_again", "_keep")


def stage(hits: DataFrame, model_score: Column | Callable[[Column], Column], k: int, threshold: float = 0.2, boost: float = 1.0, on: bool = True) -> DataFrame:
    """Hits as the k chosen of each query, with their composite scores and mmr_rank.

    hits: query_id, content, score, match_type, chunk_type, start_at, end_at, ordinal, and image_info and metadata, which
    then enrich the passage that is judged. model_score may be a function of that passage. Blank passages go; hits that
    were loaded directly (match type 7) count as certain, pass no threshold and come after the others. A query with a
    score of null, from a model that failed, gets no rows: its callers fall back on the hits.
    """
    rich = "image_info" in hits.columns and "metadata" in hits.columns
    passage = enriched_passage(F.col("content"), F.col("image_info"), F.col("metadata")) if rich else clean_passage(F.col("content"))
    direct = F.col("match_type") == 7
    score = model_score(F.col("_passage")) if callable(model_score) and not isinstance(model_score, Column) else model_score
    judged = hits.withColumn("_passage", passage).where(direct | (F.trim("_passage") != "")).withColumn("model_score", F.when(direct, F.lit(1.0)).otherwise(score)).drop("_passage")
    failed = F.max(F.col("model_score").isNull()).over(Window.partitionBy("query_id"))
    judged = judged.withColumn("_failed", failed).where(~F.col("_failed")).drop("_failed")
    order = Window.partitionBy("query_id").orderBy(F.desc("model_score"), "ordinal")
    ranked = over_or_best(judged.where(~direct).withColumn("ordinal", F.row_number().over(order) - 1), threshold)
    later = judged.where(direct).withColumn("ordinal", F.col("ordinal").cast("int") + 1_000_000)
    scored = ranked.unionByName(later).withColumn("score", faq_boost(composite(F.col("model_score"), F.col("score"), F.col("start_at"), F.col("end_at")), F.col("chunk_type"), boost, on))
    return mmr(scored, k)


#: Rows of a query that the folds on one query's candidates take at most: the over-fetch.
CANDIDATES = 500


def mmr_order(tokens: list[set], scores: list[float], k: int, weight: float = 0.7, swap: bool = False) -> list[int]:
    """Indices in the order of choice: best weight x score - (1 - weight) x greatest Jaccard to those chosen before.

    Equal values go to the earliest candidate. With swap the last candidate takes a chosen one's place, and a round
    without any value over -1 takes the first; without it such a round ends the choice.
    """
    left, nearest, chosen = list(range(len(tokens))), [0.0] * len(tokens), []
    while left and len(chosen) < k:
        values = [weight * scores[i] - (1 - weight) * nearest[i] for i in left]
        at = max(range(len(left)), key=lambda j: (values[j], -j))
        if not values[at] > -1.0:
            if not swap:
                break
            at = 0
        one = left[at]
        chosen.append(one)
        if swap:
            left[at] = left[-1]
            left.pop()
        else:
            left.pop(at)
        for i in left:
            shared = len(tokens[i] & tokens[one])
            union = len(tokens[i]) + len(tokens[one]) - shared
            nearest[i] = max(nearest[i], shared / union if union else 0.0)
    return chosen


def mmr(candidates: DataFrame, k: int, weight: float = 0.7, per: str = "query_id", score: str = "score", text: str = "content", order: str = "ordinal", swap: bool = False) -> DataFrame:
    """candidates in the order of choice: all columns and mmr_rank from 1. Of a query the first CANDIDATES take part."""
    first = Window.partitionBy(per).orderBy(order)
    with_tokens = candidates.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= CANDIDATES).drop("_nth").withColumn("_tokens", token_set(F.col(text)))
    schema = StructType([*candidates.schema.fields, StructField("mmr_rank", IntegerType())])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        chosen = mmr_order([set(t) for t in rows["_tokens"]], rows[score].astype(float).tolist(), k, weight, swap)
        out = rows.iloc[chosen].drop(columns="_tokens")
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    return with_tokens.groupBy(per).applyInPandas(pick, schema)


def hash_embed(rows: DataFrame, terms: str, dim: int, to: str = "embedding") -> DataFrame:
    """rows with a unit vector of their terms: each adds one at its BLAKE2b-64 hash modulo the dimension."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for row in batch[terms]:
                v = np.zeros(dim)
                for t in row:
                    if t not in known:
                        known[t] = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % dim
                    v[known[t]] += 1
                norm = np.sqrt((v * v).sum())
                out.append((v / norm if norm else v).astype(np.float32))
            batch[to] = out
            yield batch

    return rows.mapInPandas(embed, StructType([*rows.schema.fields, StructField(to, ArrayType(FloatType()))]))


def local_terms(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits, single CJK characters and their pairs within a run."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+|[\x{3400}-\x{9FFF}]+"), 0)
    han = lambda r: r.rlike(r"^[\x{3400}-\x{9FFF}]")
    ones = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)))
    twos = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, lambda r: F.when(han(r), F.concat(ones(r), twos(r))).otherwise(F.array(r))))


__all__ = ["composite", "faq_boost", "hash_embed", "lexical_score", "local_terms", "mmr", "mmr_order", "over_or_best", "stage"]
