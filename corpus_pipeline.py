"""Documents to packed training sequences: language ID, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a table; all but the
last return the columns of ``documents``. A stage's table is written as Parquet and read again before the next, and what
the stage wrote on its way is deleted then. Null and empty texts have no language and leave in the first stage; an empty
table passes through to no sequences; very long texts are read whole; of repeated rows and near copies one stays, that
with the smallest id (ties: of the smallest text digest); further columns stay, whatever their names, to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, langid, packing, similar
from cairn.llm.common import dropped, swept, table, written
from cairn.llm.registry import held_out

#: The least pooled probability of a language; below it no language holds half of a text.
LEAST = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter for which the network gives one language LEAST or more; all with a letter where no label taught it."""
    model = langid.fit(docs, F.coalesce(~held_out(), F.lit(False)))
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    to = tuple(f"{x}_{uuid.uuid4().hex}" for x in ("language", "score"))
    return langid.predict(docs, model, to=to).where((F.col(to[0]) != "und") & (F.col(to[1]) >= LEAST)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 or more on five-word shingles, that with the smallest id.

    Covering tables of SimHash fingerprints find the closest copies, prefix filtering the rest; whole shingle sets decide.
    """
    return similar.dedup(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    tokens = packing.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1)
    return packing.packed(tokens, 2048).drop("ids").withColumnRenamed("key", "doc_id")


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("benchmark leaks", leaks), ("packing", pack)]
#: No stage can be said in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        swept(spark)
        if last:
            dropped(spark, last)
        last = path
    return docs
