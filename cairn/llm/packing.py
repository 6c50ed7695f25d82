"""Concatenate and cut: token ids of all documents in a row, cut into windows of equal length.

Pass 1 encodes each text once and writes the ids with the partition and the ids before them in it. The partition totals
(one number a task) give each partition its global offset by a prefix sum; pass 2 adds the offset and cuts at multiples
of the window. A window that two partitions share gets pieces from both: its boundary records. Only the last window is
short; it is padded to the window length unless its length is a power of two.

Defined results: a null or empty text is its end id alone; rows are placed one by one, so repeated and null ids are
packed like others, in the order of the table; a very long text spans many windows; an empty table gives no pieces;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written_for_later
from .tokens import encoded


def tokenised(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table: key, part, before (ids before it in its part), n, ids (little-endian, four bytes each)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for keys, ids in encoded(batches, path, end):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.full(len(ids), part, np.int64)), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["key", "part", "before", "n", "ids"],
            )
            before += int(n.sum())

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind_of_key = source.schema["key"].dataType.simpleString()
    return written_for_later(source.mapInArrow(run, f"key {kind_of_key}, part long, before long, n long, ids binary"), "tokens")


def offsets(tokens: DataFrame) -> tuple[dict[int, int], int]:
    """The ids before each part, and of all: one row a task comes to the driver, never one a document."""
    at, total = {}, 0
    for part, n in sorted(map(tuple, tokens.groupBy("part").agg(F.sum("n")).collect())):
        at[part], total = total, total + n
    return at, total


def packed(tokens: DataFrame, window: int = 2048) -> DataFrame:
    """Pieces: key, doc_tokens, start, length, sequence_id, offset, padded_to, ids_crc32, ids (little-endian, four bytes each)."""
    at, total = offsets(tokens)
    # one row a task, which the driver has just held
    base = F.broadcast(tokens.sparkSession.createDataFrame(list(at.items()), "part long, base long"))
    placed = tokens.join(base, "part").withColumn("at", F.col("base") + F.col("before"))
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + n - 1) div {window}"))))
    cut = cut.withColumn("start", F.greatest(F.col("sequence_id") * window - F.col("at"), F.lit(0)))
    cut = cut.withColumn("offset", F.col("at") + F.col("start") - F.col("sequence_id") * window)
    cut = cut.withColumn("length", F.least(F.col("n") - F.col("start"), window - F.col("offset")))
    filled = F.least(F.lit(window), total - F.col("sequence_id") * window)
    ids = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    padded = F.when(filled.bitwiseAND(filled - 1) == 0, filled).otherwise(F.lit(window))
    return cut.select("key", F.col("n").alias("doc_tokens"), "start", "length", "sequence_id", "offset", padded.cast("long").alias("padded_to"), F.crc32(ids).alias("ids_crc32"), ids.alias("ids"))


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per window: sequence_id, padded_to, ids (bytes), starts of its pieces. A window holds at most as many pieces as ids."""
    one = F.struct("offset", "key", "length", "ids")
    sorted_pieces = pieces.groupBy("sequence_id").agg(F.max("padded_to").alias("padded_to"), F.array_sort(F.collect_list(one)).alias("p"))
    return sorted_pieces.select("sequence_id", "padded_to", F.expr("aggregate(transform(p, x -> x.ids), X'', (a, x) -> concat(a, x))").alias("ids"), F.col("p.offset").alias("offsets"), F.col("p.length").alias("lengths"), F.col("p.key").alias("keys"))
