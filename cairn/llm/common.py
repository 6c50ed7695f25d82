"""What the operators share: written tables, a shared folder, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import spread


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, has a default."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at a time where texts are read: an Arrow batch is held several times over.
ROWS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_AT_ONCE rows in this session, for plans that send texts to Python when they are run later."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS_AT_ONCE:
        spark.conf.set(_BATCH, ROWS_AT_ONCE)


def written(df: DataFrame, name: str, rows: int = ROWS_AT_ONCE) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which any executor can read again after another was lost; and its path."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), rows) if int(before) > 0 else rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path), path


#: Written tables that results yet to be computed still read.
_LATER: list[str] = []


def written_for_later(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder that swept() deletes."""
    table, path = written(df, name)
    _LATER.append(path)
    return table


def swept(spark: SparkSession) -> None:
    """Delete the tables of written_for_later, when what reads them is written itself."""
    while _LATER:
        dropped(spark, _LATER.pop())


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def row_digest(key: str, text: str) -> Column:
    """128 bits of a row's id and text together, which tell rows apart where ids are null or repeat."""
    k, t = F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.length(k).cast("string"), F.lit("")), F.lit(":"), F.coalesce(k, F.lit("")), F.when(t.isNull(), "-").otherwise("+"), F.coalesce(t, F.lit("")))))


def rows_of(docs: DataFrame, kept: DataFrame, key: str, text: str, repeats: bool) -> DataFrame:
    """The rows of docs that kept (_row: digests) names, one of those that repeat both id and text (repeats: there are such)."""
    name = "row_" + uuid.uuid4().hex
    keyed = docs.withColumn(name, row_digest(key, text))
    if repeats:
        keyed = keyed.dropDuplicates([name])  # its partial step leaves one row of a group of repeats in each task
    return keyed.join(kept.withColumnRenamed("_row", name), name, "left_semi").drop(name)


#: The most rows that are broadcast: of ids and digests, of at most some hundred bytes each.
SENT = 500_000


def small(df: DataFrame, rows: int = SENT) -> DataFrame:
    """A written table of narrow rows, with a broadcast hint if it has few."""
    return F.broadcast(df) if df.count() <= rows else df


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver collects what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Written tables of one computation, deleted together when its own result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
        table, path = written(df, name, rows)
        self.paths.append(path)
        return table

    def drop_named(self, name: str, keep: int = 0) -> None:
        """Delete the tables of that name, but the last ones to keep, before the others."""
        old = [p for p in self.paths if p.rsplit("/", 1)[1].startswith(f"{name}-")]
        for p in old[: len(old) - keep]:
            dropped(self.spark, p)
            self.paths.remove(p)
        released(self.spark)

    def drop(self) -> None:
        while self.paths:
            dropped(self.spark, self.paths.pop())
        released(self.spark)


#: Bytes of texts that are worked on at a time.
AT_ONCE = 1 << 20


def blocks(texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of at most AT_ONCE bytes, but for one longer text alone; null is empty."""
    first, size, now = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if now and size + len(t) > AT_ONCE:
            yield first, now
            first, size, now = i, 0, []
        now.append(t)
        size += len(t)
    if now:
        yield first, now


def relieved() -> None:
    """Give memory that a task no longer needs back to the system: workers live on and serve other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: long): root is the smallest node that links reach.

    Alternates large-star and small-star contractions until the edges stay as they are. A star's minimum is a
    partial aggregate and reaches its edges again by a join whose skewed keys adaptive execution can split, so that
    no node gathers its neighbours in one task. Each round is a written table, and the last one goes to scratch.
    Self-links, repeated edges and nulls are dropped.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            break
        was = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new, new_at = written(small.distinct(), "edges")
        dropped(spark, path)
        now, path = new, new_at
    else:
        raise RuntimeError("components did not settle")
    scratch.paths.append(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
