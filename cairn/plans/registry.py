"""How a query is declared with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables under its name."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: The least bytes of a table that is worth dealing out to idle cores, and the bytes of a split.
WORTH, SPLIT = 4 << 20, 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt out to all of them; others are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if WORTH <= size < cores * SPLIT and len(df.inputFiles()) < cores else df


class Tables:
    """Tables of a directory by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
