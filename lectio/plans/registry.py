"""Registration of queries that are written once, as SQL text for either dialect."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectio.functions.dialect import Dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def views(spark: SparkSession, sf_dir: str, sql: Callable[[Dialect], str]) -> str:
    """The Spark SQL of a query, with a view of each table that it names."""
    prefix = f"t{zlib.crc32(sf_dir.encode()):08x}_"
    text = sql(Dialect(False, prefix))
    for table in TABLES:
        if prefix + table in text:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(prefix + table)
    return text


def query(sql: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """Registers a function from a dialect to SQL under its name."""
    QUERIES[sql.__name__] = lambda spark, sf_dir: spark.sql(views(spark, sf_dir, sql))
    ORACLE_SQL[sql.__name__] = sql(Dialect(True))
    return sql


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, *columns: str) -> DataFrame:
        got = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return got.select(*columns) if columns else got


def paired(oracle: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a plan over tables beside SQL for DuckDB that is written by hand and by another way: from what the plan's input was made of, where that can be."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        ORACLE_SQL[plan.__name__] = oracle
        return plan

    return register


def rows_only(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query that SQL can't express."""
    QUERIES[plan.__name__] = plan
    return plan
