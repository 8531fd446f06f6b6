"""How query modules register a callable and its SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE

#: The generated tables lack these columns; both sides derive them the same way. Never the present time.
AS_OF = "2025-06-01 00:00:00"
LEVEL_SQL = "CASE doc_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'semi_official' ELSE 'third_party' END"
FETCHED_SQL = f"(TIMESTAMP '{AS_OF}' - (doc_id % 400) * INTERVAL 1 DAY - INTERVAL 5 HOUR)"
WS = SPACE


def level(key: str = "doc_id") -> Column:
    return F.when(F.col(key) % 3 == 0, "official").when(F.col(key) % 3 == 1, "semi_official").otherwise("third_party")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def fetched_at(key: str = "doc_id") -> Column:
    return F.timestamp_micros(F.unix_micros(as_of()) - ((F.col(key) % 400) * 24 + 5) * 3_600_000_000)


def register(queries: dict, oracles: dict, sql: str | None = None) -> Callable:
    def take(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        queries[fn.__name__] = fn
        if sql is not None:
            oracles[fn.__name__] = sql
        return fn

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
