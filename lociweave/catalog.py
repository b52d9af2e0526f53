"""All queries of the library's own operators, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import features, pairs

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (pairs, features)


def queries() -> dict[str, Query]:
    return {n: q for m in MODULES for n, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for m in MODULES for n, q in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: anchors of all genome pairs."""
    return pairs.anchors(spark, sf_dir)
