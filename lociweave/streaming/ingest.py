"""Hits as they arrive: normalised into a table that the reciprocal step reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hits import normalize
from ..sources.readers import HIT_COLUMNS


def read_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.text(folder).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= len(HIT_COLUMNS))
    return rows.select(*(F.col("c")[k].try_cast(t).alias(n) for k, (n, t) in enumerate(HIT_COLUMNS)))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """A query that appends normalised segments of new files to `target`, each file once."""
    return normalize(read_hits(spark, folder)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
