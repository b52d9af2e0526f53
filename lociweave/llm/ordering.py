"""Global numbering without a global sort in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sparkkit import stage


def _local(it):
    n = 0
    for batch in it:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))], names=[*batch.schema.names, "__local"])
        n += batch.num_rows


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' ranks from 0, ordered by `order`: range-partitioned and sorted, numbered in
    each partition, shifted by the partitions' counts (one driver row for each partition). df should
    be cheap to read twice, as range bounds are sampled first."""
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())])
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    rows = stage(rows.mapInArrow(_local, schema), "numbered")
    counts = sorted(rows.groupBy("__part").count().collect())
    shift, at = [], 0
    for part, n in counts:
        shift.append((part, at))
        at += n
    base = spark.createDataFrame(shift, "__part int, __base long")
    return rows.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__local")).drop("__part", "__local", "__base")
