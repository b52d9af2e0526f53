"""Sharding by sampled splitters.

Records are put in order of a key whose high bits come from the text and low bits from the doc_id: equal
texts stand together, and a hot group can still be divided. A sample of keys, drawn in proportion to
size, gives quantile boundaries of many small ranges; ranges whose exact bytes are over twice the
mean are subdivided by the keys that lie in them. The ranges are sorted apart from one another, and
with their exact totals every record knows the bytes before it; shard k takes the records whose
middle lies in the k-th part of all bytes. So law `bytes`: a shard is off by a record at most.

Defined cases: null text is empty (size 8, crc 0); null doc_id has a key of its own; repeated rows are
placed each; shards may stay empty if there are fewer records; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sparkkit import stage

SHARDS = 24
#: Sampled keys (16 bytes each to the driver) and ranges, whatever the input.
SAMPLES = 40_000
RANGES = 384
LOW = 24


def _ranged(cuts: np.ndarray):
    def run(it):
        for batch in it:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(cuts, key, side="right").astype(np.int32))], names=[*batch.schema.names, "part"])

    return run


def _placed(before: np.ndarray, total: int, shards: int):
    """Rows sorted by part and key; before: bytes in earlier parts."""

    def run(it):
        part_now, cum, shard_now, n = -1, 0, -1, 0
        for batch in it:
            part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            size = batch.column("size").to_numpy(zero_copy_only=False)
            if not len(part):
                continue
            run_sum = np.cumsum(size) - size
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            length = np.diff(np.append(first, len(part)))
            start = run_sum[first].copy()
            if part[0] == part_now:
                start[0] -= cum
            inside = run_sum - np.repeat(start, length)
            middle2 = 2 * (before[part] + inside) + size
            shard = np.minimum(middle2.astype(object) * shards // (2 * total), shards - 1).astype(np.int64) if total > 1 << 55 else np.minimum(middle2 * shards // (2 * total), shards - 1)
            key = part * shards + shard
            first_k = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length_k = np.diff(np.append(first_k, len(key)))
            local = np.arange(len(key)) - np.repeat(first_k, length_k)
            if key[0] == part_now * shards + shard_now:
                local[: length_k[0]] += n
            part_now, shard_now, n = int(part[-1]), int(shard[-1]), int(local[-1]) + 1
            cum = int(inside[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(local)], names=[*batch.schema.names, "shard", "local"])

    return run


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    low = (1 << LOW) - 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.lit(1), "doc_id").bitwiseAND(F.lit(low))).alias("key"),
    )
    rows = stage(rows, "records")
    total = rows.agg(F.sum("size")).first()[0] or 1
    # drawn by a hash of the record, not at random: the same again after a lost task
    chance = F.pmod(F.xxhash64(F.lit(7), "key", "text_crc32"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = np.sort(np.array([r[0] for r in rows.filter(chance < F.col("size") * F.lit(samples / total)).select("key").collect()], np.int64))
    cuts = np.unique(drawn[np.linspace(0, len(drawn), ranges + 1)[1:-1].astype(int)]) if len(drawn) >= ranges else np.unique(drawn)
    for _ in range(4):
        parts = rows.mapInArrow(_ranged(cuts), "doc_id long, size long, text_crc32 long, key long, part int")
        sums = parts.groupBy("part").agg(F.sum("size"), F.min("key"), F.max("key")).collect()
        over = [(lo, hi, s) for _, s, lo, hi in sums if s > 2 * total / ranges and hi > lo]
        if not over or len(cuts) > 4 * ranges:
            break
        more = [int(lo) + (int(hi) - int(lo)) * k // (n := int(min(16, s * ranges // total + 1))) for lo, hi, s in over for k in range(1, int(min(16, s * ranges // total + 1)))]
        cuts = np.unique(np.concatenate([cuts, np.array(more, np.int64)]))
    before = np.zeros(len(cuts) + 1, np.int64)
    for part, s, _, _ in sums:
        before[part] = s
    before = np.cumsum(before) - before
    rows = parts.repartition("part").sortWithinPartitions("part", "key", "doc_id", "size", "text_crc32")
    rows = stage(rows.mapInArrow(_placed(before, int(total), shards), "doc_id long, size long, text_crc32 long, key long, part int, shard int, local long"), "placed")
    base, at = [], {}
    for part, shard, n in sorted(rows.groupBy("part", "shard").count().collect()):
        base.append((part, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + n
    base = spark.createDataFrame(base, "part int, shard int, base long")  # a row for each range and cut
    return rows.join(F.broadcast(base), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
