"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector x, less the centre, is scaled to length 1 and rotated at random; its code is the signs of
the components, packed to bits, with two scalars: its distance to the centre and the code's inner
product with what it stands for. With them the code gives an unbiased estimate of the inner product
with a rotated query and a bound on its error. A block of queries scans the codes: the best by
estimate set a threshold, every vector whose lower distance bound stays under it is reranked on the
original vectors, in double precision. All rows are indexed; queries go in blocks, so a task holds one
block of codes and one of queries, and passes on ten rows for each query.

Defined cases: null, zero or non-finite vectors, those with null components, null ids and vectors of
another length than the most frequent (the longest of ties) take no part; of rows that share a query id the smallest
vector is the query; rows that share its id are not candidates; repeated candidate rows are candidates
each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sparkkit import stage

K = 10
EVERY = 100
#: Standard errors of the estimate that the bound allows.
ERRORS = 4.0
#: Queries sent to the tasks at a time, and vectors scanned at a time.
QUERY_BLOCK = 2048
ROW_BLOCK = 4096
#: Rows for the centre; it only sharpens the codes.
CENTRE_ROWS = 10_000


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, distance to the centre, inner product of code and direction)."""
    r = x - centre
    norm = np.sqrt((r * r).sum(1))
    o = (r / np.maximum(norm, 1e-300)[:, None]) @ turn.T
    return np.packbits(o > 0, axis=1), norm, np.abs(o).sum(1) / np.sqrt(x.shape[1])


def _index(centre, turn):
    def run(it: Iterator[pa.RecordBatch]):
        for batch in it:
            v = batch.column("v")
            if not len(v):
                continue
            bits, norm, inner = encode(_vectors(v, len(centre)), centre, turn)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(inner), v], names=["vec_id", "code", "norm", "inner", "v"])

    return run


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, components added from first to last."""
    d = x - q
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


def _search(sent, centre, turn, k, errors):
    def run(it):
        qid, qv = sent.value
        dim = len(centre)
        r = qv - centre
        qn = np.sqrt((r * r).sum(1))
        q = (r / np.maximum(qn, 1e-300)[:, None]) @ turn.T
        best: list[list] = [[] for _ in qid]
        worst = np.full(len(qid), np.inf)
        for batch in it:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            v, norms, inners = _vectors(batch.column("v"), dim), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "inner"))
            packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for a in range(0, len(ids), ROW_BLOCK):
                s = slice(a, a + ROW_BLOCK)
                sign = np.unpackbits(packed[s], axis=1, count=dim).astype(np.float32) * 2 - 1
                inner = np.maximum(inners[s], 1e-9)
                est = (sign @ q.T.astype(np.float32)) / (np.sqrt(dim) * inner)[:, None]
                err = errors * np.sqrt(np.maximum(1 - inner**2, 0) / inner**2 / max(dim - 1, 1))
                n = norms[s][:, None]
                d2 = n**2 + qn[None, :] ** 2
                low = d2 - 2 * n * qn[None, :] * np.minimum(est + err[:, None] + 1e-5, 1)
                for j in range(len(qid)):
                    other = ids[s] != qid[j]
                    if worst[j] == np.inf:
                        rank = np.where(other, d2[:, j] - 2 * n[:, 0] * qn[j] * est[:, j], np.inf)
                        first = np.argpartition(rank, min(k, len(rank)) - 1)[:k]
                        first = first[other[first]]
                        if len(first) == k:
                            worst[j] = exact(v[s][first], qv[j]).max()
                    near = np.flatnonzero(other & (low[:, j] <= worst[j] ** 2 * (1 + 1e-9) + 1e-12))
                    if not len(near):
                        continue
                    got = exact(v[s][near], qv[j])
                    own = best[j] + [(float(d), int(i)) for d, i in zip(got, ids[s][near], strict=True) if d <= worst[j]]
                    own.sort()
                    best[j] = own[:k]
                    if len(best[j]) == k:
                        worst[j] = min(worst[j], best[j][-1][0])
        rows = [(int(i), c, d) for i, own in zip(qid, best, strict=True) for d, c in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    # not null, NaN or infinite: each component less itself is 0
    rows = rows.filter(F.forall("v", lambda c: (c - c).eqNullSafe(F.lit(0.0))) & F.exists("v", lambda c: c != 0))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.filter(F.size("v") == (dims.dim if dims else 0))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, errors: float = ERRORS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = stage(taking_part(vectors), "vectors")
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_ROWS).collect()], np.float64)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre, turn = sample.mean(0), rotation(sample.shape[1])
    index = stage(rows.mapInArrow(_index(centre, turn), "vec_id long, code binary, norm double, inner double, v array<double>"), "index")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    blocks = max(1, -(-n // (block // 2)))  # of half the size, as hashing deals them unevenly
    queries = stage(queries.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks))), "queries")
    found = None
    for b in range(blocks):
        own = queries.filter(F.col("part") == b).orderBy("vec_id").select("vec_id", "v").collect()
        if not own:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in own], np.int64), np.array([r.v for r in own], np.float64)))
        part = index.mapInArrow(_search(sent, centre, turn, k, errors), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
        if b % 16 == 15:
            found = stage(found, "found")
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # at most k rows of each query and task are left
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH part AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i]))), lambda a, b: a + b)) AS score FROM part q JOIN part c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
