"""Connected components: local forests, then one bounded task or alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage

#: Edges that one task solves, about 100 bytes each; more are solved in rounds over the cluster.
ONE_TASK = 500_000
#: Edges that a worker holds at a time to reduce them to a forest.
FOREST = 500_000


def roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, smallest node of each one's component)."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = at[: len(src)], at[len(src) :]
    up = np.arange(len(nodes))
    while True:
        a, b = up[u], up[v]
        apart = a != b
        if not apart.any():
            return nodes, nodes[up]
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := up[up], up):
            up = above


def _forest(limit: int | None, names: list[str]):
    """Edges -> (node, its smallest connected node) for every node, of `limit` edges at a time."""

    def out(parts):
        if parts:
            node, root = roots(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
            for a in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[a : a + 100_000]), pa.array(root[a : a + 100_000])], names=names)

    def run(it: Iterator[pa.RecordBatch]):
        parts, held = [], 0
        for batch in it:
            if batch.num_rows:
                parts.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
                held += batch.num_rows
            if limit and held >= limit:
                yield from out(parts)
                parts, held = [], 0
        yield from out(parts)

    return run


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.*")


def _stars(e: DataFrame, rounds: int) -> DataFrame:
    """(src, dst) with dst the smallest node connected with src, by alternating stars.

    Each round links all larger neighbours of a node to its smallest neighbour (large star), then all
    smaller ones and itself (small star): O(log^2 n) rounds, whatever the diameter. Minima are partial
    aggregates, written out before they meet the edges: then the join is one of two plain shuffles, which a
    hub's edges leave in several parts (skew join) or which is a broadcast. Only a count and a checksum reach
    the driver.
    """
    before = None
    for _ in range(rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return e
        before = tuple(mark)
        adj = _both_ways(e)
        least = stage(adj.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stage(adj.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct(), "large")
        # small star: edges point from larger to smaller
        down = stage(large.groupBy("src").agg(F.min("dst").alias("m")), "down")
        small = large.join(down, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e")).select("e.*")
        e = stage(small.where("src <> dst").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def connected_components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of edges (src, dst); component is its smallest node.

    Every task first reduces its edges to a forest. A forest of up to `one_task` edges is solved in one task; a
    larger one in rounds (`_stars`). Nodes that are not whole numbers go by a 64-bit hash; should two of them share
    one, they go in rounds as they are. Self-loops give a component of one.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    kind = e.schema["src"].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        e = stage(e.distinct(), "edges")
        ends = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).groupBy(F.xxhash64("src").alias("id")).agg(F.min("src").alias("node"), F.max("src").alias("other"))
        ends = stage(ends, "ends")
        if ends.filter("node <> other").isEmpty():
            found = connected_components(e.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")), rounds, one_task)
            rows = stage(ends.select(F.col("id"), F.col("node").alias("name")).join(found, F.col("id") == F.col("node")).select("name", "component"), "rows")
            least = rows.groupBy("component").agg(F.min("name").alias("least"))
            return rows.join(least, "component").select(F.col("name").alias("node"), F.col("least").alias("component"))
        nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        e = e.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    else:
        long = e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        e = stage(long.mapInArrow(_forest(FOREST, ["src", "dst"]), "src long, dst long").distinct(), "forest")
        if e.count() <= one_task:
            found = e.coalesce(1).mapInArrow(_forest(None, ["node", "component"]), "node long, component long")
            return stage(found, "components").select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
        nodes = e.select(F.col("src").alias("node")).distinct()
        e = e.where("src <> dst")
    label = _stars(stage(e, "edges"), rounds).groupBy("src").agg(F.min("dst").alias("component"))
    out = nodes.join(label, nodes.node == label.src, "left").select("node", F.coalesce("component", "node").alias("component"))
    return out.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
