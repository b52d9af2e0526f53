"""Pair tables -> graph -> orthogroups (step 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import grouped_quantiles
from ..plans.staging import stage
from .graph import connected_components


def split_renames(pairs: DataFrame) -> DataFrame:
    """genome, tx, gene: split names (<tx>:split) of original genes that have several. pairs: g1, g2, tx1,
    tx2, gene1, gene2, original1, original2."""
    sides = [pairs.select(F.col(f"g{k}").alias("genome"), F.col(f"tx{k}").alias("tx"), F.col(f"gene{k}").alias("gene"), F.col(f"original{k}").alias("original")) for k in (1, 2)]
    rows = sides[0].unionByName(sides[1]).filter(F.col("gene").endswith(":split")).distinct()
    many = rows.groupBy("genome", "original").agg(F.count_distinct("gene").alias("n")).filter("n > 1").drop("n")
    return rows.join(many, ["genome", "original"]).select("genome", "tx", "gene").distinct()


def vertices(pairs: DataFrame) -> DataFrame:
    """name (genome:gene), genome, gene of all genes in pairs."""
    sides = [pairs.select(F.col(f"g{k}").alias("genome"), F.col(f"gene{k}").alias("gene")) for k in (1, 2)]
    return sides[0].unionByName(sides[1]).distinct().select(F.concat_ws(":", "genome", "gene").alias("name"), "genome", "gene")


def edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat_ws(":", "g1", "gene1").alias("src"), F.concat_ws(":", "g2", "gene2").alias("dst"), "mutual_ci", "g1", "g2").distinct()


def partition_components(pairs: DataFrame) -> DataFrame:
    """name, genome, gene, component, n_vertices, n_genomes, simple: one gene a genome at most."""
    pairs = stage(pairs.select("g1", "g2", "gene1", "gene2", F.lit(None).cast("double").alias("mutual_ci")).distinct(), "edges")
    rows = stage(connected_components(edges(pairs).select("src", "dst")).withColumnRenamed("node", "name").join(vertices(pairs), "name"), "rows")
    size = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n_vertices"), F.count_distinct("genome").alias("n_genomes"))
    return rows.join(size, "component").withColumn("simple", F.col("n_vertices") == F.col("n_genomes"))


def colorful_sets(vertex: list[str], colour: dict[str, str], adjacent: dict[str, set[str]]) -> list[tuple[str, ...]]:
    """All connected vertex sets with at most one vertex of a colour that no neighbour of a new colour
    could extend. Sets grow from their smallest vertex; each is met once."""
    rank = {v: k for k, v in enumerate(sorted(vertex))}
    out = []

    def grow(chosen: frozenset, frontier: frozenset, banned: frozenset, colours: frozenset):
        near = {n for v in chosen for n in adjacent[v]} - chosen
        if not any(colour[n] not in colours for n in near):
            out.append(tuple(sorted(chosen)))
        todo = sorted(v for v in frontier if colour[v] not in colours)
        shut = set(banned)
        for v in todo:
            next_front = (frontier | frozenset(adjacent[v])) - {v} - shut - chosen
            grow(chosen | {v}, next_front, frozenset(shut | {v}), colours | {colour[v]})
            shut.add(v)

    for v in sorted(vertex):
        lower = frozenset(u for u in vertex if rank[u] < rank[v])
        grow(frozenset([v]), frozenset(adjacent[v]) - lower, lower | {v}, frozenset([colour[v]]))
    return out


def _enumerate(it: Iterator[pd.DataFrame]):
    """Rows sorted by component -> the maximal sets of each; holds one component."""
    columns = ["set_id", "genome", "gene"]

    def sets_of(rows):
        genome, gene = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
        found = colorful_sets([r[1] for r in rows], genome, {r[1]: set(r[4]) for r in rows})
        return [("|".join(s), genome[v], gene[v]) for s in found for v in s]

    held, out = [], []
    for pdf in it:
        for row in pdf.itertuples(index=False, name=None):
            if held and row[0] != held[0][0]:
                out += sets_of(held)
                held = []
            held.append(row)
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out + sets_of(held), columns=columns)


def orthogroup_members(pairs: DataFrame, max_vertices: int | None = None) -> DataFrame:
    """set_id, genome, gene: the maximal sets. Components with one gene a genome pass as they are; the
    others are enumerated each in one task, unless larger than max_vertices (see skipped_components)."""
    pairs = stage(pairs.select("g1", "g2", "gene1", "gene2", F.lit(None).cast("double").alias("mutual_ci")).distinct(), "pairs")
    part = stage(partition_components(pairs).withColumn("gene", F.col("gene").cast("string")), "parts")
    fast = part.filter("simple").select(F.col("component").alias("set_id"), "genome", "gene")
    rest = part.filter("not simple")
    if max_vertices is not None:
        rest = rest.filter(F.col("n_vertices") <= max_vertices)
    rest = rest.select("component", "name", "genome", "gene")
    link = edges(pairs).select("src", "dst")
    # only edges of components that are to be enumerated
    near = link.unionByName(link.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).join(rest.select(F.col("name").alias("src")), "src", "left_semi")
    near = near.groupBy("src").agg(F.collect_set("dst").alias("near"))
    rows = rest.join(near, rest.name == near.src).select("component", "name", "genome", "gene", "near")
    heavy = rows.repartition("component").sortWithinPartitions("component").mapInPandas(_enumerate, "set_id string, genome string, gene string")
    return fast.unionByName(heavy)


def skipped_components(pairs: DataFrame, max_vertices: int) -> DataFrame:
    return partition_components(pairs).filter((~F.col("simple")) & (F.col("n_vertices") > max_vertices)).select("component", "n_vertices").distinct()


def orthogroups_wide(members: DataFrame, genomes: list[str]) -> DataFrame:
    """A column of genes for each genome, null where a set has none."""
    return members.groupBy("set_id").pivot("genome", genomes).agg(F.first("gene")).select(*genomes)


def pairwise_groups(members: DataFrame) -> DataFrame:
    """g1, g2, gene1, gene2: distinct pairs of genes in one set."""
    a = members.select("set_id", F.col("genome").alias("g1"), F.col("gene").alias("gene1"))
    b = members.select("set_id", F.col("genome").alias("g2"), F.col("gene").alias("gene2"))
    return a.join(b, "set_id").filter("g1 < g2").select("g1", "g2", "gene1", "gene2").distinct()


def reorganised_orphans(members: DataFrame, genes: DataFrame, genomes: list[str]) -> DataFrame:
    """g1, g2, genome, gene: genes that are in no pair of the reorganised tables."""
    pairs = pairwise_groups(members)
    used = pairs.select(F.explode(F.array(F.struct("g1", "g2", F.col("g1").alias("genome"), F.col("gene1").alias("gene")), F.struct("g1", "g2", F.col("g2").alias("genome"), F.col("gene2").alias("gene")))).alias("u")).select("u.*").distinct()
    every = genes.filter(F.col("genome").isin(*genomes)).select("genome", F.col("gene").cast("string").alias("gene"), F.explode(F.array(*map(F.lit, sorted(genomes)))).alias("other")).filter("genome <> other")
    every = every.select(F.least("genome", "other").alias("g1"), F.greatest("genome", "other").alias("g2"), "genome", "gene")
    return every.join(used, ["g1", "g2", "genome", "gene"], "left_anti")


def component_stats(pairs: DataFrame) -> DataFrame:
    """component, nE, nV, nGenome and max, q1, median, q3, min, mean, sd of mutual_ci."""
    e = stage(edges(pairs), "edges")
    comp = stage(connected_components(e.select("src", "dst")), "components")
    rows = e.join(comp.withColumnRenamed("node", "src"), "src")
    size = comp.withColumn("genome", F.substring_index("node", ":", 1)).groupBy("component").agg(F.count(F.lit(1)).alias("nV"), F.count_distinct("genome").alias("nGenome"))
    return rows.groupBy("component").agg(*edge_stats()).join(size, "component")


def edge_stats() -> list:
    q = lambda p: F.round(F.percentile("mutual_ci", F.lit(p)), 6)
    return [
        F.count(F.lit(1)).alias("nE"), F.round(F.max("mutual_ci"), 6).alias("max"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"),
        F.round(F.min("mutual_ci"), 6).alias("min"), F.round(F.avg("mutual_ci"), 6).alias("mean"), F.round(F.stddev_samp("mutual_ci"), 6).alias("sd"),
    ]


def genome_pair_stats(pairs: DataFrame) -> DataFrame:
    """edge_stats of each genome pair: few groups with any number of rows, so no group's values are held at once."""
    rows = stage(pairs.select("g1", "g2", "mutual_ci"), "scores")
    others = [F.count(F.lit(1)).alias("nE"), F.max("mutual_ci").alias("max"), F.min("mutual_ci").alias("min"), F.avg("mutual_ci").alias("mean"), F.stddev_samp("mutual_ci").alias("sd")]
    found = grouped_quantiles(rows, ["g1", "g2"], "mutual_ci", {"q1": 0.25, "median": 0.5, "q3": 0.75}, others)
    return found.select("g1", "g2", "nE", *(F.round(c, 6).alias(c) for c in ("max", "q1", "median", "q3", "min", "mean", "sd")))
