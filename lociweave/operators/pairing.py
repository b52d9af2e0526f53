"""Scored gene pairs of all genome pairs at once -> anchors, syntenic hits, classes, orphans, summaries.

A pair table has g1, g2 (genomes), gene1, gene2, ci_q2s, ci_s2q, pident, mutual_ci, unique by (g1, g2,
gene1, gene2); chr1, chr2, pos1, pos2 where places matter. A table cut to the rows that lead one of their genes gives
the same best pairs; it brings n1, n2, its genes' numbers of pairs in the whole table. (g1, g2) leads every key. All ranks are total:
ties go by mutual_ci descending, then the genes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import fences, fences_of, grouped_quantiles
from ..plans.staging import stage
from .graph import connected_components

PAIR = ["g1", "g2"]


def _tie() -> list[Column]:
    return [F.desc("mutual_ci"), F.asc("gene1"), F.asc("gene2")]


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark limits each partition's group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def dedup_gene_pairs(hits: DataFrame, tie: list[Column] | None = None) -> DataFrame:
    """The best hit of each gene pair."""
    return first_by(hits, [*PAIR, "gene1", "gene2"], tie or _tie())


def _best_flags(pairs: DataFrame, counts: bool = False) -> DataFrame:
    """pairs with r1, r2: ranks among gene1's and gene2's pairs; with counts also n1, n2: how many these are. One
    pass, a shuffle for each side."""
    one, two = Window.partitionBy(*PAIR, "gene1"), Window.partitionBy(*PAIR, "gene2")
    new = {"r2": F.row_number().over(two.orderBy(F.desc("ci_s2q"), F.desc("ci_q2s"), *_tie()))}
    if counts:
        new["n2"] = F.count(F.lit(1)).over(two)
    pairs = pairs.withColumns(new)
    new = {"r1": F.row_number().over(one.orderBy(F.desc("ci_q2s"), *_tie()))}
    if counts:
        new["n1"] = F.count(F.lit(1)).over(one)
    return pairs.withColumns(new)


def reciprocal_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of either gene."""
    return _best_flags(pairs).filter("r1 = 1 and r2 = 1").drop("r1", "r2")


def untangle(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of one of their genes."""
    return _best_flags(pairs).filter("r1 = 1 or r2 = 1").drop("r1", "r2")


def _counted(pairs: DataFrame) -> bool:
    return {"n1", "n2"} <= set(pairs.columns)


def _within_copies(counted: DataFrame) -> DataFrame:
    """counted (with n1, n2) without rows that have more of both than the upper fences."""
    limit = fences_of(counted, PAIR, {"f1": "n1", "f2": "n2"})
    return counted.join(limit, PAIR).filter("not (n1 > f1_high and n2 > f2_high)").select(*counted.columns)


def drop_high_copy(best: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without reciprocal bests both of whose genes have more hits than the upper fence of their side."""
    if _counted(best):
        return _within_copies(stage(best, "best"))
    n1 = pairs.groupBy(*PAIR, "gene1").agg(F.count(F.lit(1)).alias("n1"))
    n2 = pairs.groupBy(*PAIR, "gene2").agg(F.count(F.lit(1)).alias("n2"))
    return _within_copies(best.join(n1, [*PAIR, "gene1"]).join(n2, [*PAIR, "gene2"])).select(*best.columns)


def identity_fence(rows: DataFrame) -> DataFrame:
    return rows.join(fences(rows, PAIR, "pident"), PAIR).filter("pident >= fence_low").select(*rows.columns)


def anchors(pairs: DataFrame) -> DataFrame:
    """identity_fence(drop_high_copy(reciprocal_best(pairs), pairs)), with pairs read once: the bests, far fewer,
    are written with their genes' counts before the fences read them."""
    counted = stage(_best_flags(pairs, counts=not _counted(pairs)).filter("r1 = 1 and r2 = 1").drop("r1", "r2"), "best")
    return identity_fence(_within_copies(counted).drop("n1", "n2")).select(*(c for c in pairs.columns if c not in ("n1", "n2")))


#: Pairs of one chromosome pair that a task takes; more are dealt to several, each with the anchors.
NEAR_ROWS = 500_000


def nearest(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, omit_zero: bool) -> np.ndarray:
    """L1 distance of each point (x, y) to the nearest of the anchors (a, b), a ascending; infinite if none. Goes
    outwards along a from x until no anchor further off can be nearer."""
    best = np.full(len(x), np.inf)
    for step in (1, -1):
        at = np.searchsorted(a, x) if step == 1 else np.searchsorted(a, x) - 1
        open_ = np.arange(len(x))
        while len(open_):
            inside = (at >= 0) & (at < len(a))
            open_, at = open_[inside], at[inside]
            along = np.abs(a[at] - x[open_])
            near = along < best[open_]
            open_, at, along = open_[near], at[near], along[near]
            d = along + np.abs(b[at] - y[open_])
            if omit_zero:
                d = np.where(d == 0, np.inf, d)
            best[open_] = np.minimum(best[open_], d)
            at = at + step
    return best


def _near_rows(omit_zero: bool, whole: bool):
    """Rows sorted by (__gid, __salt, __kind): anchors of a group, then its pairs, which go on with dist."""

    def run(it: Iterator[pa.RecordBatch]):
        group, a, b, ready = None, [], [], None
        for batch in it:
            gid, salt, kind = (batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("__gid", "__salt", "__kind"))
            x, y = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("pos1", "pos2"))
            dist = np.full(len(gid), np.inf)
            cuts = np.flatnonzero((gid[1:] != gid[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(gid)]):
                if i == j:
                    continue
                if (gid[i], salt[i]) != group:
                    group, a, b, ready = (gid[i], salt[i]), [], [], None
                if kind[i] == 0:
                    a.append(x[i:j])
                    b.append(y[i:j])
                    continue
                if ready is None and a:
                    p, q = np.concatenate(a), np.concatenate(b)
                    order = np.argsort(p, kind="stable")
                    ready = (p[order], q[order])
                if ready is not None:
                    some = ~(np.isnan(x[i:j]) | np.isnan(y[i:j]))
                    part = np.full(j - i, np.inf)
                    part[some] = nearest(x[i:j][some], y[i:j][some], *ready, omit_zero)
                    dist[i:j] = part
            keep = kind == 1
            out = pa.array(np.where(np.isfinite(dist), dist, 0)[keep], mask=~np.isfinite(dist[keep]))
            rows = batch.filter(pa.array(keep)).drop_columns(["__salt", "__kind"])
            yield rows.append_column("dist", out.cast(pa.int64()) if whole else out)

    return run


def nearest_anchor(pairs: DataFrame, anchor: DataFrame, omit_zero: bool = False) -> DataFrame:
    """pairs with dist: L1 distance to the nearest anchor of the same two chromosomes, null if none; with omit_zero
    not its own place. Places are exact up to 2^53.

    Pairs are dealt once by chromosome pair, in portions of `NEAR_ROWS`, and meet the sorted anchors there: anchors
    are one to one, so a chromosome pair has no more of them than genes.
    """
    spot = [*PAIR, "chr1", "chr2"]
    groups = pairs.filter("chr1 is not null and chr2 is not null").groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / NEAR_ROWS).alias("__parts"))
    groups = stage(groups.withColumn("__gid", F.monotonically_increasing_id()), "groups")
    portion = F.pmod(F.xxhash64("gene1", "gene2"), F.col("__parts"))
    rows = pairs.join(groups, spot, "left").withColumn("__salt", F.coalesce(portion, F.lit(0))).withColumn("__kind", F.lit(1))
    a = anchor.filter("pos1 is not null and pos2 is not null").select(*spot, "pos1", "pos2").distinct().join(groups, spot)
    a = a.select("__gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__salt"), F.lit(0).alias("__kind"), "pos1", "pos2")
    # rows of a known group leave its texts behind; the few others have no anchor
    sent = [f for f in pairs.schema.fields if f.name not in spot]
    both = rows.filter("__gid is not null").select(*(f.name for f in sent), "__gid", "__salt", "__kind").unionByName(a, allowMissingColumns=True)
    both = both.repartition("__gid", "__salt").sortWithinPartitions("__gid", "__salt", "__kind")
    whole = all(isinstance(pairs.schema[c].dataType, T.IntegralType) for c in ("pos1", "pos2"))
    kind = T.LongType() if whole else T.DoubleType()
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in sent), T.StructField("__gid", T.LongType()), T.StructField("dist", kind)])
    out = both.mapInArrow(_near_rows(omit_zero, whole), schema).join(groups.drop("__parts"), "__gid").select(*pairs.columns, "dist")
    return out.unionByName(pairs.filter("chr1 is null or chr2 is null").withColumn("dist", F.lit(None).cast(kind)))


def syntenic_hits(pairs: DataFrame, anchor: DataFrame) -> DataFrame:
    """pairs with dist and is_anchor_pair: anchors, and what is nearer to one than the upper fence of the
    anchors' distances to each other."""
    anchor = stage(anchor, "anchors")
    own = nearest_anchor(anchor, anchor, omit_zero=True)
    limit = stage(fences(own.filter("dist is not null"), PAIR, "dist"), "limit")
    flag = anchor.select(*PAIR, "gene1", "gene2", F.lit(True).alias("is_anchor_pair"))
    # distances are computed once and cut down before they meet the anchors
    rows = nearest_anchor(pairs, anchor).join(limit, PAIR, "left").join(flag, [*PAIR, "gene1", "gene2"], "left")
    rows = rows.withColumn("is_anchor_pair", F.coalesce("is_anchor_pair", F.lit(False)))
    return rows.filter("dist < fence_high or is_anchor_pair").drop("fence_low", "fence_high")


def pair_class(pairs: DataFrame) -> DataFrame:
    """pairs with class: 1to1, 1toM, Mto1 or MtoM of the component, told from neighbours alone: a component
    is a star round gene1 if all of gene1's partners have no other."""
    w1, w2 = Window.partitionBy(*PAIR, "gene1"), Window.partitionBy(*PAIR, "gene2")
    rows = pairs.withColumn("d1", F.count(F.lit(1)).over(w1)).withColumn("d2", F.count(F.lit(1)).over(w2)).withColumn("m1", F.max("d1").over(w2))
    rows = rows.withColumn("m2", F.max("d2").over(w1))
    kind = F.when((F.col("d1") == 1) & (F.col("d2") == 1), "1to1").when((F.col("d2") > 1) & (F.col("m1") == 1), "Mto1").when((F.col("d1") > 1) & (F.col("m2") == 1), "1toM").otherwise("MtoM")
    return rows.withColumn("class", kind).drop("d1", "d2", "m1", "m2")


def _node(gene: str, side: str) -> Column:
    return F.concat_ws("|", "g1", "g2", F.lit(side), F.col(gene).cast("string"))


def components(pairs: DataFrame) -> DataFrame:
    """pairs with component: its smallest gene1 within the genome pair."""
    pairs = stage(pairs, "pairs")  # read for the edges and again for the result
    found = connected_components(pairs.select(_node("gene1", "1").alias("src"), _node("gene2", "2").alias("dst")))
    label = pairs.select(*PAIR, "gene1").distinct().join(found, _node("gene1", "1") == F.col("node")).drop("node")
    label = stage(label, "label")
    least = label.groupBy("component").agg(F.min("gene1").alias("__least"))
    label = label.join(least, "component").select(*PAIR, "gene1", F.col("__least").alias("component"))
    return pairs.join(label, [*PAIR, "gene1"]).select(*pairs.columns, "component")


def sog_ids(pairs: DataFrame) -> DataFrame:
    """pairs with class and SOG: components numbered from 1 in each genome pair, by smallest gene1. The
    numbers are ranked on one row for each component."""
    rows = stage(components(pair_class(pairs)), "classed")
    rank = F.row_number().over(Window.partitionBy(*PAIR).orderBy("component")).cast("long")
    ids = rows.select(*PAIR, "component").distinct().withColumn("SOG", rank)
    return rows.join(ids, [*PAIR, "component"]).drop("component")


def split_genes(classified: DataFrame) -> DataFrame:
    """classified pairs with is_split1, is_split2. In Mto1 gene2's transcripts with one partner, in MtoM
    those of genes with several rows become genes of their own; 1toM never splits. Needs tx1, tx2."""
    partners1 = F.size(F.collect_set("tx2").over(Window.partitionBy(*PAIR, "tx1")))
    partners2 = F.size(F.collect_set("tx1").over(Window.partitionBy(*PAIR, "tx2")))
    rows1, rows2 = F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "gene1")), F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "gene2"))
    kind = F.col("class")
    return (
        classified.withColumn("__p1", partners1).withColumn("__p2", partners2).withColumn("__n1", rows1).withColumn("__n2", rows2)
        .withColumn("is_split1", (kind == "MtoM") & (F.col("__n1") > 1) & (F.col("__p1") == 1))
        .withColumn("is_split2", ((kind == "Mto1") & (F.col("__p2") == 1)) | ((kind == "MtoM") & (F.col("__n2") > 1) & (F.col("__p2") == 1)))
        .drop("__p1", "__p2", "__n1", "__n2")
    )


def filter_pairs(pairs: DataFrame) -> DataFrame:
    """Untangled pairs whose component reaches a lower fence of the components' best scores; rows that are
    no anchors also need their component's best non-anchor identity to reach its fence. Needs
    is_anchor_pair."""
    rows = stage(sog_ids(untangle(pairs)), "sog")  # read by each fence
    key = [*PAIR, "SOG"]
    best = rows.groupBy(*key).agg(
        F.max("ci_q2s").alias("b1"), F.max("ci_s2q").alias("b2"), F.max("pident").alias("b3"), F.max(F.when(~F.col("is_anchor_pair"), F.col("pident"))).alias("b4")
    )
    best = stage(best, "components")
    limits = fences_of(best, PAIR, {k: k for k in ("b1", "b2", "b3", "b4")})
    rows = rows.join(best, key).join(limits, PAIR, "left")
    any_ = "(b1 >= b1_low or b2 >= b2_low or b3 >= b3_low)"
    return rows.filter(f"{any_} and (is_anchor_pair or b4 >= b4_low)").select(*pairs.columns, "class", "SOG")


def orphans(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """g1, g2, genome, gene: genes (genome, gene) of either genome in no pair. pairs are read four times."""
    pair_ids = pairs.select(*PAIR).distinct()
    sides = []
    for g, gene in (("g1", "gene1"), ("g2", "gene2")):
        every = pair_ids.join(genes, pair_ids[g] == genes.genome).select(*PAIR, "genome", "gene")
        used = pairs.select(*PAIR, F.col(g).alias("genome"), F.col(gene).alias("gene")).distinct()
        sides.append(every.join(used, [*PAIR, "genome", "gene"], "left_anti"))
    return sides[0].unionByName(sides[1])


def mutual_ci_stats(pairs: DataFrame) -> DataFrame:
    """genome1, genome2 (ordered), n_pairs, mean, sd, median, q10, q25, q75, q90 of finite mutual_ci."""
    rows = pairs.filter("mutual_ci is not null and not isnan(mutual_ci) and abs(mutual_ci) < double('infinity')")
    rows = stage(rows.select(F.least("g1", "g2").alias("genome1"), F.greatest("g1", "g2").alias("genome2"), "mutual_ci"), "scores")
    others = [F.count(F.lit(1)).alias("n_pairs"), F.avg("mutual_ci").alias("mean"), F.stddev_samp("mutual_ci").alias("sd")]
    names = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    rows = grouped_quantiles(rows, ["genome1", "genome2"], "mutual_ci", names, others)
    return rows.select("genome1", "genome2", "n_pairs", *(F.round(c, 6).alias(c) for c in ("mean", "sd", *names)))


def mean_ci_matrix(pairs: DataFrame, genomes: list[str]) -> DataFrame:
    """genome and a column for each genome: symmetric means, null on the diagonal."""
    stats = mutual_ci_stats(pairs)
    both = stats.select(F.col("genome1").alias("genome"), F.col("genome2").alias("other"), "mean").unionByName(stats.select(F.col("genome2").alias("genome"), F.col("genome1").alias("other"), "mean"))
    return both.groupBy("genome").pivot("other", genomes).agg(F.first("mean"))


#: Classes in reporting order.
CLASSES = ("1to1", "1toM", "Mto1", "MtoM")


def pair_summary(classified: DataFrame, genes: DataFrame) -> DataFrame:
    """g1, g2, label, genome1, genome2: counts and ratios of genes by class, one row for each label."""
    classified = stage(classified, "classified")  # read six times
    orphan = orphans(classified, genes).groupBy(*PAIR, "genome").count()
    sides = []
    for k, (g, gene) in enumerate((("g1", "gene1"), ("g2", "gene2")), 1):
        first = first_by(classified, [*PAIR, gene], _tie()).withColumn("side", F.lit(k)).withColumn("genome", F.col(g))
        counts = first.groupBy(*PAIR, "side", "genome").agg(*(F.sum(F.when(F.col("class") == c, 1).otherwise(0)).alias(c) for c in CLASSES))
        sides.append(counts)
    rows = sides[0].unionByName(sides[1]).join(orphan, [*PAIR, "genome"], "left").withColumn("Orphan", F.coalesce("count", F.lit(0)))
    rows = rows.withColumn("Classified", sum((F.col(c) for c in CLASSES), F.lit(0))).withColumn("Total", F.col("Classified") + F.col("Orphan"))
    labels = ["Total", "Classified", *CLASSES, "Orphan"]
    cells = [F.struct(F.lit(x).alias("label"), F.col(x).cast("double").alias("v")) for x in labels]
    cells += [F.struct(F.lit(f"{x}_ratio").alias("label"), F.round(F.col(x) / F.col("Total"), 4).alias("v")) for x in labels]
    long = rows.select(*PAIR, "side", F.explode(F.array(*cells)).alias("c")).select(*PAIR, "side", "c.*")
    return long.groupBy(*PAIR, "label").pivot("side", [1, 2]).agg(F.first("v")).withColumnsRenamed({"1": "genome1", "2": "genome2"})


#: Column groups of a pair table; both spellings of the directional scores are known.
SCORE = ("pident", "mutual_ci", "ci_q2s", "ci_s2q", "is_anchor_pair")
PLACE = ("chr1", "chr2", "pos1", "pos2")


def get_pairs(pairs: DataFrame, genomes: tuple[str, str] | None = None, score: bool = False, loc: bool = False) -> DataFrame:
    """Pairs of two genomes, in either order, with the column groups asked for, as far as they exist."""
    wanted = [*PAIR, "gene1", "gene2", "class", "SOG", *(SCORE if score else ()), *(PLACE if loc else ())]
    if genomes:
        a, b = genomes
        pairs = pairs.filter(F.col("g1").isin(a, b) & F.col("g2").isin(a, b) & (F.col("g1") != F.col("g2")))
    out = pairs.select(*(c for c in wanted if c in pairs.columns))
    if score:
        out = out.withColumns({new: F.col(old) for new, old in (("q2s_ci", "ci_q2s"), ("s2q_ci", "ci_s2q")) if old in out.columns})
    return out
