"""Syntenic joins, blocks and the tables behind a ribbon plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .intervals import flanking

PAIR = ["g1", "g2"]


def syntenic_join(pairs: DataFrame, anchor: DataFrame, genes: DataFrame) -> DataFrame:
    """Pairs whose gene1 has a flanking anchor whose partner flanks gene2; with is_anchor_pair. genes:
    genome, gene, chr; places are genes themselves."""
    ids = stage(pairs.select(*PAIR).distinct().withColumn("__pair", F.monotonically_increasing_id()), "ids")

    def flanks(g, k):
        own = anchor.select(*PAIR, F.col(f"gene{k}").alias("gene"), F.lit(True).alias("__a"))
        rows = ids.join(genes, ids[g] == genes.genome).join(own, [*PAIR, "gene"], "left").withColumn("__a", F.coalesce("__a", F.lit(False)))
        return flanking(rows, ["__pair", "chr"], "gene", "__a").select("__pair", F.col("gene").alias(f"gene{k}"), F.col("anchor_at").alias(f"root{k}"))

    # the anchors that either gene reaches, by their gene2: every pair meets each list once
    link = anchor.join(ids, PAIR).select("__pair", F.col("gene1").alias("root1"), F.col("gene2").alias("root2"))
    near1 = flanks("g1", 1).join(link, ["__pair", "root1"]).groupBy("__pair", "gene1").agg(F.collect_set("root2").alias("__near1"))
    near2 = flanks("g2", 2).groupBy("__pair", "gene2").agg(F.collect_set("root2").alias("__near2"))
    keyed = pairs.join(F.broadcast(ids), PAIR).select("__pair", "gene1", "gene2")
    half = stage(keyed.join(near1, ["__pair", "gene1"]), "half")  # else two shuffles of all pairs lie on disk at once
    reached = half.join(near2, ["__pair", "gene2"]).filter(F.arrays_overlap("__near1", "__near2"))
    rows = reached.select("__pair", "gene1", "gene2").distinct().join(F.broadcast(ids), "__pair").select(*PAIR, "gene1", "gene2")
    flag = anchor.select(*PAIR, "gene1", "gene2", F.lit(True).alias("is_anchor_pair"))
    return rows.join(flag, [*PAIR, "gene1", "gene2"], "left").withColumn("is_anchor_pair", F.coalesce("is_anchor_pair", F.lit(False)))


def anchor_blocks(rows: DataFrame, keys: list[str], order: list[str], anchor: str = "is_anchor_pair") -> DataFrame:
    """rows with block: runs of consecutive anchor rows in order; null for others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w) - F.sum(F.when(F.col(anchor), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__gap", F.when(F.col(anchor), n))
    return rows.withColumn("block", F.when(F.col(anchor), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__gap"))))).drop("__gap")


def synteny_blocks(rows: DataFrame, keys: list[str], order: list[str], own_anchor: str, anchor: str = "is_anchor_pair") -> DataFrame:
    """rows with synteny_block. own_anchor: the place, in `order`, of the anchor a row belongs to. Gaps take
    their rows' block; a gap that touches several takes the least plus a half; ids are renumbered where
    they rise by 1 or more."""
    rows = anchor_blocks(rows, keys, order, anchor)
    w = Window.partitionBy(*keys).orderBy(*order)
    # of several rows at an anchor's place the first counts
    at = rows.filter(F.col(anchor)).groupBy(*keys, F.col(order[0]).alias("__at")).agg(F.min("block").alias("__of"))
    rows = rows.withColumn("__at", F.col(own_anchor)).join(at, [*keys, "__at"], "left")
    gap = F.coalesce(F.last("block", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("__gap", F.when(~F.col(anchor), gap))
    g = Window.partitionBy(*keys, "__gap")
    several = F.min("__of").over(g) < F.max("__of").over(g)
    rows = rows.withColumn("__id", F.when(F.col(anchor), F.col("block").cast("double")).when(several, F.min("__of").over(g) + 0.5).otherwise(F.col("__of").cast("double")))
    step = F.when(F.col("__id") - F.lag("__id").over(w) >= 1, 1).otherwise(0)
    rows = rows.withColumn("__step", step)
    return rows.withColumn("synteny_block", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__at", "__of", "__gap", "__id", "__step", "block")


def block_ranges(rows: DataFrame) -> DataFrame:
    """For each (block1, block2): first chromosome, least start, greatest end, direction and width of either
    side. rows: block1, block2, chr1, start1, end1, chr2, start2, end2."""
    key = ["block1", "block2"]
    order = F.struct("chr1", "start1", "chr2", "start2", "end1", "end2")
    rows = rows.filter("block1 is not null and block2 is not null").groupBy(*key).agg(
        F.min(order).alias("f"), F.max(order).alias("l"), *(F.min(f"start{k}").alias(f"s{k}") for k in (1, 2)), *(F.max(f"end{k}").alias(f"e{k}") for k in (1, 2))
    )
    cols = list(key)
    for k in (1, 2):
        cols += [
            F.col(f"f.chr{k}").alias(f"chr{k}"), F.col(f"s{k}").alias(f"start{k}"), F.col(f"e{k}").alias(f"end{k}"),
            F.when(F.col(f"l.start{k}") < F.col(f"f.start{k}"), "-").otherwise("+").alias(f"direction{k}"), (F.col(f"e{k}") - F.col(f"s{k}") + 1).alias(f"width{k}"),
        ]
    return rows.select(*cols)


def chromosome_offsets(sizes: DataFrame, gap: float = 0.8, scale: float = 100.0) -> DataFrame:
    """genome, chr, len_n, offset: lengths scaled to scale less the gaps, laid end to end. sizes: genome,
    chr, size, in order of ord."""
    g = Window.partitionBy("genome")
    rows = sizes.withColumn("n", F.count(F.lit(1)).over(g)).withColumn("total", F.sum("size").over(g))
    rows = rows.withColumn("free", scale - (F.col("n") - 1) * gap).withColumn("len_n", F.col("size") / F.col("total") * F.col("free"))
    before = Window.partitionBy("genome").orderBy("ord", "chr").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum("size").over(before), F.lit(0))
    k = F.row_number().over(Window.partitionBy("genome").orderBy("ord", "chr")) - 1
    return rows.select("genome", "chr", "len_n", (done / F.col("total") * F.col("free") + k * gap).alias("offset"), "total", "free")


def plot_links(ranges: DataFrame, offsets: DataFrame, track_gap: float = 1.3, min_width: int = 0) -> DataFrame:
    """ranges (with g1, g2) with x1, x2, y1, y2, inv, alpha: midpoints in plot coordinates. Genomes stand in
    order of name from the top."""
    rows = ranges
    for k in (1, 2):
        o = offsets.select(F.col("genome").alias(f"g{k}"), F.col("chr").alias(f"chr{k}"), (F.col("offset")).alias("__o"), (F.col("free") / F.col("total")).alias("__f"))
        mid = (F.col(f"start{k}") + F.col(f"end{k}")) / 2
        rows = rows.join(o, [f"g{k}", f"chr{k}"]).withColumn(f"x{k}", F.col("__o") + mid * F.col("__f")).drop("__o", "__f")
    if min_width:
        rows = rows.filter((F.col("width1") >= min_width) & (F.col("width2") >= min_width))
    rank = offsets.select("genome").distinct().withColumn("y", (F.dense_rank().over(Window.orderBy(F.desc("genome")))) * track_gap)
    for k in (1, 2):
        rows = rows.join(rank.select(F.col("genome").alias(f"g{k}"), F.col("y").alias(f"y{k}")), f"g{k}")
    n = ranges.agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.crossJoin(F.broadcast(n))  # one row
    alpha = F.greatest(F.least(0.55 / (1 + F.log10("__n")), F.lit(0.45)), F.lit(0.06))
    inv = F.col("direction1") != F.col("direction2")
    return rows.withColumn("inv", inv).withColumn("alpha", F.when(inv, F.least(alpha * 1.6, F.lit(1.0))).otherwise(alpha)).drop("__n")


def bezier_points(links: DataFrame) -> DataFrame:
    """Four control points of each link, point 0 to 3."""
    mid = (F.col("y1") + F.col("y2")) / 2
    pts = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x1").alias("x"), mid.alias("y")), F.struct(F.col("x2").alias("x"), mid.alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return links.select("*", F.posexplode(pts).alias("point", "p")).select(*[c for c in links.columns], "point", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def sampled_links(links: DataFrame, n: int = 50_000, seed: int = 1) -> DataFrame:
    """At most n links, chosen by a hash of the row: the same ones each time."""
    return links.orderBy(F.xxhash64(F.lit(seed), *links.columns), *links.columns[:2]).limit(n)
