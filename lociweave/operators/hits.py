"""Alignment segments -> reciprocal hits: normalise, drop contained segments, cover, aggregate.

One shuffle, on the transcript pair; a pair's segments are sorted along either side and swept with running maxima,
n log n whatever the number of segments of a pair, and spilled where a pair is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import DEFAULT, Compat
from ..functions.stats import sig6


def normalize(hits: DataFrame, width: int = 1_000_000) -> DataFrame:
    """txA, txB, Astart, Aend, Bstart, Bend, pident, dir, qlen: transcripts in order of genome, then of
    id as text; dir 1 if the query is txA; self hits go. Ids are genome * width + number."""
    q, s = F.col("qseqid"), F.col("sseqid")
    gq, gs = F.floor(q / width), F.floor(s / width)
    forward = (gq < gs) | ((gq == gs) & (q.cast("string") <= s.cast("string")))
    lo = lambda a, b: F.least(F.col(a), F.col(b))
    hi = lambda a, b: F.greatest(F.col(a), F.col(b))
    pick = lambda a, b: F.when(forward, a).otherwise(b)
    return hits.filter(q != s).select(
        pick(q, s).alias("txA"), pick(s, q).alias("txB"),
        pick(lo("qstart", "qend"), lo("sstart", "send")).alias("Astart"), pick(hi("qstart", "qend"), hi("sstart", "send")).alias("Aend"),
        pick(lo("sstart", "send"), lo("qstart", "qend")).alias("Bstart"), pick(hi("sstart", "send"), hi("qstart", "qend")).alias("Bend"),
        "pident", pick(F.lit(1), F.lit(2)).alias("dir"), "qlen",
    )


PAIR = ["txA", "txB"]
RANGES = ("Astart", "Aend", "Bstart", "Bend")
SEGMENT = (*RANGES, "dir", "qlen")


def _before(window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def flagged(norm: DataFrame) -> DataFrame:
    """norm with kept: segments inside no other of their direction, on either side; two with equal ranges on
    one side only drop each other; of wholly equal ones the first stays (by length, then identity as text)."""
    rows = norm.select(*PAIR, *SEGMENT, "pident").repartition(*PAIR)
    own = [*PAIR, "dir"]
    first = F.row_number().over(Window.partitionBy(*own, *RANGES).orderBy("qlen", F.col("pident").cast("string")))
    rows = rows.withColumn("__first", first == 1)
    kept = F.col("__first")
    for side in ("A", "B"):
        start, end = f"{side}start", f"{side}end"
        same = Window.partitionBy(*own, start, end)
        # copies of a segment count once; a range that another segment has on this side drops both
        shared = F.sum(F.col("__first").cast("int")).over(same) > 1
        sweep = Window.partitionBy(*own).orderBy(F.asc(start), F.desc(end))
        # rows before have a smaller start, or the same and a greater end: any that reaches as far holds this one
        reach = F.max(end).over(_before(sweep))
        rows = rows.withColumn(f"__{side}", F.when(shared, True).otherwise(F.coalesce(reach >= F.col(end), F.lit(False))))
        kept = kept & ~F.col(f"__{side}")
    return rows.withColumn("kept", kept).drop("__first", "__A", "__B")


def union_length(rows: DataFrame, keys: list[str], start: str, end: str, where: Column | None = None, name: str = "added") -> DataFrame:
    """rows with what each closed range adds to the union of those before it, by start: the sum over a key is
    the length of its union. Ranges outside `where` add nothing."""
    where = F.lit(True) if where is None else where
    sweep = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(F.when(where, F.col(end))).over(_before(sweep))
    added = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start) - 1, reach))  # greatest skips nulls
    return rows.withColumn(name, F.when(where, added).otherwise(0).cast("long"))


def kept_segments(norm: DataFrame) -> DataFrame:
    """txA, txB and the segments that stay, one a row."""
    return flagged(norm).filter("kept").select(*PAIR, *SEGMENT, "pident")


def coverage(norm: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """txA, txB, n_kept, len1, len2, cov1, cov2: how much of the query each direction covers, in per cent, null
    where a direction has no length; n1, n2 segments kept of either direction; total, match: their summed A
    lengths, also times identity."""
    query = lambda side: F.when(F.col("dir") == 1, F.col(f"A{side}")).otherwise(F.col(f"B{side}"))
    rows = flagged(norm).withColumn("__s", query("start").cast("long")).withColumn("__e", query("end").cast("long"))
    rows = union_length(rows, [*PAIR, "dir"], "__s", "__e", F.col("kept"))
    width = (F.col("Aend") - F.col("Astart") + 1).cast("double")
    aggs = [
        F.count_if("kept").alias("n_kept"),
        F.sum(F.when(F.col("kept"), width)).alias("total"),
        F.sum(F.when(F.col("kept"), F.col("pident") / 100 * width)).alias("match"),
    ]
    for k in (1, 2):
        this = F.col("kept") & (F.col("dir") == k)
        aggs += [F.count_if(this).alias(f"n{k}"), F.sum(F.when(F.col("dir") == k, F.col("added")).otherwise(0)).alias(f"len{k}"), F.max(F.when(this, F.col("qlen"))).cast("double").alias(f"__q{k}")]
    rows = rows.groupBy(*PAIR).agg(*aggs)
    for k in (1, 2):
        cov = F.when(F.col(f"__q{k}") > 0, 100.0 * F.col(f"len{k}") / F.col(f"__q{k}"))
        rows = rows.withColumn(f"cov{k}", F.floor(cov).cast("long") if compat.truncate_coverage else cov)
    return rows.drop("__q1", "__q2")


def reciprocal_hits(norm: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """genome1_tx, genome2_tx, pident, q2s_qcovs, s2q_qcovs, q2s_ci, s2q_ci, mutual_ci of the pairs hit in
    both directions. Identity is weighted by A length."""
    rows = coverage(norm, compat).filter("n1 > 0 and n2 > 0")
    out = sig6 if compat.sig6 else (lambda x: x)
    pident = F.col("match") / F.col("total") * 100
    q2s, s2q = pident * F.col("cov1") * 1e-4, pident * F.col("cov2") * 1e-4
    return rows.select(
        F.col("txA").alias("genome1_tx"), F.col("txB").alias("genome2_tx"), out(pident).alias("pident"), F.col("cov1").alias("q2s_qcovs"), F.col("cov2").alias("s2q_qcovs"),
        out(q2s).alias("q2s_ci"), out(s2q).alias("s2q_ci"), out(q2s * s2q).alias("mutual_ci"),
    )


def exact_reciprocal(hits: DataFrame) -> DataFrame:
    """The former way: segments found alike in both directions."""
    back = hits.select(F.col("sseqid").alias("qseqid"), F.col("qseqid").alias("sseqid"), F.col("sstart").alias("qstart"), F.col("send").alias("qend"), F.col("qstart").alias("sstart"), F.col("qend").alias("send"), "pident")
    return hits.join(back, ["qseqid", "sseqid", "qstart", "qend", "sstart", "send", "pident"], "left_semi").filter("qseqid < sseqid")


def identical_sequences(seqs: DataFrame) -> DataFrame:
    """rep, member: each sequence's first id, for its other ids. seqs: seq_id, seq."""
    rows = seqs.select("seq_id", F.sha2("seq", 256).alias("k"))
    rep = rows.groupBy("k").agg(F.min("seq_id").alias("rep"), F.max("seq_id").alias("most")).filter("rep < most")
    return rows.join(rep, "k").filter("seq_id <> rep").select("rep", F.col("seq_id").alias("member"))
