"""From hit files to the pair table, all genome pairs at once: the steps of the operators in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..compat import DEFAULT, Compat
from ..operators import hits as H
from ..operators import pairing as P
from ..operators.annotation import INDEX_WIDTH
from .staging import stage


def reciprocal(hits: DataFrame, compat: Compat = DEFAULT) -> DataFrame:
    """The reciprocal hits of raw hits, best mutual score first."""
    return H.reciprocal_hits(H.normalize(hits), compat).orderBy(F.desc("mutual_ci"), "genome1_tx", "genome2_tx")


def valid_hits(rbh: DataFrame, mutual_ci_min: float | None = None) -> DataFrame:
    """rbh without rows that lack a transcript or pair one with itself, nor, if asked for, low mutual scores."""
    rows = rbh.filter("genome1_tx is not null and genome2_tx is not null and genome1_tx <> genome2_tx")
    return rows if mutual_ci_min is None else rows.filter(F.col("mutual_ci") >= mutual_ci_min)


def gene_pairs(rbh: DataFrame, transcripts: DataFrame) -> DataFrame:
    """A pair table with places: transcripts become genes (unknown ones go), of each gene pair the best hit stays.
    rbh: genome1_tx, genome2_tx, pident, q2s_ci, s2q_ci, mutual_ci; transcripts: tx_index, gene_index, seqnames
    (transcript_table). g1, g2 are genome numbers; a place is the gene's index."""
    rows = rbh
    for k in (1, 2):
        t = transcripts.select(F.col("tx_index").alias(f"genome{k}_tx"), F.col("gene_index").alias(f"gene{k}"), F.col("seqnames").alias(f"chr{k}"))
        rows = rows.join(t.filter(f"gene{k} is not null"), f"genome{k}_tx")
    genome = lambda k: F.floor(F.col(f"genome{k}_tx") / INDEX_WIDTH).alias(f"g{k}")
    rows = rows.select(
        genome(1), genome(2), "gene1", "gene2", F.col("genome1_tx").alias("tx1"), F.col("genome2_tx").alias("tx2"), F.col("q2s_ci").alias("ci_q2s"), F.col("s2q_ci").alias("ci_s2q"),
        "pident", "mutual_ci", "chr1", "chr2", F.col("gene1").alias("pos1"), F.col("gene2").alias("pos2"),
    )
    return P.dedup_gene_pairs(rows, [F.desc("mutual_ci"), F.asc("tx1"), F.asc("tx2")])


def with_split_genes(classified: DataFrame) -> DataFrame:
    """Pairs whose split genes are genes of their own: the negative of their transcript."""
    rows = P.split_genes(classified)
    for k in (1, 2):
        rows = rows.withColumn(f"gene{k}", F.when(F.col(f"is_split{k}"), -F.col(f"tx{k}")).otherwise(F.col(f"gene{k}")))
    return rows.drop("is_split1", "is_split2", "class")


def named(pairs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The pair table as it is given out: names, places and strands instead of numbers. A split gene is called
    <transcript>:split and keeps its original gene's name apart."""
    rows = pairs
    for k in (1, 2):
        cols = {"tx_index": f"tx{k}", "transcript_id": f"genome{k}_tx", "gene_id": f"genome{k}_original_gene", "start": f"genome{k}_start", "end": f"genome{k}_end"}
        strand = F.when(F.col("strand") == "1", "+").when(F.col("strand") == "2", "-").otherwise(F.col("strand")).alias(f"genome{k}_strand")
        rows = rows.join(transcripts.select(*(F.col(a).alias(b) for a, b in cols.items()), strand), f"tx{k}")
        split = F.concat(F.col(f"genome{k}_tx"), F.lit(":split"))
        rows = rows.withColumn(f"genome{k}_gene", F.when(F.col(f"gene{k}") < 0, split).otherwise(F.col(f"genome{k}_original_gene")))
    own = [f"genome{k}_{c}" for k in (1, 2) for c in ("tx", "gene", "original_gene", "start", "end", "strand")]
    return rows.select("g1", "g2", *own, F.col("chr1").alias("genome1_chr"), F.col("chr2").alias("genome2_chr"), "ci_q2s", "ci_s2q", "pident", "mutual_ci", "is_anchor_pair", "class", "SOG")


def ortholog_pairs(rbh: DataFrame, transcripts: DataFrame, mutual_ci_min: float | None = None) -> DataFrame:
    """Reciprocal hits and annotations to the final pair table: gene pairs, anchors, what lies near them, split genes,
    untangled and filtered components, classified again, named."""
    transcripts = stage(transcripts, "transcripts")
    pairs = stage(gene_pairs(valid_hits(rbh, mutual_ci_min), transcripts), "pairs")
    near = stage(P.syntenic_hits(pairs, P.anchors(pairs)).drop("dist"), "near")
    split = stage(with_split_genes(P.pair_class(near)), "split")
    kept = P.filter_pairs(split).drop("class", "SOG")
    return named(P.sog_ids(kept), transcripts)
