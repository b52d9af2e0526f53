"""Hits and annotations to named pairs, on two collinear genomes."""

from pyspark.sql import functions as F

from lociweave.plans import workflow
from lociweave.sources import readers, sinks

A, B = 1001 * 1_000_000, 1002 * 1_000_000


def annotation(spark):
    rows = [(g // 1_000_000, f"{n}g{k}", f"{n}t{k}", g + k, g + k, "1" if k <= 30 else "2", 100 * k, 100 * k + 50, "1" if k % 2 else "-") for g, n in ((A, "a"), (B, "b")) for k in range(1, 61)]
    # a second transcript of gene a7
    rows.append((A // 1_000_000, "ag7", "at7.2", A + 100, A + 7, "1", 700, 750, "1"))
    return spark.createDataFrame(rows, "genome_id long, gene_id string, transcript_id string, tx_index long, gene_index long, seqnames string, start long, end long, strand string")


def hits(spark):
    rows = []
    for k in range(1, 61):
        rows += [(A + k, B + k, 99.0, 1, 300, 1, 300, 300), (B + k, A + k, 99.0, 1, 300, 1, 300, 300)]
    rows += [(A + 100, B + 7, 80.0, 1, 200, 1, 200, 300), (B + 7, A + 100, 80.0, 1, 200, 1, 200, 300)]  # same gene pair, worse
    rows += [(A + 5, B + 55, 70.0, 1, 120, 1, 120, 300), (B + 55, A + 5, 70.0, 1, 120, 1, 120, 300)]  # elsewhere
    rows += [(A + 9, B + 999, 99.0, 1, 300, 1, 300, 300), (B + 999, A + 9, 99.0, 1, 300, 1, 300, 300)]  # unknown transcript
    rows += [(A + 9, A + 9, 99.0, 1, 300, 1, 300, 300)]
    return spark.createDataFrame(rows, "qseqid long, sseqid long, pident double, qstart int, qend int, sstart int, send int, qlen int")


def test_hits_to_named_pairs(spark, tmp_path):
    rbh = workflow.reciprocal(hits(spark))
    scores = [r.mutual_ci for r in rbh.collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) == 63
    sinks.write_reciprocal(rbh, str(tmp_path / "rbh"))
    back = readers.reciprocal_table(spark, str(tmp_path / "rbh"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rbh.collect()))
    pairs = workflow.gene_pairs(workflow.valid_hits(back), annotation(spark))
    assert pairs.count() == 61 and {r.tx1 for r in pairs.filter(F.col("gene2") == B + 7).collect()} == {A + 7}
    assert workflow.valid_hits(back, 0.9).count() == 61
    got = workflow.ortholog_pairs(back, annotation(spark)).collect()
    assert {(r.genome1_gene, r.genome2_gene) for r in got} == {(f"ag{k}", f"bg{k}") for k in range(1, 61)}
    one = next(r for r in got if r.genome1_gene == "ag3")
    assert (one.g1, one.g2, one.genome1_tx, one.genome2_tx, one.genome1_chr, one.genome1_start, one.genome1_strand, one.is_anchor_pair, one["class"]) == (1001, 1002, "at3", "bt3", "1", 300, "+", True, "1to1")
    assert sorted(r.SOG for r in got) == list(range(1, 61))


def test_split_genes_are_named(spark):
    rows = [(1, 2, A + 7, B + 7, A + 7, B + 7), (1, 2, A + 7, B + 8, A + 100, B + 8), (1, 2, A + 8, B + 8, A + 8, B + 8)]
    pairs = spark.createDataFrame(rows, "g1 int, g2 int, gene1 long, gene2 long, tx1 long, tx2 long").withColumn("class", F.lit("MtoM"))
    got = {(r.gene1, r.gene2) for r in workflow.with_split_genes(pairs).collect()}
    # gene a7's transcripts have one partner each; of b8's one transcript has two
    assert got == {(-(A + 7), B + 7), (-(A + 100), B + 8), (A + 8, B + 8)}
    full = workflow.with_split_genes(pairs).selectExpr("*", "0.5D ci_q2s", "0.5D ci_s2q", "90D pident", "0.25D mutual_ci", "'1' chr1", "'1' chr2", "true is_anchor_pair", "'MtoM' class", "1L SOG")
    names = {(r.genome1_gene, r.genome1_original_gene) for r in workflow.named(full, annotation(spark)).collect()}
    assert names == {("at7:split", "ag7"), ("at7.2:split", "ag7"), ("ag8", "ag8")}
