"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fasta(seqs: DataFrame, path: str) -> None:
    seqs.select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_gff3(features: DataFrame, path: str) -> None:
    enc = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "%", "%25"), ";", "%3B"), "[=]", "%3D")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    attr = F.concat_ws(";", F.concat(F.lit("ID="), enc(F.col("ID"))), F.when(F.size("Parent") > 0, F.concat(F.lit("Parent="), F.array_join(F.transform("Parent", enc), ","))))
    phase = dot("phase") if "phase" in features.columns else F.lit(".")
    features.select(F.concat_ws("\t", "seqnames", F.lit("lociweave"), "type", dot("start"), dot("end"), F.lit("."), dot("strand"), phase, attr).alias("value")).write.text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One folder for each genome pair, which readers prune by."""
    pairs.repartition("g1", "g2").write.partitionBy("g1", "g2").mode("overwrite").parquet(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def write_reciprocal(rbh: DataFrame, path: str) -> None:
    """Tab-separated text without header, as `readers.reciprocal_table` reads it."""
    rbh.write.option("sep", "\t").csv(path)
