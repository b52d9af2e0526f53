"""Text formats of the field as DataFrames, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotation import TYPES

#: Columns of the hit table in order; a ninth and later ones are ignored.
HIT_COLUMNS = (("qseqid", "bigint"), ("sseqid", "bigint"), ("pident", "double"), ("qstart", "int"), ("qend", "int"), ("sstart", "int"), ("send", "int"), ("qlen", "int"))
GFF_COLUMNS = ("seqnames", "source", "type", "start", "end", "score", "strand", "phase", "attributes")


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits; lines of fewer than eight columns are skipped."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= len(HIT_COLUMNS))
    return rows.select(*(F.col("c")[k].try_cast(t).alias(n) for k, (n, t) in enumerate(HIT_COLUMNS)))


def gff3(spark: SparkSession, path: str, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Features with ID, Parent (array), Name and gene_id; types are filtered before attributes are parsed.
    Escapes are resolved, a repeated attribute's last value counts, `character(0)` is no parent."""
    rows = spark.read.text(path).filter("value not like '#%' and value <> ''").select(F.split("value", "\t").alias("c")).filter(F.size("c") == len(GFF_COLUMNS))
    rows = rows.filter(F.col("c")[2].isin(*types))

    def attribute(name):
        got = F.regexp_extract(F.concat(F.lit(";"), F.col("c")[8]), rf".*;\s*{name}=([^;]*)", 1)
        return F.when(got != "", got)

    decoded = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    dot = lambda k: F.when(F.col("c")[k] != ".", F.col("c")[k])
    parent = attribute("Parent")
    return rows.select(
        decoded(F.col("c")[0]).alias("seqnames"), dot(1).alias("source"), F.col("c")[2].alias("type"), F.col("c")[3].try_cast("long").alias("start"), F.col("c")[4].try_cast("long").alias("end"),
        dot(5).try_cast("double").alias("score"), F.col("c")[6].alias("strand"), dot(7).try_cast("int").alias("phase"), decoded(attribute("ID")).alias("ID"),
        F.when(parent.isNotNull() & (parent != "character(0)"), F.transform(F.split(parent, ","), decoded)).alias("Parent"), decoded(attribute("Name")).alias("Name"), decoded(attribute("gene_id")).alias("gene_id"),
    )


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (the header's first word), seq. A record begins with > at the start of a line; others belong to the
    header."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).filter("trim(value) <> ''")
    header = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)")
    return rows.select(F.regexp_extract(header, r"^\s*(\S+)", 1).alias("seq_id"), F.regexp_replace(body, r"\s", "").alias("seq"))


def manifest(spark: SparkSession, path: str, limit: int = 8999) -> DataFrame:
    """name, genome, gff, cds, prot from a CSV file."""
    rows = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    missing = {"name", "gff"} - set(rows.columns)
    if missing:
        raise ValueError(f"manifest without {', '.join(sorted(missing))}")
    for c in ("genome", "cds", "prot"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} genomes")
    return rows.select("name", "genome", "gff", "cds", "prot")


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """A pair table in TSV with header; both spellings of the original genes' columns are known."""
    rows = spark.read.option("sep", "\t").option("header", True).option("nullValue", "").csv(path)
    for k in (1, 2):
        old, new = f"original_genome{k}_gene", f"genome{k}_original_gene"
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    return rows


#: Columns of a table of reciprocal hits, without header.
RECIPROCAL = "genome1_tx long, genome2_tx long, pident double, q2s_qcovs int, s2q_qcovs int, q2s_ci double, s2q_ci double, mutual_ci double"


def reciprocal_table(spark: SparkSession, path: str) -> DataFrame:
    """Reciprocal hits as tab-separated text without header."""
    return spark.read.option("sep", "\t").schema(RECIPROCAL).csv(path)


def names(spark: SparkSession, path: str) -> DataFrame:
    """name: one a line, trimmed; empty lines go."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")
