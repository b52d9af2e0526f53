"""Annotation repair and indexing (step 1). Features: genome_id, seqnames, type, start, end, strand, ID,
Parent (array of strings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement

#: Feature types that are kept, in sorting order.
TYPES = ("gene", "transcript", "mRNA", "CDS")
TRANSCRIPTS = ("transcript", "mRNA")
INDEX_WIDTH = 1_000_000


def keep_types(features: DataFrame) -> DataFrame:
    return features.filter(F.col("type").isin(*TYPES))


def with_gene_id(features: DataFrame) -> DataFrame:
    """features with parent (the first one) and gene_id: a gene's own ID, a transcript's parent, of other
    elements the gene of their transcript."""
    rows = features.withColumn("parent", F.get("Parent", F.lit(0)))
    tx = rows.filter(F.col("type").isin(*TRANSCRIPTS)).select("genome_id", F.col("ID").alias("parent"), F.col("parent").alias("__gene")).dropDuplicates(["genome_id", "parent"])
    rows = rows.join(tx, ["genome_id", "parent"], "left")
    gene = F.when(F.col("type") == "gene", F.col("ID")).when(F.col("type").isin(*TRANSCRIPTS), F.col("parent")).otherwise(F.col("__gene"))
    return rows.withColumn("gene_id", gene).drop("__gene")


def fix_ranges(features: DataFrame) -> DataFrame:
    """Transcripts get the span of their elements, then genes that of their transcripts, where there are
    any. Needs parent."""
    span = lambda rows: rows.groupBy("genome_id", F.col("parent").alias("ID")).agg(F.min("start").alias("__s"), F.max("end").alias("__e"))

    def widened(rows, inner):
        rows = rows.join(span(inner), ["genome_id", "ID"], "left")
        return rows.withColumn("start", F.coalesce("__s", "start")).withColumn("end", F.coalesce("__e", "end")).drop("__s", "__e")

    genes = features.filter(F.col("type") == "gene")
    tx = features.filter(F.col("type").isin(*TRANSCRIPTS))
    rest = features.filter(~F.col("type").isin("gene", *TRANSCRIPTS))
    tx = widened(tx, rest)
    return widened(genes, tx).unionByName(tx).unionByName(rest)


def cds_phase(features: DataFrame) -> DataFrame:
    """CDS rows with phase: minus the widths before them along the transcript, modulo 3."""
    ahead = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    w = Window.partitionBy("genome_id", "parent").orderBy(ahead, "ID", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0))
    return features.filter(F.col("type") == "CDS").withColumn("phase", F.pmod(-before, F.lit(3)).cast("int"))


def indexed(features: DataFrame, of: str) -> DataFrame:
    """Genes or transcripts with index: (1000 + genome) * width + their number in order of chromosome as
    text, start, type and ID. Long, so that no genome overflows."""
    kinds = ("gene",) if of == "gene" else TRANSCRIPTS
    rows = features.filter(F.col("type").isin(*kinds))
    number = F.row_number().over(Window.partitionBy("genome_id").orderBy("seqnames", "start", F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")), "ID"))
    return rows.withColumn("index", F.col("genome_id").cast("long") * INDEX_WIDTH + number)


def transcript_table(features: DataFrame) -> DataFrame:
    """genome_id, gene_id, transcript_id, tx_index, gene_index; seqnames, start, end, strand are the gene's."""
    gene = indexed(features, "gene").select("genome_id", F.col("ID").alias("gene_id"), "seqnames", "start", "end", "strand", F.col("index").alias("gene_index"))
    tx = indexed(features, "transcript").select("genome_id", F.col("gene_id"), F.col("ID").alias("transcript_id"), F.col("index").alias("tx_index"))
    return tx.join(gene, ["genome_id", "gene_id"], "left")


def representative_transcripts(features: DataFrame) -> DataFrame:
    """genome_id, transcript_id, chain, n_same: of transcripts with the same chromosome and CDS ranges the
    first by name."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    chain = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = features.filter(F.col("type") == "CDS").groupBy("genome_id", "seqnames", F.col("parent").alias("transcript_id")).agg(spans.alias("spans"))
    rows = rows.select("genome_id", "transcript_id", F.concat_ws(":", "seqnames", chain).alias("chain"))
    return rows.groupBy("genome_id", "chain").agg(F.min("transcript_id").alias("transcript_id"), F.count(F.lit(1)).alias("n_same")).select("genome_id", "transcript_id", "chain", "n_same")


def spliced_cds(features: DataFrame, genome: DataFrame) -> DataFrame:
    """transcript_id, seq: CDS cut from the sequences (genome_id, seqnames, seq), joined in order, reverse
    complement on the minus strand. Each range is cut before any are gathered."""
    cds = features.filter(F.col("type") == "CDS").join(genome, ["genome_id", "seqnames"])
    cds = cds.select("genome_id", "parent", "strand", "start", F.col("seq").substr(F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")).alias("part"))
    rows = cds.groupBy("genome_id", F.col("parent").alias("transcript_id"), "strand").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("p"))
    seq = F.array_join(F.col("p.part"), "")
    return rows.select("genome_id", "transcript_id", F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq).alias("seq"))


def check(features: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """problem, n: what is wrong with an annotation; no rows if nothing is."""
    gene = features.filter(F.col("type") == "gene").select("genome_id", "ID")
    tx = features.filter(F.col("type").isin(*TRANSCRIPTS)).select("genome_id", "ID", F.col("parent"))
    found = [
        features.filter("type is null").select(F.lit("feature without type").alias("problem")),
        tx.join(gene.withColumnRenamed("ID", "parent"), ["genome_id", "parent"], "left_anti").select(F.lit("transcript without gene").alias("problem")),
        gene.join(tx.select("genome_id", F.col("parent").alias("ID")), ["genome_id", "ID"], "left_anti").select(F.lit("gene without transcript").alias("problem")),
    ]
    if sequences is not None:
        found.append(features.select("genome_id", "seqnames").distinct().join(sequences.select("genome_id", "seqnames"), ["genome_id", "seqnames"], "left_anti").select(F.lit("sequence missing").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the same name replace old ones; genome_id continues after the largest."""
    known = old.select("name", F.col("genome_id").alias("__id"))
    top = old.agg(F.coalesce(F.max("genome_id"), F.lit(1000)).alias("__top"))
    fresh = new.join(known, "name", "left_anti").crossJoin(F.broadcast(top))  # one row
    fresh = fresh.withColumn("genome_id", (F.col("__top") + F.row_number().over(Window.orderBy("name"))).cast("int")).drop("__top")
    same = new.join(known, "name").withColumn("genome_id", F.col("__id").cast("int")).drop("__id")
    return old.join(new.select("name"), "name", "left_anti").unionByName(same.unionByName(fresh), allowMissingColumns=True)


def renamed(features: DataFrame, prefix: str) -> DataFrame:
    """Genes with serial names <prefix><chromosome>G<number>, in steps of 100, in order of place."""
    n = F.row_number().over(Window.partitionBy("genome_id", "seqnames").orderBy("start", "ID"))
    return features.filter(F.col("type") == "gene").withColumn("new_id", F.format_string(f"{prefix}%sG%07d", F.col("seqnames"), n * 100))
