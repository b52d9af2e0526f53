"""Annotation, intervals, synteny, plots, sequences and gene models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import annotation, compare, intervals, models, pairing, synteny
from ..plans import adapters as A
from ..plans.staging import stage
from .pairs import PLACED_ANCHOR


#: Letters as bases, to make sequences of texts.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "AACAACGTACGTACGTACGTACGTAC")


def _features(spark, sf):
    return annotation.fix_ranges(annotation.with_gene_id(A.annotation(spark, sf)))


def _cds(spark, sf):
    # only ranges of genes and transcripts are repaired
    return annotation.with_gene_id(A.annotation(spark, sf)).filter("type = 'CDS'").select(F.col("parent").alias("transcript_id"), "gene_id", F.col("seqnames"), "strand", "start", "end")


def feature_range_fix(spark, sf):
    return _features(spark, sf).select("type", "ID", "gene_id", "start", "end")


def cds_phase(spark, sf):
    return annotation.cds_phase(annotation.with_gene_id(A.annotation(spark, sf))).select("ID", "phase")


def feature_index(spark, sf):
    f = _features(spark, sf)
    return annotation.indexed(f, "gene").unionByName(annotation.indexed(f, "transcript")).select("ID", "index")


def representative_tx(spark, sf):
    return annotation.representative_transcripts(annotation.with_gene_id(A.annotation(spark, sf))).select("transcript_id", "chain", "n_same")


def tx_gene_table(spark, sf):
    return annotation.transcript_table(_features(spark, sf)).select("gene_id", "transcript_id", "tx_index", "gene_index", "seqnames", "start", "end", "strand")


def gff_check(spark, sf):
    return annotation.check(annotation.with_gene_id(A.annotation(spark, sf)))


def gene_rename(spark, sf):
    return annotation.renamed(_features(spark, sf), "Os").select("ID", "new_id")


def spliced_cds(spark, sf):
    t = A.table(spark, sf, "lineitem")
    text = A.table(spark, sf, "documents").select((F.col("doc_id") % 100).alias("k"), "doc_id", "text").groupBy("k").agg(F.min_by("text", "doc_id").alias("seq"))
    genome = text.select(F.lit(1001).alias("genome_id"), F.col("k").cast("string").alias("seqnames"), F.translate("seq", *LETTERS).alias("seq"))
    cds = t.select(
        F.lit(1001).alias("genome_id"), (F.col("l_orderkey") % 100).cast("string").alias("seqnames"), F.lit("CDS").alias("type"), (F.col("l_linenumber") * 8).cast("long").alias("start"), (F.col("l_linenumber") * 8 + 5).cast("long").alias("end"),
        F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("l_orderkey").cast("string").alias("parent"),
    ).distinct()
    return annotation.spliced_cds(cds, genome).select("transcript_id", "seq")


def cds_islands(spark, sf):
    rows = intervals.islands(_cds(spark, sf), ["seqnames"], tie=[F.asc("transcript_id")])
    return rows.groupBy("seqnames", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def overlap_join(spark, sf):
    c = _cds(spark, sf).select("transcript_id", F.col("seqnames").alias("chr"), "start", "end")
    d = c.select(F.col("transcript_id").alias("t2"), "chr", F.col("start").alias("start2"), F.col("end").alias("end2"))
    return intervals.overlap_join(c, d, ["chr"], 500).filter("transcript_id < t2").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"))


def flanking_anchors(spark, sf):
    g = A.genes(spark, sf).withColumn("anchor", F.col("gene") % 7 == 0)
    return intervals.flanking(g, ["genome", "chr"], "gene", "anchor").select("genome", "chr", "gene", "anchor_at")


def syntenic_join(spark, sf):
    w = A.pair_weights(spark, sf)
    a = stage(pairing.anchors(A.lead_pairs(spark, sf, w)).select("g1", "g2", "gene1", "gene2"), "anchors")
    return synteny.syntenic_join(A.genomes_of(w), a, A.genes(spark, sf)).select("g1", "g2", "gene1", "gene2", "is_anchor_pair")


def _track(spark, sf):
    rows = A.table(spark, sf, "events").select(F.col("user_id").alias("track"), "event_id", (F.col("event_type") == "click").alias("a0"), F.col("event_id").alias("pos"))
    return rows.withColumn("is_anchor_pair", F.col("pos") % 3 != 0).drop("a0")


def anchor_blocks(spark, sf):
    rows = synteny.anchor_blocks(_track(spark, sf), ["track"], ["pos"])
    return rows.select("track", "pos", F.col("block").cast("long").alias("block"))


def synteny_blocks(spark, sf):
    rows = _track(spark, sf).withColumn("own", F.col("pos") - F.col("pos") % 3 + 1)
    return synteny.synteny_blocks(rows, ["track"], ["pos"], "own").select("track", "pos", F.col("synteny_block").cast("long").alias("synteny_block"))


def _ranges(spark, sf):
    t = A.table(spark, sf, "lineitem")
    return t.select(
        (F.col("l_partkey") % 60).alias("block1"), (F.col("l_suppkey") % 10).alias("block2"), (F.col("l_partkey") % 6).cast("string").alias("chr1"), F.col("l_partkey").alias("start1"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end1"),
        (F.col("l_suppkey") % 5).cast("string").alias("chr2"), F.col("l_suppkey").alias("start2"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("end2"),
    )


def block_ranges(spark, sf):
    return synteny.block_ranges(_ranges(spark, sf))


def _sizes(spark, sf):
    return A.genes(spark, sf).groupBy("genome", "chr").agg(F.max("gene").alias("size")).withColumn("ord", S.chromosome_order(F.col("chr")))


def chr_offsets(spark, sf):
    return synteny.chromosome_offsets(_sizes(spark, sf)).select("genome", "chr", F.round("len_n", 6).alias("len_n"), F.round("offset", 6).alias("offset"))


def chr_name_norm(spark, sf):
    return A.genes(spark, sf).select("chr").distinct().select("chr", S.chromosome_name(F.col("chr")).alias("name"), S.chromosome_order(F.col("chr")).alias("ord"))


def plot_links(spark, sf):
    r = synteny.block_ranges(_ranges(spark, sf)).withColumn("g1", F.lit("P")).withColumn("g2", F.lit("S"))
    sizes = r.select(F.lit("P").alias("genome"), F.col("chr1").alias("chr"), F.col("end1").alias("e")).unionByName(r.select(F.lit("S").alias("genome"), F.col("chr2").alias("chr"), F.col("end2").alias("e")))
    sizes = sizes.groupBy("genome", "chr").agg(F.max("e").alias("size")).withColumn("ord", S.chromosome_order(F.col("chr")))
    rows = synteny.plot_links(r, synteny.chromosome_offsets(sizes))
    return rows.select("block1", "block2", F.round("x1", 5).alias("x1"), F.round("x2", 5).alias("x2"), F.round("y1", 6).alias("y1"), F.round("y2", 6).alias("y2"), "inv", F.round("alpha", 6).alias("alpha"))


def promoter_windows(spark, sf):
    sizes = A.table(spark, sf, "nation").select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("seqnames"), F.lit(200_000).cast("long").alias("size"))
    return compare.promoter_windows(_cds(spark, sf), sizes)


def revcomp(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", S.reverse_complement(F.col("text")).alias("rc"))


def protein_flags(spark, sf):
    flags = S.protein_flags(F.col("text"))
    return A.table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in flags.items()))


def codon_check(spark, sf):
    rows = A.table(spark, sf, "part").select("p_partkey", F.upper(F.translate("p_name", "bdefhijklmnopqrsuvwxyz ", "aacgtacgtacgtacgtacgtat")).alias("seq"))
    return models.valid_codons(rows).drop("seq")


def align_summary(spark, sf):
    t = A.table(spark, sf, "part")
    names, types = (t.select(F.col("p_partkey").alias("seq_id"), F.col(c).alias("seq")) for c in ("p_name", "p_type"))
    return compare.compare_sequences(t.select(F.col("p_partkey").alias("tx1"), F.col("p_partkey").alias("tx2")), names, types)


def relative_length_filter(spark, sf):
    n = models.cds_lengths(_cds(spark, sf)).withColumn("k", F.substring("transcript_id", 2, 20).cast("long"))
    m = n.select((F.col("k") - 1).alias("k"), F.col("cds_len").alias("cds_len2"), F.col("span").alias("span2"))
    return models.relative_length_filter(n.join(m, "k")).select("transcript_id", "cds_len", "cds_len2")


def overlap_collapse(spark, sf):
    c = _cds(spark, sf).select(F.col("gene_id").alias("gene"), F.col("seqnames").alias("chr"), "start", "end")
    return intervals.collapsed_classes(c)


def contained_models(spark, sf):
    return models.drop_contained(_cds(spark, sf).select("transcript_id", F.col("seqnames").alias("chr"), "start", "end"))


def longest_per_locus(spark, sf):
    c = _cds(spark, sf)
    m = c.groupBy("transcript_id", F.col("seqnames").alias("chr")).agg(F.min("start").alias("start"), F.min("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("cds_len"))
    return models.longest_per_locus(m).select("transcript_id", "chr", "cds_len")


FX = A.FEATURES_SQL
RANGED = FX + """,
txr AS (SELECT tx.*, s, e FROM tx LEFT JOIN (SELECT tx, min(s) AS s, max(e) AS e FROM cds GROUP BY 1) r USING (tx)),
gn AS (SELECT 'g' || c_custkey AS gene, 'chr' || c_nationkey AS seqnames, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM customer),
gr AS (SELECT gn.*, s, e FROM gn LEFT JOIN (SELECT gene, min(s) AS s, max(e) AS e FROM txr GROUP BY 1) r USING (gene)),
gi AS (SELECT *, 1001000000 + row_number() OVER (ORDER BY seqnames, s NULLS FIRST, gene) AS gene_index FROM gr),
ti AS (SELECT *, 1001000000 + row_number() OVER (ORDER BY seqnames, s NULLS FIRST, tx) AS tx_index FROM txr)"""

SQL = {
    "feature_range_fix": f"WITH {RANGED} SELECT 'gene' AS type, gene AS ID, gene AS gene_id, s AS start, e AS \"end\" FROM gr UNION ALL SELECT 'mRNA', tx, gene, s, e FROM txr UNION ALL SELECT 'CDS', id, gene, s, e FROM cds",
    "cds_phase": f"WITH {FX}, b AS (SELECT id, coalesce(sum(e - s + 1) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -e ELSE s END, id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cds) SELECT id AS ID, CAST((3 - before % 3) % 3 AS INTEGER) AS phase FROM b",
    "feature_index": f"WITH {RANGED} SELECT gene AS ID, gene_index AS \"index\" FROM gi UNION ALL SELECT tx, tx_index FROM ti",
    "representative_tx": f"WITH {FX}, c AS (SELECT tx, seqnames || ':' || string_agg(s || '-' || e, ',' ORDER BY s, e) AS chain FROM cds GROUP BY tx, seqnames) SELECT min(tx) AS transcript_id, chain, count(*) AS n_same FROM c GROUP BY chain",
    "tx_gene_table": f"WITH {RANGED} SELECT gene AS gene_id, tx AS transcript_id, tx_index, gene_index, gi.seqnames, gi.s AS start, gi.e AS \"end\", gi.strand FROM ti LEFT JOIN gi USING (gene)",
    "gff_check": f"WITH {FX} SELECT 'gene without transcript' AS problem, count(*) AS n FROM customer WHERE 'g' || c_custkey NOT IN (SELECT gene FROM tx) HAVING count(*) > 0",
    "gene_rename": f"WITH {RANGED} SELECT gene AS ID, printf('Os%sG%07d', seqnames, 100 * row_number() OVER (PARTITION BY seqnames ORDER BY s NULLS FIRST, gene)) AS new_id FROM gr",
    "spliced_cds": f"""WITH g AS (SELECT CAST(doc_id % 100 AS VARCHAR) AS k, translate(arg_min(text, doc_id), '{LETTERS[0]}', '{LETTERS[1]}') AS seq FROM documents GROUP BY doc_id % 100),
c AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), p AS (SELECT l_orderkey, string_agg(substr(seq, CAST(l_linenumber * 8 AS BIGINT), 6), '' ORDER BY l_linenumber) AS s FROM c JOIN g ON k = CAST(l_orderkey % 100 AS VARCHAR) GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS transcript_id, CASE WHEN l_orderkey % 2 = 0 THEN s ELSE reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) END AS seq FROM p""",
    "cds_islands": f"""WITH {FX}, r AS (SELECT *, max(e) OVER (PARTITION BY seqnames ORDER BY s, e, tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cds),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY seqnames ORDER BY s, e, tx ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT seqnames, CAST(k AS BIGINT) AS island, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY seqnames, k""",
    "overlap_join": f"WITH {FX}, c AS (SELECT tx, seqnames, s, e FROM cds) SELECT a.tx AS transcript_id, count(*) AS n FROM c a JOIN c b ON a.seqnames = b.seqnames AND a.s <= b.e AND b.s <= a.e AND a.tx < b.tx GROUP BY 1",
    "flanking_anchors": f"""WITH {A.GENES_SQL}, f AS (SELECT *, last_value(CASE WHEN gene % 7 = 0 THEN gene END IGNORE NULLS) OVER (PARTITION BY genome, chr ORDER BY gene ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
first_value(CASE WHEN gene % 7 = 0 THEN gene END IGNORE NULLS) OVER (PARTITION BY genome, chr ORDER BY gene ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM genes)
SELECT genome, chr, gene, b AS anchor_at FROM f WHERE b IS NOT NULL UNION SELECT genome, chr, gene, a FROM f WHERE a IS NOT NULL""",
    "syntenic_join": f"""WITH {PLACED_ANCHOR}, gp AS (SELECT DISTINCT g1, g2 FROM pairs),
s1 AS (SELECT gp.*, chr, gene AS x, a.gene1 AS own FROM gp JOIN genes ON genome = g1 LEFT JOIN anchor a ON a.g1 = gp.g1 AND a.g2 = gp.g2 AND a.gene1 = gene),
s2 AS (SELECT gp.*, chr, gene AS x, a.gene2 AS own FROM gp JOIN genes ON genome = g2 LEFT JOIN anchor a ON a.g1 = gp.g1 AND a.g2 = gp.g2 AND a.gene2 = gene),
{', '.join(f'''w{k} AS (SELECT g1, g2, x, unnest([last_value(own IGNORE NULLS) OVER (PARTITION BY g1, g2, chr ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(own IGNORE NULLS) OVER (PARTITION BY g1, g2, chr ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)]) AS r FROM s{k})''' for k in (1, 2))}
SELECT DISTINCT p.g1, p.g2, p.gene1, p.gene2, z.gene1 IS NOT NULL AS is_anchor_pair FROM pairs p JOIN w1 ON w1.g1 = p.g1 AND w1.g2 = p.g2 AND w1.x = p.gene1 JOIN anchor a ON a.g1 = p.g1 AND a.g2 = p.g2 AND a.gene1 = w1.r
JOIN w2 ON w2.g1 = p.g1 AND w2.g2 = p.g2 AND w2.x = p.gene2 AND w2.r = a.gene2 LEFT JOIN anchor z ON z.g1 = p.g1 AND z.g2 = p.g2 AND z.gene1 = p.gene1 AND z.gene2 = p.gene2""",
    "anchor_blocks": """WITH t AS (SELECT user_id AS track, event_id AS pos, event_id % 3 <> 0 AS a FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pos) - sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM t)
SELECT track, pos, CASE WHEN a THEN dense_rank() OVER (PARTITION BY track, a ORDER BY g) END AS block FROM n""",
    "block_ranges": """WITH r AS (SELECT l_partkey % 60 AS block1, l_suppkey % 10 AS block2, CAST(l_partkey % 6 AS VARCHAR) AS chr1, l_partkey AS start1, l_partkey + CAST(l_quantity AS BIGINT) AS end1, CAST(l_suppkey % 5 AS VARCHAR) AS chr2, l_suppkey AS start2, l_suppkey + l_linenumber AS end2 FROM lineitem),
g AS (SELECT block1, block2, min(ROW(chr1, start1, chr2, start2)) AS f, max(ROW(chr1, start1, chr2, start2)) AS l, min(start1) AS s1, max(end1) AS e1, min(start2) AS s2, max(end2) AS e2 FROM r GROUP BY ALL)
SELECT block1, block2, f[1] AS chr1, s1 AS start1, e1 AS end1, CASE WHEN l[2] < f[2] THEN '-' ELSE '+' END AS direction1, e1 - s1 + 1 AS width1, f[3] AS chr2, s2 AS start2, e2 AS end2, CASE WHEN l[4] < f[4] THEN '-' ELSE '+' END AS direction2, e2 - s2 + 1 AS width2 FROM g""",
    "chr_offsets": f"""WITH {A.GENES_SQL}, z AS (SELECT genome, chr, max(gene) AS size, coalesce(TRY_CAST(nullif(regexp_extract(chr, '([0-9]+)', 1), '') AS DOUBLE), 1e9) AS ord FROM genes GROUP BY ALL),
t AS (SELECT *, sum(size) OVER (PARTITION BY genome) AS total, 100.0 - (count(*) OVER (PARTITION BY genome) - 1) * 0.8 AS free, coalesce(sum(size) OVER (PARTITION BY genome ORDER BY ord, chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, row_number() OVER (PARTITION BY genome ORDER BY ord, chr) - 1 AS k FROM z)
SELECT genome, chr, round(CAST(size / total * free AS DOUBLE), 6) AS len_n, round(CAST(done / total * free + k * 0.8 AS DOUBLE), 6) AS "offset" FROM t""",
    "chr_name_norm": f"""WITH {A.GENES_SQL}, c AS (SELECT DISTINCT chr, regexp_extract(chr, '([0-9]+)', 1) AS d FROM genes) SELECT chr, CASE WHEN d <> '' THEN 'chr' || CASE WHEN length(d) < 2 THEN lpad(d, 2, '0') ELSE d END ELSE 'chr_' || regexp_replace(lower(chr), '[^a-z0-9]+', '_', 'g') END AS name, coalesce(TRY_CAST(nullif(d, '') AS DOUBLE), 1e9) AS ord FROM c""",
    "revcomp": "SELECT doc_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) AS rc FROM documents",
    "protein_flags": r"SELECT doc_id, starts_with(text, 'M') AS init, contains(text, '*') AS term, contains(text, '*') AND NOT regexp_full_match(text, '[^*]*\*+') AS truncated, split_part(text, '*', 1) AS trimmed FROM documents",
    "codon_check": "WITH p AS (SELECT p_partkey, upper(translate(p_name, 'bdefhijklmnopqrsuvwxyz ', 'aacgtacgtacgtacgtacgtat')) AS s FROM part), f AS (SELECT p_partkey, s[1:3] = 'ATG' AS has_start, right(s, 3) IN ('TAA', 'TGA', 'TAG') AS has_stop FROM p) SELECT *, has_start AND has_stop AS valid FROM f",
    "relative_length_filter": f"""WITH {FX}, n AS (SELECT tx, CAST(substr(tx, 2) AS BIGINT) AS k, CAST(sum(e - s) AS BIGINT) AS len, max(e) - min(s) AS span FROM cds GROUP BY 1)
SELECT a.tx AS transcript_id, a.len AS cds_len, b.len AS cds_len2 FROM n a JOIN n b ON b.k = a.k + 1 WHERE abs(a.len - b.len) / greatest(a.len, b.len) <= 0.2 AND abs(a.span - b.span) / greatest(a.span, b.span) <= 0.2""",
    "contained_models": f"""WITH {FX}, c AS (SELECT DISTINCT tx, seqnames, s, e FROM cds), n AS (SELECT tx, count(*) AS n FROM c GROUP BY 1), h AS (SELECT a.tx, b.tx AS t2, count(DISTINCT ROW(a.s, a.e)) AS k FROM c a JOIN c b ON a.seqnames = b.seqnames AND a.tx <> b.tx AND b.s <= a.s AND a.e <= b.e GROUP BY ALL),
held AS (SELECT h.tx, t2 FROM h JOIN n ON n.tx = h.tx AND k = n) SELECT tx AS transcript_id FROM n WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.tx = n.tx AND (x.t2 < x.tx OR NOT EXISTS (SELECT 1 FROM held y WHERE y.tx = x.t2 AND y.t2 = x.tx)))""",
    "longest_per_locus": f"""WITH {FX}, m AS (SELECT tx, seqnames, min(s) AS s, min(e) AS e, CAST(sum(e - s) AS BIGINT) AS len FROM cds GROUP BY ALL), r AS (SELECT *, max(e) OVER (PARTITION BY seqnames ORDER BY s, e, tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM m),
i AS (SELECT *, sum(CASE WHEN q IS NULL OR s > q THEN 1 ELSE 0 END) OVER (PARTITION BY seqnames ORDER BY s, e, tx ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT tx AS transcript_id, seqnames AS chr, len AS cds_len FROM (SELECT *, row_number() OVER (PARTITION BY seqnames, k ORDER BY len DESC, tx) AS n FROM i) WHERE n = 1""",
}
ROWS_ONLY = ("synteny_blocks", "overlap_collapse", "plot_links", "promoter_windows", "align_summary")
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
