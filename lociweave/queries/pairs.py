"""Hits, anchors, classes, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import sig6
from ..operators import graph, hits, orthogroups, pairing, synteny
from ..plans import adapters as A
from ..plans import workflow
from ..plans.staging import stage

R = 6


def _round(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


COLS = ["g1", "g2", "gene1", "gene2"]


def pair_scores(spark, sf):
    return A.pair_scores(spark, sf)


def gene_pair_dedup(spark, sf):
    t = A.table(spark, sf, "lineitem")
    hit = t.select(F.lit("P").alias("g1"), F.lit("S").alias("g2"), (F.col("l_partkey") % 97).alias("gene1"), (F.col("l_suppkey") % 31).alias("gene2"), F.col("l_quantity").alias("mutual_ci"), "l_orderkey", "l_linenumber")
    return pairing.dedup_gene_pairs(hit, [F.desc("mutual_ci"), F.asc("l_orderkey"), F.asc("l_linenumber")])


def reciprocal_best(spark, sf):
    return pairing.reciprocal_best(A.pair_scores(spark, sf)).select(COLS)


def high_copy_filter(spark, sf):
    p = A.lead_pairs(spark, sf)
    return pairing.drop_high_copy(pairing.reciprocal_best(p), p).select(COLS)


def identity_fence(spark, sf):
    return pairing.identity_fence(A.pair_scores(spark, sf)).select(*COLS, "pident")


def anchors(spark, sf):
    return pairing.anchors(A.pair_scores(spark, sf))


def _placed(spark, sf):
    return stage(A.placed_pairs(spark, sf), "placed")  # read for the anchors and again


def nearest_anchor(spark, sf):
    p = _placed(spark, sf)
    return pairing.nearest_anchor(p, pairing.anchors(p)).select(*COLS, "dist")


def distance_fence(spark, sf):
    a = stage(pairing.anchors(A.placed_pairs(spark, sf)), "anchors")
    own = pairing.nearest_anchor(a, a, omit_zero=True).filter("dist is not null")
    from ..functions.stats import fences

    return _round(fences(own, ["g1", "g2"], "dist"), "fence_low", "fence_high")


def _syntenic(spark, sf):
    p = _placed(spark, sf)
    return pairing.syntenic_hits(p, pairing.anchors(p))


def syntenic_hits(spark, sf):
    return _syntenic(spark, sf).select(*COLS, "dist", "is_anchor_pair")


def pair_class(spark, sf):
    return pairing.pair_class(pairing.untangle(A.pair_scores(spark, sf))).select(*COLS, "class")


def untangle(spark, sf):
    return pairing.untangle(A.pair_scores(spark, sf)).select(COLS)


def components(spark, sf):
    return pairing.components(pairing.untangle(A.pair_scores(spark, sf))).select(*COLS, "component")


def sog_ids(spark, sf):
    return pairing.sog_ids(pairing.untangle(A.pair_scores(spark, sf))).select(*COLS, "class", "SOG")


def split_genes(spark, sf):
    p = pairing.pair_class(pairing.untangle(A.pair_scores(spark, sf)))
    p = p.withColumn("tx1", F.col("gene1") * 10).withColumn("tx2", F.col("gene2") * 10)
    return pairing.split_genes(p).select(*COLS, "class", "is_split1", "is_split2")


def filter_pairs(spark, sf):
    return pairing.filter_pairs(_syntenic(spark, sf).drop("dist")).select(*COLS, "class", "SOG", "is_anchor_pair")


def orphans(spark, sf):
    best = stage(pairing.reciprocal_best(A.lead_pairs(spark, sf)), "best")
    return pairing.orphans(best, A.genes(spark, sf).select("genome", "gene"))


def mutual_ci_stats(spark, sf):
    return pairing.mutual_ci_stats(A.pair_scores(spark, sf))


def mean_ci_matrix(spark, sf):
    return pairing.mean_ci_matrix(A.pair_scores(spark, sf), A.GENOMES)


def pair_summary(spark, sf):
    p = pairing.pair_class(pairing.untangle(A.lead_pairs(spark, sf)))
    return pairing.pair_summary(p, A.genes(spark, sf).select("genome", "gene"))


def get_pairs_score(spark, sf):
    p = pairing.pair_class(pairing.reciprocal_best(A.pair_scores(spark, sf)))
    return pairing.get_pairs(p, ("S", "P"), score=True)


def get_pairs_loc(spark, sf):
    return pairing.get_pairs(pairing.pair_class(pairing.reciprocal_best(A.placed_pairs(spark, sf))), ("C", "P"), loc=True)


P = A.PAIRS_SQL
TIE = "mutual_ci DESC, gene1, gene2"
R1 = f"row_number() OVER (PARTITION BY g1, g2, gene1 ORDER BY ci_q2s DESC, {TIE})"
R2 = f"row_number() OVER (PARTITION BY g1, g2, gene2 ORDER BY ci_s2q DESC, ci_q2s DESC, {TIE})"
FLAGS = f"flags AS (SELECT *, {R1} AS r1, {R2} AS r2 FROM pairs)"
BEST = FLAGS + ", best AS (SELECT * EXCLUDE (r1, r2) FROM flags WHERE r1 = 1 AND r2 = 1)"
UNT = FLAGS + ", unt AS (SELECT * EXCLUDE (r1, r2) FROM flags WHERE r1 = 1 OR r2 = 1)"
IQR_HIGH = "quantile_cont({v}, 0.75) + 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25))"
IQR_LOW = "quantile_cont({v}, 0.25) - 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25))"
COPY = f"""{BEST},
n1 AS (SELECT g1, g2, gene1, count(*) AS n1 FROM pairs GROUP BY ALL), n2 AS (SELECT g1, g2, gene2, count(*) AS n2 FROM pairs GROUP BY ALL),
counted AS (SELECT * FROM best JOIN n1 USING (g1, g2, gene1) JOIN n2 USING (g1, g2, gene2)),
lim AS (SELECT g1, g2, {IQR_HIGH.format(v='n1')} AS h1, {IQR_HIGH.format(v='n2')} AS h2 FROM counted GROUP BY ALL),
copied AS (SELECT counted.* FROM counted JOIN lim USING (g1, g2) WHERE NOT (n1 > h1 AND n2 > h2))"""
ANCHOR = f"""{COPY}, idlim AS (SELECT g1, g2, {IQR_LOW.format(v='pident')} AS low FROM copied GROUP BY ALL),
anchor AS (SELECT copied.* EXCLUDE (n1, n2) FROM copied JOIN idlim USING (g1, g2) WHERE pident >= low)"""
PLACED = A.PLACED_SQL.replace("placed AS (", "placed0 AS (")
# anchors with their places
PLACED_ANCHOR = f"{PLACED}, {ANCHOR}, pa AS (SELECT p.* FROM placed0 p JOIN anchor a USING (g1, g2, gene1, gene2))"
NEAR = """near AS (SELECT p.g1, p.g2, p.gene1, p.gene2, min(abs(p.pos1 - a.pos1) + abs(p.pos2 - a.pos2)) AS dist FROM placed0 p JOIN pa a ON p.g1 = a.g1 AND p.g2 = a.g2 AND p.chr1 = a.chr1 AND p.chr2 = a.chr2 GROUP BY ALL)"""
SELF = f"""own AS (SELECT p.g1, p.g2, p.gene1, p.gene2, min(abs(p.pos1 - a.pos1) + abs(p.pos2 - a.pos2)) AS dist FROM pa p JOIN pa a ON p.g1 = a.g1 AND p.g2 = a.g2 AND p.chr1 = a.chr1 AND p.chr2 = a.chr2
  WHERE abs(p.pos1 - a.pos1) + abs(p.pos2 - a.pos2) <> 0 GROUP BY ALL),
dlim AS (SELECT g1, g2, {IQR_LOW.format(v='dist')} AS fence_low, {IQR_HIGH.format(v='dist')} AS fence_high FROM own GROUP BY ALL)"""
SYN = f"""{PLACED_ANCHOR}, {NEAR}, {SELF}, syn AS (
  SELECT p.*, dist, a.gene1 IS NOT NULL AS is_anchor_pair FROM placed0 p LEFT JOIN near USING (g1, g2, gene1, gene2) LEFT JOIN dlim USING (g1, g2)
  LEFT JOIN anchor a ON a.g1 = p.g1 AND a.g2 = p.g2 AND a.gene1 = p.gene1 AND a.gene2 = p.gene2 WHERE dist < fence_high OR a.gene1 IS NOT NULL)"""


def comp(src: str) -> str:
    return f"""el AS (SELECT g1 || '|' || g2 || '|1|' || gene1 AS a, g1 || '|' || g2 || '|2|' || gene2 AS b FROM {src}),
walk(n, m) AS (SELECT a, a FROM el UNION SELECT b, b FROM el UNION SELECT e.y, walk.m FROM walk JOIN (SELECT a AS x, b AS y FROM el UNION ALL SELECT b, a FROM el) e ON e.x = walk.n),
lab AS (SELECT n, min(m) AS m FROM walk GROUP BY n),
wc AS (SELECT s.*, m FROM {src} s JOIN lab ON n = g1 || '|' || g2 || '|1|' || gene1),
cc AS (SELECT * EXCLUDE (m), min(gene1) OVER (PARTITION BY m) AS component FROM wc)"""


def classes(src: str, out: str = "kl") -> str:
    return f"""dg AS (SELECT *, count(*) OVER (PARTITION BY g1, g2, gene1) AS d1, count(*) OVER (PARTITION BY g1, g2, gene2) AS d2 FROM {src}),
dm AS (SELECT *, max(d2) OVER (PARTITION BY g1, g2, gene1) AS m2, max(d1) OVER (PARTITION BY g1, g2, gene2) AS m1 FROM dg),
{out} AS (SELECT * EXCLUDE (d1, d2, m1, m2), CASE WHEN d1 = 1 AND d2 = 1 THEN '1to1' WHEN d2 > 1 AND m1 = 1 THEN 'Mto1' WHEN d1 > 1 AND m2 = 1 THEN '1toM' ELSE 'MtoM' END AS class FROM dm)"""


K = "g1, g2, gene1, gene2"
RS = "ci_q2s, ci_s2q, mutual_ci"
SOG = f"{classes('cc')}, sg AS (SELECT *, dense_rank() OVER (PARTITION BY g1, g2 ORDER BY component) AS SOG FROM kl)"
SUMMARY_LABELS = ["Total", "Classified", "1to1", "1toM", "Mto1", "MtoM", "Orphan"]


def _orph(src: str) -> str:
    return f"""gp AS (SELECT DISTINCT g1, g2 FROM {src}),
orph AS (SELECT g1, g2, genome, gene FROM gp JOIN genes ON genome = g1 WHERE NOT EXISTS (SELECT 1 FROM {src} b WHERE b.g1 = gp.g1 AND b.g2 = gp.g2 AND b.gene1 = gene)
UNION ALL SELECT g1, g2, genome, gene FROM gp JOIN genes ON genome = g2 WHERE NOT EXISTS (SELECT 1 FROM {src} b WHERE b.g1 = gp.g1 AND b.g2 = gp.g2 AND b.gene2 = gene))"""


SQL = {
    "pair_scores": f"WITH {P} SELECT {K}, pident, {RS} FROM pairs",
    "gene_pair_dedup": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY gene1, gene2 ORDER BY mutual_ci DESC, l_orderkey, l_linenumber) AS r FROM (SELECT 'P' AS g1, 'S' AS g2, l_partkey % 97 AS gene1, l_suppkey % 31 AS gene2, l_quantity AS mutual_ci, l_orderkey, l_linenumber FROM lineitem)) WHERE r = 1",
    "reciprocal_best": f"WITH {P}, {BEST} SELECT {K} FROM best",
    "high_copy_filter": f"WITH {P}, {COPY} SELECT {K} FROM copied",
    "identity_fence": f"WITH {P}, l AS (SELECT g1, g2, {IQR_LOW.format(v='pident')} AS low FROM pairs GROUP BY ALL) SELECT {K}, pident FROM pairs JOIN l USING (g1, g2) WHERE pident >= low",
    "anchors": f"WITH {P}, {ANCHOR} SELECT {K}, pident, {RS} FROM anchor",
    "nearest_anchor": f"WITH {PLACED_ANCHOR}, {NEAR} SELECT {K}, dist FROM placed0 LEFT JOIN near USING (g1, g2, gene1, gene2)",
    "distance_fence": f"WITH {PLACED_ANCHOR}, {SELF} SELECT g1, g2, round(fence_low, 6) AS fence_low, round(fence_high, 6) AS fence_high FROM dlim",
    "syntenic_hits": f"WITH {SYN} SELECT {K}, dist, is_anchor_pair FROM syn",
    "untangle": f"WITH {P}, {UNT} SELECT {K} FROM unt",
    "pair_class": f"WITH {P}, {UNT}, {classes('unt')} SELECT {K}, class FROM kl",
    "components": f"WITH RECURSIVE {P}, {UNT}, {comp('unt')} SELECT {K}, component FROM cc",
    "sog_ids": f"WITH RECURSIVE {P}, {UNT}, {comp('unt')}, {SOG} SELECT {K}, class, SOG FROM sg",
    "split_genes": f"""WITH {P}, {UNT}, {classes('unt')}, c AS (SELECT *, count(*) OVER (PARTITION BY g1, g2, gene1) AS n1, count(*) OVER (PARTITION BY g1, g2, gene2) AS n2 FROM kl)
SELECT {K}, class, class = 'MtoM' AND n1 > 1 AND n1 = 1 AS is_split1, (class = 'Mto1' AND n2 = 1) OR (class = 'MtoM' AND n2 > 1 AND n2 = 1) AS is_split2 FROM c""",
    "filter_pairs": f"""WITH RECURSIVE {SYN}, f2 AS (SELECT *, {R1} AS r1, {R2} AS r2 FROM syn), su AS (SELECT * EXCLUDE (r1, r2) FROM f2 WHERE r1 = 1 OR r2 = 1), {comp('su')}, {SOG},
bs AS (SELECT g1, g2, SOG, max(ci_q2s) AS b1, max(ci_s2q) AS b2, max(pident) AS b3, max(pident) FILTER (NOT is_anchor_pair) AS b4 FROM sg GROUP BY ALL),
lm AS (SELECT g1, g2, {IQR_LOW.format(v='b1')} AS l1, {IQR_LOW.format(v='b2')} AS l2, {IQR_LOW.format(v='b3')} AS l3, {IQR_LOW.format(v='b4')} AS l4 FROM bs GROUP BY ALL)
SELECT {K}, class, SOG, is_anchor_pair FROM sg JOIN bs USING (g1, g2, SOG) JOIN lm USING (g1, g2) WHERE (b1 >= l1 OR b2 >= l2 OR b3 >= l3) AND (is_anchor_pair OR b4 >= l4)""",
    "orphans": f"WITH {P}, {A.GENES_SQL}, {BEST}, {_orph('best')} SELECT * FROM orph",
    "mutual_ci_stats": f"""WITH {P} SELECT least(g1, g2) AS genome1, greatest(g1, g2) AS genome2, count(*) AS n_pairs, round(avg(mutual_ci), 6) AS mean, round(stddev_samp(mutual_ci), 6) AS sd,
{', '.join(f'round(quantile_cont(mutual_ci, {q}), 6) AS {n}' for n, q in (('q10', 0.1), ('q25', 0.25), ('median', 0.5), ('q75', 0.75), ('q90', 0.9)))} FROM pairs GROUP BY ALL""",
    "mean_ci_matrix": f"""WITH {P}, m AS (SELECT g1, g2, round(avg(mutual_ci), 6) AS v FROM pairs GROUP BY ALL), b AS (SELECT g1 AS genome, g2 AS other, v FROM m UNION ALL SELECT g2, g1, v FROM m)
SELECT genome, {', '.join(f"max(v) FILTER (other = '{g}') AS \"{g}\"" for g in A.GENOMES)} FROM b GROUP BY genome""",
    "pair_summary": f"""WITH {P}, {A.GENES_SQL}, {UNT}, {classes('unt')}, {_orph('unt')},
f1 AS (SELECT g1, g2, 1 AS side, g1 AS genome, class FROM (SELECT *, row_number() OVER (PARTITION BY g1, g2, gene1 ORDER BY {TIE}) AS r FROM kl) WHERE r = 1
UNION ALL SELECT g1, g2, 2, g2, class FROM (SELECT *, row_number() OVER (PARTITION BY g1, g2, gene2 ORDER BY {TIE}) AS r FROM kl) WHERE r = 1),
c AS (SELECT g1, g2, side, genome, count(*) AS "Classified", {', '.join(f"count(*) FILTER (class = '{k}') AS \"{k}\"" for k in pairing.CLASSES)} FROM f1 GROUP BY ALL),
o AS (SELECT g1, g2, genome, count(*) AS n FROM orph GROUP BY ALL), t AS (SELECT c.*, coalesce(n, 0) AS "Orphan", "Classified" + coalesce(n, 0) AS "Total" FROM c LEFT JOIN o USING (g1, g2, genome)),
u AS ({' UNION ALL '.join(f"SELECT g1, g2, side, '{x}' AS label, CAST(\"{x}\" AS DOUBLE) AS v FROM t UNION ALL SELECT g1, g2, side, '{x}_ratio', round(\"{x}\" / \"Total\", 4) FROM t" for x in SUMMARY_LABELS)})
SELECT g1, g2, label, max(v) FILTER (side = 1) AS genome1, max(v) FILTER (side = 2) AS genome2 FROM u GROUP BY ALL""",
    "get_pairs_score": f"WITH {P}, {BEST}, {classes('best')} SELECT {K}, class, pident, {RS}, ci_q2s AS q2s_ci, ci_s2q AS s2q_ci FROM kl WHERE g1 = 'P' AND g2 = 'S'",
    "get_pairs_loc": f"WITH {PLACED}, {BEST}, {classes('best')} SELECT {K}, class, chr1, chr2, pos1, pos2 FROM kl JOIN placed0 USING (g1, g2, gene1, gene2) WHERE g1 = 'C' AND g2 = 'P'",
}


# hits


def hsp_normalize(spark, sf):
    return hits.normalize(A.segments(spark, sf))


def hsp_contained_filter(spark, sf):
    return hits.kept_segments(hits.normalize(A.segments(spark, sf)))


def interval_union_length(spark, sf):
    return hits.coverage(hits.normalize(A.segments(spark, sf))).select("txA", "txB", "len1", "len2")


def directional_coverage(spark, sf):
    return hits.coverage(hits.normalize(A.segments(spark, sf))).select("txA", "txB", "n_kept", "cov1", "cov2")


def reciprocal_hits(spark, sf):
    from ..compat import Compat

    rows = hits.reciprocal_hits(hits.normalize(A.segments(spark, sf)), Compat(sig6=False))
    return rows.withColumns({c: F.round(c, 9) for c in ("pident", "q2s_ci", "s2q_ci", "mutual_ci")})  # sums of doubles in any order


def six_digits(spark, sf):
    v = F.sqrt("l_extendedprice")
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sig6(v).alias("v"))


def identical_sequences(spark, sf):
    return hits.identical_sequences(A.table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq")))


C = A.COVER_SQL
SQL |= {
    "hsp_normalize": f"WITH {A.SEGMENTS_SQL} SELECT txA, txB, Astart, Aend, Bstart, Bend, pident, dir, qlen FROM norm",
    "hsp_contained_filter": f"WITH {A.SEGMENTS_SQL} SELECT txA, txB, Astart, Aend, Bstart, Bend, dir, qlen, pident FROM kept",
    "interval_union_length": f"WITH {C} SELECT t.txA, t.txB, coalesce(len1, 0) AS len1, coalesce(len2, 0) AS len2 FROM (SELECT DISTINCT txA, txB FROM norm) t LEFT JOIN cov ON cov.txA = t.txA AND cov.txB = t.txB",
    "directional_coverage": f"WITH {C}, n AS (SELECT txA, txB, count(*) AS n FROM kept GROUP BY ALL) SELECT t.txA, t.txB, coalesce(n, 0) AS n_kept, CAST(floor(100.0 * len1 / q1) AS BIGINT) AS cov1, CAST(floor(100.0 * len2 / q2) AS BIGINT) AS cov2 FROM (SELECT DISTINCT txA, txB FROM norm) t LEFT JOIN cov USING (txA, txB) LEFT JOIN n USING (txA, txB)",
    "reciprocal_hits": f"""WITH {C}, w AS (SELECT txA, txB, sum(pident / 100 * (Aend - Astart + 1)) / sum(Aend - Astart + 1) * 100 AS pident FROM kept GROUP BY ALL HAVING count(DISTINCT dir) = 2),
x AS (SELECT txA, txB, pident, CAST(floor(100.0 * len1 / q1) AS BIGINT) AS c1, CAST(floor(100.0 * len2 / q2) AS BIGINT) AS c2 FROM w JOIN cov USING (txA, txB))
SELECT txA AS genome1_tx, txB AS genome2_tx, round(pident, 9) AS pident, c1 AS q2s_qcovs, c2 AS s2q_qcovs, round(pident * c1 * 1e-4, 9) AS q2s_ci, round(pident * c2 * 1e-4, 9) AS s2q_ci, round(pident * c1 * 1e-4 * (pident * c2 * 1e-4), 9) AS mutual_ci FROM x""",
    "six_digits": "SELECT l_orderkey, l_linenumber, CAST(printf('%.6g', sqrt(l_extendedprice)) AS DOUBLE) AS v FROM lineitem",
    "identical_sequences": "SELECT rep, doc_id AS member FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents) WHERE doc_id <> rep",
}


# graph


def _best(spark, sf):
    return pairing.reciprocal_best(A.pair_scores(spark, sf))


def graph_vertices(spark, sf):
    return orthogroups.vertices(_best(spark, sf))


def graph_edges(spark, sf):
    return orthogroups.edges(_best(spark, sf))


def component_partition(spark, sf):
    return orthogroups.partition_components(_best(spark, sf)).select("name", "genome", "n_vertices", "n_genomes", "simple")


def colorful_sets(spark, sf):
    return orthogroups.orthogroup_members(_best(spark, sf)).select("set_id", "genome", "gene")


def orthogroup_wide(spark, sf):
    return orthogroups.orthogroups_wide(orthogroups.orthogroup_members(_best(spark, sf)), A.GENOMES)


def pairwise_groups(spark, sf):
    return orthogroups.pairwise_groups(orthogroups.orthogroup_members(_best(spark, sf)))


def reorg_orphans(spark, sf):
    m = orthogroups.orthogroup_members(_best(spark, sf))
    return orthogroups.reorganised_orphans(m, A.genes(spark, sf).select("genome", "gene"), A.GENOMES)


def component_stats(spark, sf):
    return orthogroups.component_stats(_best(spark, sf)).drop("component")


def genome_pair_stats(spark, sf):
    return orthogroups.genome_pair_stats(A.pair_scores(spark, sf))


def split_rename(spark, sf):
    t = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda key, mod: F.when(F.col("l_linenumber") % mod == 0, F.concat(F.col(key).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(":split"))).otherwise(F.col(key).cast("string"))
    rows = t.select(
        F.lit("P").alias("g1"), F.lit("C").alias("g2"), F.concat_ws(".", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tx1"), F.concat_ws(".", F.col("o_custkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tx2"),
        name("l_partkey", 3).alias("gene1"), name("o_custkey", 4).alias("gene2"), F.col("l_partkey").cast("string").alias("original1"), F.col("o_custkey").cast("string").alias("original2"),
    )
    return orthogroups.split_renames(rows)


EDGE = f"{P}, {BEST}, ge AS (SELECT g1 || ':' || gene1 AS src, g2 || ':' || gene2 AS dst, mutual_ci FROM best)"
GCOMP = EDGE + """, walk(n, m) AS (SELECT src, src FROM ge UNION SELECT dst, dst FROM ge UNION SELECT e.y, walk.m FROM walk JOIN (SELECT src AS x, dst AS y FROM ge UNION ALL SELECT dst, src FROM ge) e ON e.x = walk.n),
lab AS (SELECT n AS name, min(m) AS component, split_part(n, ':', 1) AS genome, split_part(n, ':', 2) AS gene FROM walk GROUP BY n),
sz AS (SELECT component, count(*) AS n_vertices, count(DISTINCT genome) AS n_genomes FROM lab GROUP BY 1)"""
# with three colours a maximal set is a vertex chain of two or three: every connected set is one edge or an edge and a third vertex
SETS = GCOMP + """, ways AS (SELECT src AS a, dst AS b FROM ge UNION SELECT dst, src FROM ge),
two AS (SELECT a, b FROM ways WHERE a < b), three AS (SELECT DISTINCT list_sort([two.a, two.b, c.b]) AS s FROM two JOIN ways c ON (c.a = two.a OR c.a = two.b) WHERE split_part(c.b, ':', 1) NOT IN (split_part(two.a, ':', 1), split_part(two.b, ':', 1))),
sets AS (SELECT s FROM three UNION ALL SELECT [a, b] FROM two WHERE NOT EXISTS (SELECT 1 FROM three WHERE list_contains(s, a) AND list_contains(s, b))),
mem AS (SELECT CASE WHEN n_vertices = n_genomes THEN component ELSE array_to_string(s, '|') END AS set_id, split_part(v, ':', 1) AS genome, split_part(v, ':', 2) AS gene FROM (SELECT s, unnest(s) AS v FROM sets) JOIN lab ON name = v JOIN sz USING (component))"""
ESTAT = "count(*) AS nE, round(max(mutual_ci), 6) AS max, round(quantile_cont(mutual_ci, 0.25), 6) AS q1, round(quantile_cont(mutual_ci, 0.5), 6) AS median, round(quantile_cont(mutual_ci, 0.75), 6) AS q3, round(min(mutual_ci), 6) AS min, round(avg(mutual_ci), 6) AS mean, round(stddev_samp(mutual_ci), 6) AS sd"
PW = "pw AS (SELECT DISTINCT a.genome AS g1, b.genome AS g2, a.gene AS gene1, b.gene AS gene2 FROM mem a JOIN mem b USING (set_id) WHERE a.genome < b.genome)"
SQL |= {
    "graph_vertices": f"WITH {EDGE} SELECT name, split_part(name, ':', 1) AS genome, CAST(split_part(name, ':', 2) AS BIGINT) AS gene FROM (SELECT src AS name FROM ge UNION SELECT dst FROM ge)",
    "graph_edges": f"WITH {EDGE} SELECT src, dst, mutual_ci, split_part(src, ':', 1) AS g1, split_part(dst, ':', 1) AS g2 FROM ge",
    "component_partition": f"WITH RECURSIVE {GCOMP} SELECT name, genome, n_vertices, n_genomes, n_vertices = n_genomes AS simple FROM lab JOIN sz USING (component)",
    "colorful_sets": f"WITH RECURSIVE {SETS} SELECT set_id, genome, gene FROM mem",
    "orthogroup_wide": f"""WITH RECURSIVE {SETS} SELECT {', '.join(f"max(gene) FILTER (genome = '{g}') AS \"{g}\"" for g in A.GENOMES)} FROM mem GROUP BY set_id""",
    "pairwise_groups": f"WITH RECURSIVE {SETS}, {PW} SELECT * FROM pw",
    "reorg_orphans": f"""WITH RECURSIVE {SETS}, {PW}, {A.GENES_SQL}, gp AS (SELECT * FROM (VALUES ('C', 'P'), ('C', 'S'), ('P', 'S')) v(g1, g2))
SELECT g1, g2, genome, CAST(gene AS VARCHAR) AS gene FROM gp JOIN genes ON genome = g1 WHERE NOT EXISTS (SELECT 1 FROM pw WHERE pw.g1 = gp.g1 AND pw.g2 = gp.g2 AND gene1 = CAST(gene AS VARCHAR))
UNION ALL SELECT g1, g2, genome, CAST(gene AS VARCHAR) FROM gp JOIN genes ON genome = g2 WHERE NOT EXISTS (SELECT 1 FROM pw WHERE pw.g1 = gp.g1 AND pw.g2 = gp.g2 AND gene2 = CAST(gene AS VARCHAR))""",
    "component_stats": f"WITH RECURSIVE {GCOMP}, e AS (SELECT component, {ESTAT} FROM ge JOIN lab ON name = src GROUP BY 1) SELECT e.* EXCLUDE (component), n_vertices AS nV, n_genomes AS nGenome FROM e JOIN sz USING (component)",
    "genome_pair_stats": f"WITH {P} SELECT g1, g2, {ESTAT} FROM pairs GROUP BY ALL",
    "split_rename": """WITH r AS (SELECT l_partkey p, o_custkey c, l_linenumber n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT DISTINCT 'P' AS genome, p || '.' || n AS tx, p || '.' || n || ':split' AS gene, p AS o FROM r WHERE n % 3 = 0 UNION SELECT DISTINCT 'C', c || '.' || n, c || '.' || n || ':split', c FROM r WHERE n % 4 = 0),
m AS (SELECT genome, o FROM x GROUP BY ALL HAVING count(DISTINCT gene) > 1) SELECT genome, tx, gene FROM x JOIN m USING (genome, o)""",
}

# workflow


def _reciprocal(spark, sf):
    from ..compat import Compat

    rows = hits.reciprocal_hits(hits.normalize(A.segments(spark, sf)), Compat(sig6=False))
    return rows.withColumns({c: F.round(c, 9) for c in ("pident", "q2s_ci", "s2q_ci", "mutual_ci")})


def threshold_filter(spark, sf):
    return workflow.valid_hits(_reciprocal(spark, sf), 0.1).select("genome1_tx", "genome2_tx", "mutual_ci")


def tx_gene_map(spark, sf):
    rows = workflow.gene_pairs(workflow.valid_hits(_reciprocal(spark, sf)), A.transcripts(spark))
    return rows.select(*COLS, "tx1", "tx2", "mutual_ci", "chr1", "chr2", "pos1", "pos2")


def ortholog_pairs(spark, sf):
    """Customers and parts as transcripts, two neighbours a gene."""
    base = F.when(F.col("genome") == "C", 1001).otherwise(1002) * 1_000_000
    gene = F.floor(F.col("gene") / 2)
    tx = A.genes(spark, sf).filter("genome in ('C', 'P')").select(
        F.concat("genome", F.lit(".g"), gene.cast("string")).alias("gene_id"), F.concat("genome", F.lit(".t"), F.col("gene").cast("string")).alias("transcript_id"),
        (base + F.col("gene")).alias("tx_index"), (base + gene).alias("gene_index"), F.col("chr").alias("seqnames"), F.col("gene").alias("start"), (F.col("gene") + 1).alias("end"), F.lit("1").alias("strand"),
    )
    rbh = A.pair_scores(spark, sf).filter("g1 = 'C' and g2 = 'P'")
    rbh = rbh.select((F.col("gene1") + 1001 * 1_000_000).alias("genome1_tx"), (F.col("gene2") + 1002 * 1_000_000).alias("genome2_tx"), "pident", F.col("ci_q2s").alias("q2s_ci"), F.col("ci_s2q").alias("s2q_ci"), "mutual_ci")
    return workflow.ortholog_pairs(rbh, tx)


RECIPROCAL_SQL = SQL["reciprocal_hits"].replace("SELECT txA AS genome1_tx", ", rbh AS (SELECT txA AS genome1_tx") + ")"
SQL |= {
    "threshold_filter": f"{RECIPROCAL_SQL} SELECT genome1_tx, genome2_tx, mutual_ci FROM rbh WHERE mutual_ci >= 0.1",
    "tx_gene_map": f"""{RECIPROCAL_SQL}, tr AS (SELECT CAST(1001000000 + i AS BIGINT) AS tx, CAST(1001000000 + i // 3 AS BIGINT) AS gene, CAST(i // 3 % 5 AS VARCHAR) AS chr FROM range(200) t(i) WHERE i % 11 <> 0
UNION ALL SELECT 1002000000 + i, 1002000000 + i, CAST(i % 5 AS VARCHAR) FROM range(20) t(i)),
m AS (SELECT a.gene AS gene1, b.gene AS gene2, a.tx AS tx1, b.tx AS tx2, mutual_ci, a.chr AS chr1, b.chr AS chr2 FROM rbh JOIN tr a ON a.tx = genome1_tx JOIN tr b ON b.tx = genome2_tx)
SELECT CAST(1001 AS BIGINT) AS g1, CAST(1002 AS BIGINT) AS g2, * EXCLUDE (r), gene1 AS pos1, gene2 AS pos2 FROM (SELECT *, row_number() OVER (PARTITION BY gene1, gene2 ORDER BY mutual_ci DESC, tx1, tx2) AS r FROM m) WHERE r = 1""",
}
ROWS_ONLY = ("ortholog_pairs",)
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
__all__ = ["QUERIES", "SQL", "graph", "synteny"]
