"""Small cases with known results (FIXTURES.md) and properties."""

import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequences
from lociweave.functions.stats import fences, grouped_quantiles, sig6
from lociweave.operators import annotation, compare, graph, hits, intervals, models, orthogroups, pairing, synteny
from lociweave.plans import adapters, search

HSP = "txA long, txB long, Astart int, Aend int, Bstart int, Bend int, pident double, dir int, qlen int"
CASES = {
    1: [(1, 90, 1, 90, 90, 1, 100), (1, 90, 1, 90, 90, 2, 120)],
    2: [(1, 100, 1, 100, 95, 1, 100), (1, 100, 201, 300, 94, 1, 100), (1, 100, 1, 100, 95, 2, 300)],
    3: [(1, 60, 1, 60, 90, 1, 110), (41, 100, 141, 200, 80, 1, 110), (1, 60, 1, 60, 90, 2, 200)],
    4: [(1, 90, 1, 90, 90, 1, 100)],
    5: [(1, 90, 1, 90, 90, 1, 100), (1, 90, 1, 90, 90, 2, 120), (10, 50, 300, 340, 99, 1, 100)],
    6: [(1, 30, 1, 30, 100, 1, 90), (61, 90, 61, 90, 97.5, 1, 90), (1, 30, 1, 30, 100, 2, 91), (61, 90, 61, 90, 97.5, 2, 91)],
}


def test_hits(spark):
    rows = [(k, 9, *map(int, c[:4]), float(c[4]), c[5], c[6]) for k, cs in CASES.items() for c in cs]
    df = spark.createDataFrame(rows, HSP)
    got = {r.genome1_tx: tuple(r)[2:] for r in hits.reciprocal_hits(df).collect()}
    assert got == {
        1: (90.0, 90, 75, 0.81, 0.675, 0.54675), 3: (86.6667, 90, 30, 0.78, 0.26, 0.2028),
        5: (90.0, 90, 75, 0.81, 0.675, 0.54675), 6: (98.75, 66, 65, 0.65175, 0.641875, 0.418342),
    }
    assert {r.txA: r.n_kept for r in hits.coverage(df).collect()} == {1: 2, 2: 1, 3: 3, 4: 1, 5: 2, 6: 4}


def test_normalize(spark):
    raw = spark.createDataFrame([(1002000005, 1001000003, 90.0, 1, 40, 50, 10, 100), (7, 7, 1.0, 1, 2, 1, 2, 3)], "qseqid long, sseqid long, pident double, qstart int, qend int, sstart int, send int, qlen int")
    (r,) = hits.normalize(raw).collect()
    assert tuple(r) == (1001000003, 1002000005, 10, 50, 1, 40, 90.0, 2, 100)


def pairs(spark, rows):
    return spark.createDataFrame([("A", "B", *r) for r in rows], "g1 string, g2 string, gene1 string, gene2 string, ci_q2s double, ci_s2q double").withColumn("pident", F.lit(90.0)).withColumn("mutual_ci", F.col("ci_q2s") * F.col("ci_s2q"))


def test_reciprocal_best_and_class(spark):
    p = pairs(spark, [("a", "x", 0.9, 0.8), ("a", "y", 0.7, 0.9), ("b", "y", 0.6, 0.5)])
    assert [(r.gene1, r.gene2) for r in pairing.reciprocal_best(p).collect()] == [("a", "x")]
    for edges, kind in (([("a", "x"), ("b", "x")], "Mto1"), ([("a", "x"), ("a", "y")], "1toM"), ([("a", "x"), ("b", "x"), ("b", "y")], "MtoM"), ([("a", "x")], "1to1")):
        assert {r["class"] for r in pairing.pair_class(pairs(spark, [(*e, 0.5, 0.5) for e in edges])).collect()} == {kind}


def test_distances_and_orphans(spark):
    a = spark.createDataFrame([("A", "B", f"a{i}", f"b{i}", "1", "1", x, y) for i, (x, y) in enumerate([(1, 1), (5, 6), (9, 9)])], "g1 string, g2 string, gene1 string, gene2 string, chr1 string, chr2 string, pos1 long, pos2 long")
    assert sorted(r.dist for r in pairing.nearest_anchor(a, a, omit_zero=True).collect()) == [7, 7, 9]
    genes = spark.createDataFrame([("A", g) for g in "abc"], "genome string, gene string")
    assert sorted(r.gene for r in pairing.orphans(pairs(spark, [("a", "x", 0.5, 0.5)]), genes).collect()) == ["b", "c"]


def test_stats(spark):
    v = spark.createDataFrame([("k", float(x)) for x in (1, 2, 4, 8, 16)], "k string, v double")
    assert tuple(fences(v, ["k"], "v").first()) == ("k", 2 - 9.0, 8 + 9.0)
    assert v.select(sig6(F.lit(86.66666666)).alias("x")).first().x == 86.6667
    for x, want in ((8.998185, 8.99818), (1234565.0, 1234560.0), (1234575.0, 1234580.0), (0.0, 0.0), (-2.5e-9, -2.5e-9)):
        assert v.select(sig6(F.lit(x)).alias("x")).first().x == want
    assert v.select(sig6(F.lit(None).cast("double")).alias("x")).first().x is None


def test_phase(spark):
    f = spark.createDataFrame([(1001, "c", "CDS", s, e, strand, f"i{s}", [t]) for t, strand in (("t", "+"), ("u", "-")) for s, e in ((1, 10), (21, 25), (31, 37))], "genome_id int, seqnames string, type string, start long, end long, strand string, ID string, Parent array<string>")
    rows = annotation.cds_phase(annotation.with_gene_id(f)).collect()
    got = {(r.parent, r.start): r.phase for r in rows}
    assert [got["t", s] for s in (1, 21, 31)] == [0, 2, 0] and [got["u", s] for s in (31, 21, 1)] == [0, 2, 0]


def brute_sets(vertex, colour, adjacent):
    def connected(s):
        s, seen, todo = set(s), set(), [next(iter(s))]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [n for n in adjacent[v] if n in s]
        return seen == s

    good = [set(s) for n in range(1, len(vertex) + 1) for s in itertools.combinations(vertex, n) if len({colour[v] for v in s}) == n and connected(s)]
    return sorted(tuple(sorted(s)) for s in good if not any(s < t for t in good))


@pytest.mark.parametrize("seed", range(60))
def test_colourful_sets(seed):
    r = random.Random(seed)
    vertex = [f"{c}{i}" for c in "ABCD"[: r.randint(2, 4)] for i in range(r.randint(1, 3))]
    adjacent = {v: set() for v in vertex}
    for a, b in itertools.combinations(vertex, 2):
        if a[0] != b[0] and r.random() < 0.4:
            adjacent[a].add(b)
            adjacent[b].add(a)
    colour = {v: v[0] for v in vertex}
    assert sorted(orthogroups.colorful_sets(vertex, colour, adjacent)) == brute_sets(vertex, colour, adjacent)


def test_components(spark):
    r = random.Random(1)
    e = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 380)] + [(500, 500)]
    root = {v: v for p in e for v in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in root}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_overlap_collapse(spark):
    r = random.Random(2)
    rows = [(f"g{k}", r.choice("12"), s := r.randrange(3000), s + r.randrange(60)) for k in range(60)]
    cds = spark.createDataFrame(rows, "gene string, chr string, start long, end long")
    got = {x.gene: x.collapsed for x in intervals.collapse_overlapping(cds.select("gene"), cds, width=50).collect()}
    group = {g: {g} for g, *_ in rows}
    for a, b in itertools.combinations(rows, 2):
        if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and group[a[0]] is not group[b[0]]:
            both = group[a[0]] | group[b[0]]
            for g in both:
                group[g] = both
    assert got == {g: "/".join(sorted(s)) for g, s in group.items()}


def test_alignment():
    x, y = compare.align("ACGTACGT", "ACGACGT")
    assert x == "ACGTACGT" and y.replace("-", "") == "ACGACGT" and y.count("-") == 1
    s = compare.summarise("MKV", "MKVAA", "p.")
    assert s["aln_len"] == 5 and s["Ins_Length"] == 2 and s["Del"] is None
    assert compare.summarise(None, "A", "p.")["aln_len"] == 0


def test_promoters(spark):
    cds = spark.createDataFrame([("t1", "g1", "c", "+", 5000, 5100), ("t2", "g2", "c", "+", 3000, 3500), ("t3", "g3", "c", "-", 900, 1000)], "transcript_id string, gene_id string, seqnames string, strand string, start long, end long")
    sizes = spark.createDataFrame([("c", 3200)], "seqnames string, size long")
    got = {r.transcript_id: (r.start, r.end) for r in compare.promoter_windows(cds, sizes).collect()}
    assert got == {"t1": (3501, 3200), "t2": (1, 2999), "t3": (1001, 3200)}


def test_blocks(spark):
    rows = spark.createDataFrame([("c", k, a, o) for k, a, o in [(1, True, 1), (2, True, 2), (3, False, 2), (4, True, 4), (5, False, 1), (6, False, 4), (7, True, 7)]], "chr string, pos int, is_anchor_pair boolean, own int")
    got = {r.pos: r.synteny_block for r in synteny.synteny_blocks(rows, ["chr"], ["pos"], "own").collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[2] + 1 and got[7] > got[4]


def test_search_plan():
    assert search.all_pairs(["b", "a", "c"]) == [("b", "a"), ("b", "c"), ("a", "c")]
    jobs = search.plan([("a", "b"), ("a", "c")], {"a": 10, "b": 10, "c": 10})
    assert {(j.queries, j.database) for j in jobs} == {(("a",), ("b", "c")), (("b", "c"), ("a",))}
    assert search.chunks(["a", "b", "c"], {"a": 3, "b": 3, "c": 9}, 6) == [["a", "b"], ["c"]]


def test_codons(spark):
    df = spark.createDataFrame([("ATGAAATAA",), ("CTG",)], "seq string")
    assert [(r.a, r.b) for r in df.select(sequences.has_start(F.col("seq")).alias("a"), sequences.has_stop(F.col("seq")).alias("b")).collect()] == [(True, True), (False, False)]


@pytest.mark.parametrize("one_task", [10**6, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_either_way(spark, one_task, kind):
    r = random.Random(3)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(0, k) for k in range(400, 460)] + [(None, 3), (700, 700)]
    got = graph.connected_components(spark.createDataFrame(e, "src long, dst long").selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst").repartition(5), one_task=one_task).collect()
    root = {v: v for p in e if None not in p for v in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None:
            root[find(a)] = find(b)
    groups = {}
    for v in root:
        groups.setdefault(find(v), []).append(v if kind == "long" else str(v))
    assert {x.node: x.component for x in got} == {v: min(g) for g in groups.values() for v in g} and len(got) == len(root)


def test_islands(spark):
    r = random.Random(4)
    rows = [(r.choice(["1", "2", None]), s := r.randrange(900), s + r.choice([0, 3, 40, 200]) * r.randrange(2)) for _ in range(150)]
    got = intervals.islands(spark.createDataFrame(rows, "chr string, start long, end long"), ["chr"], width=50).collect()
    assert len(got) == len(rows)
    for c in ("1", "2", None):
        n, reach, want = 0, -1, []
        for _, s, e in sorted((x for x in rows if x[0] == c), key=lambda x: x[1:]):
            n += s > reach
            reach = max(reach, e)
            want.append((s, e, n))
        assert sorted((x.start, x.end, x.island) for x in got if x.chr == c) == sorted(want)


def test_chromosome_names(spark):
    want = {"chr001": "chr01", " scaffold ": "chr_scaffold", "Brand#12": "chr12", "0": "chr00", "Sc 7x99": "chr07", "A--b": "chr_a_b", "99999999999": "chr_99999999999"}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r.x: r.n for r in df.select("x", sequences.chromosome_name(F.col("x")).alias("n")).collect()} == want


def test_quantiles_hold_no_group(spark, tmp_path):
    """Equal to Spark's own, in brackets that are too narrow as well, and without its aggregate of all values."""
    v = F.when(F.col("id") % 7 == 0, None).otherwise(F.round(F.rand(1) * F.rand(2), 3) * F.when(F.col("id") % 11 == 0, -1).otherwise(1))
    odd = spark.createDataFrame([(5, 1.0), (5, 2.0), (6, None), (7, float("nan")), (7, 1.0), (None, 3.0)], "g long, v double")
    spark.range(20_000).select((F.col("id") % 2).alias("g"), v.alias("v")).unionByName(odd).write.parquet(str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v"))
    probs = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.9}
    want = sorted(map(repr, rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.percentile("v", F.lit(p)).alias(k) for k, p in probs.items())).collect()))
    for error in (1e-4, 0.01, 0.5):
        assert sorted(map(repr, grouped_quantiles(rows, ["g"], "v", probs, [F.count(F.lit(1)).alias("n")], error).collect())) == want
    scores = pairs(spark, [(k, "x", 0.5, 0.25 + k / 100) for k in range(9)])
    for df in (orthogroups.genome_pair_stats(scores), pairing.mutual_ci_stats(scores)):
        assert "percentile(" not in df._jdf.queryExecution().analyzed().toString()


def test_lead_pairs(spark):
    """What begins with the best pairs is the same on the leads as on the whole table, counts included."""
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    whole, leads = adapters.pair_scores(spark, sf), adapters.lead_pairs(spark, sf)
    rows = lambda df: sorted(map(tuple, df.select(*adapters.SCORED).collect()))
    assert 0 < leads.count() < whole.count()
    assert rows(pairing.untangle(leads)) == rows(pairing.untangle(whole))
    best = pairing.reciprocal_best(leads)
    assert rows(best) == rows(pairing.reciprocal_best(whole))
    assert rows(pairing.drop_high_copy(best, leads)) == rows(pairing.drop_high_copy(pairing.reciprocal_best(whole), whole))
    assert rows(pairing.anchors(leads)) == rows(pairing.anchors(whole))


def _ranges(n, genes, seed):
    r = random.Random(seed)
    spans = [(r.randrange(400), r.randrange(60)) for _ in range(n)]
    return [(f"t{k % (n // 2)}", f"g{k % genes}", "c" + str(k % 2), "+-"[k % genes % 2], a, a + b) for k, (a, b) in enumerate(spans)]


def test_promoters_by_sweep(spark):
    """Equal to the first of all overlaps, with windows over several bins; no overlap is made into a row."""
    rows = _ranges(120, 30, 3)
    cds = spark.createDataFrame(rows, "transcript_id string, gene_id string, seqnames string, strand string, start long, end long")
    sizes = spark.createDataFrame([("c0", 420), ("c1", 400)], "seqnames string, size long")
    made = compare.promoter_windows(cds, sizes, 50, 32)
    assert "overlap_join" not in dir(compare)
    env = {}
    for t, g, c, strand, a, b in rows:
        x = env.setdefault((t, g, c, strand), [a, b])
        x[:] = min(x[0], a), max(x[1], b)
    win = {k: (a - 50, a - 1) if k[3] == "+" else (b + 1, b + 50) for k, (a, b) in env.items()}
    first = {}
    for (t, g, c, strand), (lo, hi) in win.items():
        for _, g2, c2, strand2, a, b in rows:
            if (c, strand) == (c2, strand2) and g != g2 and a <= hi and b >= lo:
                first[t] = min(first.get(t, (a, b)), (a, b))
    want = []
    for (t, _, c, strand), (lo, hi) in win.items():
        if t in first:
            gap = hi - first[t][1] if strand == "+" else first[t][0] - lo
            if 0 < gap < 50:
                lo, hi = (first[t][1] + 1, hi) if strand == "+" else (lo, first[t][0] - 1)
        want.append((t, max(lo, 1), min(hi, {"c0": 420, "c1": 400}[c])))
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_collapsed_classes(spark):
    """One name a class, not one a gene; classes as by all pairs, over bins' borders."""
    rows = [(g, c, a, b) for _, g, c, _, a, b in _ranges(60, 40, 5)] + [("far", "c9", 1, 5), ("wide", "c0", 100, 180)]
    cds = spark.createDataFrame(rows, "gene string, chr string, start long, end long")
    up = {r[0]: r[0] for r in rows}
    for _ in range(len(up)):
        for a in rows:
            for b in rows:
                if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]:
                    up[a[0]] = up[b[0]] = min(up[a[0]], up[b[0]])
    got = intervals.collapsed_classes(cds, 16).collect()
    assert {r.gene: r.first for r in got} == up and len(got) == len(up)
    assert all(r.collapsed == ("/".join(sorted(g for g in up if up[g] == r.gene)) if r.gene == r.first else None) for r in got)


def test_flanking_frames_only_grow(spark):
    """Right on both sides, by frames that start at the first row: others cost the square of a chromosome's genes."""
    genes = spark.range(20).selectExpr("'c' as chr", "id as gene", "id in (3, 9) as anchor")
    rows = intervals.flanking(genes, ["chr"], "gene", "anchor")
    assert "UnboundedFollowing" not in rows._jdf.queryExecution().analyzed().toString().replace("unboundedfollowing", "UnboundedFollowing")
    assert {(r.gene, r.anchor_at) for r in rows.collect()} == {(g, a) for g in range(20) for a in ({3} if g <= 3 else {3, 9} if g < 9 else {9}) if g != a or g in (3, 9)} - {(9, 3)}


@pytest.mark.parametrize("share", [3, 10**6])
def test_contained_models(spark, share):
    """As by all pairs, in many regions or few: alike ones, rows given twice, places unknown, ends before starts, two
    sequences; and no pairs of CDS are joined."""
    r = random.Random(7)
    rows = [(f"t{r.randint(0, 250)}", r.choice("aaab"), s := r.randint(0, 60), s + r.choice([-2, 0, 3, 9, 30])) for _ in range(600)]
    rows += [("n1", None, 5, 6), ("n2", "a", None, 6), ("n2", "a", 1, 99), ("n3", "a", 4, None), ("n4", None, None, None), ("two", "a", 8, 9), ("two", "b", 8, 9), ("far", "a", 70, 10**6), ("in", "a", 9**6, 9**6 + 5)]
    rows += [("x1", "c", 1, 9), ("x1", "c", 2, 5), ("x2", "c", 1, 9), ("x3", "c", 1, 9), ("x3", "c", 20, 30), ("y1", "d", 1, 2), ("y2", "d", 1, 2), ("y2", "d", None, 2), ("z1", "e", 9, 2), ("z2", "e", 1, 3), ("z2", "e", 50, 60)]
    cds = {t: {x[1:] for x in rows if x[0] == t} for t in {x[0] for x in rows}}
    inside = lambda x, y: None not in (*x, *y) and x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]
    # the SQL counts different ranges against rows
    held = lambda t, o: t != o and len({x[1:] for x in cds[t] if any(inside(x, y) for y in cds[o])}) == len(cds[t])
    want = {t for t in cds if not any(held(t, o) and (o < t or not held(o, t)) for o in cds)}
    got = models.drop_contained(spark.createDataFrame(rows + rows[:200], "transcript_id string, chr string, start long, end long"), share=share)
    assert sorted(x.transcript_id for x in got.collect()) == sorted(want) and 50 < len(want) < len(cds) - 50
    assert "__bin" not in got._jdf.queryExecution().analyzed().toString()
