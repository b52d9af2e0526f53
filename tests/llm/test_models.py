import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lociweave.llm import op2_toxicity as t2
from lociweave.llm import op7_neighbours as n7
from lociweave.llm import op8_jaccard as j8
from lociweave.llm import op10_language as l10

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("node", T.StringType()), T.StructField("n", T.StringType()), T.StructField("toxic", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType()), T.StructField("rank", T.StringType())])


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "c", "c", "c") for i, t, lang in docs], DOCS).repartition(5)


def text_of(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_toxicity_held_out(spark):
    r = random.Random(1)
    bad = ["grobnik" + x for x in ("", "a", "os", "er", "ung", "ix")]
    docs, labels = [], []
    for i in range(1200):
        w = text_of(r, "etaoinshrdl", r.randint(10, 80)).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(r.randint(0, len(w)), r.choice(bad))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic), "c"))
    docs += [(5000, None, None), (5001, "", None), (5001, "", None), (None, "grobnika grobnik grobnikos", None), (5002, "etaoin " * 5000 + "grobnikung grobnikos grobnikix", None)]
    labels += [(None, 1, "c"), (3, None, "c"), (7, 0, "c")]
    known = spark.createDataFrame(labels, LABELS)
    rows = t2.toxicity(frame(spark, docs), known).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 1200 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and sum(r.held_out for r in rows) >= len(held) > 200
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert by[5002].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False and by[5000].predicted == 0
    clean = t2.without_toxic(frame(spark, docs), known)
    assert clean.columns == frame(spark, docs).columns and clean.count() == sum(not r.predicted for r in rows)
    assert t2.toxicity(frame(spark, []), known).collect() == []
    assert t2.toxicity(frame(spark, docs), spark.createDataFrame([], LABELS)).filter("score <> 0").count() == 0


def test_kneser_ney_ratio_is_zero_where_both_classes_agree():
    # unseen grams in contexts that neither class has leave the ratio at 0
    code = np.array([(1 << 56) | 97, (1 << 56) | 98], np.uint64)
    m = t2.Model(code, np.array([[5, 5], [5, 5]]), np.array([10, 10]), np.array([1, 1]))
    assert np.allclose(m.ratio, 0) and np.allclose(m.ctx_ratio, 0)


def test_gradients_match_differences():
    net = l10.BiGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(97, 103, (7, 5)), np.array([0, 1, 2, 1, 0])
    _, g = net.step(x, y)
    for k, at in (("Uf", (1, 2)), ("Ub", (2, 9)), ("Ef", (x[3, 2], 5)), ("Eb", (x[0, 0], 10)), ("Wf", (1, 1)), ("cb", (3,)), ("bo", (2,))):
        keep, e = net.p[k][at], 1e-3
        net.p[k][at] = keep + e
        up, _ = net.step(x, y)
        net.p[k][at] = keep - e
        down, _ = net.step(x, y)
        net.p[k][at] = keep
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-4, k


def test_language_held_out(spark):
    r = random.Random(2)
    letters = {"aa": "abcdefgh", "bb": "defghijk", "cc": "éèàùabcd"}
    docs = [(i, text_of(r, letters[k], r.randint(8, 90)), k) for i in range(900) for k in [("aa", "bb", "cc")[i % 3]]]
    docs += [(5000, None, "aa"), (5001, "12 34 !?", "aa"), (5002, "", None), (None, docs[0][1], None), (5003, "abcdefgh " * 4000, None), (5004, docs[2][1], None)]
    rows = l10.languages(frame(spark, docs), sample=250).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert len(held) > 200 and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == ("aa", "bb", "cc")[r.doc_id % 3] for r in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" for k in (5000, 5001, 5002)) and by[5003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in rows)
    assert l10.languages(frame(spark, [])).collect() == []
    assert {r.lang_pred for r in l10.languages(frame(spark, [(1, "abc", None)])).collect()} == {"und"}


def brute7(rows, k=10, every=100):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out, queries = [], {}
    for i, v in ok:
        if i % every == 0 and (i not in queries or tuple(v) < tuple(queries[i])):
            queries[i] = v
    for i, q in queries.items():
        found = sorted((float(n7.exact(v[None], q)[0]), j) for j, v in ok if j != i)[:k]
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(found)]
    return sorted(out)


def vectors(n, seed):
    g = np.random.default_rng(seed)
    rows = [(int(i), g.normal(size=8).astype(np.float32).tolist(), "c", "c") for i in range(n)]
    if n > 100:
        same = rows[1][1]
        rows += [(1000 + i, same, "c", "c") for i in range(150)]
        rows += [(2000, None, "c", "c"), (2001, [0.0] * 8, "c", "c"), (2100, [float("nan")] * 8, "c", "c"), (2200, [None, *[1.0] * 7], "c", "c"), (2300, [1.0, 2.0], "c", "c"), (None, same, "c", "c"), (200, rows[3][1], "c", "c"), (2400, [float("inf")] * 8, "c", "c"), (2500, [], "c", "c")]
    return rows


@pytest.mark.parametrize("n,block", [(700, 2048), (700, 2), (5, 2048), (0, 2048)])
def test_nearest_neighbours(spark, n, block):
    rows = vectors(n, 3)
    got = sorted(map(tuple, n7.nearest(spark.createDataFrame(rows, VECTORS).repartition(6), block=block).collect()))
    want = brute7(rows)
    assert len(got) == len(want)
    if n > 10:
        assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.95 * len(want)
    assert [x[:2] for x in got] == [x[:2] for x in want]


def near_corpus(seed):
    r = random.Random(seed)
    vocabulary = [text_of(r, "abcdefgh", 1) for _ in range(400)]
    base = [[r.choice(vocabulary) for _ in range(n)] for n in (3, 8, 14, 30, 60, 120, 240, 400)]
    docs, i = [], 0
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12, 20):
            w = list(b)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append((i, (" " if i % 2 else "\n").join(w), None))
            i += 7
    chain = list(base[5])
    for k in range(12):  # each differs from the one before by two words
        chain = chain[:]
        chain[5 + 9 * k] = "x%d" % k
        docs.append((3000 - k, " ".join(chain), None))
    docs += [(4000, None, None), (4001, "", None), (4002, " \n", None), (4003, "One", None), (4004, "one", None), (4005, "one two", None), (4006, "ONE two", None), (4006, "one three", None), (None, docs[9][1], None), (None, "only here some words", None), (4010, docs[20][1], None), (4010, docs[20][1], None), (4020, "a b c d " * 3000, None)]
    hub = [r.choice(vocabulary) for _ in range(100)]
    for k in range(60):
        w = list(hub)
        w[r.randrange(100)] = "h%d" % k
        docs.append((6000 + k, " ".join(w), None))
    r.shuffle(docs)
    return docs


def brute8(docs, shingle, percent):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t, _ in docs:
        w = low(t).split()
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    key = lambda i: 1 << 63 if i is None else i
    least = {}
    for a, (i, _, _) in enumerate(docs):
        least[find(a)] = min(least.get(find(a), 1 << 64), key(i))
    return sorted(((i, len(s), None if (m := least[find(a)]) == 1 << 63 else m) for a, ((i, _, _), s) in enumerate(zip(docs, sets))), key=str)


@pytest.mark.parametrize("shingle,percent,block,pivots", [(3, 90, 512, 16), (5, 80, 512, 16), (3, 90, 8, 0), (2, 70, 6, 1)])
def test_jaccard_components(spark, shingle, percent, block, pivots):
    docs = near_corpus(shingle)
    got = j8.near_duplicate_groups(frame(spark, docs), shingle, percent, block, pivots).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute8(docs, shingle, percent)


def test_near_duplicates_go(spark):
    docs = near_corpus(5)
    out = j8.without_near_duplicates(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    want = brute8(docs, 5, 80)
    kept = [r.doc_id for r in out.collect()]
    groups = {c for _, n, c in want if n}
    assert len(kept) == len(groups) + sum(n == 0 for _, n, _ in want)
    assert {i for i in kept if i is not None} >= {c for c in groups if c is not None}
    assert j8.without_near_duplicates(frame(spark, [])).collect() == []
    assert j8.near_duplicate_groups(frame(spark, [])).collect() == []


def test_groups_of_one_smallest_id_keep_one_each(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    docs = [(None, a, None), (None, a + " more", None), (None, b, None), (7, c, None), (7, c, None), (7, d, None), (9, d + " more", None), (None, None, None)]
    first = lambda rows: sorted((str(i), (t or "-")[0]) for i, t in rows)
    out = j8.without_near_duplicates(frame(spark, docs))
    assert first((r.doc_id, r.text) for r in out.collect()) == first([(None, a), (None, b), (7, c), (7, d), (None, None)])


def test_r_tree_bound_loses_no_link():
    r = np.random.default_rng(4)
    universe = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    base = [r.choice(universe, n, replace=False) for n in (5, 20, 80, 150)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) > 0.05], r.choice(universe, 2)])) for b in base for _ in range(25)]
    tree = j8.RTree(sets)
    for k, s in enumerate(sets):
        near = set(tree.near(tree.point[k], len(s), 80).tolist())
        assert {o for o, t in enumerate(sets) if j8.linked(s, t, 80)} <= near


@pytest.mark.parametrize("percent", [70, 80, 90])
@pytest.mark.parametrize("spare", [2, 4, 10])
def test_kept_heads_of_linked_sets_meet(percent, spare):
    """Whatever the frequencies and whichever tokens are heavy, linked sets keep a common token."""
    r = np.random.default_rng(percent + spare)
    universe = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(30):
        base = [r.choice(universe, n, replace=False) for n in (1, 2, 4, 9, 20, 60, 150)]
        sets = [np.unique(np.concatenate([b[r.random(len(b)) > r.choice([0, 0.03, 0.1])], r.choice(universe, r.integers(0, 1 + len(b) // 12))])) for b in base for _ in range(12)]
        sets = [s for s in sets if len(s)]
        off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        heavy = np.unique(r.choice(universe, r.integers(0, 200)))
        often = r.integers(16, 40, len(heavy))
        doc, key, hot, left = j8.head_tokens(np.concatenate(sets), off, percent, heavy, often, spare)
        count = dict(zip(*np.unique(key, return_counts=True)))
        kept = []
        for k in range(len(sets)):
            own, is_hot = key[doc == k], hot[doc == k]
            plain = sorted(own[~is_hot], key=lambda x: (-count[x], x))[left[k] :]
            kept.append(set(plain) | set(own[is_hot]))
        for a in range(len(sets)):
            for b in range(a):
                if j8.linked(sets[a], sets[b], percent):
                    assert kept[a] & kept[b], (len(sets[a]), len(sets[b]))
