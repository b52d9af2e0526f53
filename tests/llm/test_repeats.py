import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from lociweave.llm import op4_decontaminate as d4
from lociweave.llm import op8_jaccard as j8
from lociweave.llm import repeats
from lociweave.llm.op1_suffix_dedup import remove_repeated_bytes
from lociweave.llm.op5_substring_dedup import remove_repeated_words

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("name", T.StringType()), T.StructField("oid", T.StringType())])


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(1, 5))).strip() or "x"
    base = [" ".join(word() for _ in range(r.randint(5, 120))) for _ in range(12)]
    docs = []
    for i in range(90):
        parts = [r.choice(base)[r.randint(0, 60) :][: r.randint(20, 260)] if r.random() < 0.7 else " ".join(word() for _ in range(30)) for _ in range(r.randint(1, 4))]
        docs.append((i, (" " if r.random() < 0.5 else "\n\t").join(parts)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, "a" * 300), (203, "a" * 170 + "b"), (204, ""), (205, None), (206, "z y " * 40), (207, "q z y z y " * 30), (300, docs[5][1]), (300, docs[6][1]), (300, docs[6][1]), (None, docs[7][1]), (None, None)]
    r.shuffle(docs)
    return docs


def brute(docs, split, window, joiner):
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in docs:
        u = split(t or "")
        for p in range(len(u) - window + 1):
            w = tuple(u[p : p + window])
            first[w] = min(first.get(w, 1 << 63), key(i))
    out = []
    for i, t in docs:
        u = split(t or "")
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if first[tuple(u[p : p + window])] < key(i):
                gone[p : p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = joiner([x for x, g in zip(u, gone) if not g])
        out.append((i, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed,hot,sample", [(1, 20000, 64), (2, 3, 64), (6, 20000, 1)])
def test_bytes_against_brute_force(spark, monkeypatch, seed, hot, sample):
    monkeypatch.setattr(repeats, "SAMPLE", sample)  # 1: frequent names take the salted path
    docs = corpus(seed)
    want = brute(docs, lambda t: list(t.encode()), 50, bytes)
    got = remove_repeated_bytes(frame(spark, docs), hot=hot).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(x[2] for x in want) > 1000


@pytest.mark.parametrize("seed,hot,sample", [(3, 20000, 64), (4, 3, 1)])
def test_words_against_brute_force(spark, monkeypatch, seed, hot, sample):
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    docs = corpus(seed)
    want = [(i, n, g, h) for i, n, g, _, h in brute(docs, lambda t: t.split(), 13, lambda u: " ".join(u).encode())]
    got = remove_repeated_words(frame(spark, docs), hot=hot).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 300


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_bytes(none).collect() == []
    assert remove_repeated_words(none).collect() == []


def same_crc(a, b):
    """Two texts that start with a and b and whose crc32 are equal in the lower 20 bits."""
    crc = lambda t: zlib.crc32(t.encode()) & 0xFFFFF
    seen = {crc(f"{a} q{k}"): f"{a} q{k}" for k in range(5000)}
    return next((seen[c], t) for k in range(10**6) if (c := crc(t := f"{b} r{k}")) in seen)


def test_rows_of_one_id_are_told_apart(spark):
    words = lambda x: " ".join(f"{x}{k}" for k in range(30))
    a, b = same_crc(words("a"), words("b"))
    for i in (None, 7):
        docs = [(1, words("a")), (i, a), (i, b)]
        for remove, split, window, joiner, columns in ((remove_repeated_bytes, lambda t: list(t.encode()), 50, bytes, [0, 1, 2, 3, 4]), (remove_repeated_words, lambda t: t.split(), 13, lambda u: " ".join(u).encode(), [0, 1, 2, 4])):
            want = [tuple(r[k] for k in columns) for r in brute(docs, split, window, joiner)]
            assert sorted(map(tuple, remove(frame(spark, docs)).drop("kept").collect()), key=str) == want
    items = spark.createDataFrame([(1, words("a"))], "item_id long, text string")
    docs = frame(spark, [(7, a), (7, b)])
    assert sorted((r.n_hit, r.contaminated) for r in d4.contamination(docs, items).collect()) == [(0, False), (30, True)]
    assert b in [r.text for r in d4.decontaminate(docs, items).collect()]
    assert sorted(r.text for r in j8.without_near_duplicates(docs).collect()) == sorted([a, b])
