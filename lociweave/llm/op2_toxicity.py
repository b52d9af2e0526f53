"""Toxicity: class-conditional Kneser-Ney models over the bytes of words.

A word is ^bytes$. Each class has an interpolated Kneser-Ney model of the next byte after up to five
others; both back off to one shared distribution, whose lower orders are continuation counts and whose
highest order is pooled counts, gathered from *all* documents (they grow with the corpus). So for rare
expressions, in neither class or hardly, the classes' likelihoods agree and the ratio is near 0.

A document is scored by its length-normalised log-likelihood ratio, toxic against ordinary: over the
whole text (each byte) and over its strongest 1, 2 and 4 words, which keeps short passages in long
documents visible. A logistic function, fitted on rows that the models have not counted, makes it a
probability.

Bounds: the class counts take at most `SAMPLE` labelled rows of each class, the fit `FIT` rows, chosen
by a hash. The models' tables hold the grams of those rows only: where neither class has a gram, the
shared part cancels out, so nothing more is ever looked up. Rows with crc32(doc_id) mod 4 = 2 are never
learned from; of the others remainders 0 and 1 are counted and 3 is fitted on.

Defined cases: null and empty texts score as texts without evidence; repeated labels of a doc_id count
as toxic if any is; null labels and ids are not learned from; with one class only every score is that
share of the labels; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sparkkit import stage
from .textkit import LOWER, U, chunks, runs, trimmed, utf8, word_names

ORDER = 6
DISCOUNT = 0.75
#: How many observations the shared distribution weighs as in a class's context.
SHARED_WEIGHT = 20.0
SAMPLE = 10_000
FIT = 6_000
THRESHOLD = 0.3
TOPS = (1, 2, 4)
KNOWN = 400_000
HELD_OUT = 2

#: Words are runs of letters: anything but ASCII non-letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _codes(blob: np.ndarray, size: np.ndarray):
    """For words of these sizes, one after another, with a mark at either end: (order k, code) for each
    position but the first mark, k=1..ORDER, and each one's word; a code is k and up to 6 bytes."""
    long = size + 2
    total = int(long.sum())
    at = runs(long)
    word = np.repeat(np.arange(len(size)), long)
    seq = np.empty(total, np.uint8)
    seq[at == 0] = 2
    seq[at == np.repeat(long, long) - 1] = 3
    seq[(at > 0) & (at < np.repeat(long, long) - 1)] = blob
    code = np.zeros(total, U)
    for k in range(1, ORDER + 1):
        code[k - 1 :] |= seq[: total - k + 1].astype(U) << U(8 * (k - 1))
        ok = (at >= max(1, k - 1)) & (at >= k - 1)
        yield k, (code & U((1 << 8 * k) - 1))[ok] | U(k << 56), word[ok], at[ok]


def _uniques(data: np.ndarray, off: np.ndarray):
    """(names, blob of the words, sizes, counts for each word, doc, inverse) of a chunk's lower-cased words."""
    name, start, end, doc = word_names(data, off, lower=True, separator=NOT_LETTER)
    uniq, first, inverse = np.unique(name, return_index=True, return_inverse=True)
    return uniq, start[first], end[first], doc, inverse, end - start


def _blob(data, off, start, end):
    size = end - start
    return LOWER[data[int(off[0]) + np.repeat(start, size) + runs(size)]], size


def _count(it):
    """Partial counts: code, c0, c1, every."""
    parts: list[np.ndarray] = []
    held = 0

    def flush():
        codes = np.concatenate([p[0] for p in parts])
        uniq, inverse = np.unique(codes, return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(uniq)) for k in (1, 2, 3)]
        return [(uniq, *sums)], len(uniq)

    for batch in it:
        data, off = utf8(batch.column("text"))
        toxic = batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
        for i, j in chunks(off):
            uniq, start, end, doc, inverse, _ = _uniques(data, off[i : j + 1])
            if not len(uniq):
                continue
            label = toxic[i:j][doc]
            weights = [np.bincount(inverse[label == c], minlength=len(uniq)) for c in (0, 1)] + [np.bincount(inverse, minlength=len(uniq))]
            blob, size = _blob(data, off[i : j + 1], start, end)
            for _, code, word, _ in _codes(blob, size):
                u, inv = np.unique(code, return_inverse=True)
                parts.append((u, *(np.bincount(inv, w[word], len(u)) for w in weights)))
                held += len(u)
            if held > 1_000_000:
                parts, held = flush()
                if held > 700_000:
                    yield from _rows(parts.pop())
                    held = 0
    if parts:
        parts, _ = flush()
        yield from _rows(parts[0])


def _rows(part):
    code, *sums = part
    for a in range(0, len(code), 100_000):
        b = a + 100_000
        yield pa.RecordBatch.from_arrays([pa.array(code[a:b].view(np.int64)), *(pa.array(s[a:b].astype(np.int64)) for s in sums)], names=["code", "c0", "c1", "every"])


class Model:
    """Log-likelihood ratios of grams, and of contexts for grams that neither class has."""

    def __init__(self, code: np.ndarray, c: np.ndarray, every: np.ndarray, tails: np.ndarray, shared: np.ndarray | None = None):
        """code sorted; c[2, n] class counts; every: pooled counts; tails: distinct bytes seen before; shared[2, n]: total
        and number of all the corpus's grams of the gram's context (by default of those given)."""
        k = (code >> U(56)).astype(int)
        body = code & U((1 << 48) - 1)
        n = len(code)
        lower = np.where(k == ORDER, every, np.maximum(tails, 1)).astype(float)
        # newest byte is the lowest: context = body >> 8 with order k-1, suffix = body without the oldest byte
        context = (body >> U(8)) | ((k - 1).astype(U) << U(56))
        ctx, inv = np.unique(context, return_inverse=True)
        if shared is None:
            shared = np.stack([np.bincount(inv, lower)[inv], np.bincount(inv)[inv]])
        shared_n, shared_t = shared.astype(float)
        p = np.full(n, 1.0 / 256)
        for order in range(1, ORDER + 1):
            at = np.flatnonzero(k == order)
            back = np.full(len(at), 1.0 / 256)
            if order > 1:
                suffix = (body[at] & U((1 << 8 * (order - 1)) - 1)) | U((order - 1) << 56)
                pos = np.minimum(np.searchsorted(code, suffix), n - 1)
                back = np.where(code[pos] == suffix, p[pos], back)
            p[at] = (np.maximum(lower[at] - DISCOUNT, 0) + DISCOUNT * shared_t[at] * back) / shared_n[at]
        q, empty = [], []
        for own in c.astype(float):
            tot, types = np.bincount(inv, own), np.bincount(inv, own > 0)
            rest = DISCOUNT * types + SHARED_WEIGHT
            q.append((np.maximum(own - DISCOUNT, 0) + rest[inv] * p) / (tot + SHARED_WEIGHT)[inv])
            empty.append(rest / (tot + SHARED_WEIGHT))
        self.code, self.ratio = code, np.log(q[1] / q[0]).astype(np.float32)
        self.ctx, self.ctx_ratio = ctx, np.log(empty[1] / empty[0]).astype(np.float32)

    def words(self, blob: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio of each word: of each byte by its longest gram."""
        out = np.zeros(len(size))
        for k, code, word, at in _codes(blob, size):
            longest = at == k - 1 if k < ORDER else slice(None)
            code, word = code[longest], word[longest]
            if not len(code) or not len(self.code):
                continue
            pos = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            seen = self.code[pos] == code
            got = np.where(seen, self.ratio[pos], 0).astype(float)
            rest = np.flatnonzero(~seen)
            context = ((code[rest] & U((1 << 48) - 1)) >> U(8)) | U((k - 1) << 56)
            pos = np.minimum(np.searchsorted(self.ctx, context), len(self.ctx) - 1)
            got[rest] = np.where(self.ctx[pos] == context, self.ctx_ratio[pos], 0)
            out += np.bincount(word, got, len(size))
        return out


class Scorer:
    """Features of documents; words seen before are kept, up to KNOWN."""

    def __init__(self, model: Model):
        self.model = model
        self.name, self.value = np.zeros(0, U), np.zeros(0)

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        out = np.zeros((n, 1 + len(TOPS)))
        uniq, start, end, doc, inverse, size = _uniques(data, off)
        if not len(uniq):
            return out
        if len(self.name) + len(uniq) > KNOWN:
            self.name, self.value = np.zeros(0, U), np.zeros(0)
        new = np.ones(len(uniq), bool)
        if len(self.name):
            new = self.name[np.minimum(np.searchsorted(self.name, uniq), len(self.name) - 1)] != uniq
        if new.any():
            made = self.model.words(*_blob(data, off, start[new], end[new]))
            names = np.concatenate([self.name, uniq[new]])
            order = np.argsort(names, kind="stable")
            self.name, self.value = names[order], np.concatenate([self.value, made])[order]
        v = self.value[np.searchsorted(self.name, uniq)][inverse]
        out[:, 0] = np.bincount(doc, v, n) / np.maximum(np.bincount(doc, size + 1, n), 1)
        order = np.lexsort((-v, doc))
        count = np.bincount(doc, minlength=n)
        place = runs(count)
        for t, top in enumerate(TOPS):
            first = place < top
            out[:, 1 + t] = np.bincount(doc[order][first], v[order][first], n) / top
        return out


def _features(model, fitted=None):
    def run(it):
        scorer = Scorer(model.value)
        for batch in it:
            data, off = utf8(batch.column("text"))
            for i, j in chunks(off):
                x = scorer.features(data, off[i : j + 1])
                if fitted is None:
                    yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(fitted(x))], names=["doc_id", "score"])

    return run


class Fit:
    """Regularised logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float):
        self.prior, self.b = prior, None
        if len(y) and 0 < y.sum() < len(y):
            self.mean, self.sd = x.mean(0), x.std(0) + 1e-9
            z = self._z(x)
            b = np.zeros(z.shape[1])
            ridge = np.full(len(b), 0.5)
            ridge[-1] = 1e-6
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
                b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * b)
            self.b = b

    def _z(self, x):
        return np.c_[np.clip((x - self.mean) / self.sd, -50, 50), np.ones(len(x))]

    def __call__(self, x):
        if self.b is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.b, -30, 30)))


def fold(column: str = "doc_id"):
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit: int = FIT):
    """(model, fitted): learned from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold()).filter(F.col("fold") != HELD_OUT)
    known = stage(known, "labels")
    mixed = F.xxhash64(F.lit(3), "doc_id")
    pick = lambda rows, n: rows.orderBy(mixed, "doc_id").limit(n).select("doc_id", "toxic")
    counted = stage(pick(known.filter("fold < 2 and toxic = 0"), sample).unionByName(pick(known.filter("fold < 2 and toxic = 1"), sample)), "counted")
    # at most 2 * sample rows of 16 bytes
    rows = text.join(F.broadcast(counted), "doc_id", "left").select("text", "toxic")
    grams = rows.mapInArrow(trimmed(_count), "code long, c0 long, c1 long, every long").groupBy("code").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.sum("every").alias("every"))
    grams = stage(grams, "grams")
    # continuation counts: how many distinct longer grams end in a gram
    order = F.shiftright("code", 56)
    longer = grams.filter(order > 1).select((F.shiftleft(order - 1, 56)).bitwiseOR(F.col("code").bitwiseAND(F.expr("shiftleft(1L, cast(8 * (shiftright(code, 56) - 1) as int)) - 1"))).alias("code"))
    tails = longer.groupBy("code").agg(F.count(F.lit(1)).alias("tails"))
    grams = stage(grams.join(tails, "code", "left").withColumn("tails", F.coalesce("tails", F.lit(0))), "tails")
    # a context's total and number of grams, over the whole corpus, whatever the labelled sample has of them
    body = F.col("code").bitwiseAND(F.lit((1 << 48) - 1))
    context = F.shiftright(body, 8).bitwiseOR(F.shiftleft(order - 1, 56)).alias("context")
    lower = F.when(order == ORDER, F.col("every")).otherwise(F.greatest("tails", F.lit(1)))
    totals = grams.groupBy(context).agg(F.sum(lower).alias("shared_n"), F.count(F.lit(1)).alias("shared_t"))
    table = grams.filter("c0 + c1 > 0").withColumn("context", context).join(totals, "context").drop("context")
    got = table.toArrow()
    cols = {k: got.column(k).to_numpy() for k in got.column_names}
    o = np.argsort(cols["code"])
    model = Model(cols["code"][o].view(U), np.stack([cols["c0"][o], cols["c1"][o]]), cols["every"][o], cols["tails"][o], np.stack([cols["shared_n"][o], cols["shared_t"][o]]))
    sent = spark.sparkContext.broadcast(model)
    fitted = text.join(F.broadcast(pick(known.filter("fold = 3"), fit)), "doc_id")
    seen = fitted.mapInArrow(trimmed(_features(sent)), "toxic int, x array<double>").toArrow()
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    x = np.array(seen.column("x").to_pylist(), float).reshape(-1, 1 + len(TOPS))
    return sent, Fit(x, seen.column("toxic").to_numpy().astype(float), float(prior))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit: int = FIT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model, fitted = train(docs, labels, sample, fit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_features(model, fitted), "doc_id long, score double")
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keep(model, fitted, threshold):
    def run(it):
        scorer = Scorer(model.value)
        for batch in it:
            data, off = utf8(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            for i, j in chunks(off):
                keep[i:j] = fitted(scorer.features(data, off[i : j + 1])) < threshold
            yield batch.filter(pa.array(keep))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, same columns, without the rows that score `threshold` or more."""
    model, fitted = train(docs, labels)
    return docs.mapInArrow(trimmed(_keep(model, fitted, threshold)), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return toxicity(read("documents"), read("labels"))
