"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Two GRUs read a segment of bytes in both directions; every position gets a distribution over the
languages from both states. Training is backpropagation through time with Adam on segments of a bounded
sample. A document's whole bytes are cut into segments, every position is labelled, and the document's
probabilities are the means of its positions'.

Bounds: at most `SAMPLE` documents of each language, chosen by a hash, `PER_DOC` segments of each. Rows
with crc32(doc_id) mod 3 = 1 are never learned from.

Defined cases: null text or no letter gives `und` with score 0; with no labelled row at all every
prediction is `und`; null lang is not learned from; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import utf8

HIDDEN = 16
SEGMENT = 128
TRAIN_SEGMENT = 64
SAMPLE = 1_500
PER_DOC = 3
STEPS = 260
BATCH = 256
HELD_OUT = 1
#: Bytes labelled at a time.
BLOCK = 1 << 19


def _sigmoid(x):
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class BiGRU:
    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 1):
        r = np.random.default_rng(seed)
        h = hidden
        self.h, self.classes = h, classes
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["E" + d] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)  # byte -> gate inputs
            self.p["U" + d] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.p["c" + d] = np.zeros(3 * h, np.float32)
            self.p["W" + d] = r.normal(0, 1 / np.sqrt(h), (h, classes)).astype(np.float32)
        self.p["bo"] = np.zeros(classes, np.float32)

    def _states(self, x: np.ndarray, d: str, keep: bool, mask: np.ndarray | None = None):
        """x[T, n] bytes in reading order -> states [T, n, h] and, to train, what BPTT needs."""
        E, R, c, h = self.p["E" + d], self.p["U" + d], self.p["c" + d], self.h
        T, n = x.shape
        s = np.zeros((n, h), R.dtype)
        out = np.empty((T, n, h), R.dtype)
        tape = []
        a = np.empty((n, 3 * h), R.dtype)
        for t in range(T):
            g = E[x[t]]
            np.dot(s, R, out=a)
            a += c
            zr = _sigmoid(g[:, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            m = r * a[:, 2 * h :]
            m += g[:, 2 * h :]
            np.tanh(m, out=m)
            new = s - m
            new *= z
            new += m
            if mask is not None:
                new *= mask[t]
            if keep:
                tape.append((s, z, r, a[:, 2 * h :].copy(), m))
            s = out[t] = new
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """x[T, n]: the distribution of each position, [T, n, classes]. mask[T, n, 1]: 0 past the end."""
        T, n = x.shape
        f, _ = self._states(x, "f", False, mask)
        logits = (f.reshape(T * n, -1) @ self.p["Wf"]).reshape(T, n, -1)
        b, _ = self._states(x[::-1], "b", False, None if mask is None else mask[::-1])
        logits += (b.reshape(T * n, -1) @ self.p["Wb"]).reshape(T, n, -1)[::-1]
        logits += self.p["bo"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of segments x[T, n] of classes y[n], and its gradients."""
        T, n = x.shape
        h = self.h
        f, tf = self._states(x, "f", True)
        b, tb = self._states(x[::-1], "b", True)
        logits = f @ self.p["Wf"] + (b @ self.p["Wb"])[::-1] + self.p["bo"]
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        loss = -np.log(p[:, np.arange(n), y] + 1e-9).mean()
        p[:, np.arange(n), y] -= 1
        p /= T * n
        grads = {"bo": p.sum((0, 1))}
        for d, states, tape, dl, xs in (("f", f, tf, p, x), ("b", b, tb, p[::-1], x[::-1])):
            R, W = self.p["U" + d], self.p["W" + d]
            gW, gE, gR, gc = np.zeros_like(W), np.zeros_like(self.p["E" + d]), np.zeros_like(R), np.zeros_like(self.p["c" + d])
            ds = np.zeros((n, h), np.float32)
            for t in range(T - 1, -1, -1):
                s, z, r, ah, m = tape[t]
                gW += states[t].T @ dl[t]
                ds = ds + dl[t] @ W.T
                dm = ds * (1 - z) * (1 - m * m)
                dz = ds * (s - m) * z * (1 - z)
                dr = dm * ah * r * (1 - r)
                da = np.concatenate([dz, dr, dm * r], 1)
                dg = np.concatenate([dz, dr, dm], 1)
                np.add.at(gE, xs[t], dg)
                gR += s.T @ da
                gc += da.sum(0)
                ds = ds * z + da @ R.T
            grads |= {"W" + d: gW, "E" + d: gE, "U" + d: gR, "c" + d: gc}
        return float(loss), grads


def train_network(segments: np.ndarray, classes: np.ndarray, n: int, steps: int = STEPS, batch: int = BATCH, rate: float = 0.015, seed: int = 5) -> BiGRU:
    """segments[m, T] bytes. Batches have as many segments of each class, so no language is favoured."""
    net, r = BiGRU(n), np.random.default_rng(seed)
    own = [np.flatnonzero(classes == k) for k in range(n)]
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t in range(1, steps + 1):
        pick = np.concatenate([r.choice(o, max(1, batch // n)) for o in own])
        _, grads = net.step(segments[pick].T, classes[pick])
        lr = rate * (1 - 0.9 * t / steps)
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads.values())) + 1e-9))
        for k, g in grads.items():
            g = g * scale
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] -= (lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def document_means(net: BiGRU, data: np.ndarray, off: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Each document's mean distribution over all its bytes; whole texts, cut into segments."""
    size = np.diff(off)
    out = np.zeros((len(size), net.classes))
    full = size // segment
    doc = np.repeat(np.arange(len(size)), full)
    if len(doc):
        first = np.cumsum(full) - full
        start = off[doc] + (np.arange(len(doc)) - first[doc]) * segment
        step = max(1, BLOCK // segment)
        for a in range(0, len(doc), step):
            x = data[start[a : a + step][None, :] + np.arange(segment)[:, None]]
            p = net.probabilities(x).sum(0)
            for c in range(net.classes):
                out[:, c] += np.bincount(doc[a : a + step], p[:, c], len(size))
    rest = size - full * segment
    tail = np.flatnonzero(rest)
    tail = tail[np.argsort(rest[tail], kind="stable")]  # like lengths together: little padding
    for a in range(0, len(tail), 2048):
        d = tail[a : a + 2048]
        T = int(rest[d].max())
        at = np.arange(T)[:, None]
        mask = (at < rest[d][None, :]).astype(np.float32)[:, :, None]
        x = data[np.minimum(off[d] + full[d] * segment + at, len(data) - 1)]
        out[d] += (net.probabilities(x, mask) * mask).sum(0)
    return out / np.maximum(size, 1)[:, None]


LETTER = re.compile(r"[^\W\d_]")


def _predict(sent, langs):
    def run(it):
        net = sent.value
        for batch in it:
            column = batch.column("text")
            texts = column.to_pylist()
            letter = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
            data, off = utf8(column)
            mean = document_means(net, data, off)
            best = mean.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)], pa.string()), pa.array(np.where(letter, mean.max(1, initial=0), 0.0).clip(0, 1))],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def fold(column: str = "doc_id"):
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % 3


def train(docs: DataFrame, sample: int = SAMPLE):
    """(network, languages) or (None, []) if there is nothing to learn from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null and text rlike '\\\\p{L}'").filter(fold() != HELD_OUT)
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return None, []
    mixed = F.xxhash64(F.lit(9), "doc_id")
    segments, classes = [], []
    r = np.random.default_rng(3)
    for k, lang in enumerate(langs):
        # a text adds three short windows, taken where the text is: only they are ordered and travel, no text
        spots = [F.expr(f"substring(b, cast(1 + floor((length(b) - {TRAIN_SEGMENT}) * {q}) as int), {TRAIN_SEGMENT})") for q in (r.random(PER_DOC) * 0.999).round(4)]
        own = rows.filter(F.col("lang") == lang).select(mixed.alias("at"), "doc_id", F.encode("text", "UTF-8").alias("b"))
        own = own.select("at", "doc_id", F.when(F.length("b") >= TRAIN_SEGMENT, F.array(*spots)).otherwise(F.array("b")).alias("s"))
        for row in own.orderBy("at", "doc_id").limit(sample).toLocalIterator():
            for s in row.s:
                if s:
                    segments.append(np.resize(np.frombuffer(bytes(s), np.uint8), TRAIN_SEGMENT))
                    classes.append(k)
    return train_network(np.stack(segments), np.array(classes), len(langs)), langs


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    net, langs = train(docs, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out")
    if net is None:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return rows.mapInArrow(_predict(sent, langs), "doc_id long, lang_pred string, score double").select("doc_id", held, "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
