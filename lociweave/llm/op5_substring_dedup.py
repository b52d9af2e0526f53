"""Substring dedup: word repeats by difference-cover anchors.

D = {0, 1, 3} covers every difference modulo 7. So for windows of 13 words that start at i in one
document and at j in another there is a shift s < 7 with (i+s) mod 7 and (j+s) mod 7 both in D, and
the 7 words from there lie in both windows. Only these positions, 3 in 7, are hashed and dealt; an
anchor shared by two documents is then extended to the windows that hold it (see repeats.py).

Defined cases as in op1: null text has no words, shorter texts have no window, words are maximal runs
without space or \\t..\\r, unchanged.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .repeats import HOT, Unit, covered, with_marks
from .textkit import U, Prefix, chunks, mix, utf8, word_names, words

WINDOW = 13
#: The period and the difference cover modulo it.
PERIOD = 7
COVER = (0, 1, 3)


@dataclass(frozen=True)
class Words(Unit):
    window: int = WINDOW

    @property
    def gram(self) -> int:
        return self.window - PERIOD + 1

    @property
    def reach(self) -> int:
        return PERIOD - 1

    def split(self, data, off):
        name, _, _, doc = word_names(data, off)
        return name, np.searchsorted(doc, np.arange(len(off)), side="left")

    def anchors(self, values, off):
        prefix = Prefix(values)
        name = prefix.windows(self.gram)
        size = np.diff(off)
        doc = np.repeat(np.arange(len(size)), size)
        local = np.arange(len(values)) - np.repeat(off[:-1], size)
        ok = np.isin(local % PERIOD, COVER) & (size[doc] >= self.window) & (local + self.gram <= size[doc])
        pos = np.flatnonzero(ok)
        return pos, doc[pos], name[pos], prefix

    def pack(self, got):
        """The names of the windows that start 0..6 words before the anchor."""
        odd = np.random.default_rng(11).integers(1, 1 << 63, self.window, dtype=np.uint64) * U(2) + U(1)
        out = np.empty((len(got), self.reach + 1), U)
        for j in range(self.reach + 1):
            a = self.reach - j
            out[:, j] = mix((got[:, a : a + self.window] * odd).sum(1, dtype=U))
        return out

    def window_names(self, around):
        return np.ascontiguousarray(around).view(U)


def _digest(unit: Words):
    def run(it):
        for batch in it:
            data, off = utf8(batch.column("text"))
            ids, marks = batch.column("doc_id"), batch.column("marks")
            for i, j in chunks(off):
                start, end, doc = words(data, off[i : j + 1])
                uoff = np.searchsorted(doc, np.arange(j - i + 1), side="left")
                gone = covered(unit, marks.slice(i, j - i), uoff)
                part = data[int(off[i]) : int(off[j])].tobytes()
                texts = []
                for d in range(j - i):
                    a, b = uoff[d], uoff[d + 1]
                    if a == b:
                        texts.append(b"")
                    elif not gone[a:b].any():
                        texts.append(b" ".join(part[start[a] : end[b - 1]].split()))
                    else:
                        keep = np.flatnonzero(~gone[a:b]) + a
                        texts.append(b" ".join([part[s:e] for s, e in zip(start[keep], end[keep], strict=True)]))
                removed = np.concatenate([[0], np.cumsum(gone)])[uoff]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(np.diff(uoff).astype(np.int64)),
                        pa.array(np.diff(removed).astype(np.int64)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                        pa.array([x.decode("utf-8") for x in texts], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay). docs needs doc_id, text."""
    unit = Words(window)
    rows = with_marks(docs, unit, hot).select("doc_id", "text", "marks")
    return rows.mapInArrow(_digest(unit), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
