"""Suffix-array dedup: byte repeats by distributed prefix doubling.

Suffixes are ranked by their first h bytes, h = window/2, then by the pair of ranks at offsets 0 and
h, which is the rank of 2h = window bytes: the threshold. A rank that one document alone holds
leaves at once. Two savings keep the sorted (position, rank) pairs far fewer than the bytes:

* of every window's suffixes at offsets 0..h only the one with the smallest rank name is sorted first
  (a local minimum, about 1 position in 13): equal windows pick equal positions, so a repeated window
  always has a sampled suffix with a repeated rank, and unique ranks dismiss all their windows;
* the next ranks are only given to windows round surviving suffixes, and where a whole neighbourhood
  repeats, once for all its windows (see repeats.py).

Ranks are 64-bit names, equal for equal strings, rather than ordinals: sorting by name gives the same
classes without a global numbering pass between rounds.

Defined cases: null text is empty; an empty or shorter text has no window; rows with one doc_id are
judged each against smaller ids only; null doc_id counts as larger than any other; matches never
cross documents; other columns are ignored. A document is processed whole in memory.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .repeats import HOT, Unit, covered, with_marks
from .textkit import BYTE_VALUE, U, Prefix, chunks, mix, powers, slide, utf8

WINDOW = 50


@dataclass(frozen=True)
class Bytes(Unit):
    """Prefix-doubling ranks over bytes."""

    window: int = WINDOW

    @property
    def half(self) -> int:
        return self.window // 2

    @property
    def reach(self) -> int:
        return self.window - self.half

    def split(self, data, off):
        return data[int(off[0]) : int(off[-1])], off - off[0]

    def anchors(self, values, off):
        h, w = self.half, self.reach + 1
        n = len(values)
        none = np.zeros(0, np.int64)
        if n < self.window:
            return none, none, none.view(U), None
        prefix = Prefix(BYTE_VALUE[values])
        rank = prefix.windows(h)
        least = slide(rank, w, np.minimum)  # of the window that starts at each position
        size = np.diff(off)
        starts = np.zeros(n + 1, np.int8)  # window starts that stay in their document
        whole = size >= self.window
        np.add.at(starts, off[:-1][whole], 1)
        np.add.at(starts, off[:-1][whole] + size[whole] - self.window + 1, -1)
        least[np.cumsum(starts[: len(least)], dtype=np.int8) == 0] = 0
        pad = np.zeros(w - 1, U)
        pos = np.flatnonzero(slide(np.concatenate([pad, least, pad]), w, np.maximum)[: len(rank)] == rank)
        return pos, np.searchsorted(off, pos, side="right") - 1, rank[pos], prefix

    def pack(self, got):
        return got.astype(np.uint8)

    def window_names(self, around):
        """Ranks of the windows that start 0..reach before the anchor: the pair of half ranks."""
        h, n = self.half, around.shape[1]
        pw, ipw = powers(n + 1)
        H = np.zeros((len(around), n + 1), U)
        np.cumsum(BYTE_VALUE[around] * pw[:n], axis=1, out=H[:, 1:])
        rank = mix((H[:, h:] - H[:, :-h]) * ipw[: n + 1 - h])
        j = self.reach - np.arange(self.reach + 1)
        rest = self.window - h
        second = rank[:, j + rest]
        return mix(rank[:, j] * U(0x9FB21C651E98DF25) + second)


def _digest(unit: Bytes):
    def run(it):
        for batch in it:
            data, off = utf8(batch.column("text"))
            ids, marks = batch.column("doc_id"), batch.column("marks")
            for i, j in chunks(off):
                values, uoff = unit.split(data, off[i : j + 1])
                gone = covered(unit, marks.slice(i, j - i), uoff)
                removed = np.concatenate([[0], np.cumsum(gone)])[uoff]
                kept = values[~gone].tobytes()
                cut = uoff - removed
                edge = np.zeros(len(values) + 1, np.int64)
                if len(values):
                    edge[1:] = np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))
                    starts = uoff[:-1][(np.diff(uoff) > 0)]
                    extra = np.zeros(len(values) + 1, np.int64)  # a run over a border counts for both
                    inner = starts[starts > 0]
                    extra[inner + 1] = gone[inner] & gone[inner - 1]
                    edge += np.cumsum(extra)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(np.diff(uoff)),
                        pa.array(np.diff(removed)),
                        pa.array(np.diff(edge[uoff])),
                        pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
                        pa.array([kept[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: UTF-8 may be cut inside a
    character). docs needs doc_id and text."""
    unit = Bytes(window)
    rows = with_marks(docs, unit, hot).select("doc_id", "text", "marks")
    return rows.mapInArrow(_digest(unit), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
