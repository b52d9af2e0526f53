"""Which units (bytes or words) of a corpus lie in a window that also starts in an earlier document.

Shared by the byte operator (prefix doubling over sampled suffixes) and the word operator
(difference-cover anchors). Both supply anchors: positions with the name of a short k-gram, chosen
so that two equal windows always hold an equal anchor at the same place. An anchor's rank names its
whole neighbourhood, i.e. all windows that hold it. Then

1. anchors are dealt by name and sorted by (name, rank, doc_id). Of equal neighbourhoods all but the
   smallest doc_id's are repeated, with all their windows. A name with one neighbourhood, or of one
   document, then leaves; of the others the smallest ones stay open. Names frequent in a sample of
   documents (`heavy`) are dealt at random: each task then passes on one open row for each of their
   neighbourhoods, so no task gets a hot name;
2. open anchors meet their texts again; their windows are named and sorted with their doc_id: a window
   is repeated if an earlier document has it. Names with more than `hot` open neighbourhoods take this
   step as rows dealt by the window's own name.

Every step is a shuffle by a name with Arrow batches streamed in sorted order: memory is bounded by
a batch, `hot` neighbourhoods and one document's rows of one name. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkkit import keyed, stage
from .textkit import Prefix, U, chunks, mix, utf8

#: Open neighbourhoods of one name that one task takes, about 120 bytes each and their windows of 8; beyond, they are
#: dealt by window.
HOT = 50_000
SAMPLE = 64
#: starts of an anchor all of whose windows are repeated, as far as its document has them.
ALL = np.int64(-1)


@dataclass(frozen=True)
class Unit:
    """What differs between bytes and words. Every method works on one chunk of documents."""

    window: int

    def split(self, data: np.ndarray, off: np.ndarray):
        """(values, offsets): the units' values and each document's first unit."""
        raise NotImplementedError

    def anchors(self, values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
        """(position in values, document, name) of the anchors; prefix sums of the values."""
        raise NotImplementedError

    @property
    def reach(self) -> int:
        """A window that holds anchor p starts in p-reach..p."""
        raise NotImplementedError


def _batches(it: Iterator[pa.RecordBatch], column: str = "text"):
    for batch in it:
        data, off = utf8(batch.column(column))
        for i, j in chunks(off):
            yield batch, data, off[i : j + 1], i, j


def _edges(pos: np.ndarray, doc: np.ndarray, off: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Where each anchor's neighbourhood begins and ends, within its document."""
    return np.maximum(pos - unit.reach, off[doc]), np.minimum(pos + unit.window, off[doc + 1])


def _emit(unit: Unit, heavy: np.ndarray, sampled: bool):
    def run(it):
        for batch, data, off, i, j in _batches(it):
            values, uoff = unit.split(data, off)
            pos, doc, name, prefix = unit.anchors(values, uoff)
            if not len(pos):
                continue
            name >>= U(16)  # it only chooses candidates
            if sampled:
                both = np.unique(np.stack([name, doc.astype(U)]), axis=1)[0]
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64))], names=["name"])
                continue
            first, last = _edges(pos, doc, uoff, unit)
            rank = mix(prefix.spans(first, last) + (pos - first).astype(U) * U(0x9E3779B97F4A7C15) + (last - pos).astype(U) * U(0xC2B2AE3D27D4EB4F))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[i:j] for c in ("oid", "tag"))
            local = pos - uoff[doc]
            salt = np.zeros(len(pos), np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, name), len(heavy) - 1)
                hot = heavy[at] == name
                salt[hot] = 1 + (mix(ids[doc[hot]].view(U)) >> U(44)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(salt), pa.array(rank.view(np.int64)), pa.array(ids[doc]), pa.array(tags[doc]), pa.array(local)],
                names=["name", "salt", "rank", "oid", "tag", "loc"],
            )

    return run


def _sort_out(it: Iterator[pa.RecordBatch]):
    """Rows sorted by (name, rank, oid) -> (name, rank, oid, tag, loc): name null if all windows are repeated,
    else open. Of salted rows all smallest ones stay open."""
    names = ["name", "rank", "oid", "tag", "loc"]
    last = None  # (name, rank, least oid) of the last row
    held: list[np.ndarray] | None = None  # open rows of the last name's first rank, while it has no other
    several = False  # the last name has more ranks

    def out(cols, done):
        arrays = [pa.array(c) for c in cols]
        if done:
            n = len(cols[0])
            arrays[:2] = [pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in it:
        name, salt, rank, ids, tags, loc = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(name):
            continue
        new_name = np.concatenate([[True], name[1:] != name[:-1]])
        head = np.concatenate([[True], rank[1:] != rank[:-1]]) | new_name
        least = ids[np.flatnonzero(head)][np.cumsum(head) - 1]
        same_name = last is not None and name[0] == last[0]
        same_rank = same_name and rank[0] == last[1]
        if same_rank:
            least[: _first_run(head)] = last[2]
        done = ids > least
        if done.any():
            yield out([x[done] for x in (name, rank, ids, tags, loc)], True)
        # does each row's name have several ranks, as far as seen?
        group = np.cumsum(new_name) - 1
        kinds = np.bincount(group, head)
        if same_name:
            kinds[0] += several + (0 if same_rank else 1)
            if held is not None and kinds[0] > 1:
                yield out(held, False)
                held = None
        more = kinds > 1
        salted = salt > 0
        stay = ~done & (more[group] | salted)
        if stay.any():
            yield out([x[stay] for x in (name, rank, ids, tags, loc)], False)
        tail = ~done & (group == group[-1]) & ~more[-1] & ~salted
        own = [x[tail].copy() for x in (name, rank, ids, tags, loc)]
        if not (same_name and group[-1] == 0):
            held, several = None, False
        if len(own[0]):
            held = own if held is None else [np.concatenate([a, b]) for a, b in zip(held, own, strict=True)]
        several = bool(more[-1])
        last = (name[-1], rank[-1], least[-1])


def _neighbourhoods(unit: Unit):
    """Open anchors with what their windows are named by."""
    left = unit.reach

    def run(it):
        for batch, data, off, i, j in _batches(it):
            hits = batch.column("hits").slice(i, j - i)
            count = np.diff(hits.offsets.to_numpy().astype(np.int64))
            flat = hits.flatten()
            loc, name, rank = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("loc", "name", "rank"))
            doc = np.repeat(np.arange(j - i), count)
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[i:j][doc] for c in ("oid", "tag"))
            values, uoff = unit.split(data, off)
            for a in range(0, len(loc), 20_000):
                s = slice(a, a + 20_000)
                d, o = doc[s], loc[s]
                p = o + uoff[d]
                first, last = _edges(p, d, uoff, unit)
                at = p[:, None] + np.arange(-left, unit.window)
                inside = (at >= first[:, None]) & (at < last[:, None])
                got = np.where(inside, values[np.clip(at, 0, len(values) - 1)], 0)
                edge = (p - first) | ((last - p) << 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[s]), pa.array(rank[s]), pa.array(ids[s]), pa.array(tags[s]), pa.array(o), pa.array(edge.astype(np.int64)), _binary(np.ascontiguousarray(unit.pack(got)).view(np.uint8).reshape(len(p), -1))],
                    names=["name", "rank", "oid", "tag", "loc", "edge", "around"],
                )

    return run


def _valid(unit: Unit, edge: np.ndarray) -> np.ndarray:
    """[row, j]: the window that starts j units before the anchor lies in its document."""
    j = np.arange(unit.reach + 1)
    return (j <= (edge & 0xFFFF)[:, None]) & (unit.window - j <= (edge >> 16)[:, None])


def _bits(flags: np.ndarray) -> np.ndarray:
    return (flags.astype(np.int64) << np.arange(flags.shape[1])).sum(1)


def _settle(unit: Unit):
    """Rows sorted by (name, rank, oid) -> (oid, tag, loc, starts): a bit for each repeated window start."""

    def out(oids, tags, loc, starts):
        return pa.RecordBatch.from_arrays([pa.array(oids), pa.array(tags), pa.array(loc), pa.array(starts)], names=["oid", "tag", "loc", "starts"])

    def close(nm, rank, oids, tags, loc, edge, around):
        """Complete names, smallest oids of each neighbourhood only."""
        if len(nm) < 2:
            return
        new = np.concatenate([[True], nm[1:] != nm[:-1]])
        group = np.cumsum(new) - 1
        kinds = np.concatenate([[True], (rank[1:] != rank[:-1]) | new[1:]])
        several = np.bincount(group, kinds)[group] > 1
        around, oids, tags, loc, edge, group = around[several], oids[several], tags[several], loc[several], edge[several], group[several]
        a = 0
        while a < len(oids):
            b = min(len(oids), a + 100_000)
            if b < len(oids):  # whole names only
                b = int(np.searchsorted(group, group[b], "left"))
                b = b if b > a else int(np.searchsorted(group, group[a], "right"))
            yield from windows(around[a:b], oids[a:b], tags[a:b], loc[a:b], edge[a:b], group[a:b])
            a = b

    def windows(around, oids, tags, loc, edge, group):
        ok = _valid(unit, edge)
        h = unit.window_names(around)
        row, j = np.nonzero(ok)
        key = mix(h[row, j] + group[row].astype(U) * U(0x9E3779B97F4A7C15))
        order = np.lexsort((oids[row], key))
        k = key[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        least = oids[row[order]][np.flatnonzero(head)][np.cumsum(head) - 1]
        again = order[least < oids[row[order]]]
        flags = np.zeros(ok.shape, bool)
        flags[row[again], j[again]] = True
        some = flags.any(1)
        if some.any():
            yield out(oids[some], tags[some], loc[some], _bits(flags[some]))

    def run(it):
        kept, last = None, None  # open rows of the last name; (name, rank, least oid) of the last row
        for batch in it:
            nm, rank, oids, tags, loc, edge = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            if not len(nm):
                continue
            data, off = utf8(batch.column(6))
            mat = data[off[0] : off[-1]].reshape(len(nm), -1)
            # the smallest oid of each (name, rank), also over the batch's edge
            head = np.concatenate([[True], (rank[1:] != rank[:-1]) | (nm[1:] != nm[:-1])])
            least = oids[np.flatnonzero(head)][np.cumsum(head) - 1]
            if last is not None and (nm[0], rank[0]) == last[:2]:
                least[: _first_run(head)] = last[2]
            last = (nm[-1], rank[-1], least[-1])
            done = oids > least
            if done.any():
                yield out(oids[done], tags[done], loc[done], np.full(int(done.sum()), ALL))
            rows = [x[~done] for x in (nm, rank, oids, tags, loc, edge, mat)]
            if kept is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(kept, rows, strict=True)]
            nm = rows[0]
            if not len(nm):
                kept = None
                continue
            cut = int(np.searchsorted(-(nm[::-1] == nm[-1]).astype(int), 0, "left"))  # length of the last name's rows
            yield from close(*(x[: len(nm) - cut] for x in rows))
            kept = [x[len(nm) - cut :].copy() for x in rows]
        if kept is not None:
            yield from close(*kept)

    return run


def _binary(mat: np.ndarray) -> pa.Array:
    n, w = mat.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(mat))])


def _first_run(head: np.ndarray) -> int:
    """Length of the first run of equal keys; head marks the first row of each run."""
    rest = head[1:]
    return int(np.argmax(rest)) + 1 if rest.any() else len(head)


def _window_rows(unit: Unit):
    def run(it):
        for batch in it:
            oids, tags, loc, edge = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("oid", "tag", "loc", "edge"))
            data, off = utf8(batch.column("around"))
            if not len(oids):
                continue
            h = unit.window_names(data[off[0] : off[-1]].reshape(len(oids), -1))
            row, j = np.nonzero(_valid(unit, edge))
            yield pa.RecordBatch.from_arrays([pa.array(h[row, j].view(np.int64)), pa.array(oids[row]), pa.array(tags[row]), pa.array(loc[row]), pa.array(np.int64(1) << j)], names=["win", "oid", "tag", "loc", "starts"])

    return run


def repeated_starts(docs: DataFrame, unit: Unit, hot: int = HOT) -> DataFrame:
    """(oid, tag, marks): marks are (pos, starts) with bit j of starts set if the window that starts
    j units before pos also starts in a document of a smaller oid. docs: oid, tag, text."""
    docs = docs.select("oid", "tag", "text")
    n = docs.count()
    heavy = np.zeros(0, U)
    if n >= SAMPLE * 64:
        # at most (anchors a document) / 0.004 names can be that frequent, whatever the corpus size
        sample = docs.filter(F.pmod(F.xxhash64("oid", "tag"), F.lit(SAMPLE)) == 0)
        often = sample.mapInArrow(_emit(unit, heavy, True), "name long").groupBy("name").count()
        often = often.filter(F.col("count") >= max(16, int(0.004 * n / SAMPLE)))
        heavy = np.sort(np.array([r.name for r in often.collect()], np.int64).view(U))
    found = docs.mapInArrow(_emit(unit, heavy, False), "name long, salt long, rank long, oid long, tag long, loc long")
    found = found.repartition("name", "salt").sortWithinPartitions("name", "rank", "oid")
    sorted_out = stage(found.mapInArrow(_sort_out, "name long, rank long, oid long, tag long, loc long"), "anchors")
    still = sorted_out.filter(F.col("name").isNotNull())
    crowded = stage(still.groupBy("name").count().filter(F.col("count") > hot).select("name"), "crowded")

    def neighbourhoods(rows: DataFrame) -> DataFrame:
        hits = rows.groupBy("oid", "tag").agg(F.collect_list(F.struct("loc", "name", "rank")).alias("hits"))
        near = docs.join(hits, ["oid", "tag"]).select("oid", "tag", "text", "hits")
        return near.mapInArrow(_neighbourhoods(unit), "name long, rank long, oid long, tag long, loc long, edge long, around binary")

    near = neighbourhoods(still.join(crowded, "name", "left_anti")).repartition("name").sortWithinPartitions("name", "rank", "oid")
    marks = [stage(near.mapInArrow(_settle(unit), "oid long, tag long, loc long, starts long"), "marks")]
    if not crowded.isEmpty():
        win = neighbourhoods(still.join(crowded, "name", "left_semi")).mapInArrow(_window_rows(unit), "win long, oid long, tag long, loc long, starts long")
        least = stage(win.groupBy("win").agg(F.min("oid").alias("least"), F.max("oid").alias("most")).filter("least < most").drop("most"), "windows")
        marks.append(stage(win.join(least, "win").filter("least < oid").select("oid", "tag", "loc", "starts"), "marks"))
    out = sorted_out.filter(F.col("name").isNull()).select("oid", "tag", "loc", F.lit(int(ALL)).alias("starts"))
    for m in marks:
        out = out.unionByName(m)
    return out.groupBy("oid", "tag").agg(F.collect_list(F.struct(F.col("loc").alias("pos"), "starts")).alias("marks"))


def covered(unit: Unit, marks: pa.Array, uoff: np.ndarray) -> np.ndarray:
    """A flag for each unit of a chunk: some marked window covers it."""
    total = int(uoff[-1])
    step = np.zeros(total + 1, np.int64)
    if marks.null_count:
        marks = marks.fill_null([])
    count = np.diff(marks.offsets.to_numpy().astype(np.int64))
    flat = marks.flatten()
    doc = np.repeat(np.arange(len(uoff) - 1), count)
    pos = flat.field("pos").to_numpy(zero_copy_only=False) + uoff[doc]
    starts = flat.field("starts").to_numpy(zero_copy_only=False)
    first, last = uoff[doc], uoff[doc + 1] - unit.window
    for j in range(unit.reach + 1):
        at = pos - j
        at = at[((starts >> j) & 1 == 1) & (at >= first) & (at <= last)]
        if len(at):
            step += np.bincount(at, minlength=total + 1)
            step -= np.bincount(at + unit.window, minlength=total + 1)[: total + 1]
    return np.cumsum(step[:-1]) > 0


def with_marks(docs: DataFrame, unit: Unit, hot: int = HOT) -> DataFrame:
    """keyed() rows with their marks (null: none)."""
    rows = keyed(docs)
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("oid")).first()
    if n == ids:
        rows = rows.withColumn("tag", F.lit(0).cast("long"))  # nothing to tell apart
    return rows.join(repeated_starts(rows, unit, hot), ["oid", "tag"], "left")
