"""Comparing the sequences of paired transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..compat import DEFAULT, Compat
from ..plans.staging import stage

PROMOTER = 3000


#: Width of the bins that chromosomes are swept in.
BIN = 10_000


def first_other(start: np.ndarray, end: np.ndarray, gene: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each range [lo, hi] the first of the ranges (sorted by start, end) that overlaps it and is of another gene;
    -1 if none. The first that reaches lo is where the running maximum of the ends does."""
    at, found, open_ = np.searchsorted(np.maximum.accumulate(end), lo), np.full(len(lo), -1), np.arange(len(lo))
    while len(open_):
        inside = at < len(start)
        open_, at = open_[inside], at[inside]
        before = start[at] <= hi[open_]
        open_, at = open_[before], at[before]
        hit = (end[at] >= lo[open_]) & (gene[at] != own[open_])
        found[open_[hit]] = at[hit]
        open_, at = open_[~hit], at[~hit] + 1
    return found


def _first_rows(it: Iterator[pa.RecordBatch]):
    """Rows sorted by (spot, bin, kind, start, end): CDS of a bin, then windows, which go on with their first hit."""
    group, held, ready = None, [], None
    for batch in it:
        spot, bin_, kind, start, end, gene = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("spot", "bin", "kind", "start", "end", "gene"))
        at, first = [], []
        cuts = np.flatnonzero((spot[1:] != spot[:-1]) | (bin_[1:] != bin_[:-1]) | (kind[1:] != kind[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(spot)]):
            if i == j:
                continue
            if (spot[i], bin_[i]) != group:
                group, held, ready = (spot[i], bin_[i]), [], None
            if kind[i] == 0:
                held.append((start[i:j].copy(), end[i:j].copy(), gene[i:j].copy()))
                continue
            if ready is None and held:
                ready = [np.concatenate(x) for x in zip(*held)]
            if ready is not None:
                found = first_other(*ready, start[i:j], end[i:j], gene[i:j])
                at.append(i + np.flatnonzero(found >= 0))
                first.append(np.stack([ready[0], ready[1]])[:, found[found >= 0]])
        if at:
            rows, first = np.concatenate(at), np.concatenate(first, 1)
            yield pa.RecordBatch.from_arrays([batch.column("transcript_id").take(pa.array(rows)), pa.array(first[0]), pa.array(first[1])], names=["transcript_id", "start2", "end2"])


def _first_hits(env: DataFrame, cds: DataFrame, width: int) -> DataFrame:
    """transcript_id, start2, end2: the first CDS of another gene over each window. Both go to the bins that they touch;
    a bin is swept once, whatever its depth. Genes are compared by 64-bit names."""
    spots = stage(cds.select("seqnames", "strand").distinct().withColumn("spot", F.monotonically_increasing_id()), "spots")
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    sides = []
    for kind, rows in ((0, cds.withColumn("transcript_id", F.lit(None).cast(env.schema["transcript_id"].dataType))), (1, env)):
        rows = rows.filter("gene_id is not null").join(spots, ["seqnames", "strand"])
        sides.append(rows.select("spot", bins.alias("bin"), F.lit(kind).alias("kind"), F.col("start").cast("long"), F.col("end").cast("long"), F.xxhash64("gene_id").alias("gene"), "transcript_id"))
    both = sides[0].unionByName(sides[1]).repartition("spot", "bin").sortWithinPartitions("spot", "bin", "kind", "start", "end")
    schema = T.StructType([env.schema["transcript_id"], T.StructField("start2", T.LongType()), T.StructField("end2", T.LongType())])
    first = both.mapInArrow(_first_rows, schema).groupBy("transcript_id").agg(F.min(F.struct("start2", "end2")).alias("f"))
    return first.select("transcript_id", "f.*")


def promoter_windows(cds: DataFrame, sizes: DataFrame, length: int = PROMOTER, width: int = BIN) -> DataFrame:
    """transcript_id, start, end: `length` bases before each transcript's CDS, cut where another gene's CDS
    of the strand begins, and at the chromosome's ends. cds: transcript_id, gene_id, seqnames, strand,
    start, end; sizes: seqnames, size."""
    cds = stage(cds, "cds")  # read for the windows and for what cuts them
    env = cds.groupBy("transcript_id", "gene_id", "seqnames", "strand").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    plus = F.col("strand") != "-"
    env = env.withColumn("start", F.when(plus, F.col("s") - length).otherwise(F.col("e") + 1)).withColumn("end", F.when(plus, F.col("s") - 1).otherwise(F.col("e") + length))
    env = stage(env.drop("s", "e"), "windows")
    hit = stage(_first_hits(env, cds, width), "hits")
    rows = env.join(hit, "transcript_id", "left").join(sizes, "seqnames")
    gap = F.when(plus, F.col("end") - F.col("end2")).otherwise(F.col("start2") - F.col("start"))
    near = (gap > 0) & (gap < length)
    start = F.when(plus & near, F.col("end2") + 1).otherwise(F.col("start"))
    end = F.when(~plus & near, F.col("start2") - 1).otherwise(F.col("end"))
    return rows.select("transcript_id", F.greatest(start, F.lit(1)).alias("start"), F.least(end, F.col("size")).alias("end"))


def align(a: str, b: str, match: int = 1, mismatch: int = -1, gap_open: int = -3, gap_extend: int = -1) -> tuple[str, str]:
    """Global alignment with affine gaps; each row's gaps along b are a running maximum."""
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("latin-1", "replace"), np.uint8), np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    low = -(10**9)
    H, E, Fm = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    H[0, 0] = 0
    j = np.arange(m + 1)
    H[0, 1:] = E[0, 1:] = gap_open + gap_extend * (j[1:] - 1)
    for i in range(1, n + 1):
        Fm[i] = np.maximum(H[i - 1] + gap_open, Fm[i - 1] + gap_extend)
        best = Fm[i].copy()
        best[1:] = np.maximum(best[1:], H[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch))
        # a gap along b from column k costs gap_open + gap_extend * (j-k-1)
        run = np.maximum.accumulate(best - gap_extend * j)
        E[i, 1:] = run[:-1] + gap_open + gap_extend * (j[1:] - 1)
        H[i] = np.maximum(best, E[i])
    i, k, oa, ob = n, m, [], []
    state = "H"
    while i or k:
        if state == "H":
            if i and k and H[i, k] == H[i - 1, k - 1] + (match if x[i - 1] == y[k - 1] else mismatch):
                i, k = i - 1, k - 1
                oa.append(a[i])
                ob.append(b[k])
            elif i and H[i, k] == Fm[i, k]:
                state = "F"
            else:
                state = "E"
        elif state == "F":
            state = "H" if Fm[i, k] == H[i - 1, k] + gap_open else "F"
            i -= 1
            oa.append(a[i])
            ob.append("-")
        else:
            state = "H" if E[i, k] == H[i, k - 1] + gap_open else "E"
            k -= 1
            oa.append("-")
            ob.append(b[k])
    return "".join(reversed(oa)), "".join(reversed(ob))


def _gaps(row: str, other: str, kind: str, prefix: str, count_ends: bool):
    """(labels, total length, number) of the gaps in a row; places are those of the row without gaps."""
    labels, total, number, at, k, n = [], 0, 0, 0, 0, len(row)
    while k < n:
        if row[k] != "-":
            at, k = at + 1, k + 1
            continue
        e = k
        while e < n and row[e] == "-":
            e += 1
        size = e - k
        end = k == 0 or e == n
        place = "start" if k == 0 else "end" if e == n else f"{at}_{at + 1}"
        labels.append(f"{prefix}{place}.{kind}:{size}" if end else f"{prefix}{place}.{kind}.pos:{size}")
        total += size
        number += 1 if not end or count_ends else 0
        k = e
    return ",".join(labels) or None, total, number


def summarise(a: str | None, b: str | None, prefix: str, compat: Compat = DEFAULT) -> dict:
    if not a or not b:
        return dict.fromkeys(("Del", "Del_Length", "Del_Number", "Ins", "Ins_Length", "Ins_Number", "Mis", "Mis_Number")) | {"aln_len": 0}
    x, y = align(a, b)
    d, dl, dn = _gaps(y, x, "del", prefix, compat.count_terminal_gaps)
    i, il, in_ = _gaps(x, y, "ins", prefix, True)
    mis, pa, pb = [], 0, 0
    for c, e in zip(x, y):
        pa, pb = pa + (c != "-"), pb + (e != "-")
        if c != e and c != "-" and e != "-":
            mis.append(f"{prefix}{pb}{e} > {pa}{c}")
    return {"aln_len": len(x), "Del": d, "Del_Length": dl, "Del_Number": dn, "Ins": i, "Ins_Length": il, "Ins_Number": in_, "Mis": ",".join(mis) or None, "Mis_Number": len(mis)}


SUMMARY = "aln_len long, Del string, Del_Length long, Del_Number long, Ins string, Ins_Length long, Ins_Number long, Mis string, Mis_Number long"


def compare_sequences(pairs: DataFrame, seqs1: DataFrame, seqs2: DataFrame, prefix: str = "c.", compat: Compat = DEFAULT) -> DataFrame:
    """tx1, tx2, seq1_len, seq2_len and the alignment's gaps and mismatches; a missing sequence gives nulls.
    pairs: tx1, tx2; seqs: seq_id, seq."""
    rows = pairs.select("tx1", "tx2").distinct()
    rows = rows.join(seqs1.select(F.col("seq_id").alias("tx1"), F.col("seq").alias("seq1")), "tx1", "left").join(seqs2.select(F.col("seq_id").alias("tx2"), F.col("seq").alias("seq2")), "tx2", "left")
    rows = rows.select("tx1", "tx2", "seq1", "seq2")

    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            made = [summarise(a, b, prefix, compat) for a, b in zip(pdf.seq1, pdf.seq2)]
            out = pd.DataFrame(made, index=pdf.index, columns=[c.split()[0] for c in SUMMARY.split(", ")])
            yield pd.concat([pdf[["tx1", "tx2"]], pdf.seq1.str.len().rename("seq1_len").astype("Int64"), pdf.seq2.str.len().rename("seq2_len").astype("Int64"), out], axis=1)

    return rows.mapInPandas(run, f"tx1 {pairs.schema['tx1'].dataType.simpleString()}, tx2 {pairs.schema['tx2'].dataType.simpleString()}, seq1_len long, seq2_len long, {SUMMARY}")
