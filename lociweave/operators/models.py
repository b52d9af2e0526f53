"""Filters for gene models mapped from other genomes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import has_start, has_stop
from ..plans.staging import stage
from .intervals import islands, overlap_join

#: CDS of a region, and pairs of CDS looked at together.
SHARE, PAIRS = 1_500_000, 500_000


def cds_lengths(cds: DataFrame) -> DataFrame:
    """transcript_id, cds_len (sum of end - start), span."""
    return cds.groupBy("transcript_id").agg(F.sum(F.col("end") - F.col("start")).alias("cds_len"), (F.max("end") - F.min("start")).alias("span"))


def relative_length_filter(models: DataFrame, len_diff: float = 0.2) -> DataFrame:
    """Rows where both lengths differ by at most len_diff of the larger; two of length 0 are not alike.
    models: cds_len, cds_len2, span, span2."""
    near = lambda a, b: (F.greatest(a, b) > 0) & (F.abs(F.col(a) - F.col(b)) <= len_diff * F.greatest(a, b))
    return models.filter(near("cds_len", "cds_len2") & near("span", "span2"))


def drop_identical(new: DataFrame, known: DataFrame) -> DataFrame:
    """new models (transcript_id, chain) whose CDS chain no known model has, one of each chain."""
    first = F.row_number().over(Window.partitionBy("chain").orderBy("transcript_id"))
    return new.join(known.select("chain").distinct(), "chain", "left_anti").withColumn("r", first).filter("r = 1").drop("r")


def valid_codons(seqs: DataFrame) -> DataFrame:
    """seqs with has_start, has_stop, valid."""
    rows = seqs.withColumn("has_start", has_start(F.col("seq"))).withColumn("has_stop", has_stop(F.col("seq")))
    return rows.withColumn("valid", F.col("has_start") & F.col("has_stop"))


def drop_chimeric(models: DataFrame, genes: DataFrame, width: int = 10_000) -> DataFrame:
    """Models (transcript_id, chr, start, end) over one gene at most, with that gene."""
    other = genes.select(F.col("gene").alias("gene2"), "chr", F.col("start").alias("start2"), F.col("end").alias("end2"))
    hit = overlap_join(models, other, ["chr"], width).groupBy("transcript_id").agg(F.count_distinct("gene2").alias("n"), F.min("gene2").alias("gene"))
    return models.join(hit, "transcript_id", "left").filter("n is null or n = 1").drop("n")


def longest_per_locus(models: DataFrame) -> DataFrame:
    """Of models (chr, start, end, transcript_id, cds_len) whose ranges chain into a locus the longest."""
    rows = islands(models, ["chr"], tie=[F.asc("transcript_id")])
    first = F.row_number().over(Window.partitionBy("chr", "island").orderBy(F.desc("cds_len"), "transcript_id"))
    return rows.withColumn("r", first).filter("r = 1").drop("r")


def _steps(count: np.ndarray, most: int):
    """Slices of `count` whose sums are at most `most`, or of one entry."""
    total, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def held_by_another(start: np.ndarray, end: np.ndarray, size: np.ndarray, at: np.ndarray, test: np.ndarray, most: int = PAIRS) -> np.ndarray:
    """Which of the models under test have each range inside one of the same other model. Models' ranges stand behind
    each other, `size` of each; none is inside another of its model, and no two models are alike. `at`: the range of a
    model whose holders are looked for first.

    A model of one range is settled by a running maximum. For others the ranges that hold the one at `at` are looked
    up by length: those of 2^(n-1) to 2^n start in a window before it. Their models are then asked for the other
    ranges: of a model's own the last that starts early enough reaches furthest.
    """
    model, first = np.repeat(np.arange(len(size), dtype=np.int32), size), np.cumsum(size) - size
    gone = np.zeros(len(size), bool)
    key = first + at
    key_start, key_end = start[key], end[key]
    order = np.lexsort((-end, start))
    s, e = start[order], end[order]
    inside = np.zeros(len(order), bool)
    inside[1:] = np.maximum.accumulate(e)[:-1] >= e[1:]
    inside[:-1] |= (s[1:] == s[:-1]) & (e[1:] == e[:-1])
    found = np.empty(len(order), bool)
    found[order] = inside
    maybe = test & found[key]  # a model's own ranges don't hold each other
    gone[maybe & (size == 1)] = True
    left = np.flatnonzero(maybe & (size > 1))
    if not len(left):
        return gone
    left = left[np.argsort(key_start[left], kind="stable")]

    order = np.lexsort((start, model))
    start, end = start[order], end[order]
    del s, e, inside, found, order
    low, high = start[first], end[first + size - 1]
    starts, rank = np.unique(start, return_inverse=True)
    place = model.astype(np.int64) * len(starts) + rank
    rank = rank.astype(np.int32)
    level = np.frexp(np.maximum(end - start, 0).astype(float))[1].astype(np.int8)
    key_level = np.frexp(np.maximum(key_end - key_start, 0).astype(float))[1]
    for n in np.unique(level)[::-1]:
        rows = np.flatnonzero(level == n)
        rows = rows[np.argsort(start[rows], kind="stable")]
        s, e, of = start[rows], end[rows], model[rows]
        open_ = left[~gone[left] & (key_level[left] <= n)]
        lo = np.searchsorted(s, key_end[open_] - ((1 << min(int(n), 62)) - 1))
        count = np.maximum(np.searchsorted(s, key_start[open_], "right") - lo, 0)
        for part in _steps(count, most):
            k = count[part]
            q = np.repeat(open_[part], k)
            i = np.repeat(lo[part] - (np.cumsum(k) - k), k) + np.arange(len(q))
            near = np.flatnonzero(e[i] >= key_end[q])
            q, other = q[near], of[i[near]]
            near = (other != q) & (low[other] <= low[q]) & (high[other] >= high[q])
            q, other, j = q[near], other[near], 0
            while len(q):
                row = first[q] + j
                last = np.searchsorted(place, other.astype(np.int64) * len(starts) + rank[row], "right") - 1
                near = (last >= first[other]) & (end[last] >= end[row])
                q, other, j = q[near], other[near], j + 1
                gone[q[size[q] == j]] = True
                near = ~gone[q]
                q, other = q[near], other[near]
    return gone


def _held(t: pa.Table) -> pa.Table:
    """id of the models under test that another model of the table holds."""
    t = t.combine_chunks()
    chrs, starts, ends = (t.column(c).chunk(0) for c in ("chrs", "starts", "ends"))
    size, names = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (starts, chrs))
    start, end = (x.flatten().to_numpy() for x in (starts, ends))
    model = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(model)) - np.repeat(np.cumsum(size) - size, size)
    code = chrs.flatten().dictionary_encode().indices.to_numpy()[(np.cumsum(names) - names)[model] + np.where(names[model] > 1, within, 0)]
    # sequences one behind the other: no range of one is inside a range of another
    low, high = np.full(code.max() + 1, np.iinfo(np.int64).max), np.full(code.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, code, np.minimum(start, end))
    np.maximum.at(high, code, np.maximum(start, end))
    live = low <= high
    low[~live] = high[~live] = 0
    shift = (np.cumsum(high - low + 1) - high - 1)[code]
    start, end = start + shift, end + shift
    at, test, t = t.column("at").to_numpy().astype(np.int64), t.column("test").to_numpy(), t.select(["id"])
    del chrs, starts, ends, model, within, code, shift  # a region can be large
    return t.filter(pa.array(held_by_another(start, end, size, at, test)))


def _chains(cds: DataFrame) -> DataFrame:
    """id, chrs, starts, ends, odd: transcripts by their CDS that lie inside no other of theirs, in order. Those that
    are alike hold each other and are one, by the first name. chrs: one entry if all are the same. odd: never held,
    as a CDS has no place or stands on two sequences; such a transcript stays by itself."""
    row = F.struct("chr", F.col("start").cast("long").alias("start"), (-F.col("end").cast("long")).alias("back"))
    tx = cds.groupBy("transcript_id").agg(F.sort_array(F.collect_set(row)).alias("rows"))
    tx = tx.withColumn("placed", F.filter("rows", lambda x: x["chr"].isNotNull() & x["start"].isNotNull() & x["back"].isNotNull()))
    at = lambda rows, i: F.try_element_at(rows, F.lit(i))
    many = lambda rows: at(rows, 1)["chr"] != at(rows, -1)["chr"]
    ranges = F.array_distinct(F.transform("placed", lambda x: F.struct(x["start"], x["back"])))
    odd = F.when(F.size("placed") < F.size("rows"), True).when(many(F.col("placed")), F.size(ranges) < F.size("placed")).otherwise(False)

    def add(kept, x):
        last = at(kept, -1)
        out = last.isNull() | (last["chr"] != x["chr"]) | (last["back"] > x["back"])
        return F.when(out, F.concat(kept, F.array(x))).otherwise(kept)

    tx = tx.withColumn("core", F.aggregate("placed", F.slice("placed", 1, 0), add)).withColumn("odd", odd)
    names = F.transform("core", lambda x: x["chr"])
    tx = tx.select(
        "transcript_id", "odd", F.when(many(F.col("core")), names).otherwise(F.slice(names, 1, 1)).alias("chrs"),
        F.transform("core", lambda x: x["start"]).alias("starts"), F.transform("core", lambda x: -x["back"]).alias("ends"),
    )
    own = F.when(F.col("odd"), F.col("transcript_id")).alias("own")
    one = tx.groupBy(F.xxhash64("chrs", "starts", "ends").alias("name"), "chrs", "starts", "ends", own).agg(F.min("transcript_id").alias("id"))
    return one.select("id", "chrs", "starts", "ends", F.col("own").isNotNull().alias("odd"))


def drop_contained(cds: DataFrame, share: int = SHARE) -> DataFrame:
    """transcript_id of transcripts not all of whose CDS lie inside CDS of one other transcript; of those that
    hold each other the first by name stays. cds: transcript_id, chr, start, end.

    Transcripts with all their CDS go to the regions that these touch, about `share` CDS each. Who holds a transcript
    has a CDS over the start of its longest one, so it is tested in that region alone; no pairs leave it.
    """
    chains = stage(_chains(cds), "chains")
    low, high = F.least(F.get("starts", F.lit(0)), F.get("ends", F.lit(0))), F.greatest(F.try_element_at("starts", F.lit(-1)), F.try_element_at("ends", F.lit(-1)))
    extent = chains.groupBy(F.get("chrs", F.lit(0)).alias("chr")).agg(F.sum(F.size("starts")).alias("n"), (F.max(high) - F.min(low) + 1).alias("extent"))
    total = extent.agg(F.sum("n"), F.sum("extent")).first()
    width = -((total[1] or 1) * -share // max(total[0] or 1, 1))

    region = lambda x: F.floor(x / F.lit(width))
    chr_at = lambda i: F.get("chrs", F.when(F.size("chrs") > 1, i).otherwise(0))

    def touched(s, i):
        e, name = F.get("ends", i), chr_at(i)
        return F.transform(F.sequence(region(F.least(s, e)), region(F.greatest(s, e))), lambda r: F.struct(name.alias("chr"), r.alias("region")))

    longest = F.array_max(F.transform("starts", lambda s, i: F.struct((F.get("ends", i) - s).alias("length"), (-i).alias("i"))))
    rows = chains.withColumn("at", -longest["i"])
    rows = rows.withColumns({"c": chr_at(F.col("at")), "s": F.get("starts", F.col("at")), "e": F.get("ends", F.col("at"))})
    rows = rows.withColumn("to", F.explode(F.array_distinct(F.flatten(F.transform("starts", touched)))))
    # one that ends before it starts has no place of its own: what holds it touches what is between
    here = (F.col("to.chr") == F.col("c")) & F.col("to.region").between(region(F.least(F.col("s"), F.col("e"))), region(F.col("s")))
    rows = rows.select("to.chr", "to.region", "id", "chrs", "starts", "ends", "at", (~F.col("odd") & here).alias("test"))
    gone = rows.groupBy("chr", "region").applyInArrow(_held, T.StructType([T.StructField("id", chains.schema["id"].dataType)]))
    return chains.select("id").join(gone, "id", "left_anti").withColumnRenamed("id", "transcript_id")
