"""Packing by power-of-two decomposition.

A document of n ids is cut into whole sequences of 4096 and, for what is left, one piece for each set
bit of its length, longest first. Pieces of one length form a bucket; each piece is a sequence of its
own, so no sequence crosses documents and none is padded. Sequences are numbered bucket by bucket.

A text's ids are those of its parts between ASCII white space: the tokenizer drops white space, its
words never hold any, and neither NFC nor lower-casing looks across. Likewise a run of .,;:!? after an
ASCII letter or digit at a part's end is a word of its own. As the tokenizer lower-cases, parts may be,
unless a special token could arise. So each distinct part is tokenized once and a text's ids are
gathered; a worker keeps the parts known so far, up to `KNOWN`.

Defined cases: null and empty texts have only the end id; rows that share a doc_id are packed each;
order among equal (length, doc_id, start) is by crc; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import numbered
from .sparkkit import stage
from .textkit import BYTE_VALUE, LOWER, Prefix, U, chunks, runs, trimmed, utf8, words

LENGTH = 4096
END_ID = 2
#: About 60 bytes each.
KNOWN = 1_500_000
#: Parts encoded at a time, and bytes of text cut at a time: they bound a worker's memory.
ENCODED = 8192
STEP = 1 << 20
#: Longest run of marks that is cut off.
MARKS = 8
MARK, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(b".,;:!?")] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def parts_of(data: np.ndarray, off: np.ndarray):
    """(bytes, start, end, document) of the parts of a chunk of texts, in order; bytes may be lower-cased."""
    start, end, doc = words(data, off)
    part = data[int(off[0]) : int(off[-1])]
    if b"<|" not in part.tobytes():
        part = LOWER[part]
    cut = end.copy()
    at = np.arange(len(start))
    for _ in range(MARKS):
        at = at[MARK[part[cut[at] - 1]] & (cut[at] - 1 > start[at])]
        cut[at] -= 1
    has = (cut < end) & ALNUM[part[cut - 1]] if len(cut) else np.zeros(0, bool)
    cut = np.where(has, cut, end)
    keep = np.stack([np.ones(len(start), bool), has], 1).ravel()
    return part, np.stack([start, cut], 1).ravel()[keep], np.stack([cut, end], 1).ravel()[keep], np.repeat(doc, 2)[keep]


_known: dict[str, Ids] = {}


class Ids:
    """Token ids of white-space parts, by the parts' names."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self):
        self.name, self.at, self.size, self.pool = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, part: bytes, name: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(size of each word, ids of all)."""
        uniq, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        if len(self.name) + len(uniq) > KNOWN:
            self.clear()
        at = np.searchsorted(self.name, uniq)
        new = np.ones(len(uniq), bool)
        if len(self.name):
            new = self.name[np.minimum(at, len(self.name) - 1)] != uniq
        if new.any():
            begin, stop, ids = start[first[new]], end[first[new]], []
            for k in range(0, len(begin), ENCODED):
                own = [part[a:b].decode("utf-8") for a, b in zip(begin[k : k + ENCODED], stop[k : k + ENCODED], strict=True)]
                ids += [x.ids for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.array(list(chain.from_iterable(ids)), np.uint32)
            names = np.concatenate([self.name, uniq[new]])
            order = np.argsort(names, kind="stable")
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.pool, self.name = np.concatenate([self.pool, flat]), names[order]
            at = np.searchsorted(self.name, uniq)
        size = self.size[at][inverse]
        return size, self.pool[np.repeat(self.at[at][inverse], size) + runs(size)]


def pieces_of(n: int, length: int = LENGTH) -> list[int]:
    return [length] * (n // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if (n % length) >> k & 1]


def _cut(path: str, length: int, end_id: int):
    def run(it):
        ids_of = _known[path] = _known.get(path) or Ids(path)
        for batch in it:
            data, off = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for i, j in chunks(off, STEP):
                part, start, end, doc = parts_of(data, off[i : j + 1])
                name = Prefix(BYTE_VALUE[part]).spans(start, end)
                size, ids = ids_of(part.tobytes(), name, start, end) if len(name) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
                n = np.bincount(doc, size, j - i).astype(np.int64)
                at = np.cumsum(n) - n
                rows = ([], [], [], [], [])
                for d in range(j - i):
                    own = np.append(ids[at[d] : at[d] + n[d]], np.uint32(end_id))
                    blob, begin = own.astype("<u4").tobytes(), 0
                    for size_ in pieces_of(len(own), length):
                        for x, v in zip(rows, (i + d, begin, size_, len(own), blob[4 * begin : 4 * (begin + size_)]), strict=True):
                            x.append(v)
                        begin += size_
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:4]), pa.array(rows[4], pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian uint32): the pieces of all documents."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(trimmed(_cut(tokenizer, length, end_id)), "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    made = pieces(docs, tokenizer, length, end_id).withColumn("ids_crc32", F.crc32("ids"))
    made = stage(made if keep_ids else made.drop("ids"), "pieces")
    out = numbered(made.withColumn("bucket", -F.col("length")), ["bucket", "doc_id", "start", "ids_crc32"], "sequence_id")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), *(["ids"] if keep_ids else []))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
