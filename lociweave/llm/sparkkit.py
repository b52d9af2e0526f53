"""Row keys of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop_staged, shared_dir, stage  # noqa: F401

#: A null doc_id is ordered after every other id.
NULL_ID = (1 << 63) - 1


def oid(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def tag(text_col: str = "text") -> Column:
    """Rows that share a doc_id are told apart by all 64 bits of a hash of the text: of m such rows about
    m * m / 2^65 pairs meet by chance."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, oid, tag, text): the row key (oid, tag) and the text with null as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        oid(id_col).alias("oid"),
        tag(text_col).alias("tag"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
