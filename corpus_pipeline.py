"""A corpus pipeline of five stages over `documents`, each written as Parquet and reread by the next.

Filtering stages keep the columns of documents; the last one packs what is left. Tables that a stage stages for itself
go when the next one begins: by then its result is written. Each stage sets the session's
`spark.sql.execution.arrow.maxBytesPerBatch` to `BATCH`, which holds when its result is written. `run` also deletes each stage's copy of the corpus once
the next is written, and returns the last.

Defined cases: rows with a null doc_id, repeated rows and ids, null and empty texts, other columns and empty tables pass
every stage as the operators' modules say; null and empty texts are packed as the end mark alone.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import op2_toxicity, op3_secrets, op4_decontaminate, op6_packing, op8_jaccard
from lociweave.plans.staging import drop_staged, remove, shared_dir, staged

#: Bytes of a batch that a Python worker gets. A batch of whole texts is held several times over, by the JVM and by the
#: worker, and by default it is bounded by its rows alone.
BATCH = "4m"

#: (how many staged tables there were before, after) the stage that ran last.
_last: tuple[int, int] | None = None


def _own_tables_only(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        if _last is not None and staged() == _last[1]:  # nothing else staged since
            drop_staged(spark, _last[0])
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        before = staged()
        out = stage(spark, docs, sf_dir)
        _last = (before, staged())
        return out

    return run_stage


@_own_tables_only
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; learned from `labels` outside the held-out fold."""
    return op2_toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_own_tables_only
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 the document of the smallest doc_id stays."""
    return op8_jaccard.without_near_duplicates(docs, shingle=5, percent=80)


@_own_tables_only
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out of the texts."""
    return op4_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_own_tables_only
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are replaced in the texts."""
    return op3_secrets.redacted(docs)


@_own_tables_only
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    return op6_packing.pack(docs, op6_packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The models of the first stage and the tokenizer of the last cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/lociweave/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs.select(F.col("*"))
