"""Tables in the folder that driver and executors share: lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session has none, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="lociweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, so lost executors cost no
    recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lociweave/{label}-{uuid.uuid4().hex}"
    # nothing else can use this execution's shuffle files: they need not wait for a garbage collection
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many staged tables there are: what `drop_staged` takes as `keep` to spare those made so far."""
    return len(_made)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession, keep: int = 0) -> None:
    """Deletes this process's staged tables but the first `keep`; call it once results are written."""
    while len(_made) > keep:
        remove(spark, _made.pop()[1])


@atexit.register
def _at_exit() -> None:
    if _made:
        try:
            drop_staged(_made[0][0])
        except Exception:  # noqa: BLE001 - the JVM may be gone by now
            pass
