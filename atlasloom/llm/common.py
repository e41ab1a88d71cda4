"""What the training-data operators share: the shared folder, written cuts of the lineage, worker imports."""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasloom.operators.graph import shuffles_go

#: White space that separates words in the operators on `[^\x20\x09-\x0D]+` (fixed value).
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, a local one is made on a local master; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='atlasloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: a lost executor costs no recomputation of what is above it."""
    spark = df.sparkSession
    return written_at(df, fresh_path(spark, purpose))


def written_at(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table at `path`; the shuffles that made them are deleted."""
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, which the JVM and the worker both hold; texts make rows large.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 32 << 20}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed, and keeps Arrow batches of texts small.

    A plan reads the limits when it runs, so they stay lowered in the session.
    """
    for name, limit in BATCH_LIMITS.items():
        found = spark.conf.get(name).rstrip("bB")
        if not found.isdigit() or not 0 < int(found) <= limit:
            spark.conf.set(name, str(limit))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def lean(run):
    """A worker function that gives freed memory back when its task ends; workers live on through other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def released() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sampled(docs: DataFrame, text: str, rows: int, most_bytes: int = 1 << 16) -> DataFrame:
    """Up to `rows` texts of at most `most_bytes` each, as a table of one column. Few partitions are read, and the driver holds rows * most_bytes at most."""
    found = docs.select(F.col(text).alias("text")).where(F.octet_length("text") <= most_bytes).take(rows)
    return docs.sparkSession.createDataFrame([(r.text,) for r in found], "text string").coalesce(1)


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """At most `most` rows, those of the largest counts: the counts' classes (eighths of a power of two) that fit as a whole.

    A histogram of some hundred classes decides, so no task sends rows that are not wanted.
    """
    kind = F.floor(F.log2(count) * 8)
    sizes = rows.where(F.col(count) > 0).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = math.inf, 0
    for r in sorted(sizes, key=lambda r: -r.kind):
        total += r.n
        if total > most:
            break
        least = r.kind
    return rows.where((F.col(count) > 0) & (kind >= F.lit(float(least))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
