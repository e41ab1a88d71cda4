"""Registration of queries."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Rounded as DuckDB rounds doubles: scaled, halves away from zero. `F.round` takes the shortest decimal instead, and differs near halves."""
    return F.signum(c) * F.floor(F.abs(c) * 10.0**digits + 0.5) / F.lit(10.0**digits)


class Registry:
    """Collects queries of one module under `queries` and their SQL under `sql`."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
                    checkpoint_folder(spark)
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = query
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def checkpoint_folder(spark: SparkSession) -> None:
    """The cluster's shared folder for checkpoints; a local one only where none is set, on a local master."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='atlasloom-')}")
