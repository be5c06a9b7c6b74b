"""Results of long runs by method and seed, kept under a fingerprint of what was asked, so that a run resumes where it stopped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CELL = ["fingerprint", "method", "seed"]


def fingerprint(config: dict) -> str:
    """Run identity: SHA-256 of the configuration in a fixed form; the order of its keys doesn't matter."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()[:16]


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All results at ``path``, or None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def finished(spark: SparkSession, path: str, config: dict) -> set[tuple[str, int]]:
    """(method, seed) of the results that are there under this configuration: as many as there are cells."""
    have = stored(spark, path)
    if have is None:
        return set()
    mine = have.where(F.col("fingerprint") == fingerprint(config)).select("method", "seed").distinct()
    return {(r.method, r.seed) for r in mine.collect()}


def run(spark: SparkSession, path: str, config: dict, cells: Iterable[tuple[str, int]], compute: Callable[[str, int], DataFrame]) -> DataFrame:
    """Results of all ``cells`` (method, seed); those that are stored are not computed again.

    Each cell is written by itself, as a partition that replaces only itself; what a stopped run left
    half-written was never committed. Other configurations' results stay.
    """
    mark, done = fingerprint(config), finished(spark, path, config)
    for method, seed in cells:
        if (method, seed) in done:
            continue
        rows = compute(method, seed).withColumns({"fingerprint": F.lit(mark), "method": F.lit(method), "seed": F.lit(seed).cast("int")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELL).parquet(path)
    return stored(spark, path).where(F.col("fingerprint") == mark).drop("fingerprint")
