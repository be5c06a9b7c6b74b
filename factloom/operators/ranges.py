"""Running totals over an order, without one task for a group: ranges are summed apart, and only their totals meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with each of ``sums`` added up within ``by`` from the first row in ``order`` to each row; the order is unique within ``by``.

    Rows are dealt by ranges of (by, order). A group's part in a range begins with what its earlier
    ranges hold; a range goes on with one group at most, so these beginnings are fewer than the ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.withColumns(sums).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = part.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    base = total.select(*by, "_range", *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums]).where(F.col(f"_{next(iter(sums))}").isNotNull())
    part = part.withColumns({c: F.sum(c).over(here) for c in sums}).join(F.broadcast(base), [*by, "_range"], "left")
    return part.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).drop("_range", *[f"_{c}" for c in sums])
