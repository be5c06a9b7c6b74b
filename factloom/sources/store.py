"""Tables of the store: scans, latest-row upserts, status changes, JSON lines, the accepted view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """All rows, or those of one status; the filter reaches the files."""
    df = spark.read.parquet(path)
    return df if status is None else df.where(F.col("status") == status)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by an aggregate that combines before the shuffle."""
    names = rows.columns
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")


def upsert(base: DataFrame, delta: DataFrame, key: str, order: str) -> DataFrame:
    return latest(base.unionByName(delta), key, order)


def upsert_keeping_first(rows: DataFrame, key: str, order: str, created: str) -> DataFrame:
    """Latest row of each key with the earliest creation time."""
    names = rows.columns
    out = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), order).alias("r"), F.min(created).alias("_first"))
    return out.select(*[F.col("_first").alias(c) if c == created else F.col(f"r.{c}").alias(c) for c in names])


def set_status(rows: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Rows with the status that ``changes(key, new_status)`` gives, else their own."""
    return rows.join(changes, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def accepted_graph(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """Accepted rows both of whose endpoints exist."""
    ids = entities.select("id")
    return (
        assertions.where("status = 'accepted'")
        .join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
        .join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    )


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def metadata_filter(where: dict) -> Column:
    """A column from a filter document: equality, $eq, $ne, $in, $nin, $and, $or; unknown operators pass."""
    out = F.lit(True)
    for key, v in where.items():
        if key in ("$and", "$or"):
            parts = [metadata_filter(w) for w in v]
            one = parts[0] if parts else F.lit(key == "$and")
            for p in parts[1:]:
                one = one & p if key == "$and" else one | p
        elif isinstance(v, dict):
            one = F.lit(True)
            for op, arg in v.items():
                c = F.col(key)
                if op == "$eq":
                    one = one & c.eqNullSafe(F.lit(arg))
                elif op == "$ne":
                    one = one & ~c.eqNullSafe(F.lit(arg))
                elif op == "$in":
                    one = one & F.coalesce(c.isin(*arg), F.lit(None in arg))
                elif op == "$nin":
                    one = one & ~F.coalesce(c.isin(*arg), F.lit(None in arg))
        else:
            one = F.col(key).eqNullSafe(F.lit(v))
        out = out & one
    return out
