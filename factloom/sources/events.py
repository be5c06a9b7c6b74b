"""The assertion log: candidate facts derived from the ``events`` table, all from integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assertion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.create_map(*[F.lit(x) for x in ("click", "HAS_VALUE", "error", "ASSIGNED_TO", "purchase", "OWNS", "signup", "HAS_STATUS", "view", "ABOUT")])
    e = e.withColumn("k", k)
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), "user_id").alias("subject_id"),
        F.element_at(kind, F.col("event_type")).alias("predicate"),
        F.concat(F.lit("v"), k % 7).alias("object_id"),
        (k % 50 + 50).alias("pct"),
        F.when(k % 5 == 0, "correction").when(k % 5 == 1, "update").otherwise("new_fact").alias("write_intent"),
        F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit("analyst:"), k)).when(k % 10 == 2, F.concat(F.lit("tool:"), k)).otherwise(F.concat(F.lit("untrusted:"), k)).alias("source_ref"),
        F.when(k % 3 != 0, F.col("ts")).alias("valid_from"),
        F.when(k % 3 != 0, F.col("ts") + F.make_dt_interval(k % 10)).alias("valid_to"),
        F.col("ts").alias("created_at"),
        "k",
    )


#: The same log for DuckDB, to be put before an oracle's query.
LOG_SQL = """
WITH alog AS (
  SELECT event_id AS seq, 'u' || user_id AS subject_id,
    CASE event_type WHEN 'click' THEN 'HAS_VALUE' WHEN 'error' THEN 'ASSIGNED_TO' WHEN 'purchase' THEN 'OWNS'
      WHEN 'signup' THEN 'HAS_STATUS' WHEN 'view' THEN 'ABOUT' END AS predicate,
    'v' || (k % 7) AS object_id, k % 50 + 50 AS pct,
    CASE WHEN k % 5 = 0 THEN 'correction' WHEN k % 5 = 1 THEN 'update' ELSE 'new_fact' END AS write_intent,
    CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN 'analyst:' || k WHEN k % 10 = 2 THEN 'tool:' || k ELSE 'untrusted:' || k END AS source_ref,
    CASE WHEN k % 3 <> 0 THEN ts END AS valid_from,
    CASE WHEN k % 3 <> 0 THEN ts + to_days(CAST(k % 10 AS INTEGER)) END AS valid_to,
    ts AS created_at, k
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)
)
"""
