"""Structural and constraint checks; each gives a verdict column, the first failure wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ontology as o


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check whose condition holds, null if all pass."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks])


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def schema_check(candidates: DataFrame) -> DataFrame:
    """failed_check of required fields, predicate, confidence, endpoints (subject_type, object_type null if unknown)."""
    checks = [
        ("required", blank("subject_id") | blank("predicate") | blank("object_id") | blank("source_ref") | F.col("pct").isNull()),
        ("predicate", ~F.col("predicate").isin(*o.PREDICATES)),
        ("confidence", ~F.col("pct").between(0, 100)),
        ("endpoints", F.col("subject_type").isNull() | F.col("object_type").isNull()),
    ]
    return candidates.withColumn("failed_check", first_failure(checks))


def domain_range(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows that break a signature: unknown predicate, unresolved end, type outside it. The registry has 15 rows."""
    r = F.broadcast(relations.select("predicate", "source_types", "target_types"))
    j = candidates.join(r, "predicate", "left")
    ok = F.array_contains("source_types", F.col("subject_type")) & F.array_contains("target_types", F.col("object_type"))
    return j.where(~F.coalesce(ok, F.lit(False))).drop("source_types", "target_types")


def identity_conflicts(entities: DataFrame) -> DataFrame:
    """Ids that stand under more than one type."""
    return entities.groupBy("id").agg(F.countDistinct("entity_type").alias("n_types")).where("n_types > 1")


def out_of_bounds(rows: DataFrame, confidence: str) -> DataFrame:
    """Rows whose confidence is no number or lies outside [0, 1]."""
    value = F.col(confidence).try_cast("double")
    return rows.where(value.isNull() | ~value.between(0, 1))


def bad_intervals(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(F.col(end) < F.col(start))


def without_support(rows: DataFrame, key: str, support: DataFrame, by: str) -> DataFrame:
    """Rows that no support row points at."""
    return rows.join(support.select(F.col(by).alias(key)), key, "left_anti")


def below_floor(rows: DataFrame, key: str, support: DataFrame, by: str, floor: int) -> DataFrame:
    """Rows with fewer than ``floor`` support rows."""
    n = support.groupBy(F.col(by).alias(key)).agg(F.count("*").alias("n_support"))
    return rows.join(n, key, "left").withColumn("n_support", F.coalesce("n_support", F.lit(0))).where(F.col("n_support") < floor)


def inactive_objects(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    e = entities.where("entity_type = 'Person' and status = 'inactive'").select(F.col("id").alias("object_id"))
    return assertions.where("predicate = 'ASSIGNED_TO'").join(e, "object_id", "left_semi")


def transition_check(changes: DataFrame, transitions: DataFrame) -> DataFrame:
    """verdict of status changes(old, new, write_intent): corrections and repeats pass, others must be in the table."""
    t = F.broadcast(transitions.withColumn("allowed", F.lit(True)))
    j = changes.join(t, ["old", "new"], "left")
    fine = (F.col("write_intent") == "correction") | (F.col("old") == F.col("new")) | F.coalesce("allowed", F.lit(False))
    return j.withColumn("verdict", F.when(F.col("old").isNull() | F.col("new").isNull(), "quarantine").when(fine, "ok").otherwise("quarantine")).drop("allowed")


def fail_closed(log: DataFrame) -> DataFrame:
    """Candidates of a single-valued predicate that come after another subject's first write of it."""
    first = log.where(F.col("predicate").isin(*o.SINGLE_VALUED)).groupBy("predicate", "subject_id").agg(F.min("seq").alias("s"))
    # Two smallest first writes by distinct subjects decide for every candidate.
    two = first.groupBy("predicate").agg(F.min(F.struct("s", "subject_id")).alias("one"))
    rest = first.join(F.broadcast(two), "predicate").where("subject_id <> one.subject_id").groupBy("predicate").agg(F.min("s").alias("second"))
    both = F.broadcast(two.join(rest, "predicate", "left"))
    other = F.when(F.col("subject_id") == F.col("one.subject_id"), F.col("second")).otherwise(F.col("one.s"))
    return log.join(both, "predicate").where(F.coalesce(F.col("seq") > other, F.lit(False))).drop("one", "second")
