"""Risk features, guards, routing and the five conditions, as columns over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as o
from ..functions.scores import authority, consequence, escalation_score, review_minutes, route, sigmoid


def with_incumbents(log: DataFrame) -> DataFrame:
    """Number of other values each key holds, from a per-key aggregate."""
    keys = log.groupBy("subject_id", "predicate").agg(F.countDistinct("object_id").alias("n_values"), F.max("pct").alias("top_pct"))
    return log.join(keys, ["subject_id", "predicate"]).withColumn("n_incumbents", F.col("n_values") - 1)


def risk_features(log: DataFrame) -> DataFrame:
    """f_e, f_s, f_t, f_v, f_c in {0, .5, 1}, their interaction k, consequence, reversibility, authority.

    Of the log's columns ``failed_check`` and ``resolution`` may be missing: the first check that
    failed, and what became of the subject's name.
    """
    for c in ("failed_check", "resolution"):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast("string"))
    check = F.coalesce("failed_check", F.lit(""))
    single = F.col("predicate").isin(*o.SINGLE_VALUED)
    met = single & (F.col("n_incumbents") > 0)
    df = (
        log.withColumn("f_e", F.when(check == "C1", 1.0).when(F.lower(F.coalesce("resolution", F.lit(""))).isin("possible_match", "unresolved", "uncertain"), 0.5).otherwise(0.0))
        .withColumn("f_s", F.when(~F.col("predicate").isin(*o.PREDICATES) | check.isin("C6", "C9"), 1.0).when(met, 0.5).otherwise(0.0))
        .withColumn("f_t", F.when((F.col("valid_to") < F.col("valid_from")) | check.isin("C2", "C3", "C10"), 1.0).when(met & F.col("valid_from").isNull(), 0.5).otherwise(0.0))
        .withColumn("f_v", F.when((F.trim("source_ref") == "") | (check == "C8"), 1.0).when(F.col("source_ref").startswith("untrusted"), 0.5).otherwise(0.0))
        .withColumn("f_c", F.when(met & (F.col("pct") > 80) & (F.col("top_pct") > 80), 1.0).when(met, 0.5).otherwise(0.0))
    )
    parts = ["f_e", "f_s", "f_t", "f_v", "f_c"]
    n = sum((F.col(p) > 0).cast("int") for p in parts)
    return (
        df.withColumn("k_case", F.col("k"))
        .withColumn("k", F.greatest(n - 1, F.lit(0)))
        .withColumn("consequence", consequence(F.col("predicate")))
        .withColumn("reversibility", F.when(~met, o.CREATE_ONLY).when(F.col("n_incumbents") > 1, o.MULTI_RETIRE).otherwise(o.REVERSIBLE))
        .withColumn("authority", authority(F.col("source_ref")))
    )


def routed(features: DataFrame, policy: dict[str, float] | None = None, low: float = 0.30, high: float = 0.65) -> DataFrame:
    """risk, guards and tier of each write."""
    recoverable = (F.col("n_incumbents") > 0) & F.col("predicate").isin(*o.SINGLE_VALUED)
    df = features.withColumn("risk", F.round(sigmoid(escalation_score(policy)), 6))
    df = df.withColumn("g", (F.trim("source_ref") == "") | ~F.col("predicate").isin(*o.PREDICATES))
    df = df.withColumn("m", F.col("g") | (F.col("f_t") >= 1) | (F.col("f_e") >= 1) | (F.col("f_s") >= 1) | ~F.col("pct").between(0, 100))
    df = df.withColumn("h", (F.col("authority") >= o.AUTHORITATIVE) & (F.col("f_t") == 0) & recoverable & F.col("write_intent").isin("update", "correction") & ~F.col("m"))
    df = df.withColumn("tier", route(F.col("risk"), F.col("g"), F.col("m"), F.col("h"), recoverable, low, high))
    return df.withColumn("minutes", F.when(F.col("tier") == "review", review_minutes()).otherwise(0.0))


CONDITIONS = ("universal", "autonomous", "fixed", "frozen", "adaptive")


def conditions(df: DataFrame, adapted: dict[str, float] | None = None, low: float = 0.30, high: float = 0.65) -> DataFrame:
    """Each write under each condition; ``native`` is the ungoverned tier, the adaptive arm routes by the policy in force after its updates."""
    native = F.when(F.col("f_c") >= 1, F.when(F.col("write_intent") == "correction", "supersede").otherwise("review")).otherwise("accept")
    fixed = F.when((F.col("pct") < 80) | (F.col("consequence") >= 0.70), "review").otherwise(native)
    recoverable = (F.col("n_incumbents") > 0) & F.col("predicate").isin(*o.SINGLE_VALUED)
    again = route(F.round(sigmoid(escalation_score(adapted)), 6), F.col("g"), F.col("m"), F.col("h"), recoverable, low, high)
    tier = (
        F.when(F.col("condition") == "autonomous", native)
        .when(F.col("g"), "reject")
        .when(F.col("condition") == "universal", "review")
        .when(F.col("condition") == "fixed", fixed)
        .when(F.col("condition") == "adaptive", again)
        .otherwise(F.col("tier"))
    )
    return df.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS]))).withColumn("arm_tier", tier)
