"""Durable-state, retrieval, calibration and replay metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology as o
from ..functions.scores import bin_left_closed, bin_right_closed
from .ranges import running


def share(condition: Column, among: Column | None = None) -> Column:
    """Share of rows that meet the condition, 0 where there are none."""
    n = F.count("*") if among is None else F.count_if(among)
    hit = F.count_if(condition if among is None else condition & among)
    return F.coalesce(hit / F.nullif(n, F.lit(0)), F.lit(0.0))


def durable_violations(accepted: DataFrame) -> DataFrame:
    """One row: extra values over single-valued keys, keys in violation, accepted rows."""
    keys = accepted.where(F.col("predicate").isin(*o.SINGLE_VALUED)).groupBy("subject_id", "predicate").agg(F.countDistinct("object_id").alias("n"), F.count("*").alias("c"))
    return keys.agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("violations"), F.count_if(F.col("n") > 1).alias("keys_in_violation"), F.sum("c").alias("accepted"))


def read_time_conflicts(accepted: DataFrame) -> DataFrame:
    """Rows of every single-valued key with two or more values."""
    a = accepted.where(F.col("predicate").isin(*o.SINGLE_VALUED))
    bad = a.groupBy("subject_id", "predicate").agg(F.min("object_id").alias("lo"), F.max("object_id").alias("hi")).where("lo < hi")
    return a.join(bad.select("subject_id", "predicate"), ["subject_id", "predicate"], "left_semi")


def durable_buckets(gold: DataFrame, active: DataFrame, flagged: DataFrame) -> DataFrame:
    """bucket of each gold(subject_id, predicate, gold_value): correct, stale, split, abstained or missing."""
    a = active.groupBy("subject_id", "predicate").agg(F.collect_set("object_id").alias("values"))
    f = flagged.select("subject_id", "predicate").distinct().withColumn("flag", F.lit(True))
    j = gold.join(a, ["subject_id", "predicate"], "left").join(f, ["subject_id", "predicate"], "left")
    bucket = (
        F.when(F.size("values") > 1, "split")
        .when((F.size("values") == 1) & (F.element_at("values", 1) == F.col("gold_value")), "correct")
        .when(F.size("values") == 1, "stale")
        .when(F.col("flag"), "abstained")
        .otherwise("missing")
    )
    return j.withColumn("bucket", bucket).drop("values", "flag")


def bucket_rates(buckets: DataFrame) -> DataFrame:
    """One row of rates in percent."""
    n = {b: F.count_if(F.col("bucket") == b) for b in ("correct", "stale", "split", "abstained", "missing")}
    governed = n["correct"] + n["stale"] + n["split"]
    rate = lambda x, of: F.round(F.coalesce(100.0 * x / F.nullif(of, F.lit(0)), F.lit(0.0)), 6)
    rows = F.count("*")
    return buckets.agg(
        rate(n["correct"], rows).alias("dsc"),
        rate(n["stale"], rows).alias("ssr"),
        rate(n["split"], rows).alias("split"),
        rate(n["abstained"], rows).alias("abstention"),
        rate(n["missing"], rows).alias("missing"),
        rate(n["correct"], governed).alias("dsc_gov"),
        rate(n["stale"], governed).alias("ssr_gov"),
    )


def calibration(rows: DataFrame, p: str, y: str, bins: int = 10, left_closed: bool = False) -> DataFrame:
    """Expected calibration error and Brier score."""
    b = (bin_left_closed if left_closed else bin_right_closed)(F.col(p), bins)
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("sq"))
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def extraction_quality(rows: DataFrame) -> DataFrame:
    """precision, recall, F1, linked recall and stale rate of rows(gold, got, linked, stale); a value is right if one text holds the other."""
    right = F.coalesce(F.contains("got", F.col("gold")) | F.contains("gold", F.col("got")), F.lit(False))
    got = F.col("got").isNotNull()
    n = {"tp": right, "got": got, "linked": got & F.col("linked"), "stale": got & F.col("stale")}
    c = rows.agg(F.count("*").alias("gold"), *[F.count_if(x).alias(k) for k, x in n.items()])
    rate = lambda a, b, name: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6).alias(name)
    tp, g, p = F.col("tp"), F.col("gold"), F.col("got")
    return c.select(rate(tp, p, "precision"), rate(tp, g, "recall"), rate(2 * tp, p + g, "f1"), rate(F.col("linked"), g, "linked_recall"), rate(F.col("stale"), g, "stale_rate"))


def retrieval_metrics(records: DataFrame, k: int) -> DataFrame:
    """hit@k, precision and recall of retrieved and expected id lists; records without expectation are left out."""
    r = records.where(F.size("expected") > 0)
    both = F.size(F.array_intersect("retrieved", "expected"))
    return r.agg(
        F.round(F.avg(F.arrays_overlap(F.slice("retrieved", 1, k), "expected").cast("double")), 6).alias("hit_at_k"),
        F.round(F.sum(both) / F.nullif(F.sum(F.size(F.array_distinct("retrieved"))), F.lit(0)), 6).alias("precision"),
        F.round(F.sum(both) / F.sum(F.size(F.array_distinct("expected"))), 6).alias("recall"),
    )


def replay_metrics(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Missed consequential rate, minutes per 100 writes, review and error rates of write records."""
    error, routing = F.col("final") != F.col("gold"), F.col("routed") != F.col("gold")
    admitted = F.col("gold").isin("accept", "supersede")
    worthy, esc = F.col("gold") == "review", F.col("escalated")
    six = lambda c, n: F.round(c, 6).alias(n)
    aggs = [
        F.count("*").alias("n_writes"),
        six(share(error & ~esc, F.col("consequential")), "mcr"),
        six(100.0 * F.sum("review_minutes") / F.count("*"), "r100"),
        six(share(F.col("creates_violation")), "dvr"),
        six(share(esc), "review_rate"),
        six(share(esc & admitted), "false_escalation_rate"),
        six(share(admitted & F.col("final").isin("review", "reject")), "false_quarantine_rate"),
        six(share(~error), "accuracy"),
        six(share(~routing), "routing_accuracy"),
        six(share(worthy, esc), "queue_precision"),
        six(share(esc, worthy), "queue_recall"),
        six(share(F.col("final") == "supersede", F.col("gold") == "supersede"), "correction_quality"),
    ]
    return records.groupBy(*by).agg(*aggs) if by else records.agg(*aggs)


def risk_coverage_auc(records: DataFrame, by: str, key: str) -> DataFrame:
    """Area under error rate over coverage, rows by rising risk, errors last among equals, per ``by``."""
    df = records.select(by, "risk", key, (F.col("routed") != F.col("gold")).cast("int").alias("err"))
    df = running(df, [by], ["risk", "err", key], {"i": F.lit(1), "errors": F.col("err")})
    rate = F.col("errors") / F.col("i")
    before = F.coalesce((F.col("errors") - F.col("err")) / F.nullif(F.col("i") - 1, F.lit(0)), rate)
    return df.groupBy(by).agg(F.round(F.sum(0.5 * (rate + before)) / F.count("*"), 6).alias("auc"))


def delta_vs(rows: DataFrame, by: str, base: str, metrics: list[str]) -> DataFrame:
    """Each arm's metric less the base arm's; the base is one row."""
    b = rows.where(F.col(by) == base).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    return rows.crossJoin(F.broadcast(b.limit(1))).select(by, *[F.round(F.col(m) - F.col(f"_{m}"), 6).alias(m) for m in metrics])


def threshold_sweep(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Per threshold: share quarantined, share of good rows quarantined, calibration error of what is kept, objective.

    Rows are first counted by confidence; the thresholds meet that table only.
    """
    per = rows.groupBy("p", "y").agg(F.count("*").alias("n"))
    t = per.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in taus])))
    kept = F.col("p") > F.col("tau")
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rate = lambda a, b: F.round(100 * F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    good = F.col("y") == 1
    out = t.groupBy("tau").agg(
        rate(s(~kept), F.sum("n")).alias("quarantined"), rate(s(~kept & good), s(good)).alias("false_quarantine"), rate(s(kept & ~good), F.sum("n")).alias("contradiction_rate")
    )
    b = t.where(kept).groupBy("tau", bin_right_closed(F.col("p")).alias("bin")).agg(F.sum("n").alias("n"), F.abs(F.sum(F.col("n") * F.col("p")) - F.sum(F.col("n") * F.col("y"))).alias("gap"))
    ece = b.groupBy("tau").agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"))
    out = out.join(ece, "tau", "left").withColumn("ece", F.coalesce("ece", F.lit(0.0)))
    return out.withColumn("objective", F.round(F.col("contradiction_rate") + 0.5 * F.col("false_quarantine") + 10 * F.col("ece"), 6))


def select_thresholds(rows: DataFrame, step: int = 1, ceiling: float = 0.02) -> DataFrame:
    """Best (tau_l, tau_h) on a lattice of percents by F2 under a ceiling of missed consequential writes.

    Risks are first counted by percent: the lattice meets at most 101 rows per outcome, not all rows.
    """
    # The product can end just beside a percent (0.29 * 100 < 29), so the count is of percents that are at most the risk.
    near = F.round(F.col("risk") * 100).cast("int")
    percent = F.when(near / F.lit(100.0) > F.col("risk"), near - 1).otherwise(near)
    hist = rows.groupBy(percent.alias("r"), "worthy", "consequential").agg(F.count("*").alias("n"))
    grid = F.expr(f"flatten(transform(sequence(0, {100 - step}, {step}), a -> transform(sequence(a + {step}, 100, {step}), b -> struct(a AS tl, b AS th))))")
    g = hist.withColumn("t", F.explode(grid)).select("r", "worthy", "consequential", "n", "t.tl", "t.th")
    esc = F.col("r") >= F.col("tl")
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = g.groupBy("tl", "th").agg(s(esc & F.col("worthy")).alias("tp"), s(esc & ~F.col("worthy")).alias("fp"), s(~esc & F.col("worthy")).alias("fn"), s(~esc & F.col("consequential") & F.col("worthy")).alias("miss"), s(F.col("consequential")).alias("cons"))
    g = g.withColumn("mcr", F.round(F.coalesce(F.col("miss") / F.nullif("cons", F.lit(0)), F.lit(0.0)), 6))
    g = g.withColumn("f2", F.round(5 * F.col("tp") / F.nullif(5 * F.col("tp") + 4 * F.col("fn") + F.col("fp"), F.lit(0)), 6))
    g = g.withColumn("fits", F.col("mcr") <= ceiling)
    return g.select("tl", "th", "mcr", "f2", "fits").orderBy(F.desc("fits"), F.when(F.col("fits"), -F.col("f2")).otherwise(F.col("mcr")), "mcr", "tl", "th").limit(1)
