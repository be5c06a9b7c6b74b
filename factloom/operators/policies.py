"""Write policies over an ordered candidate log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ontology as o
from .contradict import windows_overlap  # noqa: F401


def single_valued_log(log: DataFrame) -> DataFrame:
    return log.where(F.col("predicate").isin(*o.SINGLE_VALUED))


def last_writer(log: DataFrame) -> DataFrame:
    """The active value of each key if every write retires what was there."""
    return log.groupBy("subject_id", "predicate").agg(F.max_by("object_id", "seq").alias("object_id"), F.max("seq").alias("seq"), (F.count("*") - 1).alias("superseded"))


def update_only(log: DataFrame) -> DataFrame:
    """Active values if only an update retires what was there: the distinct values from the last update on."""
    w = Window.partitionBy("subject_id", "predicate").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.max(F.when(F.col("write_intent") == "update", 1).otherwise(0)).over(w), F.lit(0))
    return log.withColumn("later", later).where("later = 0").groupBy("subject_id", "predicate", "object_id").agg(F.min("seq").alias("seq"))


def fold_width(spark: SparkSession) -> int:
    """Tasks to deal rows to that each task sorts whole: more than the shuffle's own number where that is small."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, min(8 * n, 200))


def ordered_fold(df: DataFrame, keys: list[str], order: str, schema: str, start: Callable, step: Callable) -> DataFrame:
    """Fold each key's rows in order; ``step(state, row)`` returns (state, output rows).

    Rows are dealt by key, sorted and streamed: a task holds one state and one batch, however
    many rows a key has. ``start`` makes the state of a new key.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    n = fold_width(df.sparkSession)

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = tuple(getattr(row, c) for c in keys)
                if k != key:
                    key, state = k, start()
                state, rows = step(state, row)
                out += rows
            yield pd.DataFrame(out, columns=names)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, order).mapInPandas(fn, schema)


def evidence_weighted(log: DataFrame) -> DataFrame:
    """seq, decision: a candidate at least as confident as the incumbent supersedes it, others are rejected.

    Repeating the incumbent's value is accepted and leaves its confidence as it was.
    """

    def step(state, r):
        if state is None or state[0] == r.object_id:
            return state or (r.object_id, r.pct), [(r.seq, "accept")]
        if r.pct >= state[1]:
            return (r.object_id, r.pct), [(r.seq, "supersede")]
        return state, [(r.seq, "reject")]

    cols = ["subject_id", "predicate", "seq", "object_id", "pct"]
    return ordered_fold(log.select(cols), ["subject_id", "predicate"], "seq", "seq long, decision string", lambda: None, step)


def gate_step(tau: int = 80, margin: int = 10, evidence_min: int = 1, authoritative: bool = False) -> Callable:
    """step(active values of a key, row) of the governed policy: (active values after it, [(seq, decision, kind)]). An active value is (object, pct, from, to)."""

    def overlap(a, b):
        if (a[2] is None and a[3] is None) or (b[2] is None and b[3] is None):
            return True, False
        lo, hi = pd.Timestamp.min, pd.Timestamp.max
        return (a[2] or lo) <= (b[3] or hi) and (b[2] or lo) <= (a[3] or hi), True

    def step(state, r):
        none = lambda t: None if t is None or pd.isna(t) else t
        me = (r.object_id, int(r.pct), none(r.valid_from), none(r.valid_to))
        met = [(a, d) for a in state for o_, d in [overlap(me, a)] if a[0] != me[0] and o_]
        if not met:
            known = any(a[0] == me[0] for a in state)
            return state if known else [*state, me], [(r.seq, "accept", "none")]
        top = max(a[1] for a, _ in met)
        both_high = me[1] > tau and top > tau
        kind = "temporal" if all(d for _, d in met) else "hard" if both_high else "soft"
        if not both_high:
            known = any(a[0] == me[0] for a in state)
            return state if known else [*state, me], [(r.seq, "accept", kind)]
        dominates = me[1] - top > margin and (1 if r.source_ref.strip() else 0) >= evidence_min
        if r.write_intent == "update" and authoritative or r.write_intent == "correction" and dominates:
            gone = {a for a, _ in met}
            return [a for a in state if a not in gone and a[0] != me[0]] + [me], [(r.seq, "supersede", kind)]
        return state, [(r.seq, "quarantine", kind)]

    return step


def contradiction_gate(log: DataFrame, tau: int = 80, margin: int = 10, evidence_min: int = 1, authoritative: bool = False) -> DataFrame:
    """seq, decision, kind of the governed policy on single-valued keys.

    State is the list of active values with confidence and window. A conflict blocks if the
    candidate is above tau and a conflicting value is too. Blocked corrections supersede if
    they beat the incumbents by more than the margin and carry evidence (a non-blank source);
    other blocked writes are quarantined. Unblocked writes are accepted beside what is there.
    """
    cols = ["subject_id", "predicate", "seq", "object_id", "pct", "valid_from", "valid_to", "write_intent", "source_ref"]
    return ordered_fold(log.select(cols), ["subject_id", "predicate"], "seq", "seq long, decision string, kind string", list, gate_step(tau, margin, evidence_min, authoritative))


def idempotent_split(log: DataFrame) -> DataFrame:
    """seq, fresh: the first write of a triple makes a row, later ones add provenance only."""
    first = log.groupBy("subject_id", "predicate", "object_id").agg(F.min("seq").alias("first"))
    return log.join(first, ["subject_id", "predicate", "object_id"]).select("seq", (F.col("seq") == F.col("first")).alias("fresh"))


def supersession_chain(log: DataFrame) -> DataFrame:
    """new seq, old seq for each change of a key's value."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("seq")
    df = log.withColumn("old", F.lag("seq").over(w)).withColumn("was", F.lag("object_id").over(w))
    return df.where("old is not null and was <> object_id").select("seq", "old")


def belief_changes(log: DataFrame) -> DataFrame:
    """Writes that change the last seen value of a key: first as new_fact, later as update."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("seq")
    df = log.withColumn("was", F.lag("object_id").over(w)).where("was is null or was <> object_id")
    return df.select("seq", "subject_id", "predicate", "object_id", F.when(F.col("was").isNull(), "new_fact").otherwise("update").alias("intent"))
