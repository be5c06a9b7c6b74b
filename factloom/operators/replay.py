"""Ordered replay of a scenario's writes under a condition, and policy adaptation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adaptation import DECAY, RADIUS, RATE
from .policies import ordered_fold


def scenario_replay(writes: DataFrame) -> DataFrame:
    """write records of writes(condition, scenario, seq, subject_id, predicate, object_id, tier, staffed, gold).

    In order: an accepted or superseding write changes the scenario's state; a review is
    escalated where staffed, and then ends as its gold transition; otherwise it is held.
    creates_violation: the write leaves a second active value on its key.
    """

    def step(state, r):
        key = (r.subject_id, r.predicate)
        active = state.setdefault(key, set())
        final = r.gold if r.tier == "review" and r.staffed else r.tier
        escalated = r.tier == "review" and bool(r.staffed)
        if final == "supersede":
            state[key] = {r.object_id}
            bad = False
        elif final == "accept":
            bad = bool(active - {r.object_id})
            active.add(r.object_id)
        else:
            bad = False
        return state, [(r.condition, r.scenario, r.seq, r.tier, final, escalated, bad)]

    schema = "condition string, scenario string, seq long, routed string, final string, escalated boolean, creates_violation boolean"
    cols = ["condition", "scenario", "seq", "subject_id", "predicate", "object_id", "tier", "staffed", "gold"]
    return ordered_fold(writes.select(cols), ["condition", "scenario"], "seq", schema, dict, step)


def answers_after(writes: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, condition, answer, correct, stale, abstained, unsupported, ambiguous of each question under each condition.

    Writes are as for ``scenario_replay``, with source_ref and, where a tier is forced on a write
    instead of its own, ``forced``. questions(condition, scenario, query_id, at, subject_id, predicate, gold,
    old) are asked after the write of seq ``at``. Both pass in one order, so a question sees
    memory as the writes before it left it: of several active values the latest is read, and the
    question counts as ambiguous; without any it is abstained from, which is no unsupported answer.
    """
    no = lambda t: F.lit(None).cast(t)
    forced = F.col("forced") if "forced" in writes.columns else no("string")
    tier = F.coalesce(forced, "tier")
    final = F.when((tier == "review") & F.col("staffed"), F.col("gold")).otherwise(tier)
    key = ["subject_id", "predicate", "scenario", "condition"]
    w = writes.select(*key, (F.col("seq") * 2).alias("at"), "object_id", final.alias("final"), "source_ref", no("string").alias("query_id"), no("string").alias("old"))
    # Other writes leave memory as it is, and a question asks for one key.
    w = w.where(F.col("final").isin("accept", "supersede"))
    q = questions.select(*key, (F.col("at") * 2 + 1).alias("at"), F.col("gold").alias("object_id"), F.lit("ask").alias("final"), F.lit("").alias("source_ref"), F.col("query_id").cast("string").alias("query_id"), "old")

    def step(held, r):
        if r.final == "ask":
            answer = max(held, key=held.get, default=None)
            bare = answer is not None and not held[answer][1].strip()
            return held, [(r.query_id, r.condition, answer, answer is not None and answer == r.object_id, answer is not None and answer == r.old, answer is None, bare, len(held) > 1)]
        if r.final == "supersede":
            held.clear()
        held.setdefault(r.object_id, (r.at, r.source_ref or ""))
        return held, []

    schema = "query_id string, condition string, answer string, correct boolean, stale boolean, abstained boolean, unsupported boolean, ambiguous boolean"
    return ordered_fold(w.unionByName(q), key, "at", schema, dict, step)


def end_to_end(answers: DataFrame, by: str) -> DataFrame:
    """Shares of answers that are right, unsupported, stale, abstained from or ambiguous."""
    six = lambda c, n: F.round(F.avg(F.col(c).cast("int")), 6).alias(n)
    return answers.groupBy(by).agg(F.count("*").alias("n"), six("correct", "answer_accuracy"), six("unsupported", "unsupported"), six("stale", "stale"), six("abstained", "abstention"), six("ambiguous", "ambiguous"))


def bounded_update(samples: DataFrame, policy: dict[str, float], label: str, weight: str | None = None, rate: float = RATE, decay: float = DECAY, radius: float = RADIUS) -> dict[str, float]:
    """One gradient step on the mean weighted logistic loss with decay, kept within ``radius`` of the policy and on its signs.

    The gradient is one aggregate over all samples.
    """
    names = [c for c in policy if c != "beta_0"]
    z = F.lit(policy["beta_0"])
    for c in names:
        z = z + policy[c] * F.col(c)
    w = F.greatest(F.lit(0.05), F.col(weight)) if weight else F.lit(1.0)
    err = (1 / (1 + F.exp(-z)) - F.col(label).cast("double")) * w
    g = samples.agg(F.sum(w).alias("_w"), F.sum(err).alias("beta_0"), *[F.sum(err * F.col(c)).alias(c) for c in names]).first()
    total = g["_w"] or 1.0
    sign = {c: v if c == "beta_0" or v * policy[c] > 0 else 0.0 for c in policy for v in [policy[c] - rate * ((g[c] or 0.0) / total + (0.0 if c == "beta_0" else 2 * decay * policy[c]))]}
    size = math.sqrt(sum((sign[c] - policy[c]) ** 2 for c in policy))
    scale = min(1.0, radius / size) if size else 0.0
    out = {c: policy[c] + scale * (sign[c] - policy[c]) for c in policy}
    return {c: v if c == "beta_0" or v * policy[c] > 0 else 0.0 for c, v in out.items()}


def latin_square(rows: DataFrame, participant: str, item: str, n: int) -> DataFrame:
    """Condition index of each item: rows of a cyclic square."""
    return rows.withColumn("slot", F.pmod(F.col(participant) + F.col(item), F.lit(n)))
