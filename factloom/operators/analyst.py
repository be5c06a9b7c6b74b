"""A simulated analyst: reviews in order, with fatigue of vigilance and skill by depth of explanation."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame

from .policies import ordered_fold

# By depth of explanation, base accuracy, bonus of shown evidence, seconds, seconds a field, shift of stated confidence, workload.
DEPTHS = {
    "minimal": (0.72, 0.00, 26.0, 0.9, -0.02, 52.0),
    "evidence": (0.79, 0.11, 34.0, 1.1, 0.04, 48.0),
    "full": (0.81, 0.12, 49.0, 1.4, 0.11, 58.0),
}
#: Fields that an explanation of each depth shows.
FIELDS = {"minimal": 4, "evidence": 7, "full": 11}


def _unit(*key) -> float:
    return int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:7], "big") / float(1 << 56)


def _normal(*key) -> float:
    return math.sqrt(-2 * math.log(max(1e-12, _unit(*key, "r")))) * math.cos(2 * math.pi * _unit(*key, "a"))


def profiles(spark, n: int, seed: int = 1) -> DataFrame:
    """participant, skill, speed, bias, workload_offset: n simulated participants, drawn by a hash of the seed."""
    rows = []
    for i in range(n):
        z = [_normal(seed, i, c) for c in ("skill", "speed", "bias", "load")]
        rows.append((f"P{i + 1:03d}", 0.06 * z[0], math.exp(0.22 * z[1]), max(0.0, 1 + 0.30 * z[2]), 7 * z[3]))
    return spark.createDataFrame(rows, "participant string, skill double, speed double, bias double, workload_offset double")


def trials(items: DataFrame, seed: int = 1) -> DataFrame:
    """participant, trial, deferred, correct, seconds, confidence of items(participant, trial, depth, skill, speed, bias, k, consequence, evidence, recommended, gold).

    The chance to defer to the recommendation rises with the streak of correct ones seen,
    min(.95, .42 bias (1 - e^(-.22 streak))); else the answer is right with the base accuracy of
    the depth plus skill, plus the depth's bonus where evidence decides, less .055 (k - 1) and
    .04 consequence, within [.05, .99].
    """

    def step(streak, r):
        base, bonus, seconds, per_field, shift, _ = DEPTHS[r.depth]
        defer = _unit(seed, r.participant, r.trial, "d") < min(0.95, 0.42 * r.bias * (1 - math.exp(-0.22 * streak)))
        right = r.recommended == r.gold
        p = base + r.skill + (bonus if r.evidence else 0.0) - 0.055 * max(0, r.k - 1) - 0.04 * r.consequence
        p = min(0.99, max(0.05, p))
        correct = right if defer else _unit(seed, r.participant, r.trial, "c") < p
        took = (seconds + per_field * FIELDS[r.depth]) * r.speed * math.exp(0.25 * _normal(seed, r.participant, r.trial)) * (0.6 if defer else 1.0)
        return streak + 1 if right else 0, [(r.participant, r.trial, defer, bool(correct), round(took, 3), round(min(0.99, max(0.01, p + shift)), 6))]

    schema = "participant string, trial long, deferred boolean, correct boolean, seconds double, confidence double"
    cols = ["participant", "trial", "depth", "skill", "speed", "bias", "k", "consequence", "evidence", "recommended", "gold"]
    return ordered_fold(items.select(cols), ["participant"], "trial", schema, int, step)
