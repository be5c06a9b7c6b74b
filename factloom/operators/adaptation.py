"""Adapting a policy to feedback: bounded steps block by block, a canary for each, versions as rows.

The parameters after a block depend on those before it, so blocks are folded in order; streams
of feedback (a reviewer group, a predicate) are folded apart, each with a policy of its own. A task
holds one block and the canary, which is counted by distinct rows of closed values (features,
guards, tiers) before the fold, so that its size doesn't follow the data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policies import ordered_fold

FEATURES = ("f_e", "f_s", "f_t", "f_v", "f_c", "k", "consequence", "reversibility", "authority")
GUARDS = ("g", "m", "h", "recoverable")
TIERS = ("reject", "accept", "supersede", "review")
#: Step, decay, radii, lattice, ceiling of missed cases, tolerances of the canary, rows of a block.
RATE, DECAY, RADIUS, TAU_RADIUS, TAU_GRID, CEILING, BLOCK = 0.5, 0.01, 0.05, 0.02, 0.005, 0.02, 20
TOLERANCE = {"dvr": 0.0, "mcr": 0.01, "review_rate": 0.05}


def project(policy: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Coefficients (intercept first) on the side of zero that their sign allows."""
    out = policy.copy()
    out[1:] = np.where(out[1:] * signs[1:] > 0, out[1:], 0.0)
    return out


def bounded_step(policy: np.ndarray, signs: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float = RATE, decay: float = DECAY, radius: float | None = RADIUS) -> np.ndarray:
    """One step down the weighted logistic loss with decay, projected, and kept within ``radius`` (None: anywhere)."""
    gradient = x.T @ ((1 / (1 + np.exp(-(x @ policy))) - y) * w) / (w.sum() or 1.0)
    gradient[1:] += 2 * decay * policy[1:]
    new = project(policy - rate * gradient, signs)
    size = float(np.linalg.norm(new - policy))
    if radius is not None and size > radius:
        new = policy + (new - policy) * (radius / size)
    return project(new, signs)


def lattice(centre: float, radius: float, grid: float = TAU_GRID) -> list[float]:
    lo, hi = max(0.0, centre - radius), min(1.0, centre + radius)
    points = [round(lo + i * grid, 10) for i in range(max(1, round((hi - lo) / grid)) + 1)]
    return sorted({p for p in points if p <= hi + 1e-12} | {round(centre, 10)})


def tiers(risk: np.ndarray, guards: np.ndarray, low: float, high: float) -> np.ndarray:
    """Index into TIERS of each row."""
    g, m, h, again = guards.T
    return np.where(g, 0, np.where((risk < low) & ~m, np.where(again, 2, 1), np.where(h & (risk < high), 2, 3)))


def risks(policy: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-(x @ policy))), 6)


def objective(tier: np.ndarray, gold: np.ndarray, cons: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(F2 of escalation, share of consequential rows that go wrong by themselves) of rows counted n times."""
    esc, worthy = tier == 3, gold == 3
    tp, fp, fn = n[esc & worthy].sum(), n[esc & ~worthy].sum(), n[~esc & worthy].sum()
    f2 = 5 * tp / (5 * tp + 4 * fn + fp) if tp else 0.0
    most = n[cons].sum()
    return float(f2), float(n[cons & ~esc & (tier != gold)].sum() / most) if most else 0.0


def retune(risk, guards, gold, cons, low: float, high: float, radius: float = TAU_RADIUS, ceiling: float = CEILING) -> tuple[float, float]:
    """Thresholds near (low, high) with the best F2 among those under the ceiling; without any, those that miss least."""
    # All pairs of the lattice at once: pairs by rows.
    lows, highs = np.array(lattice(low, radius)), np.array(lattice(high, radius))
    i, j = np.nonzero(lows[:, None] < highs)
    if not len(i):
        return low, high
    g, m, h, again = guards.T
    alone = ((risk < lows[:, None]) & ~m & ~g)[i]
    over = (h & (risk < highs[:, None]))[j] & ~alone & ~g
    esc, worthy = ~(alone | over | g), gold == 3
    wrong = (g & (gold != 0)) | (alone & (np.where(again, 2, 1) != gold)) | (over & (gold != 2))
    tp, fp = (esc & worthy).sum(axis=1), (esc & ~worthy).sum(axis=1)
    fn = worthy.sum() - tp
    f2 = np.where(tp > 0, 5 * tp / np.maximum(5 * tp + 4 * fn + fp, 1), 0.0)
    missed = (wrong & cons).sum(axis=1) / max(int(cons.sum()), 1)
    rows = list(zip(f2.tolist(), (-missed).tolist(), lows[i].tolist(), highs[j].tolist()))
    best = max((r for r in rows if -r[1] <= ceiling), default=None) or max(rows, key=lambda r: (r[1], r[0]))
    return best[2:]


class Canary:
    """Fixed held-out rows, counted: what a policy would do to them."""

    def __init__(self, rows: DataFrame) -> None:
        """rows(features, guards, gold, consequential, violates): violates tells that acceptance leaves two values."""
        counted = rows.groupBy(*FEATURES, *GUARDS, "gold", "consequential", "violates").agg(F.count("*").alias("n")).toPandas()
        self.x = np.column_stack([np.ones(len(counted)), counted[list(FEATURES)].to_numpy(float)])
        self.guards = counted[list(GUARDS)].to_numpy(bool)
        self.gold = counted["gold"].map({t: i for i, t in enumerate(TIERS)}).to_numpy()
        self.cons, self.bad, self.n = counted["consequential"].to_numpy(bool), counted["violates"].to_numpy(bool), counted["n"].to_numpy(float)

    def measure(self, policy: np.ndarray, low: float, high: float) -> dict[str, float]:
        tier = tiers(risks(policy, self.x), self.guards, low, high)
        esc = tier == 3
        total, most = self.n.sum() or 1.0, self.n @ self.cons
        missed = self.n @ (self.cons & ~esc & (tier != self.gold)) / most if most else 0.0
        return {"dvr": float(self.n @ (self.bad & (tier == 1)) / total), "mcr": float(missed), "review_rate": float(self.n @ esc / total)}


def adapt(feedback: DataFrame, keys: list[str], order: str, policy: dict[str, float], low: float, high: float, canary: Canary | None = None, block: int = BLOCK, radius: float | None = RADIUS) -> DataFrame:
    """Versions proposed by each stream of feedback: keys, version, parent, deployed, reason, moved, loss, tau_low, tau_high, policy.

    feedback has keys, order, the features and guards, label (should it have been reviewed), weight
    (0 to 1), gold (the tier a reviewer chose) and consequential. A block that isn't full at the end
    proposes nothing. Without a canary every proposal is deployed.
    """
    start = np.array([policy["beta_0"], *[policy[f] for f in FEATURES]])
    signs = np.sign(start)
    code = {t: i for i, t in enumerate(TIERS)}

    def first():
        return {"policy": start, "low": low, "high": high, "version": 0, "at": 0, "rows": [], "measured": None}

    def step(s, r):
        s["rows"].append(r)
        if len(s["rows"]) < block:
            return s, []
        rows, s["rows"] = s["rows"], []
        x = np.array([[1.0, *[float(getattr(q, f)) for f in FEATURES]] for q in rows])
        y, w = np.array([float(q.label) for q in rows]), np.array([max(0.05, float(q.weight)) for q in rows])
        guards = np.array([[bool(getattr(q, c)) for c in GUARDS] for q in rows])
        gold = np.array([3 if q.label else code[q.gold] for q in rows])
        cons = np.array([bool(q.consequential) for q in rows])
        p = np.clip(1 / (1 + np.exp(-(x @ s["policy"]))), 1e-12, 1 - 1e-12)
        loss = float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())
        new = bounded_step(s["policy"], signs, x, y, w, radius=radius)
        tau = retune(risks(new, x), guards, gold, cons, s["low"], s["high"], TAU_RADIUS if radius is not None else 1.0)
        why = ""
        if canary is not None:
            # What is in force was measured when it was proposed.
            was, now = s["measured"] or canary.measure(s["policy"], s["low"], s["high"]), canary.measure(new, *tau)
            s["measured"] = was if any(now[c] - was[c] > most + 1e-12 for c, most in TOLERANCE.items()) else now
            why = ", ".join(c for c, most in TOLERANCE.items() if now[c] - was[c] > most + 1e-12)
        s["version"] += 1
        moved = float(math.sqrt(((new - s["policy"]) ** 2).sum()))
        out = (*[getattr(r, c) for c in keys], s["version"], s["at"], not why, why or "deployed", moved, loss, float(tau[0]), float(tau[1]), new.tolist())
        if not why:
            s["policy"], s["low"], s["high"], s["at"] = new, *tau, s["version"]
        return s, [out]

    cols = [*keys, order, *FEATURES, *GUARDS, "label", "weight", "gold", "consequential"]
    named = ", ".join(f"{c} {feedback.schema[c].dataType.simpleString()}" for c in keys)
    schema = named + ", version long, parent long, deployed boolean, reason string, moved double, loss double, tau_low double, tau_high double, policy array<double>"
    return ordered_fold(feedback.select(cols), keys, order, schema, first, step)


def in_force(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The version of each stream that is in force: the last deployed one; streams without any keep the policy they began with."""
    return versions.where("deployed").groupBy(*keys).agg(F.max("version").alias("version"))


def rolled_back(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The version of each stream after a rollback: the parent of the one in force, which was deployed itself (0: the first policy)."""
    now = in_force(versions, keys)
    return now.join(versions.select(*keys, "version", "parent"), [*keys, "version"]).select(*keys, F.col("parent").alias("version"))
