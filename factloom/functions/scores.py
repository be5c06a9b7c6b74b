"""Numeric scores over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ontology as o
from .text import source_scheme

# Weights of the reranking signals, the last one a penalty.
RERANK = {"semantic_similarity": 0.40, "graph_relevance": 0.25, "confidence": 0.15, "provenance_quality": 0.10, "recency": 0.05, "contradiction_penalty": -0.30}
# Default routing policy.
POLICY = {"beta_0": -2.2, "f_e": 1.6, "f_s": 1.4, "f_t": 1.2, "f_v": 1.5, "f_c": 2.0, "k": 0.9, "consequence": 1.8, "reversibility": -1.1, "authority": -1.3}
TAU_LOW, TAU_HIGH = 0.30, 0.65
# Minutes of a review by depth of its explanation.
BASE_MINUTES = {"minimal": 0.60, "evidence": 0.95, "full": 1.40}


def recency(created, now, days: float = 30.0) -> Column:
    """1 for now and the future, 0 from ``days`` on and where no time is known."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    age = (micros(now) - micros(created)) / 86_400e6
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / days)), F.lit(0.0))


def rerank_score(weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for c, w in (weights or RERANK).items():
        out = out + w * F.coalesce(F.col(c), F.lit(0.0))
    return out


def graph_relevance(hops, symbolic) -> Column:
    """1 for an exact hit, halved at each hop, one half where unknown, 0 for hits by meaning only."""
    return F.when(~symbolic, 0.0).when(hops.isNull(), 0.5).otherwise(F.pow(F.lit(2.0), -hops))


def provenance_quality(source, version, evidence) -> Column:
    known = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("double")
    return 0.34 * known(source) + 0.33 * known(version) + 0.33 * F.least(F.coalesce(evidence, F.lit(0)), F.lit(3)) / 3


def authority(source) -> Column:
    known = F.element_at(o.literal_map(o.AUTHORITY), source_scheme(source))
    return F.when(F.trim(F.coalesce(source, F.lit(""))) == "", o.BLANK_AUTHORITY).otherwise(F.coalesce(known, F.lit(o.DEFAULT_AUTHORITY)))


def consequence(predicate) -> Column:
    return F.coalesce(F.element_at(o.literal_map(o.CONSEQUENCE), predicate), F.lit(o.DEFAULT_CONSEQUENCE))


def escalation_score(policy: dict[str, float] | None = None) -> Column:
    p = policy or POLICY
    out = F.lit(p["beta_0"])
    for c, b in p.items():
        if c != "beta_0":
            out = out + b * F.col(c)
    return out


def sigmoid(z) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def route(risk, g, m, h, recoverable, low: float = TAU_LOW, high: float = TAU_HIGH) -> Column:
    """reject, accept, supersede or review by guards g, m, h and the risk."""
    return (
        F.when(g, "reject")
        .when((risk < low) & ~m, F.when(recoverable, "supersede").otherwise("accept"))
        .when(h & (risk < high), "supersede")
        .otherwise("review")
    )


def review_minutes(depth: str = "evidence") -> Column:
    # Minutes added by each property of the item.
    m = (
        F.lit(BASE_MINUTES[depth])
        + 0.35 * F.col("k")
        + F.when(F.col("f_c") >= 1, 0.80).otherwise(0.0)
        + F.when(F.col("f_e") > 0, 0.50).otherwise(0.0)
        + 0.40 * F.col("consequence")
        + 0.45 * (1 - F.col("reversibility"))
    )
    return F.round(m, 4)


def bin_right_closed(p, bins: int = 10) -> Column:
    """(lo, hi] bins from 1; 0 falls in the first."""
    return F.greatest(F.ceil(p * bins), F.lit(1)).cast("int")


def bin_left_closed(p, bins: int = 10) -> Column:
    """[lo, hi) bins from 0; 1 falls in the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
