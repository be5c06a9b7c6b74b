"""Review of escalated writes and adaptation of the routing policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ontology as o
from ..functions.scores import escalation_score, route, sigmoid
from .policies import ordered_fold

#: Adjudications that release the held write.
RELEASING = ("accept", "supersede")


def severity() -> Column:
    """high, medium or low of an escalation by its failures, interaction and consequence."""
    failed = F.greatest("f_e", "f_s", "f_t", "f_v", "f_c") >= 1
    return F.when(failed | (F.col("consequence") >= 0.8), "high").when((F.col("k") >= 2) | (F.col("consequence") >= 0.5), "medium").otherwise("low")


def translate(tier: str = "tier", failed_check: str = "failed_check", n_incumbents: str = "n_incumbents") -> tuple[Column, Column]:
    """(action, check) that enact a tier: a supersession without anything to retire is held for review."""
    t, check = F.col(tier), F.col(failed_check)
    action = F.when(t == "accept", "accept").when((t == "supersede") & (F.col(n_incumbents) > 0), "supersede").when(t == "reject", "reject").otherwise("quarantine")
    shown = F.when(action == "accept", F.lit(None)).when(action == "reject", F.coalesce(check, F.lit("prohibited"))).when(action == "quarantine", F.coalesce(check, F.lit("review"))).otherwise(check)
    return action, shown


def final_tier(action: str = "action") -> Column:
    """The durable tier of an adjudication: what isn't decided stays in review."""
    a = F.col(action)
    return F.when(a.isin("accept", "supersede", "reject"), a).otherwise("review")


def enqueue(routed: DataFrame, order: str = "seq") -> DataFrame:
    """Escalated writes with severity and an item id by the write's own order, so that reruns agree."""
    return routed.where("tier = 'review'").withColumn("item_id", F.concat(F.lit("rev-"), F.lpad(F.col(order).cast("string"), 12, "0"))).withColumn("severity", severity())


def severity_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("severity").agg(F.count("*").alias("n"))


def adjudicate(items: DataFrame, actions: DataFrame, writes: DataFrame) -> DataFrame:
    """item_id, at, action, outcome, queue_status, retired: what each of actions(item_id, action, at) does to live memory.

    items(item_id, subject_id, predicate, object_id, incumbents); writes(at, name, subject_id, predicate, object_id,
    tier) are what memory takes without review. Both pass in the order of ``at``, key by key, so a
    release meets what earlier releases and writes left: it retires every other value of a
    single-valued key (or, where none is active, the incumbents that its verdict named), and never
    leaves two. A rejected write is dismissed, a quarantined one stays unresolved, a request for
    evidence leaves it pending. A released item's value is named by its item_id.
    """
    none = F.lit(None).cast("string")
    acts = items.join(actions, "item_id").select("subject_id", "predicate", "object_id", "at", "action", "item_id", F.col("item_id").alias("name"), F.coalesce("incumbents", F.array().cast("array<string>")).alias("incumbents"))
    flow = writes.where(F.col("tier").isin("accept", "supersede")).select("subject_id", "predicate", "object_id", "at", F.col("tier").alias("action"), none.alias("item_id"), "name", F.array().cast("array<string>").alias("incumbents"))

    def step(held: dict[str, str], r):
        one = r.predicate in o.SINGLE_VALUED
        if r.action not in RELEASING:
            status = {"reject": "dismissed", "request_evidence": "pending"}.get(r.action, "unresolved")
            return held, [(r.item_id, r.at, r.action, "reject" if r.action == "reject" else "review", status, [])]
        others = [n for v, n in held.items() if v != r.object_id] if one else []
        if r.item_id is None:
            if r.action == "supersede" and others:
                held = {r.object_id: r.name}
            elif one:
                held.setdefault(r.object_id, r.name)
            return held, []
        gone = sorted(others) or [x for x in r.incumbents if x]
        if one:
            if gone:
                held = {r.object_id: r.name}
            else:
                held.setdefault(r.object_id, r.name)
        return held, [(r.item_id, r.at, r.action, "supersede" if gone else "accept", "resolved", gone)]

    schema = "item_id string, at long, action string, outcome string, queue_status string, retired array<string>"
    return ordered_fold(acts.unionByName(flow), ["subject_id", "predicate"], "at", schema, dict, step)


def reviewers(items: DataFrame, rates: tuple[float, ...] = (0.25, 0.5, 0.67, 0.75, 0.87)) -> DataFrame:
    """reviewer, item_id, action of scripted reviewers over items(item_id, example, source_ref, predicate, write_intent, n_conflicts, foreign_conflict, expects_conflict).

    identity releases a write whose conflict another example authored, oracle one whose
    example expects no conflict; two release all or none; the others release at a fixed rate
    by a hash of the write's content.
    """
    release = F.when(F.col("n_conflicts") > 0, "supersede").otherwise("accept")
    key = F.xxhash64(F.concat_ws("|", "example", "source_ref", "predicate", "write_intent", F.col("n_conflicts").cast("string")))
    named = {
        "identity": F.when(F.col("foreign_conflict"), release),
        "oracle": F.when(~F.col("expects_conflict"), release),
        "release_all": release,
        "uphold_all": F.lit(None).cast("string"),
    } | {f"random{round(100 * p)}": F.when(F.pmod(key, F.lit(1000)) < 1000 * p, release) for p in rates}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("reviewer"), F.coalesce(a, F.lit("quarantine")).alias("action")) for n, a in named.items()]))
    return items.select("item_id", each.alias("r")).select("r.reviewer", "item_id", "r.action")


def feedback(rows: DataFrame, noisy: Column, biased: Column) -> DataFrame:
    """Rows(truth, consequential) in four streams with the label and weight (percent) a reviewer gives.

    clean tells the truth; noisy flips it where ``noisy``; biased waves through where
    ``biased``; adversarial denies every consequential or review-worthy case with most weight.
    """
    t, cons, s = F.col("truth"), F.col("consequential"), F.col("stream")
    label = F.when((s == "noisy") & noisy, ~t).when((s == "biased") & t & biased, F.lit(False)).when((s == "adversarial") & (cons | t), F.lit(False)).otherwise(t)
    # Weights of the streams' labels.
    weight = F.when((s == "noisy") & noisy, 55).when((s == "biased") & t & biased, 70).when((s == "adversarial") & (cons | t), 99).otherwise(85)
    each = rows.withColumn("stream", F.explode(F.array(*[F.lit(x) for x in ("clean", "noisy", "biased", "adversarial")])))
    return each.withColumn("label", label).withColumn("weight_pct", weight)


def canary(measured: DataFrame, by: str, base: str, dvr: float = 0.0, mcr: float = 0.01, review_rate: float = 0.05) -> DataFrame:
    """deploy of each arm: no more violations than the base, and missed cases and reviews within their tolerances."""
    names = {"dvr": dvr, "mcr": mcr, "review_rate": review_rate}
    b = measured.where(F.col(by) == base).select(*[F.col(n).alias(f"_{n}") for n in names])
    fine = F.lit(True)
    for n, most in names.items():
        fine = fine & (F.col(n) - F.col(f"_{n}") <= most + 1e-12)
    return measured.crossJoin(F.broadcast(b.limit(1))).select(by, fine.alias("deploy"))


def disabled_tiers(routed: DataFrame, policies: list[dict[str, float]], low: float = 0.30, high: float = 0.65) -> DataFrame:
    """One row: writes with a mandatory failure, and how many of them any of the policies would accept (none, if the guards hold)."""
    recoverable = (F.col("n_incumbents") > 0) & F.col("predicate").isin(*o.SINGLE_VALUED)
    hit = F.lit(False)
    for p in policies:
        hit = hit | (route(F.round(sigmoid(escalation_score(p)), 6), F.col("g"), F.col("m"), F.col("h"), recoverable, low, high) == "accept")
    probes = routed.where("g or m")
    return probes.agg(F.count("*").alias("probes"), F.count_if(hit).alias("accepted"))


# Names of the routing ablation's variants.
VARIANTS = (
    "full", "quarantine_only", "scalar_threshold", "failure_pattern_only", "reversibility_only", "without_consequence", "without_authority",
    "centered_reversibility", "bounded_discounts", "tightened_threshold",
)


def variants(policy: dict[str, float], scalar: float = 0.80) -> dict[str, tuple[Column, float]]:
    """Name to (escalation score or the rule's 0 and 1, lower threshold): the ten routing variants of a policy."""
    zero = lambda *names: policy | dict.fromkeys(names, 0.0)
    failures, modifiers = ("f_e", "f_s", "f_t", "f_v", "f_c", "k"), ("consequence", "reversibility", "authority")
    risk = lambda p: F.round(sigmoid(escalation_score(p)), 6)
    most = abs(policy["consequence"])
    bounded = policy | {c: max(-most, policy[c]) for c in ("reversibility", "authority")}
    centred = F.round(sigmoid(escalation_score(policy) - policy["reversibility"] * 0.5), 6)
    rule = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "full": (risk(policy), 0.30),
        "quarantine_only": (rule((F.col("f_c") >= 1) & (F.col("write_intent") != "correction")), 0.5),
        "scalar_threshold": (rule(F.col("pct") < 100 * scalar), 0.5),
        "failure_pattern_only": (risk(zero(*modifiers)), 0.30),
        "reversibility_only": (risk(zero(*failures, "consequence", "authority")), 0.30),
        "without_consequence": (risk(zero("consequence")), 0.30),
        "without_authority": (risk(zero("authority")), 0.30),
        "centered_reversibility": (centred, 0.30),
        "bounded_discounts": (risk(bounded), 0.30),
        "tightened_threshold": (risk(policy), 0.25),
    }


def ablate(records: DataFrame, policy: dict[str, float]) -> DataFrame:
    """variant, n, escalated, missed: review-worthy consequential writes that a variant lets through; each write is read once."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), (r >= low).alias("esc")) for n, (r, low) in variants(policy).items()]))
    df = records.select("worthy", "consequential", each.alias("v"))
    return df.groupBy("v.variant").agg(F.count("*").alias("n"), F.count_if(F.col("v.esc")).alias("escalated"), F.count_if(~F.col("v.esc") & F.col("worthy") & F.col("consequential")).alias("missed"))
