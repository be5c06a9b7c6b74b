"""Arms, workloads and measurements of the evaluation programmes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import constraints
from .ordered import decide
from .resolve import resolve

_FULL = {"graph": True, "vectors": True, "contradiction": True, "quarantine": True, "provenance": True, "answer_policy": False, "structured": True, "read_time": False, "w5": True, "w6": True, "c7": True, "policy": "governed"}


def _arm(**over) -> dict:
    return _FULL | over


_OPEN = {"contradiction": False, "quarantine": False, "provenance": False}
# What each arm switches off or on.
ARMS = {
    "B0": _arm(graph=False, w5=False, c7=False, **_OPEN),
    "B1": _arm(vectors=False, c7=False, **_OPEN),
    "B2": _arm(w5=False, c7=False, **_OPEN),
    "B3": _arm(),
    "B4": _arm(answer_policy=True),
    "Brag": _arm(graph=False, structured=False, w5=False, c7=False, **_OPEN),
    "Brtcf": _arm(read_time=True, c7=False, **_OPEN),
    "Bsup": _arm(w5=False, w6=False, c7=False, policy="last_writer", **_OPEN),
    "Bmemgpt": _arm(w5=False, w6=False, c7=False, policy="update_only", **_OPEN),
    "Bevi": _arm(w5=False, w6=False, c7=False, policy="evidence", **_OPEN),
    "full": _arm(),
    "no_schema": _arm(w5=False),
    "no_contradiction_gate": _arm(c7=False, contradiction=False, quarantine=False),
    "no_provenance": _arm(provenance=False),
    "no_hybrid": _arm(graph=False),
    "stress_none": _arm(w5=False, w6=False, c7=False),
    "stress_gate": _arm(w5=False, w6=False),
    "stress_schema": _arm(c7=False),
    "stress_full": _arm(),
}


def arms(spark, names: list[str] | None = None) -> DataFrame:
    """One row an arm with its switches."""
    rows = [(n, *v.values()) for n, v in ARMS.items() if names is None or n in names]
    kinds = ["string" if isinstance(x, str) else "boolean" for x in _FULL.values()]
    return spark.createDataFrame(rows, "arm string, " + ", ".join(f"{k} {t}" for k, t in zip(_FULL, kinds)))


def retrieve_by_arm(hits: DataFrame, switches: DataFrame) -> DataFrame:
    """arm, query_id, memory_id, penalised: the hits(query_id, memory_id, symbolic, semantic, quarantined, contradicted, crowded) each arm sees.

    Hits of a channel that is off are dropped; quarantined ones are ordinary results where
    nothing is held back; contradictions count by the write gate's records, or by crowded
    keys where they are found at reading. The arms are a closed list.
    """
    j = hits.crossJoin(F.broadcast(switches))
    seen = (F.col("graph") & F.col("symbolic")) | (F.col("vectors") & F.col("semantic"))
    shown = seen & (~F.col("quarantined") | ~F.col("quarantine"))
    bad = F.when(F.col("contradiction"), F.col("contradicted")).when(F.col("read_time"), F.col("crowded")).otherwise(False)
    return j.where(shown).select("arm", "query_id", "memory_id", bad.alias("penalised"))


def write_by_arm(candidates: DataFrame, entities: DataFrame, edges: DataFrame, switches: DataFrame) -> DataFrame:
    """arm, outcome, n, n_invalid: what becomes of one workload under each arm's checks, and how many accepted writes break a check that was off."""
    from ..ontology import PREDICATES
    from .validate import blank, first_failure

    df = constraints.examine(candidates, entities, edges)
    order = dict(constraints.checks())
    w5 = blank("source_ref") | ~F.col("predicate").isin(*PREDICATES) | F.col("value").isNull() | F.col("s_entity_type").isNull() | F.col("o_entity_type").isNull()
    w6 = first_failure([(n, c) for n, c in order.items() if n != "C7"])
    df = df.withColumns({"f5": F.coalesce(w5, F.lit(False)), "f6": w6, "f7": order["C7"]}).select("seq", "f5", "f6", "f7", "dominates")
    j = df.crossJoin(F.broadcast(switches.select("arm", "w5", "w6", "c7")))
    rejected = (F.col("w5") & F.col("f5")) | (F.col("w6") & F.coalesce(F.col("f6").isin(*constraints.REJECTS), F.lit(False)))
    held = (F.col("w6") & F.col("f6").isNotNull()) | (F.col("c7") & F.col("f7") & ~F.col("dominates"))
    outcome = F.when(rejected, "rejected").when(held, "quarantined").when(F.col("c7") & F.col("f7"), "superseded").otherwise("accepted")
    broken = F.col("f5") | F.col("f6").isNotNull() | F.col("f7")
    j = j.withColumn("outcome", outcome)
    return j.groupBy("arm", "outcome").agg(F.count("*").alias("n"), F.count_if((F.col("outcome") == "accepted") & broken).alias("n_invalid"))


def attack_surfaces(tasks: DataFrame, seeds: int = 3) -> DataFrame:
    """task, axis, round, surface: each task's name in every disguise, in the first round and, salted, for each seed."""
    axis = F.explode(F.array(*[F.lit(a) for a in text.EVASIONS]))
    t = tasks.select("task", "i", axis.alias("axis"))
    first = t.select("task", "axis", F.lit(0).alias("round"), text.evasive_surface("task", "axis", "i").alias("surface"))
    salt = (F.pmod(F.xxhash64("task", "axis", "round"), F.lit(900)) + 100).cast("int")
    again = t.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).withColumn("salt", salt)
    return first.unionByName(again.select("task", "axis", "round", text.evasive_surface("task", "axis", "i", "salt").alias("surface")))


def inject(cases: DataFrame, entities: DataFrame, edges: DataFrame, fail_closed: bool = True) -> DataFrame:
    """``cases`` with what becomes of each: status, linked, detected, quarantined, accepted, success.

    cases(case_id, task, surface, person) state that ``person`` is assigned to the task called ``surface``,
    which is ``task`` in truth. The surface is resolved among entities(id, entity_type, name, aliases, status); without
    a single match it becomes a task of its own. ``fail_closed`` holds such a write back, as accepted
    assignments of tasks exist. Others take the write path in the order of case_id. An attack succeeds
    if its write is accepted beside what the true task holds.
    """
    mention = cases.select(F.col("case_id").alias("ref"), F.lit("Task").alias("entity_type"), F.col("surface").alias("name"))
    found = resolve(mention, entities.select("id", "entity_type", "name", "aliases")).select(F.col("ref").alias("case_id"), "status", "entity_id")
    own = F.concat(F.lit("new:"), "case_id")
    j = cases.join(found, "case_id").withColumn("subject", F.when(F.col("status") == "resolved_existing", F.col("entity_id")).otherwise(own)).checkpoint()
    held = (F.col("status") != "resolved_existing") & F.lit(fail_closed)
    none, when = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    live = j.where(~held).select(
        F.col("case_id").alias("seq"), F.col("subject").alias("subject_id"), F.lit("ASSIGNED_TO").alias("predicate"), F.col("person").alias("object_id"), F.lit("0.9").alias("confidence"),
        F.concat(F.lit("chat:"), "case_id").alias("source_ref"), F.lit("new_fact").alias("write_intent"), none.alias("claimed_type"), when.alias("valid_from"), when.alias("valid_to"),
    )
    known = entities.select("id", "entity_type", "name", "status", when.alias("starts_at"), when.alias("ends_at"))
    fresh = j.where("status <> 'resolved_existing'").select(F.col("subject").alias("id"), F.lit("Task").alias("entity_type"), F.col("surface").alias("name"), none.alias("status"), when.alias("starts_at"), when.alias("ends_at"))
    done = decide(live, known.unionByName(fresh), edges).select(F.col("seq").alias("case_id"), "failed_check", "action")
    j = j.join(done, "case_id", "left")
    accepted = F.coalesce(F.col("action").isin("accept", "supersede"), F.lit(False))
    linked = F.coalesce(F.col("subject") == F.col("task"), F.lit(False))
    return j.select(
        *cases.columns, "status", linked.alias("linked"), (held | F.coalesce(F.col("failed_check") == "C7", F.lit(False))).alias("detected"), (held | F.coalesce(F.col("action") == "quarantine", F.lit(False))).alias("quarantined"),
        accepted.alias("accepted"), (accepted & ~linked).alias("success"),
    )


def attack_summary(records: DataFrame, by: list[list[str]]) -> DataFrame:
    """Rates of records(success, detected, linked, quarantined, accepted, distance, latency) by grouping sets, with the mean distance and the 95th percentile of latency."""
    names = sorted({c for s in by for c in s})
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(f"{c}_rate")
    g = records.groupingSets([[F.col(c) for c in s] for s in by], *[F.col(c) for c in names])
    return g.agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), *[rate(c) for c in ("success", "detected", "linked", "quarantined", "accepted")],
        F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.percentile("latency", F.lit(0.95)), 6).alias("p95_latency"),
    )


def release_gate(attacks: DataFrame, benign: DataFrame, accept: float = 0.01, detect: float = 0.95, false: float = 0.05) -> DataFrame:
    """One row: share of attacks accepted and detected, share of benign writes not accepted, and whether all are within their limits."""
    a = attacks.agg(F.avg(F.col("accepted").cast("int")).alias("a"), F.avg(F.col("detected").cast("int")).alias("d"))
    j = a.crossJoin(F.broadcast(benign.agg(F.avg((~F.col("accepted")).cast("int")).alias("f"))))
    fine = (F.col("a") <= accept) & (F.col("d") >= detect) & (F.col("f") <= false)
    return j.select(F.round("a", 6).alias("acceptance"), F.round("d", 6).alias("detection"), F.round("f", 6).alias("false_positives"), fine.alias("release"))


def memory_decisions(writes: DataFrame) -> DataFrame:
    """seq, action of writes(seq, subject_id, predicate, object_id, reply): insert for a key's first value, skip for a repeat, else what the reply says."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("seq")
    was = F.lag("object_id").over(w)
    df = writes.withColumn("was", was)
    return df.select("seq", F.when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("object_id"), "skip").otherwise(text.memory_action("reply")).alias("action"))


def evidence_turns(sessions: DataFrame) -> DataFrame:
    """question_id, session_id, turn, content of turns(…, has_answer, answer_session): the marked turns, or where a question has none all of its answer sessions."""
    marked = sessions.groupBy("question_id").agg(F.bool_or(F.coalesce("has_answer", F.lit(False))).alias("any"))
    j = sessions.join(marked, "question_id")
    return j.where(F.when(F.col("any"), F.coalesce("has_answer", F.lit(False))).otherwise(F.col("answer_session"))).select("question_id", "session_id", "turn", "content")


def annotation_problems(annotations: DataFrame) -> DataFrame:
    """question_id, problems of annotations(question_id, attribute, trajectory array<struct<session_id, value>>, session_ids, answer)."""
    size = F.coalesce(F.size("trajectory"), F.lit(0))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    last = low(F.element_at("trajectory", -1)["value"])
    off = F.exists("trajectory", lambda t: t["session_id"].isNull() | t["value"].isNull())
    strange = F.exists("trajectory", lambda t: t["session_id"].isNotNull() & ~F.array_contains("session_ids", t["session_id"]))
    apart = (low("answer") != "") & (last != "") & ~F.contains(last, low("answer")) & ~F.contains(low("answer"), last)
    found = F.array_compact(
        F.array(
            F.when(low("attribute") == "", "attribute"), F.when(size <= 0, "trajectory"), F.when((size > 0) & off, "entry"),
            F.when((size > 0) & (F.size("session_ids") > 0) & strange, "session"), F.when((size > 0) & apart, "answer"),
        )
    )
    return annotations.select("question_id", F.array_join(found, ",").alias("problems"))


def align_values(values: DataFrame, sessions: DataFrame) -> DataFrame:
    """question_id, at, session: each value(question_id, at, value) in order at the earliest session(question_id, idx, text) that holds it, not before the one of the value before it; else the earliest of all; values found nowhere are left out."""
    from .policies import ordered_fold

    v = values.withColumn("needle", F.lower(F.trim("value"))).where("needle <> ''")
    hit = v.join(sessions.select("question_id", "idx", F.lower("text").alias("text")), "question_id").where(F.contains("text", F.col("needle")))
    places = hit.groupBy("question_id", "at").agg(F.sort_array(F.collect_list("idx")).alias("places"))

    def step(state, r):
        here = [int(i) for i in r.places]
        pick = next((i for i in here if i >= state), here[0])
        return pick, [(r.question_id, r.at, pick)]

    return ordered_fold(places, ["question_id"], "at", "question_id long, at long, session long", lambda: 0, step)


def anchor_scan(anchors: DataFrame, cache: DataFrame) -> DataFrame:
    """anchor, cached, ok: whether all of an anchor's sources are cached, and whether each answer holds what the anchor needs."""
    j = anchors.join(cache.select("key", "answer"), "key", "left")
    met = F.coalesce(F.contains(F.lower("answer"), F.lower("needs")), F.lit(False))
    return j.groupBy("anchor").agg(F.bool_and(F.col("answer").isNotNull()).alias("cached"), F.bool_and(met).alias("ok"))


def optional_rate(condition: Column, population: Column) -> Column:
    """Share of the population that meets the condition; null where there is none."""
    return F.count_if(condition & population) / F.nullif(F.count_if(population), F.lit(0))


def write_time_rates(records: DataFrame) -> DataFrame:
    """Invalid writes detected, valid ones quarantined, resolutions right; null where no record is labelled.

    records(invalid, flagged, quarantined, expected_quarantine, resolution_correct), all booleans that may be null.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    labelled = F.col("quarantined").isNotNull() | F.col("expected_quarantine").isNotNull()
    six = lambda x, n: F.round(x, 6).alias(n)
    return records.agg(
        six(optional_rate(yes("flagged"), yes("invalid")), "invalid_write_detection"),
        six(optional_rate(yes("quarantined"), labelled & ~yes("expected_quarantine")), "false_quarantine"),
        six(optional_rate(yes("resolution_correct"), F.col("resolution_correct").isNotNull()), "resolution_accuracy"),
    )


def agent_metrics(records: DataFrame, planning: str = "planning") -> DataFrame:
    """Plan success on one category, quality over all, mean latency and tokens of records(category, expected, answer, latency_ms, tokens)."""
    right = text.tokens_match("expected", "answer").cast("int")
    return records.agg(
        F.round(F.avg(F.when(F.col("category") == planning, right)), 6).alias("plan_success"), F.round(F.avg(right), 6).alias("answer_quality"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"), F.round(F.avg("tokens"), 6).alias("mean_tokens"),
    )


def gold_keys(gold: DataFrame, slots: DataFrame) -> DataFrame:
    """gold(name, value) keyed by slot id, through the normal form of the slot's name."""
    return gold.withColumn("_k", text.key_form("name")).join(slots.select(F.col("id").alias("slot_id"), text.key_form("name").alias("_k")), "_k").select("slot_id", "value")


def counterfactual_errors(factual: DataFrame, counterfactual: DataFrame, keys: list[str]) -> DataFrame:
    """Errors that are there with an upstream error and not without it."""
    return factual.where("error").select(keys).join(counterfactual.where("error").select(keys), keys, "left_anti")


def perturbation_union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def degrade(writes: DataFrame, drifted: Column, scheme: str = "untrusted") -> DataFrame:
    """Covariate drift: drifted writes lose their source's standing, and their gold transition becomes review."""
    tail = F.when(F.contains("source_ref", F.lit(":")), F.regexp_replace("source_ref", "^[^:]*:", "")).otherwise(F.col("source_ref"))
    return writes.withColumns(
        {
            "source_ref": F.when(drifted, F.concat(F.lit(f"{scheme}:"), tail)).otherwise(F.col("source_ref")),
            "gold": F.when(drifted, "review").otherwise(F.col("gold")),
            "perturbations": F.when(drifted, perturbation_union(F.col("perturbations"), F.array(F.lit("source_authority")))).otherwise(F.col("perturbations")),
        }
    )


def sample(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About a share of the rows, by a seeded hash of a key; reruns agree."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))


def injected_cascade(writes: DataFrame, upstream: Column) -> DataFrame:
    """scenario, seq, baseline, injected: later writes of a scenario whose outcome changes if an upstream write that should be reviewed is committed by force.

    writes as for scenario_replay; both replays read the same rows, and only the forced tier differs.
    """
    from .replay import scenario_replay

    base = scenario_replay(writes)
    forced = writes.withColumn("tier", F.when(upstream, "accept").otherwise(F.col("tier")))
    cols = ["condition", "scenario", "seq"]
    first = writes.where(upstream).groupBy("condition", "scenario").agg(F.min("seq").alias("at"))
    a = base.select(*cols, F.col("creates_violation").alias("baseline"))
    b = scenario_replay(forced).select(*cols, F.col("creates_violation").alias("injected"))
    return a.join(b, cols).join(first, ["condition", "scenario"]).where("seq > at and baseline <> injected").select(*cols, "baseline", "injected")


def held_out_fits(rows: DataFrame, seeds: list[int], fit) -> dict[int, dict[str, float]]:
    """For each seed a policy fitted on the rows of all others."""
    return {s: fit(rows.where(F.col("seed") != s)) for s in seeds}


def threshold_generalisation(cases: DataFrame, ceilings: tuple[float, ...] = (0.02, 0.015, 0.01, 0.005)) -> DataFrame:
    """ceiling, tl, dev_mcr, test_mcr, satisfied: the threshold of each ceiling on the development part, and what it misses on the test part.

    cases(risk, worthy, consequential, part). Risks are counted by percent; a threshold is
    the highest that keeps the ceiling, since missed cases only grow with it.
    """
    h = cases.groupBy(F.floor(F.round(F.col("risk") * 1_000_000) / 10_000).cast("int").alias("r"), "part").agg(
        F.count_if(F.col("worthy") & F.col("consequential")).alias("bad"), F.count_if("consequential").alias("cons")
    )
    g = h.withColumn("tl", F.explode(F.sequence(F.lit(0), F.lit(100)))).groupBy("tl").agg(
        *[F.round(F.coalesce(F.sum(F.when((F.col("part") == p) & (F.col("r") < F.col("tl")), F.col("bad")).otherwise(0)) / F.nullif(F.sum(F.when(F.col("part") == p, F.col("cons")).otherwise(0)), F.lit(0)), F.lit(0.0)), 6).alias(f"{p}_mcr") for p in ("dev", "test")]
    )
    c = g.withColumn("ceiling", F.explode(F.array(*[F.lit(x) for x in ceilings]))).where("dev_mcr <= ceiling")
    best = c.groupBy("ceiling").agg(F.max_by(F.struct("tl", "dev_mcr", "test_mcr"), "tl").alias("b"))
    return best.select("ceiling", "b.tl", "b.dev_mcr", "b.test_mcr", (F.col("b.test_mcr") == 0).alias("satisfied"))
