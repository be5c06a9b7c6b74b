"""The ten write constraints in their order over candidates, entities and accepted edges, all as joins.

Candidates have subject_id, predicate, object_id, confidence (text or number), source_ref,
write_intent and, where the write names its subject's type, claimed_type. Entities have id,
entity_type, status, starts_at, ends_at; accepted edges seq, subject_id, predicate,
object_id, pct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ontology as o
from . import graph
from .validate import blank, first_failure

#: Checks whose failure rejects a write; the others quarantine, and C7 says itself.
REJECTS = ("C1", "C2", "C3", "C6", "C9")


def evidence_units(candidates: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with n_evidence: one for a source, one for each accepted EVIDENCE_FOR of a document or event into the subject."""
    return _counted(candidates, "subject_id", support(edges, entities), "n_support").withColumn("n_evidence", (~blank("source_ref")).cast("long") + F.col("n_support"))


def support(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """object_id, n: accepted EVIDENCE_FOR edges of documents and events."""
    by = entities.where("entity_type in ('Document', 'Event')").select(F.col("id").alias("subject_id"))
    return edges.where("predicate = 'EVIDENCE_FOR'").join(by, "subject_id", "left_semi").groupBy("object_id").agg(F.count("*").alias("n"))


def counts(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """id, n_done, n_support: accepted RESULTS_IN edges into each node, and EVIDENCE_FOR edges of documents and events."""
    one, none = F.lit(1), F.lit(0)
    done = edges.where("predicate = 'RESULTS_IN'").select(F.col("object_id").alias("id"), one.alias("n_done"), none.alias("n_support"))
    backed = support(edges, entities).select(F.col("object_id").alias("id"), none.alias("n_done"), F.col("n").alias("n_support"))
    return done.unionByName(backed).groupBy("id").agg(F.sum("n_done").alias("n_done"), F.sum("n_support").alias("n_support"))


def _counted(df: DataFrame, key: str, counts: DataFrame, to: str) -> DataFrame:
    c = counts.select(F.col("object_id").alias(key), F.col("n").alias(to))
    return df.join(c, key, "left").withColumn(to, F.coalesce(to, F.lit(0)))


def neighbourhood(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """seq, n_edges, top_pct: how many accepted edges touch an end of a candidate, and the highest confidence among them.

    Edges are counted by node and by pair of nodes first, so that a node which all share costs one row;
    what touches both ends is counted once.
    """
    ends = F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("node")
    node = edges.select("pct", ends).groupBy("node").agg(F.count("*").alias("n"), F.max("pct").alias("top"))
    pair = edges.where("subject_id <> object_id").groupBy(F.least("subject_id", "object_id").alias("lo"), F.greatest("subject_id", "object_id").alias("hi")).agg(F.count("*").alias("both"))
    df = candidates.select("seq", "subject_id", "object_id", F.least("subject_id", "object_id").alias("lo"), F.greatest("subject_id", "object_id").alias("hi"))
    for end, p in (("subject_id", "s"), ("object_id", "o")):
        df = df.join(node.select(F.col("node").alias(end), F.col("n").alias(f"{p}_n"), F.col("top").alias(f"{p}_top")), end, "left")
    df = df.join(pair, ["lo", "hi"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    other = F.when(F.col("subject_id") == F.col("object_id"), 0).otherwise(zero("o_n") - zero("both"))
    return df.select("seq", (zero("s_n") + other).alias("n_edges"), F.greatest("s_top", "o_top").alias("top_pct"))


def neighbourhood_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """part, seq, node, n_edges, pct: which accepted edges touch each candidate, listed once a node.

    ``candidate`` rows give each candidate its nodes, the number of its edges and the highest confidence;
    ``edge`` rows give each of these nodes its edges and their confidence. The edges of a candidate are those of its nodes.
    """
    ends = lambda df, *c: df.select("seq", *c, F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("node"))
    mine = ends(candidates).join(neighbourhood(candidates, edges).withColumnRenamed("top_pct", "pct"), "seq")
    listed = ends(edges, "pct").join(ends(candidates).select("node").distinct(), "node", "left_semi").withColumn("n_edges", F.lit(None).cast("long"))
    cols = ["part", "seq", "node", "n_edges", "pct"]
    return mine.withColumn("part", F.lit("candidate")).select(cols).unionByName(listed.withColumn("part", F.lit("edge")).select(cols))


def incumbents(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """seq, n_incumbents, top_pct, incumbent (the earliest): other accepted values of a candidate's single-valued key."""
    held = edges.where(F.col("predicate").isin(*o.SINGLE_VALUED)).groupBy("subject_id", "predicate", F.col("object_id").alias("held")).agg(F.max("pct").alias("pct"), F.min("seq").alias("edge"))
    hit = candidates.select("seq", "subject_id", "predicate", "object_id").join(held, ["subject_id", "predicate"]).where("held <> object_id")
    return hit.groupBy("seq").agg(F.count("*").alias("n_incumbents"), F.max("pct").alias("top_pct"), F.min("edge").alias("incumbent"))


def _at_either(kind: str, status: str, count: str) -> Column:
    one = lambda p: (F.col(f"{p}entity_type") == kind) & (F.col(f"{p}status") == status) & (F.col(f"{p}{count}") == 0)
    return F.coalesce(one("s_"), F.lit(False)) | F.coalesce(one("o_"), F.lit(False))


def examine_alone(candidates: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with everything the checks look at that no other candidate can change."""
    # Both ends meet the same columns of the same two tables, one after the other, so each table is dealt out once.
    known = entities.select("id", "entity_type", "status", (F.col("ends_at") < F.col("starts_at")).alias("back"))
    n = counts(edges, entities)
    df = candidates
    for end, p in (("subject_id", "s_"), ("object_id", "o_")):
        df = df.join(known.select(F.col("id").alias(end), *[F.col(c).alias(p + c) for c in ("entity_type", "status", "back")]), end, "left")
        df = df.join(n.select(F.col("id").alias(end), *[F.col(c).alias(p + c) for c in ("n_done", "n_support")]), end, "left")
        df = df.withColumns({p + c: F.coalesce(p + c, F.lit(0)) for c in ("n_done", "n_support")})
    df = df.withColumn("n_evidence", (~blank("source_ref")).cast("long") + F.col("s_n_support"))
    r = F.broadcast(o.relations(candidates.sparkSession).select("predicate", "source_types", "target_types"))
    df = df.join(r, "predicate", "left").withColumn("value", F.col("confidence").try_cast("double")).withColumn("pct", F.round(100 * F.col("value")))
    fits = F.array_contains("source_types", F.col("s_entity_type")) & F.array_contains("target_types", F.col("o_entity_type"))
    df = df.withColumn("in_range", F.coalesce(fits, F.lit(False)))
    t = F.broadcast(o.transitions(candidates.sparkSession).select(F.col("old").alias("s_status"), F.concat(F.lit("status:"), "new").alias("object_id"), F.lit(True).alias("allowed")))
    return df.join(t, ["s_status", "object_id"], "left")


def examine(candidates: DataFrame, entities: DataFrame, edges: DataFrame, margin_pct: int = 10, evidence_min: int = 1, high_pct: int = 80) -> DataFrame:
    """Candidates with everything the checks look at, each against the accepted edges as they are before all candidates."""
    order = candidates.where("predicate = 'PRECEDES'").select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).distinct()
    closing = graph.would_close_cycle(order, graph.predicate_subgraph(edges, "PRECEDES"))
    closing = candidates.where("predicate = 'PRECEDES'").select("seq", F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).join(closing, ["src", "dst"], "left_semi").select("seq", F.lit(True).alias("closes"))
    # An order of events is no single-valued key: a candidate has a row of one of the two at most.
    met = incumbents(candidates, edges).unionByName(closing, allowMissingColumns=True)
    df = examine_alone(candidates, entities, edges).join(met, "seq", "left")
    blocked = (F.col("pct") > high_pct) & (F.col("top_pct") > high_pct)
    dominates = (F.col("write_intent") == "correction") & (F.col("pct") - F.col("top_pct") > margin_pct) & (F.col("n_evidence") >= evidence_min)
    return df.withColumn("blocked", F.coalesce(blocked, F.lit(False))).withColumn("dominates", F.coalesce(dominates, F.lit(False)))


def checks() -> list[tuple[str, Column]]:
    """The ten constraints in order: name and when a row of ``examine`` breaks it."""
    status = (F.col("predicate") == "HAS_STATUS") & (F.col("s_entity_type") == "Task")
    same = F.concat(F.lit("status:"), "s_status") == F.col("object_id")
    return [
        ("C1", F.col("claimed_type") != F.col("s_entity_type")),
        ("C2", F.coalesce("s_back", F.lit(False)) | F.coalesce("o_back", F.lit(False))),
        ("C3", F.col("closes")),
        ("C4", _at_either("Task", "done", "n_done")),
        ("C5", (F.col("predicate") == "ASSIGNED_TO") & (F.col("o_entity_type") == "Person") & (F.col("o_status") == "inactive")),
        ("C6", F.col("value").isNull() | ~F.col("value").between(0, 1)),
        ("C7", F.col("blocked")),
        ("C8", _at_either("Decision", "final", "n_support")),
        ("C9", ~F.col("in_range")),
        ("C10", status & (F.col("write_intent") != "correction") & ~F.coalesce(same, F.lit(False)) & F.col("allowed").isNull()),
    ]


def constraint_validate(candidates: DataFrame, entities: DataFrame, edges: DataFrame, **limits) -> DataFrame:
    """seq, failed_check (null if none), action: accept, supersede, quarantine or reject."""
    df = examine(candidates, entities, edges, **limits).withColumn("failed_check", first_failure(checks()))
    f = F.col("failed_check")
    action = F.when(f.isNull(), "accept").when(f.isin(*REJECTS), "reject").when((f == "C7") & F.col("dominates"), "supersede").otherwise("quarantine")
    return df.select("seq", "failed_check", action.alias("action"))


def validate_only(candidates: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """seq, stage, failed_check: the first of structure (W5), constraints (W6) and contradiction (W7) that fails; nothing is written."""
    df = examine(candidates, entities, edges)
    structure = [
        ("required_fields", blank("subject_id") | blank("predicate") | blank("object_id") | blank("source_ref") | F.col("confidence").isNull()),
        ("predicate", ~F.col("predicate").isin(*o.PREDICATES)),
        ("confidence", F.col("value").isNull() | ~F.col("value").between(0, 1)),
        ("endpoints", F.col("s_entity_type").isNull() | F.col("o_entity_type").isNull()),
    ]
    w5, w6 = first_failure(structure), first_failure(checks())
    w7 = F.when(F.col("n_incumbents") > 0, "single_valued_conflict")
    stage = F.when(w5.isNotNull(), "W5").when(w6.isNotNull(), "W6").when(w7.isNotNull(), "W7").otherwise("ok")
    return df.select("seq", stage.alias("stage"), F.coalesce(w5, w6, w7).alias("failed_check"))


def typed_violations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """seq, kind: the first of schema_invalid, temporally_invalid_interval, unsupported_final_decision, illegal_status_state that an accepted row is, else none."""
    status = F.when(F.col("predicate") == "HAS_STATUS", F.regexp_replace("object_id", "^status:", ""))
    rows = edges.withColumn("value", status)
    # A status is reached from a final one if the task also holds another status that allows no change.
    ends = [s for s in {b for _, b in o.TRANSITIONS} if s not in {a for a, _ in o.TRANSITIONS}]
    tasks = entities.where("entity_type = 'Task'").select(F.col("id").alias("subject_id"))
    final = rows.where(F.col("value").isin(*ends)).join(tasks, "subject_id", "left_semi").groupBy("subject_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # The object first, so that what is known of a subject meets rows that are dealt out by it once.
    known = entities.select("id", "entity_type", F.coalesce(F.col("ends_at") < F.col("starts_at"), F.lit(False)).alias("back"))
    df = rows.select("seq", "subject_id", "predicate", "object_id", "value")
    for end, p in (("object_id", "o_"), ("subject_id", "s_")):
        df = df.join(known.select(F.col("id").alias(end), *[F.col(c).alias(p + c) for c in ("entity_type", "back")]), end, "left")
        df = df.drop("object_id") if p == "o_" else df
    df = _counted(df, "subject_id", support(edges, entities), "n_support")
    df = _counted(df, "subject_id", edges.where("predicate = 'RESULTS_IN'").groupBy("object_id").agg(F.count("*").alias("n")), "n_done")
    df = df.join(final, "subject_id", "left")
    r = F.broadcast(o.relations(edges.sparkSession).select("predicate", "source_types", "target_types"))
    df = df.join(r, "predicate", "left")
    off = lambda t, c: F.coalesce(~F.array_contains(t, F.col(c)), F.lit(False))
    task = F.col("s_entity_type") == "Task"
    other_end = F.col("lo").isNotNull() & ((F.col("lo") != F.col("value")) | (F.col("hi") != F.col("value")))
    kind = (
        F.when(off("source_types", "s_entity_type") | off("target_types", "o_entity_type"), "schema_invalid")
        .when(F.coalesce("s_back", F.lit(False)) | F.coalesce("o_back", F.lit(False)), "temporally_invalid_interval")
        .when((F.col("s_entity_type") == "Decision") & (F.col("value") == "final") & (F.col("n_support") == 0), "unsupported_final_decision")
        .when(task & F.col("value").isNotNull() & (((F.col("value") == "done") & (F.col("n_done") == 0)) | other_end), "illegal_status_state")
        .otherwise("none")
    )
    return df.select("seq", kind.alias("kind"))


def terminal_history(edges: DataFrame) -> DataFrame:
    """subject_id, statuses: the different accepted statuses of each subject, sorted. A status is one of a closed list, so the set is small."""
    s = edges.where("predicate = 'HAS_STATUS'").select("subject_id", F.regexp_replace("object_id", "^status:", "").alias("status")).distinct()
    return s.groupBy("subject_id").agg(F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))
