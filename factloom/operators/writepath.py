"""The write path as tables: normalise, build candidates, persist entities, reconcile statuses, commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as o
from ..functions import text
from .policies import ordered_fold
from .validate import blank


def normalize_entities(rows: DataFrame) -> DataFrame:
    """Entity rows with canonical name, status and priority; null-like strings are null. Nothing is merged."""
    return rows.withColumns(
        {
            "name": text.canonical_name("name"),
            "status": text.status_canon(text.nullish_to_null("status"), F.col("entity_type")),
            "priority": text.priority_canon(text.nullish_to_null("priority")),
        }
    )


def normalize_relations(rows: DataFrame) -> DataFrame:
    """Relation rows with canonical ends, predicate and confidence."""
    return rows.withColumns(
        {
            "subject": text.canonical_name("subject"),
            "predicate": text.predicate_canon("predicate"),
            "object": text.canonical_name("object"),
            "confidence": text.confidence_parse("confidence"),
        }
    )


def build_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, rows without a source): the intent is new_fact where none is given."""
    intent = F.coalesce(text.nullish_to_null("write_intent"), F.lit("new_fact"))
    key = text.stable_id(F.lit("ast"), "subject_id", "predicate", "object_id", "source_ref")
    fine = rows.where(~blank("source_ref")).withColumn("write_intent", intent).withColumn("assertion_id", key)
    return fine, rows.where(blank("source_ref"))


def same_as_links(pairs: DataFrame) -> DataFrame:
    """POSSIBLY_SAME_AS candidates of confidence 0.5, one for each near pair(l_id, r_id) of a new entity; other columns follow."""
    more = [c for c in pairs.columns if c not in ("l_id", "r_id")]
    return pairs.select(F.col("l_id").alias("subject_id"), F.lit("POSSIBLY_SAME_AS").alias("predicate"), F.col("r_id").alias("object_id"), F.lit(0.5).alias("confidence"), *more)


def persist_entities(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to store, latest by seq, with is_new; a new task's done waits for reconciliation and a decision's id is made of its topic."""
    topic = F.concat(F.lit("dec_"), F.left(F.sha1(F.lower(F.trim("name"))), F.lit(12)))
    rows = rows.withColumn("id", F.when(F.col("entity_type") == "Decision", topic).otherwise(F.col("id")))
    names = [c for c in rows.columns]
    last = rows.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*names), "seq").alias("r")).select("r.*")
    known = existing.select("id").distinct().withColumn("_known", F.lit(True))
    out = last.join(known, "id", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
    late = F.col("is_new") & (F.col("entity_type") == "Task") & (F.col("status") == "done")
    return out.withColumn("deferred_status", F.when(late, F.col("status"))).withColumn("status", F.when(~F.coalesce(late, F.lit(False)), F.col("status")))


def reconcile_statuses(writes: DataFrame) -> DataFrame:
    """seq, action, retired: what becomes of stated statuses in order, entity by entity.

    writes(seq, entity_id, entity_type, desired, write_intent, has_completion, has_evidence).
    A repeat of the current status is none; a task's done needs a completion event and a
    decision's final needs evidence. Else the first status is accepted, a task changes by a
    correction or a permitted transition, other entities by an update or a correction.
    ``retired`` is the seq of the status that a supersession replaces.
    """
    permitted = set(o.TRANSITIONS)

    def verdict(state, r):
        has = state is not None
        task = r.entity_type == "Task"
        if task and r.desired == "done" or r.entity_type == "Decision" and r.desired == "final":
            if not (r.has_completion if task else r.has_evidence):
                return "quarantine"
            return "supersede" if has else "accept"
        if not has or state[0] == "unknown":
            return "accept"
        if task:
            return "supersede" if r.write_intent == "correction" or (state[0], r.desired) in permitted else "quarantine"
        return "supersede" if r.write_intent in ("update", "correction") else "quarantine"

    def step(state, r):
        if r.desired == (state[0] if state is not None else "unknown"):
            return state, [(r.seq, "none", None)]
        action = verdict(state, r)
        if action == "quarantine":
            return state, [(r.seq, action, None)]
        return (r.desired, r.seq), [(r.seq, action, state[1] if action == "supersede" else None)]

    cols = ["seq", "entity_id", "entity_type", "desired", "write_intent", "has_completion", "has_evidence"]
    return ordered_fold(writes.select(cols), ["entity_id"], "seq", "seq long, action string, retired long", lambda: None, step)


def commit(decisions: DataFrame) -> DataFrame:
    """seq, status, superseded_by of decisions(seq, action, retired): accepted rows stay until a later one retires them.

    A supersession that names nothing to retire is quarantined.
    """
    status = (
        F.when(F.col("action") == "accept", "accepted")
        .when((F.col("action") == "supersede") & F.col("retired").isNotNull(), "accepted")
        .when(F.col("action") == "reject", "rejected")
        .otherwise("quarantined")
    )
    rows = decisions.where("action <> 'none'").select("seq", status.alias("status"))
    links = decisions.where("action = 'supersede' and retired is not null").groupBy(F.col("retired").alias("seq")).agg(F.min("seq").alias("superseded_by"))
    j = rows.join(links, "seq", "left")
    return j.withColumn("status", F.when((F.col("status") == "accepted") & F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


def supersedes_links(decisions: DataFrame) -> DataFrame:
    """SUPERSEDES edges from the new row to the retired one."""
    return decisions.where("action = 'supersede' and retired is not null").select(F.col("seq").alias("subject_id"), F.lit("SUPERSEDES").alias("predicate"), F.col("retired").alias("object_id"))


def manual_write(entities: DataFrame, subject_id: str, predicate: str, object_id: str, source_ref: str, confidence: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(the two entities named, one accepted assertion between them); no row if an end is missing or the predicate unknown."""
    ends = entities.where(F.col("id").isin(subject_id, object_id))
    both = ends.agg((F.countDistinct("id") == len({subject_id, object_id})).alias("both"))
    row = both.where(F.col("both") & F.lit(predicate in o.PREDICATES)).select(
        text.stable_id(F.lit("ast"), F.lit(subject_id), F.lit(predicate), F.lit(object_id), F.lit(source_ref)).alias("assertion_id"),
        F.lit(subject_id).alias("subject_id"), F.lit(predicate).alias("predicate"), F.lit(object_id).alias("object_id"),
        F.lit(float(confidence)).alias("confidence"), F.lit(source_ref).alias("source_ref"), F.lit("accepted").alias("status"),
    )
    return ends, row


def strict_errors(rows: DataFrame) -> DataFrame:
    """fault of each extraction attempt(status_code, body): environment, model or none."""
    parsed = F.get_json_object("body", "$")
    return rows.withColumn("fault", F.when(F.col("status_code").isNull() | (F.col("status_code") >= 500) | F.col("status_code").isin(408, 429), "environment").when(parsed.isNull(), "model").otherwise("none"))


def memoised(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers known by the SHA-256 of prompt and model, requests to make)."""
    key = F.sha2(F.concat_ws("\x1f", "model", "prompt"), 256)
    r = requests.withColumn("key", key)
    return r.join(cache.select("key", "answer"), "key"), r.join(cache.select("key"), "key", "left_anti")


def oracle_extract(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts given for a source_ref; a text without any stays with null."""
    return texts.join(facts, "source_ref", "left")


def canonical_sections(facts: DataFrame) -> DataFrame:
    """Facts of each source in one order, whatever order they were found in; a source's facts come from one text."""
    one = F.struct("predicate", "subject", "object")
    return facts.groupBy("source_ref").agg(F.sort_array(F.collect_list(one)).alias("facts"))
