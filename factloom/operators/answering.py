"""Questions to packaged answers: classify, resolve names, look up, merge, rank, package, render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..ontology import SINGLE_VALUED
from .policies import fold_width
from .retrieve import rerank

#: A best result below this confidence is called weak.
LOW_CONFIDENCE = 0.5


def classify(questions: DataFrame) -> DataFrame:
    """questions(query_id, text) with query_type, names, hints and whether meaning must be searched too; what is classified stays as it is."""
    if {"query_type", "names", "hints", "needs_semantic"} <= set(questions.columns):
        return questions
    df = questions.withColumns({"query_type": text.query_type("text"), "names": text.mentions("text"), "hints": text.predicate_hints("text")})
    plain = F.col("query_type").isin("direct_fact", "temporal") & (F.size("names") > 0) & (F.size("hints") > 0)
    return df.withColumn("needs_semantic", ~F.coalesce(plain, F.lit(False)))


def resolve_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (query_id, id): entities whose id or name is a form of a name, by an equality join on forms."""
    asked = names.select("query_id", F.explode(text.label_variants("name")).alias("label")).where("label <> ''")
    label = F.explode(F.array_distinct(F.array(text.key_form("id"), text.key_form(F.coalesce("name", F.lit(""))))))
    n = fold_width(names.sparkSession)
    return asked.repartition(n, "label").join(entities.select("id", label.alias("label")).repartition(n, "label"), "label").select("query_id", "id").distinct()


def symbolic_hits(resolved: DataFrame, questions: DataFrame, edges: DataFrame) -> DataFrame:
    """Accepted edges at a resolved entity, of the hinted predicates if any, each once, placed by predicate, subject, object and seq."""
    ends = edges.select("*", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("id"))
    # The ends pass by a table of what is asked for: a node that a sixth of all edges share is neither sorted nor held.
    n = fold_width(edges.sparkSession)
    hit = resolved.repartition(n, "id").hint("shuffle_hash").join(ends.repartition(n, "id"), "id")
    hit = hit.repartition(n, "query_id").join(questions.select("query_id", "hints").repartition(n, "query_id"), "query_id")
    hit = hit.where((F.size("hints") == 0) | F.array_contains("hints", F.col("predicate"))).select("query_id", "seq", "subject_id", "predicate", "object_id", "pct").dropDuplicates(["query_id", "seq"])
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("predicate", "subject_id", "object_id", "seq")))


def conflict_relevant(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Hits(query_id, memory_id, text) that hold one of their query's names; all of a query without names."""
    n = names.select("query_id", text.key_form("name").alias("name")).where("name <> ''").groupBy("query_id").agg(F.collect_set("name").alias("_names"))
    kept = F.col("_names").isNull() | (F.coalesce("text", F.lit("")) == "") | F.exists("_names", lambda x: F.contains(F.lower("text"), x))
    return hits.join(n, "query_id", "left").where(kept).drop("_names")


def containing(names: DataFrame, summaries: DataFrame) -> DataFrame:
    """(query_id, id) where a summary(id, summary) holds a name(query_id, name); found by an equality join on the name's first three letters."""
    n = names.select("query_id", text.key_form("name").alias("name")).where("name <> ''").distinct().withColumn("gram", F.left("name", F.lit(3)))
    s = summaries.select("id", text.key_form("summary").alias("summary"))
    at = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length("summary"), F.lit(1))), lambda i: F.substring(F.col("summary"), i, F.lit(w)))
    s = s.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(at(1), at(2), at(3))))))
    # The grams that are asked for are of three letters at most, so they are few whatever is asked.
    met = s.join(F.broadcast(n.select("gram").distinct()), "gram", "left_semi")
    # Merged, as the planner would take the exploded side for small by its file and send it through the driver.
    return n.join(met.hint("merge"), "gram").where(F.contains("summary", F.col("name"))).select("query_id", "id").distinct()


def decision_answers(names: DataFrame, decisions: DataFrame) -> DataFrame:
    """query_id, answer: the first decision(id, summary, status) by id that names one of a query's entities."""
    first = containing(names, decisions).groupBy("query_id").agg(F.min("id").alias("id")).join(decisions, "id")
    shown = F.concat(F.lit("Decision: "), F.col("summary"), F.when(F.col("status").isNotNull(), F.concat(F.lit(" ("), "status", F.lit(")"))).otherwise(""))
    return first.select("query_id", shown.alias("answer"))


def paired_statuses(accepted: DataFrame, held: DataFrame) -> DataFrame:
    """subject_id, statement: an entity's accepted status beside a status of it that is held back."""
    a = accepted.select("subject_id", F.col("object_id").alias("_a"))
    h = held.select("subject_id", F.col("object_id").alias("_h"))
    value = lambda c: F.regexp_replace(c, "^status:", "")
    return a.join(h, "subject_id").where("_a <> _h").select("subject_id", F.concat(value("_a"), F.lit(" (accepted) | "), value("_h"), F.lit(" (quarantined)")).alias("statement")).distinct()


def derive_answers(questions: DataFrame, resolved: DataFrame, hits: DataFrame, entities: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """query_id, answer: a status for questions of a status, else an owner or assignee, the events before, a decision, or again a status.

    ``hits`` are supporting edges that name their query's entities; ``place`` is their order.
    """
    label = entities.select("id", F.coalesce("name", "id").alias("label"), "entity_type", "status")
    bearing = label.where("entity_type in ('Task', 'Project', 'Person', 'Organization') and status is not null and status <> 'unknown'")
    status = resolved.join(bearing, "id").groupBy("query_id").agg(F.min_by(F.concat_ws(": ", "label", "status"), "id").alias("status_answer"))
    owner = hits.where("predicate = 'OWNS'").select("query_id", "place", F.col("subject_id").alias("id"))
    owner = owner.unionByName(hits.where("predicate = 'ASSIGNED_TO'").select("query_id", "place", F.col("object_id").alias("id")))
    owner = owner.join(label, "id").groupBy("query_id").agg(F.min_by("label", "place").alias("owner_answer"))
    before = hits.where("predicate = 'PRECEDES'").join(resolved.select("query_id", F.col("id").alias("object_id")), ["query_id", "object_id"], "left_semi")
    before = before.select("query_id", "place", F.col("subject_id").alias("id")).join(label, "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "label"))).alias("b"))
    before = before.select("query_id", F.concat(F.lit("Preceding events: "), F.array_join(F.array_distinct(F.transform("b", lambda x: x["label"])), ", ")).alias("before_answer"))
    df = questions.join(status, "query_id", "left").join(owner, "query_id", "left").join(before, "query_id", "left")
    if decisions is None:
        df = df.withColumn("decision_answer", F.lit(None).cast("string"))
    else:
        names = questions.select("query_id", F.explode("names").alias("name"))
        df = df.join(decision_answers(names, decisions).withColumnRenamed("answer", "decision_answer"), "query_id", "left")
    low = F.lower("text")
    asked = low.contains("status") | low.contains("state of")
    late = F.when(F.col("query_type").isin("planning", "temporal", "direct_fact"), F.col("status_answer"))
    return df.select("query_id", F.coalesce(F.when(asked, F.col("status_answer")), "owner_answer", "before_answer", "decision_answer", late).alias("answer"))


def missing_notes() -> Column:
    """Gaps of a packaged answer with n_hits, n_supporting, n_sources and confidence."""
    weak = F.col("confidence") < LOW_CONFIDENCE
    # The sentences.
    return F.array_compact(
        F.array(
            F.when(F.col("n_hits") == 0, F.lit("No memory items matched the query.")),
            F.when((F.col("n_hits") > 0) & (F.col("n_supporting") == 0), F.lit("No accepted supporting assertions were found; only unresolved or quarantined items matched the query.")),
            F.when((F.col("n_supporting") > 0) & weak, F.concat(F.lit("Best-supported result has low confidence ("), F.format_number("confidence", 2), F.lit(")."))),
            F.when((F.col("n_supporting") > 0) & (F.col("n_sources") == 0), F.lit("No provenance records were found for the supporting assertions.")),
        )
    )


#: Days after which an item counts as old.
RECENCY_DAYS = 30.0


def merged(sym: DataFrame, semantic: DataFrame, edges: DataFrame, contradicted: DataFrame, now: Column) -> DataFrame:
    """One row a query and item with the six signals, score and position.

    An item that was looked up is exact: its similarity and relevance are 1. One found by meaning alone
    has its similarity and nothing else. ``contradicted`` (memory_id) and quarantined items are penalised.
    ``edges`` may have extractor_version and created_at.
    """
    extra = [c for c in ("extractor_version", "created_at") if c in edges.columns]
    fact = sym.join(edges.select("seq", "source_ref", *extra), "seq").select("query_id", F.concat(F.lit("a"), "seq").alias("memory_id"), "subject_id", "predicate", "object_id", (F.col("pct") / 100).alias("confidence"), "source_ref", *extra)
    found = semantic.select("query_id", "memory_id", "similarity", "memory_type", "status", "text")
    df = fact.withColumn("exact", F.lit(True)).join(found, ["query_id", "memory_id"], "full_outer")
    bad = contradicted.select("memory_id").distinct().withColumn("_bad", F.lit(True))
    exact = F.coalesce("exact", F.lit(False))
    known = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("double") if c in df.columns else F.lit(0.0)
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 86_400e6 if "created_at" in extra else F.lit(None).cast("double")
    df = df.join(bad, "memory_id", "left").withColumns(
        {
            "exact": exact,
            "status": F.coalesce("status", F.lit("accepted")),
            "memory_type": F.coalesce("memory_type", F.lit("assertion")),
            "semantic_similarity": F.when(exact, 1.0).otherwise(F.least(F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))),
            "graph_relevance": exact.cast("double"),
            "provenance_quality": 0.34 * known("source_ref") + 0.33 * known("extractor_version"),
            "recency": F.coalesce(F.least(F.greatest(1 - age / RECENCY_DAYS, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)),
        }
    )
    penalty = (F.coalesce("_bad", F.lit(False)) | (F.col("status") == "quarantined")).cast("double")
    return rerank(df.withColumn("contradiction_penalty", penalty).drop("_bad"))


def contradicted_by(held: DataFrame, edges: DataFrame) -> DataFrame:
    """held_seq, memory_id: accepted other values of a held write's single-valued key."""
    h = held.where(F.col("predicate").isin(*SINGLE_VALUED)).select(F.col("seq").alias("held_seq"), "subject_id", "predicate", F.col("object_id").alias("_o"))
    e = edges.select("subject_id", "predicate", "object_id", F.concat(F.lit("a"), "seq").alias("memory_id"))
    return h.join(e, ["subject_id", "predicate"]).where("_o <> object_id").select("held_seq", "memory_id")


def answer(questions: DataFrame, entities: DataFrame, edges: DataFrame, held: DataFrame, semantic: DataFrame, decisions: DataFrame | None = None, most: int = 3, now: Column | None = None) -> DataFrame:
    """One row a question: type, answer, confidence, supporting ids and sources, conflicts, notes and the rendered text.

    ``edges`` are accepted rows (seq, subject_id, predicate, object_id, pct, source_ref), ``held``
    quarantined ones; ``semantic`` hits (query_id, memory_id, similarity, memory_type, status, text)
    count where the question needs them. Items that a held write contradicts, and quarantined ones,
    support nothing and are conflicts; so is each held write about a retrieved item or an asked entity.
    """
    q = classify(questions)
    names = q.select("query_id", F.explode("names").alias("name"))
    resolved = resolve_names(names, entities)
    sym = symbolic_hits(resolved, q, edges)
    near = conflict_relevant(semantic.where("status = 'quarantined'"), names).unionByName(semantic.where("status <> 'quarantined'"))
    near = near.join(q.where("needs_semantic").select("query_id"), "query_id", "left_semi")
    against = contradicted_by(held, edges)
    ranked = merged(sym, near, edges, against, F.current_timestamp() if now is None else now).checkpoint()

    good = ranked.where("status = 'accepted' and contradiction_penalty = 0")
    line = F.when(F.col("exact"), F.concat_ws(" ", "subject_id", "predicate", "object_id")).otherwise(F.coalesce("text", F.lit("")))
    sure = F.coalesce("confidence", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    source = edges.select(F.concat(F.lit("a"), "seq").alias("memory_id"), F.when(F.trim(F.coalesce("source_ref", F.lit(""))) != "", F.col("source_ref")).alias("_source"))
    good = good.withColumn("place", place).withColumn("sure", sure).withColumn("line", line).join(source, "memory_id", "left")
    one = F.struct("place", "line", F.col("sure").alias("confidence"), F.col("_source").alias("source_ref"), "memory_id")
    top = good.groupBy("query_id").agg(
        F.count("*").alias("n_supporting"), F.max(F.when(F.col("place") == 1, F.col("sure"))).alias("confidence"), F.count("_source").alias("n_sources"), F.sort_array(F.collect_list(F.when(F.col("place") <= most, one))).alias("top")
    )
    about = ranked.select("query_id", F.col("memory_id").alias("id")).unionByName(ranked.where("exact").select("query_id", F.explode(F.array("subject_id", "object_id")).alias("id"))).unionByName(resolved.select("query_id", "id")).distinct()
    names_of = against.select("held_seq", F.col("memory_id").alias("id")).unionByName(held.select(F.col("seq").alias("held_seq"), F.col("subject_id").alias("id")))
    claim = held.select(F.concat(F.lit("h"), "seq").alias("name"), F.concat_ws(" ", "subject_id", "predicate", "object_id").alias("claim"))
    records = about.join(names_of, "id").select("query_id", F.concat(F.lit("h"), "held_seq").alias("name")).distinct().join(claim, "name")
    penalised = ranked.where("contradiction_penalty > 0").select("query_id", F.col("memory_id").alias("name"), line.alias("claim"))
    conflict = records.select("query_id", "name", "claim").unionByName(penalised).groupBy("query_id").agg(F.count("*").alias("n_conflicts"), F.min_by("claim", "name").alias("first_claim"))
    any_hit = ranked.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    facts = good.where("exact").select("query_id", "place", "subject_id", "predicate", "object_id")
    df = q.join(derive_answers(q, resolved, facts, entities, decisions), "query_id", "left")
    for part in (top, conflict, any_hit):
        df = df.join(part, "query_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_supporting", "n_sources", "n_conflicts", "n_hits")}
    df = df.withColumns(zero | {"confidence": F.coalesce("confidence", F.lit(0.0))}).withColumn("notes", missing_notes())
    return df.withColumn("rendered", render())


def render(high_stakes: bool = False) -> Column:
    """The answer first with its confidence, then each conflict by itself, provenance if asked for, and what is missing."""
    shown = F.format_number("confidence", 2)
    lines = F.transform(F.coalesce("top", F.array().cast("array<struct<place:int,line:string,confidence:double,source_ref:string,memory_id:string>>")), lambda t: F.concat(F.lit("- "), t["line"], F.lit(" (confidence "), F.format_number(t["confidence"], 2), F.lit(")")))
    head = (
        F.when(F.col("answer").isNotNull(), F.concat(F.lit("Answer: "), "answer", F.when(F.col("n_supporting") > 0, F.concat(F.lit(" (confidence "), shown, F.lit(")"))).otherwise("")))
        .when(F.col("n_supporting") > 0, F.concat(F.lit("Answer (confidence "), shown, F.lit("):\n"), F.array_join(lines, "\n")))
        .otherwise("Answer: No accepted assertions support this query.")
    )
    conflicts = F.when(F.col("n_conflicts") > 0, F.concat(F.lit("Conflicts detected: "), F.col("n_conflicts").cast("string"), F.lit(", first "), "first_claim"))
    sources = F.array_distinct(F.filter(F.transform("top", lambda t: t["source_ref"]), lambda s: F.trim(s) != ""))
    proof = F.when(F.lit(high_stakes), F.when(F.size(sources) > 0, F.concat(F.lit("Provenance:\n- "), F.array_join(sources, "\n- "))).otherwise("Provenance: none recorded for the supporting assertions."))
    missing = F.when(F.size("notes") > 0, F.concat(F.lit("Missing evidence:\n- "), F.array_join("notes", "\n- ")))
    return F.concat_ws("\n\n", head, conflicts, proof, missing)


def explanation(depth: str) -> Column:
    """What a reviewer is shown of an escalated write at a depth; each depth holds the one before."""
    minimal = [F.col("subject_id").alias("subject"), F.col("predicate"), F.col("object_id").alias("object"), F.col("tier")]
    evidence = [*minimal, F.col("source_ref"), F.col("pct"), F.col("n_incumbents")]
    full = [*evidence, F.col("risk"), F.col("consequence"), F.col("reversibility"), F.col("authority")]
    return F.to_json(F.struct(*{"minimal": minimal, "evidence": evidence, "full": full}[depth]))


def top_ids(ranked: DataFrame, k: int) -> DataFrame:
    """query_id, ids: the first k memory ids of a ranking, as they are logged."""
    first = ranked.where(F.col("position") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "memory_id"))).alias("s"))
    return first.select("query_id", F.array_join(F.transform("s", lambda x: x["memory_id"]).cast("array<string>"), ",").alias("ids"))


def agent_turns(messages: DataFrame, entities: DataFrame, edges: DataFrame, held: DataFrame, semantic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers to all messages(query_id, text), candidates extracted from those that are statements)."""
    from .extract import extract

    told = messages.where(~text.is_question("text")).select(F.col("query_id").cast("string").alias("source_ref"), "text")
    return answer(messages, entities, edges, held, semantic), extract(told)
