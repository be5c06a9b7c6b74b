"""Entity resolution: mentions to entities by id, name, alias, then near names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alpha_number, compact, name_tokens, normalize_name


def keyed(entities: DataFrame) -> DataFrame:
    """One row per (id, type, key): the normalised name and each normalised alias, ``own`` marking the name."""
    keys = F.concat(F.array(F.struct(normalize_name("name").alias("key"), F.lit(True).alias("own"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(normalize_name(a).alias("key"), F.lit(False).alias("own"))))
    return entities.select("id", "entity_type", F.inline(keys)).where("key <> ''").groupBy("id", "entity_type", "key").agg(F.bool_or("own").alias("own"))


def near(a: str, b: str):
    """Whether two names may be one: the words of one are all in the other, one's compact form starts with the other's, or letters and number are equal."""
    ta, tb, ca, cb = name_tokens(a), name_tokens(b), compact(a), compact(b)
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    start = (ca != "") & (cb != "") & (F.startswith(ca, cb) | F.startswith(cb, ca))
    return (F.size(ta) > 0) & (F.size(tb) > 0) & (inside(ta, tb) | inside(tb, ta) | start | F.coalesce(alpha_number(a) == alpha_number(b), F.lit(False)))


def near_keys(names: DataFrame, other: DataFrame) -> DataFrame:
    """The rows (entity_type, name) of ``names`` that are near a row of ``other``, both distinct; found by equality joins.

    Word sets of which one holds the other share the smaller one's first word. A compact form that the
    other's starts with is one of its prefixes, so each is looked up whole among the other side's prefixes.
    """
    by = lambda df, c: df.select("entity_type", F.col("name").alias(c), F.sort_array(name_tokens("name")).alias("t"), compact("name").alias("c"), alpha_number("name").alias("key"))
    a, b = by(names, "x"), by(other, "y")
    first, every = F.get("t", F.lit(0)), F.explode("t")
    named = F.size("t") > 0
    found = lambda df: df.select("entity_type", F.col("x").alias("name"))
    out = None
    for l, r, inside in [(first, every, ("t", "u")), (every, first, ("u", "t"))]:
        l, r = a.where(named).select("entity_type", "x", "t", l.alias("k")), b.where(named).select("entity_type", F.col("t").alias("u"), r.alias("k"))
        pairs = found(l.join(r, ["entity_type", "k"]).where(F.size(F.array_except(*inside)) == 0))
        out = pairs if out is None else out.unionByName(pairs)
    # Here equal keys are the whole condition, so only whether one is there counts.
    whole = F.col("c")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("c")), lambda i: F.left(F.col("c"), i)))
    for l, r, kept in [(whole, prefixes, F.col("c") != ""), (prefixes, whole, F.col("c") != ""), (F.col("key"), F.col("key"), F.col("key").isNotNull())]:
        there = b.where(named & kept).select("entity_type", r.alias("k")).distinct()
        out = out.unionByName(found(a.where(named & kept).select("entity_type", "x", l.alias("k")).join(there, ["entity_type", "k"], "left_semi")))
    return out.distinct()


def contextual(mentions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """ref, by_context: the only near entity that an edge, either way, joins to one of the mention's related_ids."""
    r = mentions.select("ref", "entity_type", "name", F.explode("related_ids").alias("related"))
    ends = edges.select(F.col("src").alias("related"), F.col("dst").alias("id")).unionByName(edges.select(F.col("dst").alias("related"), F.col("src").alias("id")))
    e = entities.select("id", "entity_type", F.col("name").alias("other"))
    c = r.join(ends, "related").join(e, ["entity_type", "id"]).where(near("name", "other"))
    return c.groupBy("ref").agg(F.countDistinct("id").alias("n"), F.min("id").alias("by_context")).where("n = 1").drop("n")


def resolve(mentions: DataFrame, entities: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """status and entity_id of mentions(ref, entity_type, name, related_ids where edges(src, dst) are given).

    One entity of that name: resolved_existing; several: uncertain. Else the same by alias.
    Else the only near entity (see ``near``) beside a related id: resolved_existing. Else any
    near entity: possible_match, which gets an id of its own; else created_new.
    """
    m = mentions.withColumn("key", normalize_name("name"))
    k = keyed(entities)
    hit = k.groupBy("entity_type", "key").agg(
        F.count_if("own").alias("n_name"), F.min(F.when(F.col("own"), F.col("id"))).alias("by_name"), F.count("*").alias("n_any"), F.min("id").alias("by_any")
    )
    j = m.join(hit, ["entity_type", "key"], "left")
    open_ = j.where("n_any is null")
    # Nearness rests on the normalised names alone, so each is compared once.
    ours = open_.select("entity_type", F.col("key").alias("name")).distinct()
    found_near = near_keys(ours, entities.select("entity_type", normalize_name("name").alias("name")).distinct())
    j = j.join(found_near.withColumnRenamed("name", "key").withColumn("is_near", F.lit(True)), ["entity_type", "key"], "left")
    if edges is None:
        j = j.withColumn("by_context", F.lit(None).cast(dict(entities.dtypes)["id"]))
    else:
        j = j.join(contextual(open_, entities, edges), "ref", "left")
    status = (
        F.when(F.col("n_name") == 1, "resolved_existing")
        .when(F.col("n_name") > 1, "uncertain")
        .when(F.col("n_any") == 1, "resolved_existing")
        .when(F.col("n_any") > 1, "uncertain")
        .when(F.col("by_context").isNotNull(), "resolved_existing")
        .when(F.col("is_near") & F.col("n_any").isNull(), "possible_match")
        .otherwise("created_new")
    )
    named = F.when(F.col("n_name") == 1, F.col("by_name")).when((F.coalesce("n_name", F.lit(0)) == 0) & (F.col("n_any") == 1), F.col("by_any"))
    return j.select("ref", status.alias("status"), F.coalesce(named, F.when(F.col("n_any").isNull(), F.col("by_context"))).alias("entity_id"))


def endpoints(relations: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with subject_id and object_id, relations with an unresolved end) for relations(ref, subject, object) and resolved(name, id); of a name's ids the smallest."""
    key = resolved.groupBy(normalize_name("name").alias("key")).agg(F.min("id").alias("id"))
    r = relations.withColumn("s", normalize_name("subject")).withColumn("o", normalize_name("object"))
    r = r.join(key.select(F.col("key").alias("s"), F.col("id").alias("subject_id")), "s", "left").join(key.select(F.col("key").alias("o"), F.col("id").alias("object_id")), "o", "left")
    both = F.col("subject_id").isNotNull() & F.col("object_id").isNotNull()
    return r.where(both).drop("s", "o"), r.where(~both).drop("s", "o")
