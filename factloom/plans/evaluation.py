"""Evaluation, extraction, resolution and replay queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text, udfs
from ..operators import extract, metrics, policies, replay, resolve, routing, stats
from ..sources.events import LOG_SQL, assertion_log
from .analytics import _ARMS, _records, _routed, gold

PLANS: dict = {}


def plan(name: str, sql: str | None = None, log: bool = True):
    def keep(f):
        PLANS[name] = (f, LOG_SQL + sql if sql and log else sql)
        return f

    return keep


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@plan("scan_entities", """ SELECT DISTINCT subject_id AS id, 'Person' AS entity_type FROM alog UNION SELECT DISTINCT object_id, 'SlotValue' FROM alog""")
def scan_entities(spark, d):
    log = assertion_log(spark, d)
    a = log.select(F.col("subject_id").alias("id"), F.lit("Person").alias("entity_type"))
    return a.unionByName(log.select(F.col("object_id").alias("id"), F.lit("SlotValue").alias("entity_type"))).distinct()


@plan("scan_assertions", " SELECT seq, subject_id, predicate, object_id, pct FROM alog WHERE predicate = 'OWNS'")
def scan_assertions(spark, d):
    return assertion_log(spark, d).where("predicate = 'OWNS'").select("seq", "subject_id", "predicate", "object_id", "pct")


@plan("w1_rule_extractor", """, t AS (SELECT *, k % 3 AS r FROM alog WHERE k % 4 < 3)
SELECT seq, CASE r WHEN 0 THEN 'OWNS' WHEN 1 THEN 'ASSIGNED_TO' ELSE 'PRECEDES' END AS predicate, CASE r WHEN 0 THEN 'Ann' || k WHEN 1 THEN 'Task ' || k ELSE 'Event' || k END AS subject,
 CASE r WHEN 0 THEN 'Orion' || k WHEN 1 THEN 'Bob Ray' ELSE 'Launch' END AS object, CASE WHEN k % 5 = 0 THEN 97 ELSE 85 END AS confidence_pct FROM t""")
def w1_rule_extractor(spark, d):
    k = F.col("k")
    line = (
        F.when(k % 4 == 3, "nothing to see here")
        .when(k % 3 == 0, F.concat(F.lit("Ann"), k, F.lit(" owns Orion"), k))
        .when(k % 3 == 1, F.concat(F.lit("Task "), k, F.lit(" is assigned to Bob Ray")))
        .otherwise(F.concat(F.lit("Event"), k, F.lit(" precedes Launch")))
    )
    body = F.concat(line, F.when(k % 5 == 0, " in fact").otherwise(""), F.lit(".\nthe end!"))
    t = assertion_log(spark, d).select(F.col("seq").cast("string").alias("source_ref"), body.alias("text"))
    return extract.extract(t).select(F.col("source_ref").cast("long").alias("seq"), "predicate", "subject", "object", "confidence_pct")


_ENT = """ WITH e AS (SELECT c_custkey AS id, 'T' || (c_nationkey % 3) AS ty, lower(c_mktsegment) || ' ' || (c_custkey % 40) AS name, CASE WHEN c_custkey % 7 = 0 THEN 'alias ' || (c_custkey % 90) END AS alias FROM customer),
m AS (SELECT o_orderkey AS ref, 'T' || (o_orderkey % 3) AS ty, CASE o_orderkey % 4 WHEN 0 THEN 'building ' || (o_orderkey % 60) WHEN 1 THEN 'alias ' || (o_orderkey % 120) WHEN 2 THEN 'build' ELSE 'zzz ' || o_orderkey END AS name FROM orders),
k AS (SELECT id, ty, name AS key, true AS own FROM e UNION ALL SELECT id, ty, alias, false FROM e WHERE alias IS NOT NULL),
h AS (SELECT ty, key, count(*) FILTER (own) AS n_name, min(id) FILTER (own) AS by_name, count(*) AS n_any, min(id) AS by_any FROM k GROUP BY 1, 2),
nr AS (SELECT DISTINCT ref FROM m JOIN e ON m.ty = e.ty AND (starts_with(replace(e.name, ' ', ''), replace(m.name, ' ', '')) OR starts_with(replace(m.name, ' ', ''), replace(e.name, ' ', ''))))
SELECT m.ref, CASE WHEN n_name = 1 THEN 'resolved_existing' WHEN n_name > 1 THEN 'uncertain' WHEN n_any = 1 THEN 'resolved_existing' WHEN n_any > 1 THEN 'uncertain' WHEN nr.ref IS NOT NULL THEN 'possible_match' ELSE 'created_new' END AS status,
 CASE WHEN n_name = 1 THEN by_name WHEN coalesce(n_name, 0) = 0 AND n_any = 1 THEN by_any END AS entity_id FROM m LEFT JOIN h ON h.ty = m.ty AND h.key = m.name LEFT JOIN nr ON nr.ref = m.ref"""


@plan("w3_resolve", _ENT, log=False)
def w3_resolve(spark, d):
    c = _read(spark, d, "customer")
    kind = lambda x: F.concat(F.lit("T"), F.col(x) % 3)
    e = c.select(
        F.col("c_custkey").alias("id"), kind("c_nationkey").alias("entity_type"), F.concat("c_mktsegment", F.lit("  "), F.col("c_custkey") % 40).alias("name"),
        F.when(F.col("c_custkey") % 7 == 0, F.array(F.concat(F.lit("Alias "), F.col("c_custkey") % 90))).alias("aliases"),
    )
    o = F.col("o_orderkey")
    name = F.when(o % 4 == 0, F.concat(F.lit("Building "), o % 60)).when(o % 4 == 1, F.concat(F.lit("alias "), o % 120)).when(o % 4 == 2, "Build").otherwise(F.concat(F.lit("zzz "), o))
    return resolve.resolve(_read(spark, d, "orders").select(o.alias("ref"), kind("o_orderkey").alias("entity_type"), name.alias("name")), e)


@plan("resolve_endpoints", """, n AS (SELECT DISTINCT subject_id AS id FROM alog) SELECT seq, a.id AS subject_id, b.id AS object_id FROM alog JOIN n a ON a.id = alog.subject_id JOIN n b ON b.id = 'u' || (k % 30)""")
def resolve_endpoints(spark, d):
    log = assertion_log(spark, d)
    names = log.select(F.upper("subject_id").alias("name"), F.col("subject_id").alias("id")).distinct()
    r = log.select("seq", F.concat(F.lit(" "), "subject_id").alias("subject"), F.concat(F.lit("U"), F.col("k") % 30).alias("object"))
    return resolve.endpoints(r, names)[0].select("seq", "subject_id", "object_id")


@plan("lenient_json", """ SELECT seq, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS v FROM alog""")
def lenient_json(spark, d):
    k = F.col("k")
    raw = F.when(k % 3 == 0, "no {object here").when(k % 3 == 1, F.concat(F.lit('Sure: {"v": '), k, F.lit(', "t": "a } b"} done'))).otherwise(F.concat(F.lit('{bad} then {"v": '), k, F.lit("}")))
    return assertion_log(spark, d).select("seq", F.get_json_object(udfs.lenient_json(raw), "$.v").cast("int").alias("v"))


@plan("hash_embed")
def hash_embed(spark, d):
    v = _read(spark, d, "benchmark").select("item_id", udfs.hash_embed(F.col("text")).alias("v"))
    return v.select("item_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("norm"))


@plan("mention_distance")
def mention_distance(spark, d):
    p = _read(spark, d, "part")
    return p.select("p_partkey", F.round(udfs.mention_distance(F.col("p_name"), F.col("p_type")), 6).alias("distance"))


@plan("latin_square", """ SELECT subject_id, CAST(k AS BIGINT) AS item, (CAST(substr(subject_id, 2) AS BIGINT) + k) % 3 AS slot, count(*) AS n FROM alog GROUP BY 1, 2, 3""")
def latin_square(spark, d):
    rows = assertion_log(spark, d).withColumn("p", F.expr("cast(substr(subject_id, 2) as bigint)")).withColumn("item", F.col("k").cast("long"))
    return replay.latin_square(rows, "p", "item", 3).groupBy("subject_id", "item", "slot").agg(F.count("*").alias("n"))


@plan("scenario_replay")
def scenario_replay(spark, d):
    r = _records(spark, d).select("condition", F.col("subject_id").alias("scenario"), "seq", "subject_id", "predicate", "object_id", F.col("arm_tier").alias("tier"), (F.col("condition") != "autonomous").alias("staffed"), "gold")
    return replay.scenario_replay(r)


@plan("bounded_update")
def bounded_update(spark, d):
    f = _routed(spark, d).withColumn("y", F.col("k_case") % 7 < 2)
    new = replay.bounded_update(f, scores.POLICY, "y")
    return spark.createDataFrame(sorted((k, round(v, 6)) for k, v in new.items()), "coefficient string, value double")


@plan("success_criteria", _ARMS + """, m AS (SELECT condition, count(*) FILTER (consequential AND final <> gold AND NOT escalated) / count(*) FILTER (consequential) AS mcr, count(*) FILTER (creates_violation) / count(*) AS dvr, count(*) FILTER (escalated) / count(*) AS rr FROM wr GROUP BY 1)
SELECT a.mcr < f.mcr AS mcr_ok, a.dvr - f.dvr <= 0.005 AS dvr_ok, a.rr < u.rr AS review_ok FROM m a, m f, m u WHERE a.condition = 'frozen' AND f.condition = 'fixed' AND u.condition = 'universal'""")
def success_criteria(spark, d):
    m = metrics.replay_metrics(_records(spark, d), ["condition"])
    of = lambda c, x: F.max(F.when(F.col("condition") == c, F.col(x)))
    return m.agg(
        (of("frozen", "mcr") < of("fixed", "mcr")).alias("mcr_ok"), (of("frozen", "dvr") - of("fixed", "dvr") <= 0.005).alias("dvr_ok"), (of("frozen", "review_rate") < of("universal", "review_rate")).alias("review_ok")
    )


# Each key is asked for after its last write; the true value is that of the last write which is right to take, the old one the last other such value.
_ASKED = """, gw AS (SELECT *, CASE WHEN condition <> 'autonomous' AND arm_tier = 'review' THEN gold ELSE arm_tier END AS fin FROM wr),
tv AS (SELECT DISTINCT seq, subject_id, predicate, object_id FROM wr WHERE gold IN ('accept', 'supersede')),
tg AS (SELECT subject_id, predicate, max_by(object_id, seq) AS gold FROM tv GROUP BY 1, 2),
tq AS (SELECT k.subject_id, k.predicate, tg.gold, max_by(tv.object_id, tv.seq) FILTER (tv.object_id <> tg.gold) AS old FROM (SELECT DISTINCT subject_id, predicate FROM wr) k LEFT JOIN tg USING (subject_id, predicate) LEFT JOIN tv USING (subject_id, predicate) GROUP BY 1, 2, 3),
lastsup AS (SELECT condition, subject_id, predicate, max(seq) AS sup FROM gw WHERE fin = 'supersede' GROUP BY 1, 2, 3),
act AS (SELECT condition, subject_id, predicate, object_id, min(seq) AS seq, min_by(source_ref, seq) AS source_ref FROM gw LEFT JOIN lastsup USING (condition, subject_id, predicate) WHERE fin IN ('accept', 'supersede') AND seq >= coalesce(sup, -1) GROUP BY 1, 2, 3, 4),
fin AS (SELECT condition, subject_id, predicate, max_by(object_id, seq) AS answer, max_by(source_ref, seq) AS source_ref, count(*) AS n FROM act GROUP BY 1, 2, 3),
qa AS (SELECT c.condition, q.*, answer, source_ref, coalesce(n, 0) AS n FROM tq q CROSS JOIN (SELECT DISTINCT condition FROM wr) c LEFT JOIN fin f ON f.condition = c.condition AND f.subject_id = q.subject_id AND f.predicate = q.predicate) """


def _questioned(spark, d):
    w = _records(spark, d).select("condition", F.col("subject_id").alias("scenario"), "seq", "subject_id", "predicate", "object_id", F.col("arm_tier").alias("tier"), (F.col("condition") != "autonomous").alias("staffed"), "gold", "source_ref")
    # The true value of a key is the last right one, the old one the last other: the first two of its values by their last right write.
    log = assertion_log(spark, d).where("subject_id is not null and predicate is not null")
    right = F.when(gold(F.col("k")).isin("accept", "supersede"), F.col("seq"))
    values = log.groupBy("subject_id", "predicate", "object_id").agg(F.max("seq").alias("at"), F.max(right).alias("last"))
    values = values.withColumn("place", F.row_number().over(Window.partitionBy("subject_id", "predicate").orderBy(F.desc_nulls_last("last"))))
    placed = lambda n: F.max(F.when((F.col("place") == n) & F.col("last").isNotNull(), F.col("object_id")))
    keys = values.groupBy("subject_id", "predicate").agg(F.max("at").alias("at"), placed(1).alias("gold"), placed(2).alias("old"))
    q = keys.select(F.explode(F.array(*[F.lit(c) for c in routing.CONDITIONS])).alias("condition"), F.col("subject_id").alias("scenario"), F.concat_ws("|", "subject_id", "predicate").alias("query_id"), "at", "subject_id", "predicate", "gold", "old")
    return replay.answers_after(w, q)


@plan("answers_after_replay", _ARMS + _ASKED + """ SELECT concat_ws('|', subject_id, predicate) AS query_id, condition, answer, coalesce(answer = gold, false) AS correct, coalesce(answer = old, false) AS stale, answer IS NULL AS abstained, coalesce(trim(source_ref) = '', false) AS unsupported, n > 1 AS ambiguous FROM qa""")
def answers_after_replay(spark, d):
    return _questioned(spark, d)


@plan("end_to_end_metrics", _ARMS + _ASKED + """ SELECT condition, count(*) AS n, round(avg(coalesce(answer = gold, false)::INT), 6) AS answer_accuracy, round(avg(coalesce(trim(source_ref) = '', false)::INT), 6) AS unsupported, round(avg(coalesce(answer = old, false)::INT), 6) AS stale, round(avg((answer IS NULL)::INT), 6) AS abstention, round(avg((n > 1)::INT), 6) AS ambiguous FROM qa GROUP BY 1""")
def end_to_end_metrics(spark, d):
    return replay.end_to_end(_questioned(spark, d), "condition")


@plan("supersession_loss", """, g AS (SELECT subject_id, predicate, arg_max(object_id, pct * 1000000 + seq) AS gold, arg_max(object_id, seq) AS final FROM alog WHERE predicate = 'HAS_VALUE' GROUP BY 1, 2)
SELECT CASE WHEN gold = final THEN 'retained' ELSE 'lost' END AS outcome, count(*) AS n FROM g GROUP BY 1""")
def supersession_loss(spark, d):
    log = assertion_log(spark, d).where("predicate = 'HAS_VALUE'")
    g = log.groupBy("subject_id", "predicate").agg(F.max_by("object_id", F.col("pct") * 1_000_000 + F.col("seq")).alias("gold"), F.max_by("object_id", "seq").alias("final"))
    return g.groupBy(F.when(F.col("gold") == F.col("final"), "retained").otherwise("lost").alias("outcome")).agg(F.count("*").alias("n"))


@plan("attestation_profile", """, c AS (SELECT subject_id, object_id, count(*) AS n, max(seq) AS last FROM alog GROUP BY 1, 2)
SELECT subject_id, count(*) AS n_values, sum(n)::BIGINT AS n_writes, arg_max(object_id, last) AS final_value, arg_max(object_id, n * 1000000 + last) AS best_attested FROM c GROUP BY 1""")
def attestation_profile(spark, d):
    c = assertion_log(spark, d).groupBy("subject_id", "object_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    return c.groupBy("subject_id").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_writes"), F.max_by("object_id", "last").alias("final_value"), F.max_by("object_id", F.col("n") * 1_000_000 + F.col("last")).alias("best_attested"))


@plan("lost_gold_recoverability", """, c AS (SELECT subject_id, object_id, count(*) AS n FROM alog GROUP BY 1, 2), g AS (SELECT subject_id, arg_max(object_id, pct * 1000000 + seq) AS gold, arg_max(object_id, seq) AS final FROM alog GROUP BY 1)
SELECT count(*) AS n_lost, count(*) FILTER (a.n > b.n) AS recoverable FROM g JOIN c a ON a.subject_id = g.subject_id AND a.object_id = gold JOIN c b ON b.subject_id = g.subject_id AND b.object_id = final WHERE gold <> final""")
def lost_gold_recoverability(spark, d):
    log = assertion_log(spark, d)
    c = log.groupBy("subject_id", "object_id").agg(F.count("*").alias("n"))
    g = log.groupBy("subject_id").agg(F.max_by("object_id", F.col("pct") * 1_000_000 + F.col("seq")).alias("gold"), F.max_by("object_id", "seq").alias("final")).where("gold <> final")
    g = g.join(c.select("subject_id", F.col("object_id").alias("gold"), F.col("n").alias("a")), ["subject_id", "gold"]).join(c.select("subject_id", F.col("object_id").alias("final"), F.col("n").alias("b")), ["subject_id", "final"])
    return g.agg(F.count("*").alias("n_lost"), F.count_if(F.col("a") > F.col("b")).alias("recoverable"))


@plan("extraction_quality", """, x AS (SELECT split_part(p_name, ' ', 1) AS gold, p_name || ' ' || p_brand AS got, p_partkey % 5 <> 0 AS extracted, p_partkey % 7 = 0 AS linked, p_partkey % 11 = 0 AS stale FROM part),
c AS (SELECT count(*) FILTER (extracted AND (contains(got, gold) OR contains(gold, got))) AS tp, count(*) FILTER (extracted) AS n_got, count(*) AS n_gold, count(*) FILTER (extracted AND linked) AS n_linked, count(*) FILTER (extracted AND stale) AS n_stale FROM x)
SELECT round(tp / n_got, 6) AS precision, round(tp / n_gold, 6) AS recall, round(2 * tp / (n_got + n_gold), 6) AS f1, round(n_linked / n_gold, 6) AS linked_recall, round(n_stale / n_gold, 6) AS stale_rate FROM c""".replace(", x AS", " WITH x AS", 1), log=False)
def extraction_quality(spark, d):
    k = F.col("p_partkey")
    p = _read(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("gold"), F.when(k % 5 != 0, F.concat_ws(" ", "p_name", "p_brand")).alias("got"), (k % 7 == 0).alias("linked"), (k % 11 == 0).alias("stale"))
    return metrics.extraction_quality(p)


@plan("failure_taxonomy", """ SELECT CASE WHEN trim(source_ref) = '' THEN 'extraction' WHEN k % 13 = 0 THEN 'link' WHEN pct <= 80 THEN 'governance' ELSE 'none' END AS cause, count(*) AS n FROM alog GROUP BY 1""")
def failure_taxonomy(spark, d):
    cause = F.when(F.trim("source_ref") == "", "extraction").when(F.col("k") % 13 == 0, "link").when(F.col("pct") <= 80, "governance").otherwise("none")
    return assertion_log(spark, d).groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@plan("iso_to_utc", """ SELECT o_orderkey, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') AS utc FROM orders""", log=False)
def iso_to_utc(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return _read(spark, d, "orders").select("o_orderkey", F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd'T'HH:mm:ss").alias("utc"))


@plan("render_text", """ SELECT seq, concat_ws(' ', subject_id, predicate, object_id) AS t FROM alog""")
def render_text(spark, d):
    return assertion_log(spark, d).select("seq", F.concat_ws(" ", "subject_id", "predicate", "object_id").alias("t"))


@plan("answer_token_match", """ SELECT seq, round((contains(predicate, 'OWN')::INT + contains(object_id, '3')::INT) / 2.0, 6)::DOUBLE AS score FROM alog""")
def answer_token_match(spark, d):
    hay = F.lower(F.concat_ws(" ", "predicate", "object_id"))
    want = F.array(F.lit("own"), F.lit("3"))
    return assertion_log(spark, d).select("seq", F.round(F.size(F.filter(want, lambda t: F.contains(hay, t))) / F.size(want), 6).alias("score"))


@plan("label_drift", """ SELECT predicate, count(*) FILTER (gold = 'review') AS review FROM (SELECT predicate, CASE WHEN k % 7 = 0 AND seq % 4 = 0 THEN 'accept' WHEN k % 7 = 0 THEN 'review' ELSE 'accept' END AS gold FROM alog) GROUP BY 1""")
def label_drift(spark, d):
    gold = F.when((F.col("k") % 7 == 0) & (F.col("seq") % 4 == 0), "accept").when(F.col("k") % 7 == 0, "review").otherwise("accept")
    return assertion_log(spark, d).groupBy("predicate").agg(F.count_if(gold == "review").alias("review"))


@plan("aggregate_methods")
def aggregate_methods(spark, d):
    per = assertion_log(spark, d).groupBy("write_intent", "subject_id").agg(F.avg("pct").alias("score"))
    return stats.mean_ci(per, "write_intent", "score")


@plan("significance_table")
def significance_table(spark, d):
    per = assertion_log(spark, d).groupBy("subject_id", "predicate").agg(*[F.avg(F.when(F.col("write_intent") == w, F.col("pct"))).alias(n) for w, n in (("update", "a"), ("new_fact", "b"))])
    t = stats.paired_t(per.where("a is not null and b is not null"), "predicate", "a", "b")
    return stats.holm(t, "predicate", "p")


@plan("incumbent_timeline", """ SELECT subject_id, predicate, string_agg(object_id, '>' ORDER BY seq) AS history FROM alog WHERE predicate = 'HAS_STATUS' GROUP BY 1, 2""")
def incumbent_timeline(spark, d):
    rows = assertion_log(spark, d).where("predicate = 'HAS_STATUS'")
    return rows.groupBy("subject_id", "predicate").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "object_id"))), lambda s: s["object_id"]), ">").alias("history"))


@plan("knowledge_update_writes", """, x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, length(text) AS v FROM conversations WHERE role = 'user')
SELECT p.conv_id, p.turn, q.v AS value FROM x p JOIN x q ON p.conv_id = q.conv_id AND p.a = q.b""".replace(", x AS", " WITH x AS", 1), log=False)
def knowledge_update_writes(spark, d):
    c = _read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").alias("v"))
    w = Window.partitionBy("conv_id")
    c = c.withColumn("a", F.row_number().over(w.orderBy("turn"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("turn"))))
    other = c.select("conv_id", F.col("b").alias("a"), F.col("v").alias("value"))
    return c.join(other, ["conv_id", "a"]).select("conv_id", "turn", "value")


@plan("slot_value_lookup", """ SELECT subject_id, arg_max(object_id, created_at) AS value FROM alog WHERE predicate = 'HAS_VALUE' GROUP BY 1""")
def slot_value_lookup(spark, d):
    rows = policies.single_valued_log(assertion_log(spark, d)).where("predicate = 'HAS_VALUE'").withColumn("body", F.concat(F.lit("slot [["), "subject_id", F.lit("]] value")))
    return rows.groupBy(text.marker("body").alias("subject_id")).agg(F.max_by("object_id", "created_at").alias("value"))


@plan("entity_assertions", """ SELECT DISTINCT seq FROM alog WHERE subject_id = 'u3' OR object_id = 'v3'""")
def entity_assertions(spark, d):
    return assertion_log(spark, d).where("subject_id = 'u3' or object_id = 'v3'").select("seq").distinct()
