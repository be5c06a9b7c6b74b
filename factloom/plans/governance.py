"""Write-governance queries over the assertion log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology as o
from ..operators import contradict, metrics, policies, ranges, review, validate
from ..sources import store
from ..sources.events import LOG_SQL, assertion_log
from ..sources.scratch import checkpoint_folder

PLANS: dict = {}
SINGLE = "('ASSIGNED_TO', 'HAS_STATUS', 'HAS_VALUE')"


def plan(name: str, sql: str | None = None, log: bool = True):
    def keep(f):
        PLANS[name] = (f, LOG_SQL + sql if sql and log else sql)
        return f

    return keep


@plan("durable_violations", f""", k AS (SELECT subject_id, predicate, count(DISTINCT object_id) AS n, count(*) AS c FROM alog WHERE predicate IN {SINGLE} GROUP BY 1, 2)
SELECT CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS violations, count(*) FILTER (n > 1) AS keys_in_violation, CAST(sum(c) AS BIGINT) AS accepted FROM k""")
def durable_violations(spark, d):
    return metrics.durable_violations(assertion_log(spark, d))


@plan("write_summary", """ SELECT write_intent, predicate, count(*) AS n, count(*) FILTER (pct > 80) AS n_high FROM alog GROUP BY 1, 2""")
def write_summary(spark, d):
    return assertion_log(spark, d).groupBy("write_intent", "predicate").agg(F.count("*").alias("n"), F.count_if(F.col("pct") > 80).alias("n_high"))


@plan("read_time_conflicts", f""" SELECT seq, subject_id, predicate FROM alog WHERE predicate IN {SINGLE} AND (subject_id, predicate) IN
 (SELECT (subject_id, predicate) FROM alog WHERE predicate IN {SINGLE} GROUP BY subject_id, predicate HAVING count(DISTINCT object_id) > 1)""")
def read_time_conflicts(spark, d):
    return metrics.read_time_conflicts(assertion_log(spark, d)).select("seq", "subject_id", "predicate")


@plan("policy_bsup", f""" SELECT subject_id, predicate, arg_max(object_id, seq) AS object_id, max(seq) AS seq, count(*) - 1 AS superseded FROM alog WHERE predicate IN {SINGLE} GROUP BY 1, 2""")
def policy_bsup(spark, d):
    return policies.last_writer(policies.single_valued_log(assertion_log(spark, d)))


@plan("policy_memgpt", f""", s AS (SELECT *, sum(CASE WHEN write_intent = 'update' THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate ORDER BY seq) AS seg FROM alog WHERE predicate IN {SINGLE}),
t AS (SELECT *, max(seg) OVER (PARTITION BY subject_id, predicate) AS last FROM s)
SELECT subject_id, predicate, object_id, min(seq) AS seq FROM t WHERE seg = last GROUP BY 1, 2, 3""")
def policy_memgpt(spark, d):
    return policies.update_only(policies.single_valued_log(assertion_log(spark, d)))


_FOLD = f""", r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY seq) AS rn FROM alog WHERE predicate IN {SINGLE}),
f AS (
  SELECT subject_id, predicate, rn, seq, object_id AS cur, pct AS conf, 'accept' AS decision FROM r WHERE rn = 1
  UNION ALL
  SELECT r.subject_id, r.predicate, r.rn, r.seq,
    CASE WHEN r.object_id <> f.cur AND r.pct >= f.conf THEN r.object_id ELSE f.cur END,
    CASE WHEN r.object_id <> f.cur AND r.pct >= f.conf THEN r.pct ELSE f.conf END,
    CASE WHEN r.object_id = f.cur THEN 'accept' WHEN r.pct >= f.conf THEN 'supersede' ELSE 'reject' END
  FROM f JOIN r ON r.subject_id = f.subject_id AND r.predicate = f.predicate AND r.rn = f.rn + 1
)
"""


@plan("policy_evidence", LOG_SQL.replace("WITH alog", "WITH RECURSIVE alog") + _FOLD + " SELECT seq, decision FROM f", log=False)
def policy_evidence(spark, d):
    return policies.evidence_weighted(policies.single_valued_log(assertion_log(spark, d)))


@plan("commit_outcomes", LOG_SQL.replace("WITH alog", "WITH RECURSIVE alog") + _FOLD + " SELECT decision, count(*) AS n FROM f GROUP BY 1", log=False)
def commit_outcomes(spark, d):
    return policy_evidence(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@plan("c7_gate")
def c7_gate(spark, d):
    return policies.contradiction_gate(policies.single_valued_log(assertion_log(spark, d)))


_CONF = f""", a AS (SELECT * FROM alog WHERE predicate IN {SINGLE}),
hit AS (
  SELECT c.seq, c.pct, c.write_intent, x.seq AS o_seq, x.pct AS o_pct,
    (c.valid_from IS NOT NULL OR c.valid_to IS NOT NULL) AND (x.valid_from IS NOT NULL OR x.valid_to IS NOT NULL) AS both_dated
  FROM a c JOIN a x ON c.subject_id = x.subject_id AND c.predicate = x.predicate AND c.object_id <> x.object_id AND x.seq < c.seq
  WHERE NOT ((c.valid_from IS NOT NULL OR c.valid_to IS NOT NULL) AND (x.valid_from IS NOT NULL OR x.valid_to IS NOT NULL))
     OR (coalesce(c.valid_from <= x.valid_to, true) AND coalesce(x.valid_from <= c.valid_to, true))
),
g AS (SELECT seq, pct, write_intent, count(*) AS n_conflicts, min(o_seq) AS first_conflict, max(o_pct) AS met_pct, bool_and(both_dated) AS all_dated FROM hit GROUP BY 1, 2, 3)
"""


def _conflicts(spark, d):
    log = assertion_log(spark, d)
    return contradict.single_valued(log, log)


@plan("contradiction_single_valued", _CONF + " SELECT seq, n_conflicts, first_conflict, met_pct FROM g")
def contradiction_single_valued(spark, d):
    return _conflicts(spark, d).select("seq", "n_conflicts", "first_conflict", "met_pct")


@plan("w7_contradiction_check", _CONF + """ SELECT seq, CASE WHEN all_dated THEN 'temporal' WHEN pct > 80 AND met_pct > 80 THEN 'hard' ELSE 'soft' END AS kind,
 CASE WHEN pct > 80 AND met_pct > 80 THEN 'high' ELSE 'low' END AS severity,
 CASE WHEN NOT (pct > 80 AND met_pct > 80) THEN 'accept' WHEN write_intent = 'correction' THEN 'supersede' ELSE 'quarantine' END AS action FROM g""")
def w7_contradiction_check(spark, d):
    return contradict.grade(_conflicts(spark, d)).select("seq", "kind", "severity", "action")


@plan("interval_overlap", _CONF + " SELECT both_dated, count(*) AS n FROM hit GROUP BY 1")
def interval_overlap(spark, d):
    log = assertion_log(spark, d)
    return contradict.overlapping(log, log).groupBy("both_dated").agg(F.count("*").alias("n"))


@plan("contradiction_explicit", """, e AS (SELECT seq AS edge, pct, unnest([subject_id, object_id]) AS node FROM alog WHERE k = 7),
m AS (SELECT DISTINCT seq, unnest([subject_id, object_id]) AS node FROM alog WHERE k <> 7)
SELECT seq, count(DISTINCT edge) AS n_edges, max(pct) AS met_pct FROM m JOIN e USING (node) GROUP BY 1""")
def contradiction_explicit(spark, d):
    log = assertion_log(spark, d)
    return contradict.explicit(log.where("k <> 7"), log.where("k = 7"))


@plan("single_valued_incumbents", f""" SELECT subject_id, predicate, count(DISTINCT object_id) AS n_values, max(pct) AS top_pct FROM alog WHERE predicate IN {SINGLE} GROUP BY 1, 2""")
def single_valued_incumbents(spark, d):
    return policies.single_valued_log(assertion_log(spark, d)).groupBy("subject_id", "predicate").agg(F.countDistinct("object_id").alias("n_values"), F.max("pct").alias("top_pct"))


@plan("idempotent_accept", """ SELECT seq, seq = min(seq) OVER (PARTITION BY subject_id, predicate, object_id) AS fresh FROM alog""")
def idempotent_accept(spark, d):
    return policies.idempotent_split(assertion_log(spark, d))


@plan("supersession_chain", """, x AS (SELECT seq, object_id, lag(seq) OVER w AS old, lag(object_id) OVER w AS was FROM alog WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY seq))
SELECT seq, old FROM x WHERE old IS NOT NULL AND was <> object_id""")
def supersession_chain(spark, d):
    return policies.supersession_chain(assertion_log(spark, d))


@plan("delta_vs_cumulative_belief", """, x AS (SELECT *, lag(object_id) OVER (PARTITION BY subject_id, predicate ORDER BY seq) AS was FROM alog)
SELECT seq, subject_id, predicate, object_id, CASE WHEN was IS NULL THEN 'new_fact' ELSE 'update' END AS intent FROM x WHERE was IS NULL OR was <> object_id""")
def delta_vs_cumulative_belief(spark, d):
    return policies.belief_changes(assertion_log(spark, d))


@plan("supersession_burden", """, x AS (SELECT *, lag(object_id) OVER (PARTITION BY subject_id, predicate ORDER BY seq) AS was, count(*) OVER (PARTITION BY subject_id, predicate, object_id) AS attested FROM alog)
SELECT attested, count(*) AS n FROM x WHERE was IS NOT NULL AND was <> object_id GROUP BY 1""")
def supersession_burden(spark, d):
    log = assertion_log(spark, d)
    n = log.groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("attested"))
    return policies.belief_changes(log).where("intent = 'update'").join(n, ["subject_id", "predicate", "object_id"]).groupBy("attested").agg(F.count("*").alias("n"))


@plan("latest_value", """ SELECT subject_id, predicate, arg_max(object_id, struct_pack(t := coalesce(valid_from, created_at), s := seq)) AS object_id, count(DISTINCT object_id) > 1 AS ambiguous FROM alog GROUP BY 1, 2""")
def latest_value(spark, d):
    at = F.struct(F.coalesce("valid_from", "created_at"), "seq")
    return assertion_log(spark, d).groupBy("subject_id", "predicate").agg(F.max_by("object_id", at).alias("object_id"), (F.countDistinct("object_id") > 1).alias("ambiguous"))


@plan("corroborated_intent", """, x AS (SELECT subject_id, predicate, object_id, count(DISTINCT seq // 100) AS n FROM alog GROUP BY 1, 2, 3)
SELECT subject_id, predicate, object_id, CAST(least(98, 82 + 6 * (n - 1)) AS BIGINT) AS pct FROM x""")
def corroborated_intent(spark, d):
    n = F.countDistinct(F.floor(F.col("seq") / 100))
    return assertion_log(spark, d).groupBy("subject_id", "predicate", "object_id").agg(F.least(F.lit(98), 82 + 6 * (n - 1)).cast("long").alias("pct"))


@plan("feedback_blocks", """, x AS (SELECT *, (row_number() OVER (PARTITION BY predicate ORDER BY seq) - 1) // 20 AS block FROM alog)
SELECT predicate, CAST(block AS BIGINT) AS block, count(*) AS n, max(pct) AS top FROM x GROUP BY 1, 2""")
def feedback_blocks(spark, d):
    checkpoint_folder(spark)
    df = ranges.running(assertion_log(spark, d).select("predicate", "seq", "pct"), ["predicate"], ["seq"], {"at": F.lit(1)})
    return df.groupBy("predicate", F.floor((F.col("at") - 1) / 20).alias("block")).agg(F.count("*").alias("n"), F.max("pct").alias("top"))


_TYPED = """, c AS (SELECT *, CASE k % 4 WHEN 0 THEN 'Task' WHEN 1 THEN 'Person' WHEN 2 THEN 'Slot' ELSE NULL END AS subject_type,
 CASE k % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'SlotValue' ELSE 'StatusValue' END AS object_type FROM alog) """


def _typed(spark, d):
    k = F.col("k")
    return (
        assertion_log(spark, d)
        .withColumn("subject_type", F.when(k % 4 == 0, "Task").when(k % 4 == 1, "Person").when(k % 4 == 2, "Slot"))
        .withColumn("object_type", F.when(k % 3 == 0, "Person").when(k % 3 == 1, "SlotValue").otherwise("StatusValue"))
    )


@plan("w5_schema_validate", _TYPED + """ SELECT seq, CASE WHEN trim(source_ref) = '' THEN 'required' WHEN pct > 100 THEN 'confidence' WHEN subject_type IS NULL THEN 'endpoints' END AS failed_check FROM c""")
def w5_schema_validate(spark, d):
    return validate.schema_check(_typed(spark, d)).select("seq", "failed_check")


@plan("c9_domain_range", _TYPED + """ SELECT seq, predicate FROM c WHERE NOT coalesce(
 CASE predicate WHEN 'ASSIGNED_TO' THEN subject_type = 'Task' AND object_type = 'Person' WHEN 'HAS_VALUE' THEN subject_type = 'Slot' AND object_type = 'SlotValue'
 WHEN 'HAS_STATUS' THEN subject_type IN ('Task', 'Person') AND object_type = 'StatusValue' ELSE false END, false)""")
def c9_domain_range(spark, d):
    return validate.domain_range(_typed(spark, d), o.relations(spark)).select("seq", "predicate")


@plan("c1_identity", _TYPED + " SELECT subject_id AS id, count(DISTINCT subject_type) AS n_types FROM c GROUP BY 1 HAVING count(DISTINCT subject_type) > 1")
def c1_identity(spark, d):
    return validate.identity_conflicts(_typed(spark, d).select(F.col("subject_id").alias("id"), F.col("subject_type").alias("entity_type")))


@plan("c2_temporal_sanity", " SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate", log=False)
def c2_temporal_sanity(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    od = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return validate.bad_intervals(li.join(od, "l_orderkey"), "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber")


@plan("c4_done_task", " SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)", log=False)
def c4_done_task(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return validate.without_support(e.where("event_type = 'signup'").select("user_id").distinct(), "user_id", e.where("event_type = 'purchase' and value > 90"), "user_id")


@plan("c5_inactive_assignee", """ SELECT seq FROM alog WHERE predicate = 'ASSIGNED_TO' AND object_id IN ('v1', 'v4')""")
def c5_inactive_assignee(spark, d):
    log = assertion_log(spark, d)
    people = log.select(F.col("object_id").alias("id")).distinct().select("id", F.lit("Person").alias("entity_type"), F.when(F.col("id").isin("v1", "v4"), "inactive").otherwise("active").alias("status"))
    return validate.inactive_objects(log, people).select("seq")


@plan("c6_confidence_bounds", """ SELECT seq FROM (SELECT seq, TRY_CAST(CASE WHEN k % 11 = 0 THEN 'high' ELSE ((pct - 52) * 3) || 'e-2' END AS DOUBLE) AS c FROM alog) WHERE c IS NULL OR c NOT BETWEEN 0 AND 1""")
def c6_confidence_bounds(spark, d):
    c = F.when(F.col("k") % 11 == 0, "high").otherwise(F.concat((F.col("pct") - 52) * 3, F.lit("e-2")))
    return validate.out_of_bounds(assertion_log(spark, d).withColumn("confidence", c), "confidence").select("seq")


@plan("c8_evidence_floor", """ SELECT o_orderkey, coalesce(n, 0) AS n_support FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) < 2""", log=False)
def c8_evidence_floor(spark, d):
    od = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return validate.below_floor(od, "o_orderkey", spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 25"), "l_orderkey", 2)


_STATES = "['todo', 'in_progress', 'blocked', 'done', 'cancelled']"


@plan("c10_transition", f""", s AS (SELECT seq, write_intent, {_STATES}[CAST(k % 5 + 1 AS INTEGER)] AS new, lag({_STATES}[CAST(k % 5 + 1 AS INTEGER)]) OVER (PARTITION BY subject_id ORDER BY seq) AS old FROM alog WHERE predicate = 'HAS_STATUS')
SELECT seq, CASE WHEN old IS NULL THEN 'quarantine' WHEN write_intent = 'correction' OR old = new OR (old, new) IN ({", ".join(f"('{a}', '{b}')" for a, b in o.TRANSITIONS)}) THEN 'ok' ELSE 'quarantine' END AS verdict FROM s""")
def c10_transition(spark, d):
    from pyspark.sql import Window

    state = F.element_at(F.array(*[F.lit(s) for s in ("todo", "in_progress", "blocked", "done", "cancelled")]), F.col("k") % 5 + 1)
    log = assertion_log(spark, d).where("predicate = 'HAS_STATUS'").withColumn("new", state)
    log = log.withColumn("old", F.lag("new").over(Window.partitionBy("subject_id").orderBy("seq")))
    return validate.transition_check(log, o.transitions(spark)).select("seq", "verdict")


@plan("fail_closed_linkage", f""" SELECT seq FROM alog a WHERE predicate IN {SINGLE} AND EXISTS (SELECT 1 FROM alog b WHERE b.predicate = a.predicate AND b.subject_id <> a.subject_id AND b.seq < a.seq)""")
def fail_closed_linkage(spark, d):
    return validate.fail_closed(assertion_log(spark, d)).select("seq")


# Accepted are high-confidence updates with a source.
_ACTIVE = "write_intent = 'update' and pct > 80 and source_ref <> ''"
_BUCKETS = f""", a AS (SELECT subject_id, predicate, count(DISTINCT object_id) AS n, min(object_id) AS v FROM alog WHERE predicate IN {SINGLE} AND {_ACTIVE} GROUP BY 1, 2),
g AS (SELECT subject_id, predicate, arg_max(object_id, seq) AS gold_value FROM alog WHERE predicate IN {SINGLE} GROUP BY 1, 2),
f AS (SELECT DISTINCT subject_id, predicate FROM alog WHERE seq % 11 = 0),
b AS (SELECT g.*, CASE WHEN n > 1 THEN 'split' WHEN n = 1 AND v = gold_value THEN 'correct' WHEN n = 1 THEN 'stale' WHEN f.subject_id IS NOT NULL THEN 'abstained' ELSE 'missing' END AS bucket
 FROM g LEFT JOIN a USING (subject_id, predicate) LEFT JOIN f USING (subject_id, predicate)) """


def _buckets(spark, d):
    log = assertion_log(spark, d)
    single = policies.single_valued_log(log)
    gold = policies.last_writer(single).select("subject_id", "predicate", F.col("object_id").alias("gold_value"))
    return metrics.durable_buckets(gold, single.where(_ACTIVE), log.where("seq % 11 = 0"))


@plan("durable_state_buckets", _BUCKETS + " SELECT subject_id, predicate, bucket FROM b")
def durable_state_buckets(spark, d):
    return _buckets(spark, d).select("subject_id", "predicate", "bucket")


@plan("gold_join", _BUCKETS + """ SELECT round(100.0 * count(*) FILTER (bucket = 'correct') / count(*), 6) AS dsc, round(100.0 * count(*) FILTER (bucket = 'stale') / count(*), 6) AS ssr,
 round(100.0 * count(*) FILTER (bucket = 'split') / count(*), 6) AS split, round(100.0 * count(*) FILTER (bucket = 'abstained') / count(*), 6) AS abstention, round(100.0 * count(*) FILTER (bucket = 'missing') / count(*), 6) AS missing,
 round(100.0 * count(*) FILTER (bucket = 'correct') / count(*) FILTER (bucket IN ('correct', 'stale', 'split')), 6) AS dsc_gov, round(100.0 * count(*) FILTER (bucket = 'stale') / count(*) FILTER (bucket IN ('correct', 'stale', 'split')), 6) AS ssr_gov FROM b""")
def gold_join(spark, d):
    return metrics.bucket_rates(_buckets(spark, d))


@plan("upsert_assertions", """ SELECT subject_id || predicate AS id, arg_max(object_id, seq) AS object_id, max(seq) AS seq FROM alog GROUP BY 1""")
def upsert_assertions(spark, d):
    rows = assertion_log(spark, d).select(F.concat("subject_id", "predicate").alias("id"), "object_id", "seq")
    return store.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), "id", "seq")


@plan("upsert_entity", """ SELECT subject_id AS id, arg_max(object_id, seq) AS object_id, max(seq) AS seq, CAST(min(created_at) AS VARCHAR) AS created FROM alog GROUP BY 1""")
def upsert_entity(spark, d):
    rows = assertion_log(spark, d).select(F.col("subject_id").alias("id"), "object_id", "seq", "created_at")
    df = store.upsert_keeping_first(rows, "id", "seq", "created_at")
    text = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.select("id", "object_id", "seq", F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "").alias("created"))


@plan("update_status", """ SELECT CASE WHEN seq % 10 = 0 THEN 'superseded' ELSE 'accepted' END AS status, count(*) AS n FROM alog GROUP BY 1""")
def update_status(spark, d):
    rows = assertion_log(spark, d).select("seq", F.lit("accepted").alias("status"))
    changes = rows.where("seq % 10 = 0").select("seq", F.lit("superseded").alias("new_status"))
    return store.set_status(rows, "seq", changes).groupBy("status").agg(F.count("*").alias("n"))


@plan("rebuild_graph", """ SELECT seq FROM alog WHERE k % 5 <> 0 AND subject_id IN (SELECT subject_id FROM alog WHERE seq % 3 = 0) AND object_id <> 'v3'""")
def rebuild_graph(spark, d):
    log = assertion_log(spark, d).withColumn("status", F.when(F.col("k") % 5 != 0, "accepted").otherwise("quarantined"))
    ids = log.where("seq % 3 = 0").select(F.col("subject_id").alias("id")).unionByName(log.where("object_id <> 'v3'").select(F.col("object_id").alias("id"))).distinct()
    return store.accepted_graph(log, ids).select("seq")


@plan("edge_triples_diff", """ (SELECT DISTINCT subject_id, predicate, object_id FROM alog WHERE k < 90 EXCEPT SELECT DISTINCT subject_id, predicate, object_id FROM alog WHERE k >= 20)""")
def edge_triples_diff(spark, d):
    t = assertion_log(spark, d).select("subject_id", "predicate", "object_id", "k")
    cols = ["subject_id", "predicate", "object_id"]
    return t.where("k < 90").select(cols).subtract(t.where("k >= 20").select(cols))


@plan("metadata_where", """ SELECT seq FROM alog WHERE (predicate IN ('OWNS', 'ABOUT') AND write_intent <> 'update') OR object_id = 'v2'""")
def metadata_where(spark, d):
    where = {"$or": [{"$and": [{"predicate": {"$in": ["OWNS", "ABOUT"]}}, {"write_intent": {"$ne": "update"}}]}, {"object_id": "v2"}]}
    return assertion_log(spark, d).where(store.metadata_filter(where)).select("seq")


@plan("filter_accepted", " SELECT seq, object_id FROM alog WHERE k % 5 <> 0")
def filter_accepted(spark, d):
    return assertion_log(spark, d).where("k % 5 <> 0").select("seq", "object_id")


@plan("point_lookup_entity", " SELECT seq, predicate, object_id FROM alog WHERE subject_id = 'u8'")
def point_lookup_entity(spark, d):
    return assertion_log(spark, d).where("subject_id = 'u8'").select("seq", "predicate", "object_id")


@plan("durable_row_count", " SELECT count(DISTINCT subject_id) + count(*) + count(*) FILTER (k % 5 = 0) AS n FROM alog")
def durable_row_count(spark, d):
    return assertion_log(spark, d).agg((F.countDistinct("subject_id") + F.count("*") + F.count_if(F.col("k") % 5 == 0)).alias("n"))


@plan("quarantine_cause_table", """, r AS (SELECT *, CASE k % 6 WHEN 0 THEN 'possible alias of entity' WHEN 1 THEN 'lacks supporting text' WHEN 2 THEN 'single-valued conflict on x' WHEN 3 THEN 'valid_from after valid_to' WHEN 4 THEN 'domain mismatch' ELSE 'other' END AS reason FROM alog)
SELECT CASE k % 6 WHEN 0 THEN 'entity_alias_resolution' WHEN 1 THEN 'evidence_provenance' WHEN 2 THEN 'genuine_ambiguity' WHEN 3 THEN 'temporal_cardinality' WHEN 4 THEN 'temporal_cardinality' ELSE 'other' END AS cause,
 count(*) AS n, count(*) FILTER (write_intent = 'update') AS n_valid FROM r GROUP BY 1""")
def quarantine_cause_table(spark, d):
    texts = ["possible alias of entity", "lacks supporting text", "single-valued conflict on x", "valid_from after valid_to", "domain mismatch", "other"]
    log = assertion_log(spark, d).withColumn("reason", F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("k") % 6 + 1))
    cause = F.lit("other")
    for name, pattern in reversed(o.QUARANTINE_CAUSES):
        cause = F.when(F.col("reason").rlike(f"(?i){pattern}"), name).otherwise(cause)
    return log.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.count_if(F.col("write_intent") == "update").alias("n_valid"))


@plan("quarantine_reason_histogram", """, q AS (SELECT *, 'reason-' || (k % 9) AS reason, bool_or(k = 3) OVER (PARTITION BY subject_id) AS expected FROM alog WHERE k % 4 = 0)
SELECT reason, count(*) AS n, count(*) FILTER (NOT expected) AS false_quarantine FROM q GROUP BY 1""")
def quarantine_reason_histogram(spark, d):
    q = assertion_log(spark, d).where("k % 4 = 0").withColumn("reason", F.concat(F.lit("reason-"), F.col("k") % 9))
    e = q.groupBy("subject_id").agg(F.bool_or(F.col("k") == 3).alias("expected"))
    return q.join(e, "subject_id").groupBy("reason").agg(F.count("*").alias("n"), F.count_if(~F.col("expected")).alias("false_quarantine"))


@plan("stress_by_intensity", """ SELECT predicate, k % 3 AS intensity, round(avg(pct), 6) AS score, count(*) AS n FROM alog GROUP BY 1, 2""")
def stress_by_intensity(spark, d):
    return assertion_log(spark, d).groupBy("predicate", (F.col("k") % 3).alias("intensity")).agg(F.round(F.avg("pct"), 6).alias("score"), F.count("*").alias("n"))


@plan("cascade_downstream", """, u AS (SELECT subject_id, predicate, min(seq) AS s FROM alog WHERE k % 17 = 0 GROUP BY 1, 2)
SELECT a.seq, u.s AS upstream FROM alog a JOIN u USING (subject_id, predicate) WHERE a.seq > u.s""")
def cascade_downstream(spark, d):
    log = assertion_log(spark, d)
    up = log.where("k % 17 = 0").groupBy("subject_id", "predicate").agg(F.min("seq").alias("upstream"))
    return log.join(up, ["subject_id", "predicate"]).where("seq > upstream").select("seq", "upstream")


@plan("corpus_counts", """ SELECT write_intent, p, count(*) AS n FROM (SELECT write_intent, unnest(CASE WHEN k % 2 = 0 THEN ['even', 'any'] ELSE ['any'] END) AS p FROM alog) GROUP BY 1, 2""")
def corpus_counts(spark, d):
    p = F.when(F.col("k") % 2 == 0, F.array(F.lit("even"), F.lit("any"))).otherwise(F.array(F.lit("any")))
    return assertion_log(spark, d).select("write_intent", F.explode(p).alias("p")).groupBy("write_intent", "p").agg(F.count("*").alias("n"))


@plan("feedback_streams", """, t AS (SELECT *, k % 7 < 3 AS truth, k % 3 = 0 AS cons, unnest(['clean', 'noisy', 'biased', 'adversarial']) AS stream FROM alog),
l AS (SELECT *, CASE stream WHEN 'noisy' THEN truth <> (k % 5 = 0) WHEN 'biased' THEN truth AND k % 20 >= 7 WHEN 'adversarial' THEN CASE WHEN cons OR truth THEN false ELSE truth END ELSE truth END AS label,
 CASE WHEN stream = 'noisy' AND k % 5 = 0 THEN 55 WHEN stream = 'biased' AND truth AND k % 20 < 7 THEN 70 WHEN stream = 'adversarial' AND (cons OR truth) THEN 99 ELSE 85 END AS weight FROM t)
SELECT stream, count(*) FILTER (label = truth) AS kept, count(*) FILTER (label <> truth) AS flipped, CAST(sum(weight) AS BIGINT) AS weight_pct FROM l GROUP BY 1""")
def feedback_streams(spark, d):
    k = F.col("k")
    rows = assertion_log(spark, d).withColumn("truth", k % 7 < 3).withColumn("consequential", k % 3 == 0)
    f = review.feedback(rows, noisy=k % 5 == 0, biased=k % 20 < 7)
    return f.groupBy("stream").agg(F.count_if(F.col("label") == F.col("truth")).alias("kept"), F.count_if(F.col("label") != F.col("truth")).alias("flipped"), F.sum("weight_pct").alias("weight_pct"))
