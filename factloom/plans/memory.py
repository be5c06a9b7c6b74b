"""Queries of the write path and its constraints over the typed workspace."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology as o
from ..functions import text
from ..operators import constraints, extract, graph, ordered, writepath
from ..sources import workspace
from ..sources.events import LOG_SQL, assertion_log
from ..sources.workspace import TRADED_SQL, WORKSPACE_SQL, WRITE_LOG_SQL
from .analytics import _checkpointed, _near_match, near_sql
from .governance import SINGLE

PLANS: dict = {}


def plan(name: str, sql: str | None = None, before: str = WORKSPACE_SQL):
    def keep(f):
        PLANS[name] = (f, before + sql if sql else sql)
        return f

    return keep


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _store(spark, d, traded=False):
    _checkpointed(spark)
    return workspace.candidates(spark, d), workspace.entities(spark, d), workspace.edges(spark, d, traded)


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_RANGE = " ".join(f"WHEN '{p}' THEN s_type IN ({_quoted(s)}) AND o_type IN ({_quoted(t)})" for p, s, t, _ in o.RELATIONS)
_CHANGES = ", ".join(f"('{a}', 'status:{b}')" for a, b in o.TRANSITIONS)
_EXAMINE = f""",
sup AS (SELECT object_id AS id, count(*) AS n FROM edge WHERE predicate = 'EVIDENCE_FOR' AND subject_id IN (SELECT id FROM ent WHERE entity_type IN ('Document', 'Event')) GROUP BY 1),
don AS (SELECT object_id AS id, count(*) AS n FROM edge WHERE predicate = 'RESULTS_IN' GROUP BY 1),
inc AS (SELECT c.seq, count(DISTINCT e.object_id) AS n_inc, max(e.pct) AS top, min(e.seq) AS incumbent FROM cand c JOIN edge e ON e.subject_id = c.subject_id AND e.predicate = c.predicate AND e.object_id <> c.object_id WHERE c.predicate IN {SINGLE} GROUP BY 1),
path(src, dst) AS (SELECT subject_id, object_id FROM edge WHERE predicate = 'PRECEDES' UNION SELECT p.src, e.object_id FROM path p JOIN edge e ON e.predicate = 'PRECEDES' AND e.subject_id = p.dst),
ex AS (
  SELECT c.*, TRY_CAST(c.confidence AS DOUBLE) AS value, round(100 * TRY_CAST(c.confidence AS DOUBLE)) AS pct,
    s.entity_type AS s_type, s.status AS s_status, s.ends_at < s.starts_at AS s_back, t.entity_type AS o_type, t.status AS o_status, t.ends_at < t.starts_at AS o_back,
    coalesce(ss.n, 0) AS s_sup, coalesce(os.n, 0) AS o_sup, coalesce(sd.n, 0) AS s_don, coalesce(od.n, 0) AS o_don, inc.n_inc, inc.top, inc.incumbent,
    (trim(c.source_ref) <> '')::BIGINT + coalesce(ss.n, 0) AS n_evidence,
    c.predicate = 'PRECEDES' AND (c.subject_id = c.object_id OR p.src IS NOT NULL) AS closes
  FROM cand c LEFT JOIN ent s ON s.id = c.subject_id LEFT JOIN ent t ON t.id = c.object_id
  LEFT JOIN sup ss ON ss.id = c.subject_id LEFT JOIN sup os ON os.id = c.object_id LEFT JOIN don sd ON sd.id = c.subject_id LEFT JOIN don od ON od.id = c.object_id
  LEFT JOIN inc ON inc.seq = c.seq LEFT JOIN path p ON c.predicate = 'PRECEDES' AND p.src = c.object_id AND p.dst = c.subject_id
),
chk AS (
  SELECT *, pct > 80 AND top > 80 AS blocked, write_intent = 'correction' AND pct - top > 10 AND n_evidence >= 1 AS dominates,
  CASE WHEN claimed_type <> s_type THEN 'C1' WHEN coalesce(s_back, false) OR coalesce(o_back, false) THEN 'C2' WHEN closes THEN 'C3'
    WHEN (s_type = 'Task' AND s_status = 'done' AND s_don = 0) OR (o_type = 'Task' AND o_status = 'done' AND o_don = 0) THEN 'C4'
    WHEN predicate = 'ASSIGNED_TO' AND o_type = 'Person' AND o_status = 'inactive' THEN 'C5' WHEN value IS NULL OR value NOT BETWEEN 0 AND 1 THEN 'C6' WHEN pct > 80 AND top > 80 THEN 'C7'
    WHEN (s_type = 'Decision' AND s_status = 'final' AND s_sup = 0) OR (o_type = 'Decision' AND o_status = 'final' AND o_sup = 0) THEN 'C8'
    WHEN NOT coalesce(CASE predicate {_RANGE} END, false) THEN 'C9'
    WHEN predicate = 'HAS_STATUS' AND s_type = 'Task' AND write_intent <> 'correction' AND coalesce('status:' || s_status <> object_id AND (s_status, object_id) NOT IN ({_CHANGES}), true) THEN 'C10' END AS failed
  FROM ex
) """
_WS = WORKSPACE_SQL.replace("WITH ent", "WITH RECURSIVE ent")
_TRADED_WS = TRADED_SQL.replace("WITH ent", "WITH RECURSIVE ent")


# The log in order: what each row alone decides, then one step of a recursion a row of its group, whose state is lists of active values, contradictions and evidence.
_MEET = "(NOT {a}.dated OR NOT {b}.dated OR ({a}.lo <= {b}.hi AND {b}.lo <= {a}.hi))".format
_LO, _HI = "coalesce(valid_from, TIMESTAMP '0001-01-01')", "coalesce(valid_to, TIMESTAMP '9999-01-01')"
_CLAIMS = """CASE WHEN subject_id LIKE 'C%' OR object_id LIKE 'C%' THEN 'C' || (CAST(CASE WHEN subject_id LIKE 'C%' THEN subject_id ELSE object_id END [2:] AS BIGINT) // 10)
  WHEN predicate = 'EVIDENCE_FOR' THEN object_id ELSE subject_id END"""
_ORDERED = WRITE_LOG_SQL + f""",
sup AS (SELECT object_id AS id, count(*) AS n FROM ledge WHERE predicate = 'EVIDENCE_FOR' AND subject_id IN (SELECT id FROM lent WHERE entity_type IN ('Document', 'Event')) GROUP BY 1),
don AS (SELECT DISTINCT object_id AS id FROM ledge WHERE predicate = 'RESULTS_IN'),
one AS (
  SELECT c.*, TRY_CAST(c.confidence AS DOUBLE) AS value, CAST(round(100 * TRY_CAST(c.confidence AS DOUBLE)) AS BIGINT) AS pct, s.entity_type AS s_type, s.status AS s_status, t.entity_type AS o_type,
    CASE WHEN claimed_type <> s.entity_type THEN 'C1' WHEN coalesce(s.ends_at < s.starts_at, false) OR coalesce(t.ends_at < t.starts_at, false) THEN 'C2' END AS early,
    CASE WHEN (s.entity_type = 'Task' AND s.status = 'done' AND c.subject_id NOT IN (SELECT id FROM don)) OR (t.entity_type = 'Task' AND t.status = 'done' AND c.object_id NOT IN (SELECT id FROM don)) THEN 'C4'
      WHEN predicate = 'ASSIGNED_TO' AND t.entity_type = 'Person' AND t.status = 'inactive' THEN 'C5' WHEN value IS NULL OR value NOT BETWEEN 0 AND 1 THEN 'C6' END AS mid,
    CASE WHEN (s.entity_type = 'Decision' AND s.status = 'final' AND c.subject_id NOT IN (SELECT id FROM sup)) OR (t.entity_type = 'Decision' AND t.status = 'final' AND c.object_id NOT IN (SELECT id FROM sup)) THEN 'C8'
      WHEN NOT coalesce(CASE predicate {_RANGE} END, false) THEN 'C9'
      WHEN predicate = 'HAS_STATUS' AND s_type = 'Task' AND write_intent <> 'correction' AND coalesce('status:' || s_status <> object_id AND (s_status, object_id) NOT IN ({_CHANGES}), true) THEN 'C10' END AS late
  FROM llog c LEFT JOIN lent s ON s.id = c.subject_id LEFT JOIN lent t ON t.id = c.object_id
),
prow AS (
  SELECT seq, subject_id AS u, object_id AS v, mid IS NULL AND late IS NULL AS enters, CAST(subject_id[2:] AS BIGINT) // 48 AS blk, row_number() OVER (PARTITION BY CAST(subject_id[2:] AS BIGINT) // 48 ORDER BY seq) AS n
  FROM one WHERE predicate = 'PRECEDES' AND early IS NULL
),
base(u, v) AS (SELECT subject_id, object_id FROM ledge WHERE predicate = 'PRECEDES' UNION SELECT b.u, e.object_id FROM base b JOIN ledge e ON e.predicate = 'PRECEDES' AND e.subject_id = b.v),
ring AS (
  SELECT blk, CAST(0 AS BIGINT) AS n, coalesce(paths, []) AS paths, CAST(NULL AS BIGINT) AS seq, false AS closes
  FROM (SELECT DISTINCT blk FROM prow) LEFT JOIN (SELECT CAST(u[2:] AS BIGINT) // 48 AS blk, list([u, v]) AS paths FROM base GROUP BY 1) USING (blk)
  UNION ALL
  SELECT blk, n, CASE WHEN closes OR NOT enters THEN paths ELSE list_distinct(list_concat(paths, flatten(list_transform(
      list_prepend(u, list_transform(list_filter(paths, lambda p: p[2] = u), lambda p: p[1])), lambda x: list_transform(list_prepend(v, list_transform(list_filter(paths, lambda p: p[1] = v), lambda p: p[2])), lambda y: [x, y]))))) END, seq, closes
  FROM (SELECT r.*, g.paths, r.u = r.v OR list_contains(g.paths, [r.v, r.u]) AS closes FROM ring g JOIN prow r ON r.blk = g.blk AND r.n = g.n + 1)
),
lone AS (SELECT subject_id, predicate, object_id, min_by(pct, seq) AS pct, min_by(valid_from, seq) AS valid_from, min_by(valid_to, seq) AS valid_to, min(seq) AS seq FROM ledge GROUP BY 1, 2, 3),
item AS (
  SELECT {_CLAIMS} AS grp, predicate IN {SINGLE} AS single, {{'s': subject_id, 'p': predicate, 'o': object_id, 'pct': CAST(pct AS BIGINT), 'lo': {_LO}, 'hi': {_HI}, 'dated': valid_from IS NOT NULL OR valid_to IS NOT NULL, 'name': 's' || seq}} AS e
  FROM lone WHERE predicate IN {SINGLE} OR predicate = 'CONTRADICTS'
),
wrow AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS n FROM (
    SELECT {_CLAIMS} AS grp, seq, predicate IN {SINGLE} AS single, write_intent, late IS NOT NULL AS fails, trim(source_ref) <> '' AS sourced, s_type IN ('Document', 'Event') AS backs,
      {{'s': subject_id, 'p': predicate, 'o': object_id, 'pct': pct, 'lo': {_LO}, 'hi': {_HI}, 'dated': valid_from IS NOT NULL OR valid_to IS NOT NULL, 'name': 'w' || seq}} AS me
    FROM one WHERE early IS NULL AND mid IS NULL AND predicate <> 'PRECEDES')
),
fold AS (
  SELECT grp, CAST(0 AS BIGINT) AS n, coalesce(act, []) AS act, coalesce(con, []) AS con, coalesce(ev, []) AS ev, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS kind, CAST([] AS VARCHAR[]) AS retired
  FROM (SELECT DISTINCT grp FROM wrow) LEFT JOIN (SELECT grp, list(e) FILTER (single) AS act, list(e) FILTER (NOT single) AS con FROM item GROUP BY 1) USING (grp)
  LEFT JOIN (SELECT {_CLAIMS} AS grp, list([subject_id, object_id]) AS ev FROM lone WHERE predicate = 'EVIDENCE_FOR' AND subject_id IN (SELECT id FROM lent WHERE entity_type IN ('Document', 'Event')) GROUP BY 1) USING (grp)
  UNION ALL
  SELECT grp, n,
    CASE WHEN verdict = 'quarantine' OR NOT takes THEN act WHEN single AND (verdict = 'supersede' OR len(list_filter(act, lambda x: x.s = me.s AND x.p = me.p AND x.o = me.o)) = 0)
      THEN list_append(list_filter(act, lambda x: NOT list_contains(gone, x.name) AND NOT (x.s = me.s AND x.p = me.p AND x.o = me.o)), me) ELSE list_filter(act, lambda x: NOT list_contains(gone, x.name)) END,
    CASE WHEN verdict = 'quarantine' OR NOT takes THEN con WHEN me.p = 'CONTRADICTS' AND len(list_filter(con, lambda x: x.s = me.s AND x.o = me.o)) = 0 THEN list_append(con, me) ELSE list_filter(con, lambda x: NOT list_contains(gone, x.name)) END,
    CASE WHEN verdict = 'quarantine' OR NOT takes OR NOT coalesce(backs, false) OR me.p <> 'EVIDENCE_FOR' THEN ev ELSE list_distinct(list_append(ev, [me.s, me.o])) END,
    seq, verdict, kind, gone
  FROM (
    SELECT *, CASE WHEN verdict = 'supersede' THEN list_sort(list_transform(met, lambda x: x.name)) ELSE CAST([] AS VARCHAR[]) END AS gone, verdict = 'supersede' OR NOT fails AS takes FROM (
      SELECT *, CASE WHEN NOT blocked THEN 'pass' WHEN write_intent = 'correction' AND me.pct - top > 10 AND CAST(sourced AS BIGINT) + len(list_filter(ev, lambda x: x[2] = me.s)) >= 1 THEN 'supersede' ELSE 'quarantine' END AS verdict,
        CASE WHEN top IS NULL THEN 'none' WHEN NOT explicit AND len(list_filter(met, lambda x: NOT (x.dated AND me.dated))) = 0 THEN 'temporal' WHEN blocked THEN 'hard' ELSE 'soft' END AS kind FROM (
        SELECT *, list_max(list_transform(met, lambda x: x.pct)) AS top, coalesce(me.pct > 80 AND list_max(list_transform(met, lambda x: x.pct)) > 80, false) AS blocked FROM (
          SELECT * EXCLUDE (near), len(near) > 0 AS explicit, CASE WHEN len(near) > 0 THEN near WHEN single THEN list_filter(act, lambda x: x.s = me.s AND x.p = me.p AND x.o <> me.o AND {_MEET(a="x", b="me")}) ELSE near END AS met FROM (
            SELECT r.*, f.act, f.con, f.ev, CASE WHEN r.me.p = 'CONTRADICTS' THEN list_filter(f.con, lambda x: false) ELSE list_filter(f.con, lambda x: x.s IN (r.me.s, r.me.o) OR x.o IN (r.me.s, r.me.o)) END AS near
            FROM fold f JOIN wrow r ON r.grp = f.grp AND r.n = f.n + 1
  )))))
),
dec AS (
  SELECT seq, coalesce(early, CASE WHEN c.closes THEN 'C3' END, mid, CASE WHEN w.verdict <> 'pass' THEN 'C7' END, late) AS failed_check, w.verdict, coalesce(w.kind, 'none') AS kind, coalesce(w.retired, CAST([] AS VARCHAR[])) AS retired
  FROM one LEFT JOIN (SELECT seq, closes FROM ring WHERE seq IS NOT NULL) c USING (seq) LEFT JOIN (SELECT * FROM fold WHERE seq IS NOT NULL) w USING (seq)
),
fin AS (SELECT *, CASE WHEN failed_check IS NULL THEN 'accept' WHEN failed_check IN ('C1', 'C2', 'C3', 'C6', 'C9') THEN 'reject' WHEN failed_check = 'C7' AND verdict = 'supersede' THEN 'supersede' ELSE 'quarantine' END AS action FROM dec) """


def _log(spark, d):
    _checkpointed(spark)
    return workspace.write_log(spark, d), workspace.log_entities(spark, d), workspace.log_edges(spark, d)


@plan("constraint_validate", _ORDERED + " SELECT seq, failed_check, action, kind, array_to_string(list_sort(retired), ',') AS retired FROM fin", _WS)
def constraint_validate(spark, d):
    return ordered.decide(*_log(spark, d)).withColumn("retired", F.array_join(F.sort_array("retired"), ","))


@plan("simple_cycles", WRITE_LOG_SQL + """,
pe AS (SELECT DISTINCT subject_id AS src, object_id AS dst FROM (SELECT subject_id, object_id FROM llog WHERE predicate = 'PRECEDES' UNION ALL SELECT subject_id, object_id FROM ledge WHERE predicate = 'PRECEDES')),
walk AS (
  SELECT [src] AS path, dst, src = dst AS closed FROM pe
  UNION ALL
  SELECT list_append(path, w.dst), e.dst, e.dst = path[1] FROM walk w JOIN pe e ON e.src = w.dst WHERE NOT closed AND w.dst > path[1] AND NOT list_contains(path, w.dst) AND e.dst >= path[1] AND len(path) < 8
)
SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS BIGINT) AS n FROM walk WHERE closed""", _WS)
def simple_cycles(spark, d):
    # Cycles that the proposed orders of events would close among themselves and with the store's.
    log, _, edges = _log(spark, d)
    both = graph.predicate_subgraph(log, "PRECEDES").unionByName(graph.predicate_subgraph(edges, "PRECEDES"))
    return graph.simple_cycles(both).select(F.array_join("cycle", ">").alias("cycle"), F.size("cycle").cast("long").alias("n"))


@plan("contradiction_kinds", _ORDERED + " SELECT kind, action, count(*) AS n, CAST(sum(len(retired)) AS BIGINT) AS retired FROM fin GROUP BY 1, 2", _WS)
def contradiction_kinds(spark, d):
    return ordered.decide(*_log(spark, d)).groupBy("kind", "action").agg(F.count("*").alias("n"), F.sum(F.size("retired")).alias("retired"))


@plan("constraint_snapshot", _EXAMINE + """ SELECT seq, failed AS failed_check, CASE WHEN failed IS NULL THEN 'accept' WHEN failed IN ('C1', 'C2', 'C3', 'C6', 'C9') THEN 'reject' WHEN failed = 'C7' AND dominates THEN 'supersede' ELSE 'quarantine' END AS action FROM chk""", _WS)
def constraint_snapshot(spark, d):
    return constraints.constraint_validate(*_store(spark, d))


@plan("validate_only", _EXAMINE + f""", w AS (SELECT seq, CASE WHEN trim(source_ref) = '' THEN 'required_fields' WHEN predicate NOT IN ({_quoted(o.PREDICATES)}) THEN 'predicate' WHEN value IS NULL OR value NOT BETWEEN 0 AND 1 THEN 'confidence'
 WHEN s_type IS NULL OR o_type IS NULL THEN 'endpoints' END AS w5, failed AS w6, CASE WHEN n_inc > 0 THEN 'single_valued_conflict' END AS w7 FROM chk)
SELECT seq, CASE WHEN w5 IS NOT NULL THEN 'W5' WHEN w6 IS NOT NULL THEN 'W6' WHEN w7 IS NOT NULL THEN 'W7' ELSE 'ok' END AS stage, coalesce(w5, w6, w7) AS failed_check FROM w""", _WS)
def validate_only(spark, d):
    return constraints.validate_only(*_store(spark, d))


@plan("evidence_units", _EXAMINE + " SELECT seq, n_evidence FROM ex", _TRADED_WS)
def evidence_units(spark, d):
    c, e, g = _store(spark, d, traded=True)
    return constraints.evidence_units(c, g, e).select("seq", "n_evidence")


# A candidate's edges are those at its two nodes; each node lists its edges once, whoever shares it.
@plan("accepted_neighbourhood", """, c AS (SELECT DISTINCT seq, unnest([subject_id, object_id]) AS node FROM cand), e AS (SELECT DISTINCT seq, pct, unnest([subject_id, object_id]) AS node FROM edge),
n AS (SELECT c.seq, count(DISTINCT e.seq) AS n_edges, max(e.pct) AS pct FROM c LEFT JOIN e USING (node) GROUP BY 1)
SELECT 'candidate' AS part, seq, node, n_edges, pct FROM c JOIN n USING (seq) UNION ALL SELECT 'edge', seq, node, NULL, pct FROM e WHERE node IN (SELECT node FROM c)""", TRADED_SQL)
def accepted_neighbourhood(spark, d):
    c, _, g = _store(spark, d, traded=True)
    return constraints.neighbourhood_edges(c, g)


@plan("typed_violations", f""", sup AS (SELECT object_id AS id FROM edge WHERE predicate = 'EVIDENCE_FOR' AND subject_id IN (SELECT id FROM ent WHERE entity_type IN ('Document', 'Event'))), don AS (SELECT object_id AS id FROM edge WHERE predicate = 'RESULTS_IN'),
a AS (SELECT e.*, s.entity_type AS s_type, t.entity_type AS o_type, coalesce(s.ends_at < s.starts_at, false) OR coalesce(t.ends_at < t.starts_at, false) AS back, CASE WHEN predicate = 'HAS_STATUS' THEN object_id[8:] END AS value FROM edge e LEFT JOIN ent s ON s.id = e.subject_id LEFT JOIN ent t ON t.id = e.object_id)
SELECT seq, CASE WHEN s_type IS NOT NULL AND o_type IS NOT NULL AND NOT CASE predicate {_RANGE} END THEN 'schema_invalid' WHEN back THEN 'temporally_invalid_interval' WHEN s_type = 'Decision' AND value = 'final' AND subject_id NOT IN (SELECT id FROM sup) THEN 'unsupported_final_decision'
 WHEN s_type = 'Task' AND value = 'done' AND subject_id NOT IN (SELECT id FROM don) THEN 'illegal_status_state'
 WHEN s_type = 'Task' AND value IS NOT NULL AND EXISTS (SELECT 1 FROM a b WHERE b.subject_id = a.subject_id AND b.value IN ('done', 'cancelled') AND b.value <> a.value) THEN 'illegal_status_state' ELSE 'none' END AS kind FROM a""", TRADED_SQL)
def typed_violations(spark, d):
    _, e, g = _store(spark, d, traded=True)
    return constraints.typed_violations(_flipped(g), e)


# A third of the tasks with a status hold a second one, so that histories are met.
_FLIP = """, edge AS (SELECT * FROM edge0 UNION ALL SELECT seq + 1, subject_id, predicate, 'status:done', pct FROM edge0 WHERE predicate = 'HAS_STATUS' AND seq % 9 = 2)"""
PLANS["typed_violations"] = (PLANS["typed_violations"][0], PLANS["typed_violations"][1].replace("edge AS (\n", "edge0 AS (\n").replace("),\ncand AS", ")" + _FLIP + ",\ncand AS"))


def _flipped(g):
    more = g.where("predicate = 'HAS_STATUS' and seq % 9 = 2").withColumn("seq", F.col("seq") + 1).withColumn("object_id", F.lit("status:done"))
    return g.unionByName(more)


@plan("terminal_status_history", """ SELECT subject_id, string_agg(DISTINCT object_id[8:], ',' ORDER BY object_id[8:]) AS statuses FROM edge WHERE predicate = 'HAS_STATUS' GROUP BY 1""")
def terminal_status_history(spark, d):
    return constraints.terminal_history(_flipped(workspace.edges(spark, d)))


PLANS["terminal_status_history"] = (terminal_status_history, PLANS["terminal_status_history"][1].replace("edge AS (\n", "edge0 AS (\n").replace("),\ncand AS", ")" + _FLIP + ",\ncand AS"))


@plan("w2_normalize", """ SELECT o_orderkey AS ref, 'Task ' || o_orderkey || ' of ACME' AS name,
 CASE o_orderkey % 4 WHEN 0 THEN 'todo' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'blocked' END AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE substr(o_orderpriority, 3) END AS priority,
 CASE o_orderkey % 3 WHEN 0 THEN 'ASSIGNED_TO' WHEN 1 THEN 'OWNS' ELSE 'LIKES_IT' END AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE (o_orderkey % 100) / 100.0 END::DOUBLE AS confidence FROM orders""", " ")
def w2_normalize(spark, d):
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    rows = _read(spark, d, "orders").select(
        k.alias("ref"), F.lit("Task").alias("entity_type"), F.concat(F.lit("  task  "), k, F.lit(" OF ACME ")).alias("name"), pick(4, "To  do", "WIP", "on hold", " n/a ").alias("status"), F.substring("o_orderpriority", 3, 99).alias("priority"),
        F.lit("x").alias("subject"), pick(3, "is assigned  to", "Owner of", "likes-it").alias("predicate"), F.lit("y").alias("object"), F.when(k % 2 == 0, "High").otherwise(F.concat(k % 100, F.lit("%"))).alias("confidence"),
    )
    df = writepath.normalize_relations(writepath.normalize_entities(rows))
    return df.select("ref", F.replace("name", F.lit("OF"), F.lit("of")).alias("name"), "status", "priority", "predicate", "confidence")


@plan("w4_build_candidate", """ SELECT seq, coalesce(CASE WHEN k % 6 <> 0 THEN write_intent END, 'new_fact') AS write_intent, 'ast_' || left(sha1(subject_id || '|' || predicate || '|' || object_id || '|' || source_ref), 12) AS assertion_id FROM alog WHERE trim(source_ref) <> ''""", LOG_SQL)
def w4_build_candidate(spark, d):
    log = assertion_log(spark, d).withColumn("write_intent", F.when(F.col("k") % 6 == 0, " None ").otherwise(F.col("write_intent")))
    return writepath.build_candidates(log)[0].select("seq", "write_intent", "assertion_id")


@plan("possibly_same_as", near_sql("SELECT l_id AS subject_id, 'POSSIBLY_SAME_AS' AS predicate, r_id AS object_id, 0.5::DOUBLE AS confidence, part FROM"), "")
def possibly_same_as(spark, d):
    return writepath.same_as_links(_near_match(spark, d))


@plan("persist_entities", """ WITH r AS (SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'dec_' || left(sha1(lower(trim('Plan ' || (o_custkey % 40)))), 12) WHEN 1 THEN 'T' || (o_custkey * 10) ELSE 'P' || (o_custkey + 200) END AS id,
 CASE o_orderkey % 3 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Task' ELSE 'Person' END AS entity_type, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'active' END AS status FROM orders),
l AS (SELECT id, arg_max(entity_type, seq) AS entity_type, arg_max(status, seq) AS status FROM r GROUP BY 1), k AS (SELECT 'P' || c_custkey AS id FROM customer UNION SELECT 'T' || o_orderkey FROM orders WHERE o_orderkey < 5000),
n AS (SELECT *, id NOT IN (SELECT id FROM k) AS is_new FROM l)
SELECT id, entity_type, is_new, CASE WHEN is_new AND entity_type = 'Task' AND status = 'done' THEN NULL ELSE status END AS status, CASE WHEN is_new AND entity_type = 'Task' AND status = 'done' THEN 'done' END AS deferred_status FROM n""", "")
def persist_entities(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit(" Plan "), F.col("o_custkey") % 40)
    rows = _read(spark, d, "orders").select(
        k.alias("seq"), F.when(k % 3 == 1, F.concat(F.lit("T"), F.col("o_custkey") * 10)).otherwise(F.concat(F.lit("P"), F.col("o_custkey") + 200)).alias("id"),
        F.element_at(F.array(F.lit("Decision"), F.lit("Task"), F.lit("Person")), (k % 3 + 1).cast("int")).alias("entity_type"), name.alias("name"), F.when(k % 2 == 0, "done").otherwise("active").alias("status"),
    )
    # The store holds the people and the older tasks.
    known = _read(spark, d, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("id")).unionByName(_read(spark, d, "orders").where("o_orderkey < 5000").select(F.concat(F.lit("T"), "o_orderkey").alias("id")))
    return writepath.persist_entities(rows, known).select("id", "entity_type", "is_new", "status", "deferred_status")


_TASKS, _OTHER = ("todo", "in_progress", "blocked", "done", "cancelled"), {"Decision": ("draft", "final", "rejected"), "Person": ("active", "inactive", "unknown")}
_STATUS_WRITES = f""" WITH RECURSIVE w AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 < 2 THEN 'Task' WHEN o_orderkey % 4 = 2 THEN 'Decision' ELSE 'Person' END AS ty, o_orderkey // 4 % 400 AS n,
 CASE WHEN o_orderkey % 4 < 2 THEN [{_quoted(_TASKS)}][o_custkey % 5 + 1] WHEN o_orderkey % 4 = 2 THEN [{_quoted(_OTHER["Decision"])}][o_custkey % 3 + 1] ELSE [{_quoted(_OTHER["Person"])}][o_custkey % 3 + 1] END AS want,
 CASE o_orderkey % 5 WHEN 0 THEN 'correction' WHEN 1 THEN 'update' ELSE 'new_fact' END AS intent FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY ty, n ORDER BY seq) AS rn FROM w),
f AS (
  SELECT ty, n, 0::BIGINT AS rn, NULL::BIGINT AS seq, 'unknown' AS cur, NULL::BIGINT AS cur_seq, 'start' AS action, NULL::BIGINT AS retired FROM (SELECT DISTINCT ty, n FROM w)
  UNION ALL
  SELECT ty, n, rn, seq, CASE WHEN action IN ('accept', 'supersede') THEN want ELSE cur END, CASE WHEN action IN ('accept', 'supersede') THEN seq ELSE cur_seq END, action, CASE WHEN action = 'supersede' THEN cur_seq END
  FROM (
    SELECT r.*, f.cur, f.cur_seq, CASE WHEN r.want = f.cur THEN 'none'
      WHEN (r.ty = 'Task' AND r.want = 'done' AND r.n % 2 = 1) OR (r.ty = 'Decision' AND r.want = 'final' AND r.n % 3 <> 0) THEN 'quarantine'
      WHEN (r.ty = 'Task' AND r.want = 'done') OR (r.ty = 'Decision' AND r.want = 'final') THEN CASE WHEN f.cur_seq IS NULL THEN 'accept' ELSE 'supersede' END
      WHEN f.cur = 'unknown' THEN 'accept'
      WHEN r.ty = 'Task' THEN CASE WHEN r.intent = 'correction' OR (f.cur, r.want) IN ({", ".join(f"('{a}', '{b}')" for a, b in o.TRANSITIONS)}) THEN 'supersede' ELSE 'quarantine' END
      WHEN r.intent IN ('update', 'correction') THEN 'supersede' ELSE 'quarantine' END AS action
    FROM f JOIN r ON r.ty = f.ty AND r.n = f.n AND r.rn = f.rn + 1)
),
dec AS (SELECT * FROM f WHERE rn > 0) """


def _status_decisions(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (c % len(words) + 1).cast("int"))
    kind = F.when(k % 4 < 2, "Task").when(k % 4 == 2, "Decision").otherwise("Person")
    n = F.floor(k / 4) % 400
    w = _read(spark, d, "orders").select(
        k.alias("seq"), kind.alias("entity_type"), F.concat(kind, n).alias("entity_id"), F.when(k % 4 < 2, of(_TASKS)).when(k % 4 == 2, of(_OTHER["Decision"])).otherwise(of(_OTHER["Person"])).alias("desired"),
        F.when(k % 5 == 0, "correction").when(k % 5 == 1, "update").otherwise("new_fact").alias("write_intent"), (n % 2 == 0).alias("has_completion"), (n % 3 == 0).alias("has_evidence"),
    )
    return writepath.reconcile_statuses(w)


@plan("status_reconcile", _STATUS_WRITES + " SELECT seq, action, retired FROM dec", "")
def status_reconcile(spark, d):
    return _status_decisions(spark, d)


@plan("status_commit_state", _STATUS_WRITES + """, l AS (SELECT retired, min(seq) AS by_seq FROM dec WHERE action = 'supersede' AND retired IS NOT NULL GROUP BY 1)
SELECT seq, CASE WHEN (action = 'accept' OR (action = 'supersede' AND dec.retired IS NOT NULL)) THEN CASE WHEN by_seq IS NOT NULL THEN 'superseded' ELSE 'accepted' END WHEN action = 'reject' THEN 'rejected' ELSE 'quarantined' END AS status, by_seq AS superseded_by
FROM dec LEFT JOIN l ON l.retired = dec.seq WHERE action <> 'none'""", "")
def status_commit_state(spark, d):
    return writepath.commit(_status_decisions(spark, d))


@plan("w8_commit_state", _ORDERED + """, gone AS (SELECT name, max_by('w' || seq, seq) AS by_name FROM (SELECT seq, unnest(retired) AS name FROM fin) GROUP BY 1)
SELECT name, CASE WHEN by_name IS NOT NULL THEN 'superseded' ELSE status END AS status, by_name AS superseded_by FROM (
  SELECT 'w' || seq AS name, CASE WHEN action IN ('accept', 'supersede') THEN 'accepted' WHEN action = 'reject' THEN 'rejected' ELSE 'quarantined' END AS status FROM fin UNION ALL SELECT 's' || seq, 'accepted' FROM ledge) LEFT JOIN gone USING (name)""", _WS)
def w8_commit_state(spark, d):
    log, entities, edges = _log(spark, d)
    return ordered.state_after(ordered.decide(log, entities, edges), edges)


@plan("supersedes_links", _STATUS_WRITES + " SELECT seq AS subject_id, 'SUPERSEDES' AS predicate, retired AS object_id FROM dec WHERE action = 'supersede' AND retired IS NOT NULL", "")
def supersedes_links(spark, d):
    return writepath.supersedes_links(_status_decisions(spark, d))


@plan("manual_write", """ SELECT 'ast_' || left(sha1('T8|ASSIGNED_TO|P7|analyst:1'), 12) AS assertion_id, 'T8' AS subject_id, 'ASSIGNED_TO' AS predicate, 'P7' AS object_id, 1.0::DOUBLE AS confidence, 'analyst:1' AS source_ref, 'accepted' AS status WHERE (SELECT count(DISTINCT id) FROM ent WHERE id IN ('T8', 'P7')) = 2""")
def manual_write(spark, d):
    return writepath.manual_write(workspace.entities(spark, d), "T8", "ASSIGNED_TO", "P7", "analyst:1")[1]


@plan("strict_extractor", """ SELECT CASE WHEN k % 6 = 0 OR k % 6 = 1 OR k % 6 = 2 THEN 'environment' WHEN k % 6 = 3 THEN 'model' ELSE 'none' END AS fault, count(*) AS n FROM alog GROUP BY 1""", LOG_SQL)
def strict_extractor(spark, d):
    k = F.col("k") % 6
    a = assertion_log(spark, d).select(F.when(k == 0, F.lit(503)).when(k == 1, F.lit(429)).when(k > 2, F.lit(200)).alias("status_code"), F.when(k == 3, "no json {").otherwise('{"facts": []}').alias("body"))
    return writepath.strict_errors(a).groupBy("fault").agg(F.count("*").alias("n"))


@plan("extraction_cache", """ SELECT count(*) FILTER (doc_id % 3 = 0) AS known, count(*) FILTER (doc_id % 3 <> 0) AS asked FROM documents WHERE text IS NOT NULL""", "")
def extraction_cache(spark, d):
    r = _read(spark, d, "documents").where("text is not null").select("doc_id", F.lit("m1").alias("model"), F.concat("doc_id", "text").alias("prompt"))
    key = F.sha2(F.concat_ws("\x1f", "model", "prompt"), 256).alias("key")
    hit, ask = writepath.memoised(r, r.where("doc_id % 3 = 0").select(key, F.lit("a").alias("answer")))
    return hit.agg(F.count("*").alias("known")).crossJoin(F.broadcast(ask.agg(F.count("*").alias("asked"))))


@plan("oracle_extractor", """ SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN 'label' END AS fact FROM documents LEFT JOIN labels USING (doc_id)""", "")
def oracle_extractor(spark, d):
    t = _read(spark, d, "documents").select(F.col("doc_id").alias("source_ref"))
    f = _read(spark, d, "labels").select(F.col("doc_id").alias("source_ref"), F.when(F.col("toxic").isNotNull(), "label").alias("fact"))
    return writepath.oracle_extract(t, f).select(F.col("source_ref").alias("doc_id"), "fact")


@plan("extractor_canonical_sort", """ SELECT k AS source_ref, string_agg(f, ';' ORDER BY f) AS facts FROM (SELECT DISTINCT k, predicate || ' ' || subject_id || ' ' || object_id AS f FROM alog) GROUP BY 1""", LOG_SQL)
def extractor_canonical_sort(spark, d):
    facts = assertion_log(spark, d).select(F.col("k").alias("source_ref"), F.col("subject_id").alias("subject"), "predicate", F.col("object_id").alias("object")).distinct()
    line = F.transform("facts", lambda f: F.concat_ws(" ", f["predicate"], f["subject"], f["object"]))
    return writepath.canonical_sections(facts).select("source_ref", F.array_join(line, ";").alias("facts"))
