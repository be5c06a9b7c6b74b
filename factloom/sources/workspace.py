"""A typed store derived from the TPC-H-like tables: entities, accepted edges and candidate writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _name(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), F.col(number) if isinstance(number, str) else number)


def entities(spark: SparkSession, d: str) -> DataFrame:
    """id, entity_type, name, status, starts_at, ends_at."""
    none, when = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    c, o, p, s, n = (_read(spark, d, t) for t in ("customer", "orders", "part", "supplier", "nation"))
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("todo")
    end = F.when(k % 13 != 0, F.col("o_orderdate") + F.make_dt_interval((k % 11 - 1).cast("int")))

    def rows(df, prefix, key, kind, name, status=none, starts=when, ends=when):
        return df.select(_name(prefix, key).alias("id"), F.lit(kind).alias("entity_type"), name.alias("name"), status.alias("status"), starts.alias("starts_at"), ends.alias("ends_at"))

    parts = [
        rows(c, "P", "c_custkey", "Person", F.col("c_name"), F.when(F.col("c_custkey") % 7 == 0, "inactive").otherwise("active")),
        rows(o, "T", "o_orderkey", "Task", _name("Task ", "o_orderkey"), state),
        rows(o, "E", "o_orderkey", "Event", _name("Event ", "o_orderkey"), none, F.col("o_orderdate"), end),
        rows(p, "D", "p_partkey", "Decision", F.col("p_name"), F.when(F.col("p_size") > 25, "final").otherwise("draft")),
        rows(s, "S", "s_suppkey", "Document", F.col("s_name")),
        rows(c, "K", "c_custkey", "Slot", _name("slot ", "c_custkey")),
        rows(n, "V", "n_nationkey", "SlotValue", F.col("n_name")),
        rows(n.select(F.element_at(F.array(*[F.lit(x) for x in ("todo", "in_progress", "blocked", "done", "final")]), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("v")).distinct(), "status:", "v", "StatusValue", F.col("v")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def edges(spark: SparkSession, d: str, traded: bool = False) -> DataFrame:
    """Accepted rows: seq, subject_id, predicate, object_id, pct; ``traded``: evidence is every pair of supplier and part in ``lineitem``."""
    o = _read(spark, d, "orders")
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("todo")

    def rows(df, seq, subject, predicate, obj, pct):
        return df.select(seq.cast("long").alias("seq"), subject.alias("subject_id"), F.lit(predicate).alias("predicate"), obj.alias("object_id"), pct.cast("long").alias("pct"))

    p = F.col("p_partkey")
    backed = rows(_read(spark, d, "part").where(p % 3 != 0), p * 8 + 2, _name("S", p % 10), "EVIDENCE_FOR", _name("D", "p_partkey"), F.lit(90))
    if traded:
        l = _read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
        backed = rows(l, F.col("l_suppkey") * 10_000_000_000 + F.col("l_partkey") * 8 + 2, _name("S", "l_suppkey"), "EVIDENCE_FOR", _name("D", "l_partkey"), F.lit(90))
    return (
        rows(o.where(k % 2 == 0), k * 8 + 1, _name("E", "o_orderkey"), "RESULTS_IN", _name("T", "o_orderkey"), F.lit(90))
        .unionByName(backed)
        .unionByName(rows(o.where(k % 4 != 0), k * 8 + 3, _name("T", "o_orderkey"), "ASSIGNED_TO", _name("P", "o_custkey"), k % 50 + 50))
        .unionByName(rows(o.where(k % 4 != 3), k * 8 + 4, _name("E", "o_orderkey"), "PRECEDES", _name("E", k + 1), F.lit(85)))
        .unionByName(rows(o.where(k % 3 == 0), k * 8 + 5, _name("T", "o_orderkey"), "HAS_STATUS", _name("status:", state), F.lit(95)))
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """seq, subject_id, predicate, object_id, confidence (as text), source_ref, write_intent, claimed_type: one write an order."""
    k = F.col("o_orderkey")
    by = lambda *v: F.element_at(F.array(*v), (k % 8 + 1).cast("int"))
    T, E, K = _name("T", "o_orderkey"), _name("E", "o_orderkey"), _name("K", "o_custkey")
    D, P = _name("D", k % 2100), _name("P", F.col("o_custkey") + 3)
    return _read(spark, d, "orders").select(
        k.alias("seq"),
        by(T, E, T, _name("S", k % 120), D, K, P, T).alias("subject_id"),
        by(*[F.lit(x) for x in ("ASSIGNED_TO", "PRECEDES", "HAS_STATUS", "EVIDENCE_FOR", "HAS_STATUS", "HAS_VALUE", "ASSIGNED_TO", "LIKES")]).alias("predicate"),
        by(P, _name("E", k - 1 - F.floor(k / 8) % 2 * 4), F.lit("status:done"), D, F.lit("status:final"), _name("V", k % 25), T, P).alias("object_id"),
        F.when(k % 17 == 0, "high").otherwise(F.concat((k % 103).cast("string"), F.lit("e-2"))).alias("confidence"),
        F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit("analyst:"), k)).otherwise(F.concat(F.lit("tool:"), k)).alias("source_ref"),
        F.when(k % 5 == 0, "correction").when(k % 5 == 1, "update").otherwise("new_fact").alias("write_intent"),
        F.when(k % 29 == 0, "Task").alias("claimed_type"),
    )


def log_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities, with a claim a part; each 31st task has no status."""
    e = entities(spark, d)
    number = F.substring("id", 2, 20).try_cast("long")
    e = e.withColumn("status", F.when(~((F.col("entity_type") == "Task") & F.coalesce(number % 31 == 0, F.lit(False))), F.col("status")))
    none = F.lit(None)
    claims = _read(spark, d, "part").select(_name("C", "p_partkey").alias("id"), F.lit("Claim").alias("entity_type"), F.col("p_name").alias("name"), none.cast("string").alias("status"), none.cast("timestamp").alias("starts_at"), none.cast("timestamp").alias("ends_at"))
    return e.unionByName(claims)


def log_edges(spark: SparkSession, d: str) -> DataFrame:
    """The accepted rows with validity windows, slot values and contradictions of claims beside them."""
    never = F.lit(None).cast("timestamp")
    e = edges(spark, d).withColumns({"valid_from": never, "valid_to": never})
    c, p = F.col("c_custkey"), F.col("p_partkey")
    day = lambda x: F.when(c % 2 == 1, F.lit(x).cast("timestamp"))
    held = _read(spark, d, "customer").select((c * 8 + 6).cast("long").alias("seq"), _name("K", "c_custkey").alias("subject_id"), F.lit("HAS_VALUE").alias("predicate"), _name("V", "c_nationkey").alias("object_id"), (c % 30 + 70).cast("long").alias("pct"), day("1995-01-01").alias("valid_from"), day("1996-06-30").alias("valid_to"))
    against = _read(spark, d, "part").where(p % 20 == 0).select((p * 8 + 7).cast("long").alias("seq"), _name("C", "p_partkey").alias("subject_id"), F.lit("CONTRADICTS").alias("predicate"), _name("C", p + 1).alias("object_id"), (p % 41 + 60).cast("long").alias("pct"), never.alias("valid_from"), never.alias("valid_to"))
    return e.unionByName(held).unionByName(against)


def write_log(spark: SparkSession, d: str) -> DataFrame:
    """An ordered log, one write an order: several writes a key, claims that contradict each other, rings of PRECEDES; seq, what ``candidates`` has, and a window."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    i, turn, block = k % 48, F.floor(k / 12), F.col("o_orderkey") - F.col("o_orderkey") % 48
    claim = lambda n: _name("C", F.floor(k / 120) * 10 + n)
    station = lambda n: _name("E", block + 1 + n % 48)
    by = lambda *v: F.element_at(F.array(*v), (k % 12 + 1).cast("int"))
    word = F.concat(F.lit("status:"), F.element_at(F.array(*[F.lit(x) for x in ("todo", "in_progress", "blocked", "done", "final")]), (turn % 5 + 1).cast("int")))
    task = F.when(k % 24 == 3, _name("T", block + 6)).otherwise(_name("D", F.floor(k / 24) % 200))
    backed = F.when(k % 24 == 11, _name("D", F.floor(k / 24) % 200)).otherwise(_name("P", "o_custkey"))
    start = F.when(turn % 3 != 0, F.col("o_orderdate").cast("timestamp"))
    return _read(spark, d, "orders").select(
        k.alias("seq"),
        by(_name("T", block + 2), _name("E", "o_orderkey"), station(i - 2 + 24), task, _name("K", "o_custkey"), _name("K", "o_custkey"), claim(k % 10), claim(k % 7), _name("S", k % 10), claim(turn % 10), claim(k % 8), _name("S", k % 10)).alias("subject_id"),
        by(*[F.lit(x) for x in ("ASSIGNED_TO", "PRECEDES", "PRECEDES", "HAS_STATUS", "HAS_VALUE", "HAS_VALUE", "CONTRADICTS", "SUPPORTS", "EVIDENCE_FOR", "HAS_STATUS", "ABOUT", "EVIDENCE_FOR")]).alias("predicate"),
        by(_name("P", c + 3), station(i - 1 + 12), _name("E", k - 1), word, _name("V", k % 25), _name("V", k % 25), claim((k * 3 + 1) % 10), claim(k % 3), claim(k % 9), word, _name("P", "o_custkey"), backed).alias("object_id"),
        F.when(k % 61 == 0, "high").when(k % 67 == 0, "1.5").otherwise(F.concat((k * 37 % 41 + 60).cast("string"), F.lit("e-2"))).alias("confidence"),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("tool:"), k)).alias("source_ref"),
        F.element_at(F.array(*[F.lit(x) for x in ("correction", "correction", "update", "new_fact")]), (turn % 4 + 1).cast("int")).alias("write_intent"),
        F.when(k % 97 == 0, "Task").alias("claimed_type"),
        start.alias("valid_from"),
        F.when((turn % 3 == 1) | (k % 5 > 0), start + F.make_dt_interval((k % 40).cast("int"))).alias("valid_to"),
    )


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in_progress' ELSE 'todo' END"
#: The same tables for DuckDB, to be put before an oracle's query.
WORKSPACE_SQL = f"""
WITH ent AS (
  SELECT 'P' || c_custkey AS id, 'Person' AS entity_type, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'inactive' ELSE 'active' END AS status, NULL::TIMESTAMP AS starts_at, NULL::TIMESTAMP AS ends_at FROM customer
  UNION ALL SELECT 'T' || o_orderkey, 'Task', 'Task ' || o_orderkey, {_STATE}, NULL, NULL FROM orders
  UNION ALL SELECT 'E' || o_orderkey, 'Event', 'Event ' || o_orderkey, NULL, o_orderdate, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 11 - 1 AS INTEGER)) END FROM orders
  UNION ALL SELECT 'D' || p_partkey, 'Decision', p_name, CASE WHEN p_size > 25 THEN 'final' ELSE 'draft' END, NULL, NULL FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'Document', s_name, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'K' || c_custkey, 'Slot', 'slot ' || c_custkey, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'V' || n_nationkey, 'SlotValue', n_name, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'status:' || v, 'StatusValue', v, NULL, NULL, NULL FROM (SELECT DISTINCT ['todo', 'in_progress', 'blocked', 'done', 'final'][n_nationkey % 5 + 1] AS v FROM nation)
),
edge AS (
  SELECT o_orderkey * 8 + 1 AS seq, 'E' || o_orderkey AS subject_id, 'RESULTS_IN' AS predicate, 'T' || o_orderkey AS object_id, 90 AS pct FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT p_partkey * 8 + 2, 'S' || (p_partkey % 10), 'EVIDENCE_FOR', 'D' || p_partkey, 90 FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT o_orderkey * 8 + 3, 'T' || o_orderkey, 'ASSIGNED_TO', 'P' || o_custkey, o_orderkey % 50 + 50 FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT o_orderkey * 8 + 4, 'E' || o_orderkey, 'PRECEDES', 'E' || (o_orderkey + 1), 85 FROM orders WHERE o_orderkey % 4 <> 3
  UNION ALL SELECT o_orderkey * 8 + 5, 'T' || o_orderkey, 'HAS_STATUS', 'status:' || {_STATE}, 95 FROM orders WHERE o_orderkey % 3 = 0
),
cand AS (
  SELECT o_orderkey AS seq,
    CASE o_orderkey % 8 WHEN 1 THEN 'E' || o_orderkey WHEN 3 THEN 'S' || (o_orderkey % 120) WHEN 4 THEN 'D' || (o_orderkey % 2100) WHEN 5 THEN 'K' || o_custkey WHEN 6 THEN 'P' || (o_custkey + 3) ELSE 'T' || o_orderkey END AS subject_id,
    ['ASSIGNED_TO', 'PRECEDES', 'HAS_STATUS', 'EVIDENCE_FOR', 'HAS_STATUS', 'HAS_VALUE', 'ASSIGNED_TO', 'LIKES'][o_orderkey % 8 + 1] AS predicate,
    CASE o_orderkey % 8 WHEN 1 THEN 'E' || (o_orderkey - 1 - o_orderkey // 8 % 2 * 4) WHEN 2 THEN 'status:done' WHEN 3 THEN 'D' || (o_orderkey % 2100) WHEN 4 THEN 'status:final' WHEN 5 THEN 'V' || (o_orderkey % 25) WHEN 6 THEN 'T' || o_orderkey ELSE 'P' || (o_custkey + 3) END AS object_id,
    CASE WHEN o_orderkey % 17 = 0 THEN 'high' ELSE (o_orderkey % 103) || 'e-2' END AS confidence,
    CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'analyst:' || o_orderkey ELSE 'tool:' || o_orderkey END AS source_ref,
    CASE o_orderkey % 5 WHEN 0 THEN 'correction' WHEN 1 THEN 'update' ELSE 'new_fact' END AS write_intent,
    CASE WHEN o_orderkey % 29 = 0 THEN 'Task' END AS claimed_type
  FROM orders
)
"""

_PARTS = "SELECT p_partkey * 8 + 2, 'S' || (p_partkey % 10), 'EVIDENCE_FOR', 'D' || p_partkey, 90 FROM part WHERE p_partkey % 3 <> 0"
_LINES = "SELECT DISTINCT l_suppkey * 10000000000 + l_partkey * 8 + 2, 'S' || l_suppkey, 'EVIDENCE_FOR', 'D' || l_partkey, 90 FROM lineitem"
#: The tables with ``traded`` evidence.
TRADED_SQL = WORKSPACE_SQL.replace(_PARTS, _LINES)

_WORD = "'status:' || ['todo', 'in_progress', 'blocked', 'done', 'final'][turn % 5 + 1]"
_CLAIM = "'C' || (k // 120 * 10 + {})".format
_STATION = "'E' || (block + 1 + ({}) % 48)".format
#: The ordered log and its store, to follow WORKSPACE_SQL.
WRITE_LOG_SQL = f""",
lent AS (
  SELECT * REPLACE (CASE WHEN NOT (entity_type = 'Task' AND coalesce(TRY_CAST(id[2:] AS BIGINT) % 31 = 0, false)) THEN status END AS status) FROM ent
  UNION ALL SELECT 'C' || p_partkey, 'Claim', p_name, NULL, NULL, NULL FROM part
),
ledge AS (
  SELECT *, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to FROM edge
  UNION ALL SELECT c_custkey * 8 + 6, 'K' || c_custkey, 'HAS_VALUE', 'V' || c_nationkey, c_custkey % 30 + 70, CASE WHEN c_custkey % 2 = 1 THEN TIMESTAMP '1995-01-01' END, CASE WHEN c_custkey % 2 = 1 THEN TIMESTAMP '1996-06-30' END FROM customer
  UNION ALL SELECT p_partkey * 8 + 7, 'C' || p_partkey, 'CONTRADICTS', 'C' || (p_partkey + 1), p_partkey % 41 + 60, NULL, NULL FROM part WHERE p_partkey % 20 = 0
),
lord AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 48 AS i, o_orderkey // 12 AS turn, o_orderkey - o_orderkey % 48 AS block, o_orderdate FROM orders),
llog AS (
  SELECT k AS seq,
    [ 'T' || (block + 2), 'E' || k, {_STATION("i - 2 + 24")}, CASE WHEN k % 24 = 3 THEN 'T' || (block + 6) ELSE 'D' || (k // 24 % 200) END, 'K' || c, 'K' || c, {_CLAIM("k % 10")}, {_CLAIM("k % 7")}, 'S' || (k % 10), {_CLAIM("turn % 10")}, {_CLAIM("k % 8")}, 'S' || (k % 10)][k % 12 + 1] AS subject_id,
    ['ASSIGNED_TO', 'PRECEDES', 'PRECEDES', 'HAS_STATUS', 'HAS_VALUE', 'HAS_VALUE', 'CONTRADICTS', 'SUPPORTS', 'EVIDENCE_FOR', 'HAS_STATUS', 'ABOUT', 'EVIDENCE_FOR'][k % 12 + 1] AS predicate,
    ['P' || (c + 3), {_STATION("i - 1 + 12")}, 'E' || (k - 1), {_WORD}, 'V' || (k % 25), 'V' || (k % 25), {_CLAIM("(k * 3 + 1) % 10")}, {_CLAIM("k % 3")}, {_CLAIM("k % 9")}, {_WORD}, 'P' || c, CASE WHEN k % 24 = 11 THEN 'D' || (k // 24 % 200) ELSE 'P' || c END][k % 12 + 1] AS object_id,
    CASE WHEN k % 61 = 0 THEN 'high' WHEN k % 67 = 0 THEN '1.5' ELSE (k * 37 % 41 + 60) || 'e-2' END AS confidence,
    CASE WHEN k % 9 = 0 THEN '' ELSE 'tool:' || k END AS source_ref,
    ['correction', 'correction', 'update', 'new_fact'][turn % 4 + 1] AS write_intent,
    CASE WHEN k % 97 = 0 THEN 'Task' END AS claimed_type,
    CASE WHEN turn % 3 <> 0 THEN o_orderdate::TIMESTAMP END AS valid_from,
    CASE WHEN turn % 3 <> 0 AND (turn % 3 = 1 OR k % 5 > 0) THEN o_orderdate::TIMESTAMP + to_days(CAST(k % 40 AS INTEGER)) END AS valid_to
  FROM lord
)
"""
