"""Queries and operators that SQL doesn't express, against plain Python on the rows themselves."""

import difflib
import hashlib
import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators import replay, stats, suites
from factloom.plans import registry

from .duck import DATA

Q = registry.queries()


def rows(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def test_mean_ci(spark):
    by = defaultdict(list)
    for r in rows(spark, "orders"):
        by[r.o_orderpriority].append(r.o_totalprice)
    got = {r.o_orderpriority: r for r in Q["mean_ci"](spark, DATA).collect()}
    assert set(got) == set(by)
    for k, v in by.items():
        half = stats.t_quantile(0.975, len(v) - 1) * statistics.stdev(v) / math.sqrt(len(v))
        assert (got[k].n, got[k].mean, got[k].lo) == (len(v), pytest.approx(statistics.fmean(v)), pytest.approx(statistics.fmean(v) - half, abs=1e-4))


def _pairs(spark):
    nation = {r.c_custkey: r.c_nationkey for r in rows(spark, "customer")}
    cell = defaultdict(lambda: ([], []))
    for r in rows(spark, "orders"):
        if r.o_custkey in nation:
            cell[r.o_orderpriority, nation[r.o_custkey]][r.o_orderkey % 2].append(r.o_totalprice)
    out = defaultdict(list)
    for (g, _), (a, b) in cell.items():
        if a and b:
            out[g].append(math.floor(statistics.fmean(a) + 0.5) - math.floor(statistics.fmean(b) + 0.5))
    return out


def test_paired_t(spark):
    got = {r.grp: r for r in Q["paired_t"](spark, DATA).collect()}
    for g, d in _pairs(spark).items():
        t = statistics.fmean(d) / (statistics.stdev(d) / math.sqrt(len(d)))
        assert got[g].t == pytest.approx(t, abs=1e-5) and got[g].p == pytest.approx(stats.t_two_sided(t, len(d) - 1), abs=1e-5)


def _log(spark):
    from factloom.sources.events import assertion_log

    return assertion_log(spark, DATA).collect()


def test_aggregate_methods(spark):
    cell = defaultdict(list)
    for r in _log(spark):
        cell[r.write_intent, r.subject_id].append(r.pct)
    by = defaultdict(list)
    for (w, _), v in cell.items():
        by[w].append(statistics.fmean(v))
    got = {r.write_intent: r for r in Q["aggregate_methods"](spark, DATA).collect()}
    assert {w: (r.n, round(r.mean, 4)) for w, r in got.items()} == {w: (len(v), round(statistics.fmean(v), 4)) for w, v in by.items()}


def test_significance_table(spark):
    cell = defaultdict(lambda: defaultdict(list))
    for r in _log(spark):
        cell[r.predicate, r.subject_id][r.write_intent].append(r.pct)
    by = defaultdict(list)
    for (p, _), c in cell.items():
        if c["update"] and c["new_fact"]:
            by[p].append(statistics.fmean(c["update"]) - statistics.fmean(c["new_fact"]))
    p = {}
    for k, d in by.items():
        s = statistics.stdev(d) if len(d) > 1 else 0
        p[k] = round(stats.t_two_sided(round(statistics.fmean(d) / (s / math.sqrt(len(d))), 6), len(d) - 1), 6) if s else 1.0
    top, want = 0.0, {}
    for i, (k, v) in enumerate(sorted(p.items(), key=lambda kv: (kv[1], kv[0]))):
        top = max(top, min(1.0, (len(p) - i) * v))
        want[k] = top
    got = {r.predicate: r.corrected_p for r in Q["significance_table"](spark, DATA).collect()}
    assert got == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_hash_embed(spark):
    from factloom.functions import udfs

    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, "abc")], "i long, t string").select("i", udfs.hash_embed(F.col("t")).alias("v"))
    got = {r.i: r.v for r in df.collect()}
    assert got[1] == got[3] != got[2]
    assert all(math.isclose(sum(x * x for x in v), 1, abs_tol=1e-5) for v in got.values()) and len({len(v) for v in got.values()}) == 1


def test_mention_distance(spark):
    got = {r.p_partkey: r.distance for r in Q["mention_distance"](spark, DATA).collect()}
    norm = {r.p_partkey: (r.n, r.t) for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", text.normalize_name("p_name").alias("n"), text.normalize_name("p_type").alias("t")).collect()}
    for k, (a, b) in list(norm.items())[:100]:
        assert got[k] == pytest.approx(1 - difflib.SequenceMatcher(None, a, b).ratio(), abs=1e-5)


WRITES = "condition string, scenario string, seq long, subject_id string, predicate string, object_id string, tier string, staffed boolean, gold string"


def _fold(writes):
    state, out = defaultdict(set), []
    for w in sorted(writes, key=lambda w: w[2]):
        cond, sc, seq, s, p, o_, tier, staffed, gold = w
        final, active = gold if tier == "review" and staffed else tier, state[cond, sc, s, p]
        bad = final == "accept" and bool(active - {o_})
        if final == "supersede":
            state[cond, sc, s, p] = {o_}
        elif final == "accept":
            active.add(o_)
        out.append((cond, sc, seq, final, bad))
    return sorted(out)


def _some_writes(n=400):
    pick = lambda i, c, *v: v[int(hashlib.md5(f"{i}{c}".encode()).hexdigest(), 16) % len(v)]
    return [(pick(i, 1, "a", "b"), pick(i, 2, "s", "t", "u"), i, "x", pick(i, 3, "P", "Q"), pick(i, 4, "1", "2", "3"), pick(i, 5, "accept", "supersede", "review", "reject"), pick(i, 6, True, False), pick(i, 7, "accept", "review", "reject")) for i in range(n)]


def test_scenario_replay(spark):
    w = _some_writes()
    got = replay.scenario_replay(spark.createDataFrame(w, WRITES)).collect()
    assert sorted((r.condition, r.scenario, r.seq, r.final, r.creates_violation) for r in got) == _fold(w)


def test_injected_cascade(spark):
    w = _some_writes()
    up = lambda x: x[8] == "review" and x[2] % 5 == 0
    base = {r[:3]: r[4] for r in _fold(w)}
    forced = {r[:3]: r[4] for r in _fold([(*x[:6], "accept", *x[7:]) if up(x) else x for x in w])}
    first = {}
    for x in w:
        if up(x):
            first.setdefault((x[0], x[1]), x[2])
    want = sorted((*k, base[k], forced[k]) for k in base if k[2] > first.get(k[:2], 10**9) and base[k] != forced[k])
    got = suites.injected_cascade(spark.createDataFrame(w, WRITES), (F.col("gold") == "review") & (F.col("seq") % 5 == 0))
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_bounded_update(spark):
    policy = {"beta_0": -0.2, "x": 0.03, "z": -0.01}
    data = [(0.5 * (i % 3), 1.0 * (i % 2), i % 5 < 2, (0.01, 0.5, 0.9)[i % 3]) for i in range(40)]
    got = replay.bounded_update(spark.createDataFrame(data, "x double, z double, y boolean, w double"), policy, "y", "w")
    g, total = [0.0, 0.0, 0.0], sum(max(0.05, w) for *_, w in data)
    for x, z, y, w in data:
        e = 1 / (1 + math.exp(-(policy["beta_0"] + policy["x"] * x + policy["z"] * z))) - y
        for j, v in enumerate((1, x, z)):
            g[j] += e * v * max(0.05, w) / total
    step = [-0.5 * (v + (0.02 * policy[c] if c != "beta_0" else 0)) for c, v in zip(policy, g)]
    keep = lambda p: {c: v if c == "beta_0" or v * policy[c] > 0 else 0.0 for c, v in p.items()}
    want = keep({c: policy[c] + s for c, s in zip(policy, step)})
    scale = min(1.0, 0.05 / math.sqrt(sum((want[c] - policy[c]) ** 2 for c in want)))
    want = keep({c: policy[c] + scale * (want[c] - policy[c]) for c in want})
    assert got == pytest.approx(want)


def test_fit_logistic_meets_its_conditions(spark):
    data = [(0.5 * (i % 3), 1.0 * (i % 2), (i * 7) % 11 < 3 + 2 * (i % 3)) for i in range(200)]
    w = stats.fit_logistic(spark.createDataFrame(data, "x double, z double, y boolean"), ["x", "z"], "y", sign={"x": 1, "z": -1})
    p = [1 / (1 + math.exp(-(w["beta_0"] + w["x"] * x + w["z"] * z))) for x, z, _ in data]
    slope = {c: sum((q - y) * v[j] for q, (*v, y) in zip(p, data)) / len(data) + 0.02 * w[c] for j, c in enumerate(("x", "z"))}
    assert abs(sum(q - y for q, (*_, y) in zip(p, data))) / len(data) < 1e-4
    # At the least loss a coefficient has no slope, or it is held at zero by its sign.
    assert all(abs(slope[c]) < 1e-4 or w[c] == 0 and slope[c] * s > 0 for c, s in (("x", 1), ("z", -1)))


def test_held_out_fits_leave_their_seed_out(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "seed long, v long")
    got = suites.held_out_fits(df, [0, 1, 2], lambda d: sorted(r.v for r in d.collect()))
    assert got == {s: [i for i in range(9) if i % 3 != s] for s in range(3)}


def test_align_values(spark):
    v = [(1, 0, "Rome"), (1, 1, "Oslo"), (1, 2, "rome "), (1, 3, "Paris"), (1, 4, " "), (2, 0, "x")]
    s = [(1, 0, "in ROME"), (1, 1, "nothing"), (1, 2, "Oslo, not Rome"), (2, 3, "xx")]
    got = suites.align_values(spark.createDataFrame(v, "question_id long, at long, value string"), spark.createDataFrame(s, "question_id long, idx long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0), (1, 1, 2), (1, 2, 2), (2, 0, 3)]


def test_cluster_bootstrap_is_wider_for_dependent_rows(spark):
    df = spark.range(4000).selectExpr("'g' AS g", "id % 20 AS c", "(id % 20) * 1.0 AS v")
    own = stats.cluster_bootstrap(df, "g", "c", "v", 400).first()
    one = stats.cluster_bootstrap(df.withColumn("c", F.monotonically_increasing_id()), "g", "c", "v", 400).first()
    assert own.lo < own.mean < own.hi and own.mean == 9.5 and own.hi - own.lo > 5 * (one.hi - one.lo)


def test_policy_fit_names_every_seed(spark):
    got = Q["policy_fit_across_seeds"](spark, DATA).collect()
    assert {r.held_out for r in got} == {0, 1, 2} and {r.coefficient for r in got} == set(scores.POLICY)


def test_participants(spark):
    got = Q["participant_accuracy"](spark, DATA).collect()
    assert len(got) == 24 and all(0 <= r.accuracy <= 1 and r.median_seconds > 0 for r in got)


def test_answers_after_replay(spark):
    """Questions between writes, forced tiers, several active values, none."""
    w = [
        ("x", "s", 1, "K", "HAS_VALUE", "a", "accept", True, "accept", "t", None),
        ("x", "s", 3, "K", "HAS_VALUE", "b", "review", True, "supersede", "", None),
        ("x", "s", 5, "K", "HAS_VALUE", "c", "accept", True, "accept", "t", None),
        ("x", "s", 7, "K", "HAS_VALUE", "d", "accept", True, "accept", "t", "reject"),
        ("y", "s", 3, "K", "HAS_VALUE", "b", "review", False, "supersede", "t", None),
    ]
    q = [("x", "s", n, at, "K", p, g, o_) for n, at, p, g, o_ in (("q0", 0, "HAS_VALUE", "a", None), ("q1", 1, "HAS_VALUE", "a", None), ("q2", 3, "HAS_VALUE", "c", "b"), ("q3", 9, "HAS_VALUE", "d", "c"), ("q4", 9, "OWNS", None, None))] + [("y", "s", "q5", 9, "K", "HAS_VALUE", "b", "a")]
    writes = spark.createDataFrame(w, "condition string, scenario string, seq long, subject_id string, predicate string, object_id string, tier string, staffed boolean, gold string, source_ref string, forced string")
    asked = spark.createDataFrame(q, "condition string, scenario string, query_id string, at long, subject_id string, predicate string, gold string, old string")
    got = {r.query_id: tuple(r)[2:] for r in replay.answers_after(writes, asked).collect()}
    assert got == {
        "q0": (None, False, False, True, False, False),
        "q1": ("a", True, False, False, False, False),
        "q2": ("b", False, True, False, True, False),
        "q3": ("c", False, True, False, False, True),
        "q4": (None, False, False, True, False, False),
        "q5": (None, False, False, True, False, False),
    }


def test_explicit_contradictions_at_shared_nodes_are_counted_without_pairs(spark):
    from factloom.operators import contradict

    cols = "seq long, subject_id string, predicate string, object_id string, pct long"
    edges = [(i, f"n{i % 3}", "CONTRADICTS", f"n{i % 5}", i % 50) for i in range(300)] + [(900, "a", "CONTRADICTS", "a", 7), (901, "a", "CONTRADICTS", "b", 9)]
    writes = [(1000 + i, f"n{i % 4}", "OWNS", f"n{i % 7}", 1) for i in range(200)] + [(2000, "a", "OWNS", "a", 1), (2001, "a", "OWNS", "b", 1), (2002, "x", "OWNS", "y", 1), (2003, "a", "CONTRADICTS", "b", 1)]
    want = {}
    for seq, s, p, o, _ in writes:
        met = {e: c for e, a, _, b, c in edges if {a, b} & {s, o}}
        if met and p != "CONTRADICTS":
            want[seq] = (len(met), max(met.values()))
    df = contradict.explicit(spark.createDataFrame(writes, cols), spark.createDataFrame(edges, cols))
    assert {r.seq: (r.n_edges, r.met_pct) for r in df.collect()} == want
    # Edges are counted before they are joined, so nothing is left to tell apart after.
    assert "count(distinct" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_exploded_summaries_are_not_broadcast(spark):
    from factloom.operators import answering

    names = spark.createDataFrame([(1, "Ring"), (2, "o"), (3, ""), (4, "zz")], "query_id long, name string")
    held = spark.createDataFrame([("D1", "Large ring"), ("D2", "hot bolt"), ("D3", None)], "id string, summary string")
    df = answering.containing(names, held)
    assert {tuple(r) for r in df.collect()} == {(1, "D1"), (2, "D2")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "strategy=broadcast" in plan


def test_classes_of_near_names_lose_no_link(spark):
    from factloom.operators import retrieve

    rng = random.Random(8)
    rows = [(i, rng.choice("PT"), sorted(rng.sample("abcd", rng.randrange(0, 4)))) for i in range(120)]
    names = spark.createDataFrame(rows, "id long, entity_type string, tokens array<string>")
    got = retrieve.near_classes(names).collect()
    of = {r.r_id: r.l_id for r in got if r.part == "member"}
    linked = {(r.l_id, r.r_id) for r in got if r.part == "pair"}
    wide = {(a, b) for a in of for b in of if a != b and (of[a] == of[b] or (of[a], of[b]) in linked)}
    assert wide == {(r.l_id, r.r_id) for r in retrieve.near_names(names, names).collect()}
    assert len(got) < len(wide) / 4


def test_neighbourhood_lists_every_edge_of_a_candidate(spark):
    from factloom.operators import constraints

    rng = random.Random(9)
    cands = [(i, f"n{rng.randrange(6)}", f"n{rng.randrange(9)}") for i in range(60)]
    edges = [(500 + i, f"n{rng.randrange(8)}", f"n{rng.randrange(12)}", rng.randrange(100)) for i in range(80)]
    got = constraints.neighbourhood_edges(spark.createDataFrame(cands, "seq long, subject_id string, object_id string"), spark.createDataFrame(edges, "seq long, subject_id string, object_id string, pct long")).collect()
    at = [(r.node, r.seq, r.pct) for r in got if r.part == "edge"]
    listed = {(r.seq, e, p) for r in got if r.part == "candidate" for n, e, p in at if n == r.node}
    assert listed == {(c, e, p) for c, s, o in cands for e, a, b, p in edges if {a, b} & {s, o}} and len(at) == len(set(at))
    assert all(r.n_edges == len({e for c, e, _ in listed if c == r.seq}) for r in got if r.part == "candidate")


@pytest.mark.parametrize("name", ["accepted_neighbourhood", "evidence_units", "typed_violations", "stress_ablation", "symbolic_order"])
def test_evidence_is_every_traded_pair(name):
    from factloom.plans import registry

    sql = registry.oracle_sql()[name]
    assert "FROM lineitem" in sql and "FROM part WHERE p_partkey % 3" not in sql and "l_quantity" not in sql


@pytest.mark.parametrize("name", ["symbolic_order", "agent_loop"])
def test_every_order_asks(spark, name):
    from factloom.plans import registry

    assert "o_orderkey AS query_id" in registry.oracle_sql()[name] and "c_custkey AS query_id" not in registry.oracle_sql()[name]


def test_questions_and_writes_are_dealt_by_key(spark, monkeypatch):
    """Writes that change nothing are left out, and a scenario's keys are no one task's."""
    seen = []
    monkeypatch.setattr(replay, "ordered_fold", lambda df, keys, *rest: seen.append((df, keys)))
    w = [("x", "s", n, f"K{n}", "HAS_VALUE", "a", tier, staffed, "reject", "t") for n, (tier, staffed) in enumerate((("accept", True), ("reject", True), ("quarantine", True), ("review", True), ("review", False), ("supersede", False)))]
    writes = spark.createDataFrame(w, "condition string, scenario string, seq long, subject_id string, predicate string, object_id string, tier string, staffed boolean, gold string, source_ref string")
    asked = spark.createDataFrame([("x", "s", "q", 9, "K0", "HAS_VALUE", "a", None)], "condition string, scenario string, query_id string, at long, subject_id string, predicate string, gold string, old string")
    replay.answers_after(writes, asked)
    (df, keys), = seen
    assert set(keys) == {"condition", "scenario", "subject_id", "predicate"}
    assert sorted((r.subject_id, r.final) for r in df.collect()) == [("K0", "accept"), ("K0", "ask"), ("K5", "supersede")]


def test_edges_of_a_shared_node_are_not_sorted_to_be_found(spark):
    from factloom.operators import answering

    edges = spark.createDataFrame([(n, f"T{n % 50}", "HAS_STATUS", "status:done", 95) for n in range(400)], "seq long, subject_id string, predicate string, object_id string, pct long")
    asked = spark.createDataFrame([(1, ["HAS_STATUS"]), (2, []), (3, ["OWNS"])], "query_id long, hints array<string>")
    ids = spark.createDataFrame([(1, "T3"), (2, "status:done"), (3, "T4")], "query_id long, id string")
    hits = answering.symbolic_hits(ids, asked, edges)
    got = sorted((r.query_id, r.seq, r.place) for r in hits.collect())
    first = sorted(range(400), key=lambda n: (f"T{n % 50}", n))
    assert got == [(1, n, i + 1) for i, n in enumerate(range(3, 400, 50))] + sorted((2, n, i + 1) for i, n in enumerate(first))
    assert "ShuffledHashJoin" in hits._jdf.queryExecution().executedPlan().toString()


def test_evidence_units_count_every_traded_pair(spark):
    """Rows, not only SQL: each supplier of a part in ``lineitem`` backs the part's decision, whatever the quantity."""
    from collections import Counter

    from factloom.plans import memory

    table = lambda name, *c: spark.read.parquet(f"{DATA}/{name}.parquet").select(*c).collect()
    pairs = {(r.l_suppkey, r.l_partkey) for r in table("lineitem", "l_suppkey", "l_partkey")}
    known = {r.s_suppkey for r in table("supplier", "s_suppkey")}
    backing = Counter(p for s, p in pairs if s in known)
    want = {k: (k % 10 != 0) + (backing[k % 2100] if k % 8 == 4 else 0) for (k,) in table("orders", "o_orderkey")}
    assert {r.seq: r.n_evidence for r in memory.evidence_units(spark, DATA).collect()} == want and sum(backing.values()) > 2 * len(backing)


def test_typed_violations_deal_edges_by_each_end_once(spark):
    from factloom.operators import constraints

    edges = spark.createDataFrame([(1, "T1", "HAS_STATUS", "status:done", 95), (2, "T1", "HAS_STATUS", "status:todo", 95), (3, "S1", "EVIDENCE_FOR", "D1", 90), (4, "E1", "RESULTS_IN", "T2", 90), (5, "P1", "ASSIGNED_TO", "T1", 60), (6, "T2", "HAS_STATUS", "status:done", 95)], "seq long, subject_id string, predicate string, object_id string, pct long")
    ents = spark.createDataFrame([(i, t, None, s, e) for i, t, s, e in (("T1", "Task", None, None), ("T2", "Task", None, None), ("S1", "Document", None, None), ("D1", "Decision", None, None), ("P1", "Person", None, None), ("E1", "Event", 2, 1), ("status:done", "StatusValue", None, None), ("status:todo", "StatusValue", None, None))], "id string, entity_type string, status string, starts_at long, ends_at long")
    ents = ents.withColumns({c: F.timestamp_seconds(c) for c in ("starts_at", "ends_at")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = constraints.typed_violations(edges, ents)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {r.seq: r.kind for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {1: "illegal_status_state", 2: "illegal_status_state", 3: "none", 4: "temporally_invalid_interval", 5: "schema_invalid", 6: "none"}
    # The edges go to their objects and then to their subjects, and not to their subjects before that too.
    assert plan.count("Exchange hashpartitioning") <= 10
