"""The ordered write path against a plain programme that takes one write after the other."""

import random

import pytest

from factloom import ontology as o
from factloom.operators import graph, ordered
from factloom.sources import workspace
from factloom.sources.scratch import checkpoint_folder

from .duck import DATA

REL = {r[0]: r for r in o.RELATIONS}
MOVES = set(o.TRANSITIONS)


def plain(cands, ents, edges, margin=10, enough=1, high=80, authoritative=False):
    """seq to (failed check, action, kind, retired): a store of triples, changed by each write in turn."""
    ent = {e.id: e for e in ents}
    store = {}
    for e in sorted(edges, key=lambda e: e.seq):
        store.setdefault((e.subject_id, e.predicate, e.object_id), (e.pct, e.valid_from, e.valid_to, f"s{e.seq}"))

    def n_evidence(x):
        return sum(p == "EVIDENCE_FOR" and b == x and a in ent and ent[a].entity_type in ("Document", "Event") for a, p, b in store)

    def leads(a, b):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            for s, p, t in store:
                if p == "PRECEDES" and s == x and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return False

    def overlap(a, b):
        if not (a[1] or a[2]) or not (b[1] or b[2]):
            return True, False
        return not (a[1] and b[2] and a[1] > b[2]) and not (b[1] and a[2] and b[1] > a[2]), True

    out = {}
    for c in sorted(cands, key=lambda c: c.seq):
        s, t = ent.get(c.subject_id), ent.get(c.object_id)
        try:
            value = float(c.confidence)
        except ValueError:
            value = None
        pct = None if value is None else int(100 * value + 0.5)
        kind, retired, failed, action = "none", [], None, None
        me = (pct, c.valid_from, c.valid_to, f"w{c.seq}")

        def met():
            if c.predicate != "CONTRADICTS":
                near = [k for k in store if k[1] == "CONTRADICTS" and {k[0], k[2]} & {c.subject_id, c.object_id}]
                if near:
                    return near, False
            if c.predicate not in o.SINGLE_VALUED:
                return [], False
            hits = [(k, overlap(me, v)) for k, v in store.items() if k[:2] == (c.subject_id, c.predicate) and k[2] != c.object_id]
            hits = [(k, d) for k, (yes, d) in hits if yes]
            return [k for k, _ in hits], all(d for _, d in hits)

        bad_interval = any(e and e.ends_at and e.starts_at and e.ends_at < e.starts_at for e in (s, t))
        if c.claimed_type and s and c.claimed_type != s.entity_type:
            failed = "C1"
        elif bad_interval:
            failed = "C2"
        elif c.predicate == "PRECEDES" and leads(c.object_id, c.subject_id):
            failed = "C3"
        elif any(e and e.entity_type == "Task" and e.status == "done" and not any(p == "RESULTS_IN" and b == e.id for _, p, b in store) for e in (s, t)):
            failed = "C4"
        elif c.predicate == "ASSIGNED_TO" and t and t.entity_type == "Person" and t.status == "inactive":
            failed = "C5"
        elif value is None or not 0 <= value <= 1:
            failed = "C6"
        else:
            near, dated = met()
            if near:
                top = max(store[k][0] for k in near)
                blocked = pct > high and top > high
                kind = "temporal" if dated else "hard" if blocked else "soft"
                if blocked:
                    failed, action = "C7", "quarantine"
                    wins = c.write_intent == "correction" and pct - top > margin and bool(c.source_ref.strip()) + n_evidence(c.subject_id) >= enough
                    if wins or authoritative and c.write_intent == "update":
                        action = "supersede"
                        retired = sorted(store.pop(k)[3] for k in near)
            status = (c.object_id or "").removeprefix("status:")
            if failed:
                pass
            elif any(e and e.entity_type == "Decision" and e.status == "final" and not n_evidence(e.id) for e in (s, t)):
                failed = "C8"
            elif c.predicate not in REL or not s or not t or s.entity_type not in REL[c.predicate][1] or t.entity_type not in REL[c.predicate][2]:
                failed = "C9"
            elif c.predicate == "HAS_STATUS" and s.entity_type == "Task" and c.write_intent != "correction" and s.status != status and (s.status, status) not in MOVES:
                failed = "C10"
        action = action or ("accept" if failed is None else "reject" if failed in ("C1", "C2", "C3", "C6", "C9") else "quarantine")
        key = (c.subject_id, c.predicate, c.object_id)
        if action == "supersede" or action == "accept" and key not in store:
            store.pop(key, None)
            store[key] = me
        out[c.seq] = (failed, action, kind, retired)
    return out


def got(df):
    return {r.seq: (r.failed_check, r.action, r.kind, sorted(r.retired)) for r in df.collect()}


def test_log_matches_plain_fold(spark):
    checkpoint_folder(spark)
    log, ents, edges = workspace.write_log(spark, DATA), workspace.log_entities(spark, DATA), workspace.log_edges(spark, DATA)
    have, want = got(ordered.decide(log, ents, edges)), plain(log.collect(), ents.collect(), edges.collect())
    assert have == want
    assert {k for _, _, k, _ in want.values()} == {"none", "soft", "hard", "temporal"}
    assert {f for f, *_ in want.values()} >= {None, "C1", "C2", "C3", "C6", "C7", "C9", "C10"}
    assert {a for _, a, *_ in want.values()} == {"accept", "reject", "quarantine", "supersede"}


LOG = "seq long, subject_id string, predicate string, object_id string, confidence string, source_ref string, write_intent string, claimed_type string, valid_from timestamp, valid_to timestamp"
ENT = "id string, entity_type string, name string, status string, starts_at timestamp, ends_at timestamp"
EDGE = "seq long, subject_id string, predicate string, object_id string, pct long, valid_from timestamp, valid_to timestamp"


def tables(spark, writes, ents, edges=()):
    row = lambda w: (*w[:5], *(w[5:] or ("tool:1", "new_fact")), None, None, None)
    return spark.createDataFrame([row(w) for w in writes], LOG), spark.createDataFrame([(i, k, i, s, None, None) for i, k, s in ents], ENT), spark.createDataFrame(list(edges), EDGE)


def test_conflict_inside_the_batch(spark):
    checkpoint_folder(spark)
    people = [("T1", "Task", "todo"), ("P1", "Person", "active"), ("P2", "Person", "active"), ("E1", "Event", None), ("E2", "Event", None), ("T2", "Task", None), ("status:done", "StatusValue", None)]
    writes = [
        (1, "T1", "ASSIGNED_TO", "P1", "0.9"), (2, "T1", "ASSIGNED_TO", "P2", "0.9"),
        (3, "T1", "ASSIGNED_TO", "P2", "0.99", "", "correction"), (4, "T1", "ASSIGNED_TO", "P2", "1.0", "x", "correction"),
        (5, "E1", "PRECEDES", "E2", "0.5"), (6, "E2", "PRECEDES", "E1", "0.5"), (7, "E1", "PRECEDES", "E1", "0.5"),
        (8, "T2", "HAS_STATUS", "status:done", "0.5"),
    ]
    d = tables(spark, writes, people)
    have = got(ordered.decide(*d))
    assert [have[i][:2] for i in range(1, 9)] == [
        (None, "accept"), ("C7", "quarantine"), ("C7", "quarantine"), ("C7", "quarantine"), (None, "accept"), ("C3", "reject"), ("C3", "reject"), ("C10", "quarantine"),
    ]
    have = got(ordered.decide(*d, margin_pct=5))
    assert have[4] == ("C7", "supersede", "hard", ["w1"])
    state = {r.name: (r.status, r.superseded_by) for r in ordered.state_after(ordered.decide(*d, margin_pct=5), d[2]).collect()}
    assert state["w1"] == ("superseded", "w4") and state["w4"] == ("accepted", None) and state["w2"][0] == "quarantined" and state["w6"][0] == "rejected"
    assert got(ordered.decide(d[0].limit(0), d[1], d[2])) == {}


@pytest.mark.parametrize("seed", range(2))
def test_random_logs(spark, seed):
    """Few claims, tasks and slots, so that contradictions, evidence and windows meet in every way."""
    import datetime

    checkpoint_folder(spark)
    rng = random.Random(seed)
    ents = [(f"C{i}", "Claim", None) for i in range(7)] + [(f"D{i}", "Decision", rng.choice(["draft", "final"])) for i in range(4)] + [(f"S{i}", "Document", None) for i in range(3)]
    ents += [(f"K{i}", "Slot", None) for i in range(3)] + [(f"V{i}", "SlotValue", None) for i in range(5)] + [(f"E{i}", "Event", None) for i in range(9)] + [(f"status:{w}", "StatusValue", None) for w in ("draft", "final", "todo")]
    day = lambda: datetime.datetime(2020, 1, 1) + datetime.timedelta(rng.randrange(30))

    def window():
        a = day() if rng.random() < 0.6 else None
        b = (a or day()) + datetime.timedelta(rng.randrange(9)) if rng.random() < 0.6 else None
        return a, b

    def triple():
        c, n = rng.choice("CCCKKKSSDEEE"), lambda k: rng.randrange(k)
        return {
            "C": [(f"C{n(7)}", "CONTRADICTS", f"C{n(7)}"), (f"C{n(7)}", "SUPPORTS", f"C{n(7)}"), (f"C{n(7)}", "HAS_STATUS", f"status:{rng.choice(['draft', 'final'])}")][n(3)],
            "K": (f"K{n(3)}", "HAS_VALUE", f"V{n(5)}"),
            "S": (f"S{n(3)}", "EVIDENCE_FOR", rng.choice([f"C{n(7)}", f"D{n(4)}"])),
            "D": (f"D{n(4)}", "HAS_STATUS", f"status:{rng.choice(['draft', 'final', 'todo'])}"),
            "E": (f"E{n(9)}", "PRECEDES", f"E{n(9)}"),
        }[c]

    log = [(i, *triple(), rng.choice(["0.7", "0.85", "0.97", "0.99", "1", "x"]), rng.choice(["", "tool:1"]), rng.choice(["correction", "update", "new_fact"]), None, *window()) for i in range(400)]
    edges, seen = [], set()
    for i in range(25):
        t = triple()
        if t not in seen and t[1] != "PRECEDES":
            seen.add(t)
            edges.append((i, *t, rng.choice([70, 85, 90]), *window()))
    d = spark.createDataFrame(log, LOG), spark.createDataFrame([(i, k, i, s, None, None) for i, k, s in ents], ENT), spark.createDataFrame(edges, EDGE)
    for authoritative in (False, True):
        have = got(ordered.decide(*d, evidence_min=2, authoritative=authoritative))
        assert have == plain(*(x.collect() for x in d), enough=2, authoritative=authoritative)


def test_acyclic_order_matches_search():
    rng = random.Random(8)
    for _ in range(200):
        n, order, edges = rng.randrange(2, 12), ordered.Acyclic(), []
        for _ in range(40):
            u, v = rng.randrange(n), rng.randrange(n)
            seen, todo = {v}, [v]
            while todo:
                x = todo.pop()
                for a, b in edges:
                    if a == x and b not in seen:
                        seen.add(b)
                        todo.append(b)
            assert order.closes(u, v) == (u in seen)
            if u not in seen:
                order.insert(u, v)
                edges.append((u, v))


def test_values_held_in_slots_match_a_scan():
    rng = random.Random(9)
    for _ in range(300):
        held, rows = ordered.Held(), {}
        for _ in range(30):
            obj, dated = f"v{rng.randrange(12)}", rng.random() < 0.8
            lo = rng.choice([-ordered.OPEN, rng.randrange(1000)]) if dated else -ordered.OPEN
            hi = rng.choice([ordered.OPEN, max(lo, 0) + rng.randrange(rng.choice([3, 300]))]) if dated else ordered.OPEN
            if rng.random() < 0.2:
                held.drop(obj)
                rows.pop(obj, None)
            else:
                held.put(obj, (50, lo, hi, dated, obj))
                rows[obj] = (lo, hi, dated)
            want = {x for x, (a, b, d) in rows.items() if x != obj and (not d or not dated or (a <= hi and lo <= b))}
            assert set(held.others(obj, lo, hi, dated)) == want


def test_components(spark):
    checkpoint_folder(spark)
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(30)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    have = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert have == {k: v for k, v in root.items() if k in have} and all(k == v for k, v in root.items() if k not in have)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_log_is_folded_once_for_all_that_reads_it(spark):
    from factloom.plans import registry

    for name, folds in (("checked_routes", 2), ("constraint_validate", 2), ("w8_commit_state", 0)):
        # One fold of the orders of events and one of all else; the state after a batch reads decisions that are written.
        assert _plan(registry.queries()[name](spark, DATA)).count("MapInPandas") == folds, name


def test_both_ends_meet_each_table_once(spark):
    from factloom.operators import constraints

    d = workspace.candidates(spark, DATA), workspace.entities(spark, DATA), workspace.edges(spark, DATA)
    # Entities and counts at two ends, the relations, the transitions, and two kinds of evidence's sources.
    assert _plan(constraints.examine_alone(*d)).count("Join Left") <= 8
    assert _plan(constraints.examine(*d)).count("Join LeftOuter") <= 8


def test_stored_evidence_lets_a_correction_win(spark):
    """Evidence of the store for a subject, without a source of the write's own; the batch repeats a stored pair, which counts once."""
    checkpoint_folder(spark)
    ents = [("D1", "Decision", "draft"), ("S1", "Document", None), ("status:draft", "StatusValue", None), ("status:final", "StatusValue", None)]
    writes = [(1, "S1", "EVIDENCE_FOR", "D1", "0.9"), (2, "D1", "HAS_STATUS", "status:draft", "0.85"), (3, "D1", "HAS_STATUS", "status:final", "1.0", "", "correction")]
    edge = (9, "S1", "EVIDENCE_FOR", "D1", 90, None, None)
    assert got(ordered.decide(*tables(spark, writes, ents, [edge])))[3] == ("C7", "supersede", "hard", ["w2"])
    assert got(ordered.decide(*tables(spark, writes, ents, [edge]), evidence_min=2))[3][1] == "quarantine"
    assert got(ordered.decide(*tables(spark, writes[1:], ents, [])))[3][1] == "quarantine"
