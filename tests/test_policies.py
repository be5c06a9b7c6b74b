import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators import policies
from factloom.sources.events import assertion_log

from .duck import DATA

T0 = dt.datetime(2024, 1, 1)


def gate(rows, tau=80, margin=10):
    """One pass in order, straight from the rules."""
    state, out = {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        active = state.setdefault((r["subject_id"], r["predicate"]), [])
        met, dated = [], []
        for a in active:
            if a["object_id"] == r["object_id"]:
                continue
            both = a["valid_from"] is not None and r["valid_from"] is not None
            if not both or r["valid_from"] <= a["valid_to"] and a["valid_from"] <= r["valid_to"]:
                met.append(a)
                dated.append(both)
        top = max((a["pct"] for a in met), default=0)
        blocked = bool(met) and r["pct"] > tau and top > tau
        if blocked and r["write_intent"] == "correction" and r["pct"] - top > margin and r["source_ref"].strip():
            active[:] = [a for a in active if a not in met and a["object_id"] != r["object_id"]] + [r]
            out.append((r["seq"], "supersede"))
        elif blocked:
            out.append((r["seq"], "quarantine"))
        else:
            if all(a["object_id"] != r["object_id"] for a in active):
                active.append(r)
            out.append((r["seq"], "accept"))
    return out


def table(spark, rows):
    schema = "seq long, subject_id string, predicate string, object_id string, pct int, write_intent string, source_ref string, valid_from timestamp, valid_to timestamp"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def random_log(rng, n):
    rows = []
    for i in range(n):
        t = None if rng.random() < 0.4 else T0 + dt.timedelta(days=rng.randrange(20))
        rows.append(
            {
                "seq": i, "subject_id": f"u{rng.randrange(4)}", "predicate": "HAS_VALUE", "object_id": f"v{rng.randrange(3)}", "pct": rng.randrange(60, 100),
                "write_intent": rng.choice(["new_fact", "update", "correction"]), "source_ref": rng.choice(["", "a:1"]), "valid_from": t, "valid_to": t and t + dt.timedelta(days=rng.randrange(5)),
            }
        )
    return rows


def test_gate_matches_a_plain_pass(spark):
    rows = random_log(random.Random(1), 400)
    got = {(r.seq, r.decision) for r in policies.contradiction_gate(table(spark, rows)).collect()}
    assert got == set(gate(rows))


def test_gate_on_the_log(spark):
    log = policies.single_valued_log(assertion_log(spark, DATA))
    rows = [r.asDict() for r in log.collect()]
    got = {(r.seq, r.decision) for r in policies.contradiction_gate(log).collect()}
    assert got == set(gate(rows))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(50, 99)), max_size=30))
def test_evidence_policy_keeps_the_most_confident(spark, steps):
    rows = [{"seq": i, "subject_id": f"u{s}", "predicate": "HAS_VALUE", "object_id": f"v{o}", "pct": p} for i, (s, o, p) in enumerate(steps)]
    if not rows:
        return
    df = spark.createDataFrame([(r["seq"], r["subject_id"], r["predicate"], r["object_id"], r["pct"]) for r in rows], "seq long, subject_id string, predicate string, object_id string, pct int")
    want, held = {}, {}
    for r in rows:
        cur = held.get(r["subject_id"])
        if cur is None or cur[0] == r["object_id"]:
            held.setdefault(r["subject_id"], (r["object_id"], r["pct"]))
            want[r["seq"]] = "accept"
        elif r["pct"] >= cur[1]:
            held[r["subject_id"]] = (r["object_id"], r["pct"])
            want[r["seq"]] = "supersede"
        else:
            want[r["seq"]] = "reject"
    assert {r.seq: r.decision for r in policies.evidence_weighted(df).collect()} == want
