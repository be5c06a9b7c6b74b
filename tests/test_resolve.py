import random
import re

from factloom.operators import resolve


def norm(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (s or "").lower())).strip()


def near(a, b):
    """The rule, straight."""
    ta, tb = set(norm(a).split()), set(norm(b).split())
    ca, cb = ("".join(re.findall("[a-z0-9]+", norm(x))) for x in (a, b))
    ka, kb = (re.match("([a-z]+)0*([0-9]+)", c) for c in (ca, cb))
    if not ta or not tb:
        return False
    return ta <= tb or tb <= ta or bool(ca and cb and (ca.startswith(cb) or cb.startswith(ca) or ka and kb and ka.groups() == kb.groups()))


def plain(m, entities, edges):
    ref, kind, name, related = m
    same = [e for e in entities if e[1] == kind]
    for hits in ([e for e in same if norm(e[2]) and norm(e[2]) == norm(name)], [e for e in same if norm(name) and norm(name) in [norm(a) for a in e[3] or []]]):
        if hits:
            return ("resolved_existing", hits[0][0]) if len(hits) == 1 else ("uncertain", None)
    close = [e[0] for e in same if near(name, e[2])]
    beside = [i for i in close if ({b for a, b in edges if a == i} | {a for a, b in edges if b == i}) & set(related or [])]
    if len(beside) == 1:
        return "resolved_existing", beside[0]
    return ("possible_match" if close else "created_new"), None


def run(spark, mentions, entities, edges):
    m = spark.createDataFrame(mentions, "ref long, entity_type string, name string, related_ids array<long>")
    e = spark.createDataFrame(entities, "id long, entity_type string, name string, aliases array<string>")
    return {r.ref: (r.status, r.entity_id) for r in resolve.resolve(m, e, spark.createDataFrame(edges, "src long, dst long")).collect()}


def test_near_names_and_context(spark):
    entities = [(1, "P", "Bob Smith", None), (2, "T", "task-007", None), (3, "O", "AB Corp", None), (4, "P", "Ann Smith", None), (5, "O", "Q", None), (6, "T", "x" + "9" * 45, None)]
    mentions = [(1, "P", "Smith", None), (2, "T", "Task 7", None), (3, "O", "AB", None), (4, "P", "smith", [9]), (5, "P", "Smith", [9, 8]), (6, "O", "Quorum", None), (7, "T", "Smith", None), (8, "T", "x0" + "9" * 45, None), (9, "O", "", None), (10, "O", None, None)]
    got = run(spark, mentions, entities, [(1, 9), (8, 4)])
    new, maybe = ("created_new", None), ("possible_match", None)
    assert got == {1: maybe, 2: maybe, 3: maybe, 4: ("resolved_existing", 1), 5: maybe, 6: maybe, 7: new, 8: maybe, 9: new, 10: new}


def test_matches_the_plain_rule(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "ab", "abc", "abcd", "Bob", "bo", "Smith", "t1", "T-01", "t001", "7", "07", "é", "Task", "x", "--"])
    name = lambda: " ".join(word() for _ in range(rng.randrange(0, 4)))
    entities = [(i, rng.choice("PT"), name(), [name()] if rng.random() < 0.2 else None) for i in range(40)]
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    mentions = [(i, rng.choice("PT"), name(), [rng.randrange(40) for _ in range(2)] if rng.random() < 0.5 else None) for i in range(200)]
    want = {m[0]: plain(m, entities, edges) for m in mentions}
    assert {s for s, _ in want.values()} == {"resolved_existing", "uncertain", "possible_match", "created_new"}
    assert run(spark, mentions, entities, edges) == want


def test_names_that_share_letters_do_not_meet_as_pairs(spark):
    names = lambda n: spark.createDataFrame([("T", f"t12{i}{s}") for i in range(n) for s in ("", "alias")], "entity_type string, name string")
    df = resolve.near_keys(names(30), spark.createDataFrame([("T", "t125"), ("T", "t1"), ("P", "t12")], "entity_type string, name string"))
    assert {r.name for r in df.collect()} == {f"t12{i}{s}" for i in range(30) for s in ("", "alias")}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 3
