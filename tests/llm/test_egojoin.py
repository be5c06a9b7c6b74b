import math
import random

from factloom.llm import egojoin


def rows(seed=1, n=150, dim=16):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = rng.choice(out)
            v = [x + rng.gauss(0, 0.08) for x in base[1]] if rng.random() < 0.7 else list(base[1])
            out.append((i, v, base[2] if rng.random() < 0.8 else 1))
        else:
            out.append((i, [rng.gauss(0, 1) for _ in range(dim)], rng.randrange(3)))
    nan, inf = float("nan"), float("inf")
    out += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [nan] + [1.0] * (dim - 1), 1), (n + 3, [inf] + [1.0] * (dim - 1), 1), (n + 4, [None] + [1.0] * (dim - 1), 1)]
    out += [(n + 5, out[0][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [1e200, 2e200], 1), (n + 9, [], 1)]
    return out


def brute(data):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        m, k = max(map(abs, a)), max(map(abs, b))
        a, b = [x / m for x in a], [x / k for x in b]
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    links = {i: set() for i, _, _ in data}
    for i, v, a in data:
        for j, w, b in data:
            if i != j and a is not None and a == b and good(v) and good(w) and len(v) == len(w) and cos(v, w) >= 0.93:
                links[i].add(j)
    out = set()
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.add((i, len(links[i]), min(seen), min(seen) == i))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


def test_matches_brute_force(spark, monkeypatch):
    data = rows()
    assert {tuple(r) for r in egojoin.self_join(frame(spark, data)).collect()} == brute(data)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK", 7)
    monkeypatch.setattr(egojoin, "LEAF", 2)
    data = rows(4)
    df = frame(spark, data).selectExpr("*", "1 AS cid", "'x' AS links", "2 AS a")
    assert {tuple(r) for r in egojoin.self_join(df, sample=20).collect()} == brute(data)


def test_empty_and_null_ids(spark):
    assert egojoin.self_join(frame(spark, [])).collect() == []
    got = {tuple(r) for r in egojoin.self_join(frame(spark, [(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)])).collect()}
    assert got == {(None, 0, None, True), (2, 0, 2, True)}
