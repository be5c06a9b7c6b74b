import tracemalloc

import numpy as np

from factloom.llm import durable as D


def brute(edges):
    label = {x: x for e in edges for x in e}
    while True:
        old = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == old:
            return {k: v for k, v in label.items() if k != v}


def test_united_matches_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = int(rng.integers(2, 60)), int(rng.integers(1, 80))
        e = rng.integers(0, n, (m, 2)) * 7 - 50
        nodes, low = D.united(e[:, 0], e[:, 1])
        assert dict(zip(nodes.tolist(), low.tolist())) == brute(e.tolist())
    path = np.arange(100_000)
    assert (D.united(path[1:], path[:-1])[1] == 0).all()


def test_memory_follows_the_limit():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 1 << 40, (2, 400_000))
    tracemalloc.start()
    D.united(e[0], e[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000 * 150  # bytes an edge; a dict takes 175 and the lists beside it


def test_components_over_shares(spark, monkeypatch):
    monkeypatch.setattr(D, "EDGES", 7)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.comp for r in D.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert {k: v for k, v in got.items() if k != v} == want
