import random

import numpy as np

from factloom.llm import mixing

from . import cases


def level(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in free)
        left = total - sum(fixed.values())
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_takes(spark):
    rng = random.Random(6)
    rows = [(i, cases.sentence(rng, rng.randrange(0, 120))) for i in range(600)] + [(900, None), (901, ""), (902, "x " * 30_000)]
    df = cases.docs(spark, rows, extra=True)
    src = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = {i: len(cases.words(t)) for i, t in rows}
    sizes = {}
    for i, s in src.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    target, taken = level(sizes), {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source == src[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2, (s, taken[s], target[s])


def test_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_RANKED", 5)
    df = cases.docs(spark, [(i, "a b c") for i in range(300)])
    got = mixing.mix(df).collect()
    for s in {r.source for r in got}:
        part = [r for r in got if r.source == s]
        assert abs(sum(3 * r.copies for r in part) - part[0].target) <= 3


def test_knapsack_and_empty(spark):
    rng = np.random.default_rng(1)
    for _ in range(40):
        length, count = np.unique(rng.integers(1, 60, 12)), None
        count = rng.integers(1, 20, len(length))
        budget = int(rng.integers(0, (length * count).sum() + 5))
        take = mixing.fit_counts(length, count, budget)
        assert (take >= 0).all() and (take <= count).all() and (take * length).sum() <= budget
    assert mixing.mix(cases.docs(spark, [])).collect() == []
    assert [r.copies for r in mixing.mix(cases.docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]
