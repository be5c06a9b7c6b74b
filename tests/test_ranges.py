"""Running totals by ranges, cycles, the bootstrap by counts and the checkpoint store."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, ranges, stats
from factloom.sources import checkpoints
from factloom.sources.scratch import checkpoint_folder


def test_running_totals_cross_ranges(spark):
    checkpoint_folder(spark)
    rng = random.Random(1)
    rows = [("hot", i, rng.randrange(9)) for i in range(3000)] + [(f"g{i % 40}", i, rng.randrange(9)) for i in range(400)]
    rng.shuffle(rows)
    df = ranges.running(spark.createDataFrame(rows, "g string, at long, v long"), ["g"], ["at"], {"n": F.lit(1), "s": F.col("v")})
    got = {(r.g, r.at): (r.n, r.s) for r in df.collect()}
    want = {}
    for g, part in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        n = s = 0
        for _, at, v in part:
            n, s = n + 1, s + v
            want[g, at] = (n, s)
    assert got == want
    assert ranges.running(spark.createDataFrame([], "g string, at long, v long"), ["g"], ["at"], {"s": F.col("v")}).collect() == []


def test_simple_cycles(spark):
    checkpoint_folder(spark)
    rng = random.Random(2)
    for _ in range(3):
        edges = {(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}") for _ in range(18)}
        want = set()
        for k in range(1, 6):
            for p in itertools.permutations([f"n{i}" for i in range(8)], k):
                if p[0] == min(p) and all((a, b) in edges for a, b in zip(p, p[1:] + p[:1])):
                    want.add(p)
        got = [tuple(r.cycle) for r in graph.simple_cycles(spark.createDataFrame(list(edges), "src string, dst string"), 5).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bootstrap_agrees_with_resampling(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(5, 2, 300).round(1)
    means = [rng.choice(v, len(v)).mean() for _ in range(4000)]
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", None)], "g string, v double")
    (r,) = stats.bootstrap_ci(df, "g", "v", 4000).collect()
    assert r.lo == pytest.approx(np.percentile(means, 2.5), abs=0.06) and r.hi == pytest.approx(np.percentile(means, 97.5), abs=0.06)
    assert tuple(r) == tuple(stats.bootstrap_ci(df.repartition(7), "g", "v", 4000).first())


def test_stopped_run_resumes(spark, tmp_path):
    path, made = f"{tmp_path}/results", []

    def compute(method, seed):
        if len(made) == 3 and not stopped:
            raise RuntimeError("stopped")
        made.append((method, seed))
        return spark.createDataFrame([(len(method) * 100 + seed,)], "score long")

    cells = [(m, s) for m in ("full", "plain") for s in (1, 2)]
    config, stopped = {"corpus": "x", "k": 5}, False
    with pytest.raises(RuntimeError):
        checkpoints.run(spark, path, config, cells, compute)
    assert checkpoints.finished(spark, path, {"k": 5, "corpus": "x"}) == set(cells[:3])
    stopped = True
    out = checkpoints.run(spark, path, config, cells, compute)
    assert made == cells and {(r.method, r.seed, r.score) for r in out.collect()} == {(m, s, len(m) * 100 + s) for m, s in cells}
    checkpoints.run(spark, path, config, cells, compute)
    assert made == cells
    other = checkpoints.run(spark, path, config | {"k": 6}, cells[:1], compute)
    assert len(made) == 5 and other.count() == 1 and checkpoints.finished(spark, path, config) == set(cells)
