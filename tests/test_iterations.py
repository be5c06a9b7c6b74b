import math
import random

from factloom.operators import stats


def test_fit_runs_the_reference_s_steps(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.75]), rng.random() < 0.3) for _ in range(60)]
    df = spark.createDataFrame(rows, "f double, v double, y boolean")
    start = {"beta_0": -2.2, "f": 1.6, "v": -1.1}
    b, w = start["beta_0"], [1.6, -1.1]
    for _ in range(4000):
        err = [1 / (1 + math.exp(-(b + w[0] * f + w[1] * v))) - y for f, v, y in rows]
        grad = [sum(e * r[i] for e, r in zip(err, rows)) / len(rows) + 2 * 0.01 * w[i] for i in range(2)]
        b -= 0.25 * sum(err) / len(rows)
        w = [max(0.0, w[0] - 0.25 * grad[0]), min(0.0, w[1] - 0.25 * grad[1])]
    got = stats.fit_logistic(df, ["f", "v"], "y", sign={"f": 1, "v": -1}, initial=start)
    assert all(abs(a - c) < 1e-9 for a, c in zip((got["beta_0"], got["f"], got["v"]), (b, *w)))


def test_bootstrap_takes_ten_thousand_resamples(spark):
    n = 400
    df = spark.createDataFrame([("a", i, float(i % 2)) for i in range(n)], "g string, id long, v double")
    r = stats.bootstrap_ci(df, "g", "v").first()
    half = 1.96 * 0.5 / math.sqrt(n)
    # The ends of 100 resamples are off by several thousandths.
    assert abs(r.lo - (0.5 - half)) < 0.0015 and abs(r.hi - (0.5 + half)) < 0.0015
    assert tuple(r) == tuple(stats.bootstrap_ci(df, "g", "v", 10_000).first()) != tuple(stats.bootstrap_ci(df, "g", "v", 100).first())
