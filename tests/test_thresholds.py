import inspect
import random

from factloom.operators import metrics


def best(rows, ceiling=0.02):
    """Every pair of percents, straight."""
    out = []
    for tl in range(101):
        for th in range(tl + 1, 101):
            esc = [r >= tl / 100 for r, _, _ in rows]
            tp = sum(e and w for e, (_, w, _) in zip(esc, rows))
            fp = sum(e and not w for e, (_, w, _) in zip(esc, rows))
            fn = sum(not e and w for e, (_, w, _) in zip(esc, rows))
            miss = sum(not e and w and c for e, (_, w, c) in zip(esc, rows))
            mcr, f2 = round(miss / sum(c for _, _, c in rows), 6), round(5 * tp / (5 * tp + 4 * fn + fp), 6)
            fits = mcr <= ceiling
            out.append(((not fits, -f2 if fits else mcr, mcr, tl, th), (tl, th, mcr, f2, fits)))
    return min(out)[1]


def test_every_percent_is_tried(spark):
    rng = random.Random(2)
    # Worthy cases start at exactly 0.29, between two points of a lattice of 0.05.
    rows = [(0.29, True, True)] * 3 + [(rng.randrange(29, 100) / 100, True, rng.random() < 0.5) for _ in range(20)] + [(rng.randrange(0, 29) / 100, False, rng.random() < 0.5) for _ in range(40)]
    df = spark.createDataFrame(rows, "risk double, worthy boolean, consequential boolean")
    assert tuple(metrics.select_thresholds(df).first()) == best(rows)
    assert best(rows)[0] == 29
    assert inspect.signature(metrics.select_thresholds).parameters["step"].default == 1
