"""Statistics over groups: intervals, paired tests, corrections, agreement."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return lo


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@F.udf(DoubleType())
def _t95(n):
    return t_quantile(0.975, n - 1) if n and n > 1 else 0.0


@F.udf(DoubleType())
def _t_p(t, n):
    if n is None or n < 2 or t is None:
        return 1.0
    return t_two_sided(t, n - 1)


def mean_ci(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean with a 95 % t interval per group; the quantile is computed once a group, after the aggregate."""
    g = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.coalesce(_t95("n") * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return g.select(by, "n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - half, 6).alias("lo"), F.round(F.col("mean") + half, 6).alias("hi"))


def paired_t(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """t, p and Cohen's d of a - b per group."""
    d = F.col(a) - F.col(b)
    g = pairs.groupBy(by).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    t = F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n")))
    return g.select(by, "n", F.round(t, 6).alias("t"), F.round(_t_p(t, F.col("n")), 6).alias("p"), F.round(F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0), 6).alias("d"))


def wilcoxon(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Signed-rank statistic, z with continuity and rank-biserial effect; zeros are left out, ties share ranks."""
    df = pairs.withColumn("diff", F.col(a) - F.col(b)).where("diff <> 0").withColumn("mag", F.abs("diff"))
    w, tie = Window.partitionBy(by).orderBy("mag"), Window.partitionBy(by, "mag")
    df = df.withColumn("rank", F.rank().over(w) + (F.count("*").over(tie) - 1) / 2.0)
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("plus"))
    n, total = F.col("n"), F.col("n") * (F.col("n") + 1) / 2.0
    minus = total - F.col("plus")
    stat = F.least("plus", minus)
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    z = F.when(stat < total / 2, (stat - total / 2 + 0.5) / sd).otherwise((stat - total / 2 - 0.5) / sd)
    return g.select(by, "n", F.round(stat, 6).alias("w"), F.round(z, 6).alias("z"), F.round((F.col("plus") - minus) / total, 6).alias("rank_biserial"))


def holm(tests: DataFrame, label: str, p: str, alpha: float = 0.05, inclusive: bool = False) -> DataFrame:
    """Step-down corrected p and rejection. The table is a family of tests, a few rows."""
    w = Window.orderBy(p, label)
    m = tests.agg(F.count("*").alias("m"))
    df = tests.crossJoin(F.broadcast(m)).withColumn("i", F.row_number().over(w))
    c = F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col(p))
    df = df.withColumn("corrected_p", F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.col("corrected_p") <= alpha if inclusive else F.col("corrected_p") < alpha
    return df.select(label, F.round(p, 6).alias("raw_p"), F.round("corrected_p", 6).alias("corrected_p"), hit.alias("reject"))


def _poisson_means(units: DataFrame, by: str, resamples: int) -> DataFrame:
    """by, b, m: the mean in each Poisson resample of units(by, s: sum, m: rows, n: how many such units).

    n equal units together weigh a Poisson of mean n, drawn by a generator that their values seed: so
    draws don't depend on how rows are dealt; means are rounded to nine places. A task adds up arrays as long as there are resamples.
    """

    def fn(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[k][0].tolist() for k in keys], pa.list_(pa.float64())), pa.array([held[k][1].tolist() for k in keys], pa.list_(pa.float64()))], names=["k", "s", "m"])

        for b in batches:
            for k, s, m, n, seed in zip(*(b.column(c).to_pylist() for c in ("k", "s", "m", "n", "seed"))):
                w = np.random.Generator(np.random.Philox(seed & ((1 << 64) - 1))).poisson(n, resamples)
                acc = held.setdefault(k, np.zeros((2, resamples)))
                acc[0] += w * s
                acc[1] += w * m
                if len(held) > 64:
                    yield out()
                    held = {}
        if held:
            yield out()

    u = units.select(F.col(by).cast("string").alias("k"), F.col("s").cast("double"), F.col("m").cast("double"), "n", F.xxhash64(by, "s", "m").alias("seed"))
    sums = u.mapInArrow(fn, "k string, s array<double>, m array<double>").select("k", F.posexplode(F.arrays_zip("s", "m")).alias("b", "x"))
    sums = sums.groupBy("k", "b").agg(F.round(F.sum("x.s") / F.nullif(F.sum("x.m"), F.lit(0.0)), 9).alias("m"))
    return sums.select(F.col("k").cast(units.schema[by].dataType).alias(by), "b", "m")


def _interval(means: DataFrame, by: str) -> DataFrame:
    return means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def bootstrap_ci(rows: DataFrame, by: str, value: str, resamples: int = 10_000) -> DataFrame:
    """Percentile interval of the mean under Poisson resampling. Rows are counted by value first, so that equal values are drawn at once."""
    units = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("s")).agg(F.count("*").alias("n")).withColumn("m", F.lit(1))
    return _interval(_poisson_means(units, by, resamples), by)


def cluster_bootstrap(rows: DataFrame, by: str, cluster: str, value: str, resamples: int = 2000) -> DataFrame:
    """Percentile interval of the mean when whole clusters are resampled; each is first reduced to its count and sum, and equal ones are drawn at once."""
    c = rows.groupBy(by, cluster).agg(F.count(value).alias("m"), F.sum(value).alias("s")).where("m > 0")
    units = c.groupBy(by, "s", "m").agg(F.count("*").alias("n"))
    point = units.groupBy(by).agg((F.sum(F.col("s") * F.col("n")) / F.sum(F.col("m") * F.col("n"))).alias("mean"))
    return point.join(_interval(_poisson_means(units, by, resamples), by), by)


def krippendorff(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """Nominal alpha from value counts per unit; units with one rating are left out."""
    c = ratings.groupBy(unit, value).agg(F.count("*").alias("c"))
    n = c.groupBy(unit).agg(F.sum("c").alias("m")).where("m > 1")
    c = c.join(n, unit)
    same = c.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("agree"), F.sum("c").alias("n"))
    marg = c.groupBy(value).agg(F.sum("c").alias("v")).agg(F.sum(F.col("v") * (F.col("v") - 1)).alias("chance"))
    j = same.crossJoin(F.broadcast(marg))
    observed, expected = 1 - F.col("agree") / F.col("n"), 1 - F.col("chance") / (F.col("n") * (F.col("n") - 1))
    return j.select(F.col("n"), F.round(F.when(expected > 0, 1 - observed / expected).otherwise(1.0), 6).alias("alpha"))


def two_proportion(rows: DataFrame, by: str, hit: str, a: str, b: str) -> DataFrame:
    """z of the difference of two groups' shares."""
    c = F.col(hit).cast("double")
    g = rows.where(F.col(by).isin(a, b)).agg(*[f(F.when(F.col(by) == x, v)).alias(n) for x, s in ((a, "a"), (b, "b")) for f, v, n in ((F.count, c, f"n{s}"), (F.sum, c, f"x{s}"))])
    p = (F.col("xa") + F.col("xb")) / (F.col("na") + F.col("nb"))
    z = (F.col("xa") / F.col("na") - F.col("xb") / F.col("nb")) / F.sqrt(p * (1 - p) * (1 / F.col("na") + 1 / F.col("nb")))
    return g.select("na", "nb", F.round(z, 6).alias("z"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, steps: int = 4000, rate: float = 0.25, decay: float = 0.01, sign: dict[str, int] | None = None, initial: dict[str, float] | None = None) -> dict[str, float]:
    """Projected-gradient logistic fit of the mean loss plus ``decay`` times the squared coefficients, from ``initial`` or zeros. Rows are first counted by distinct feature values, so a step costs those only."""
    g = rows.groupBy(*features).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).toPandas()
    x, n, pos = g[features].to_numpy(float), g["n"].to_numpy(float), g["pos"].to_numpy(float)
    start = initial or {}
    w, b, total = np.array([start.get(f, 0.0) for f in features]), start.get("beta_0", 0.0), max(1.0, n.sum())
    s = np.array([(sign or {}).get(f, 0) for f in features])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        err = n * p - pos
        w = w - rate * (x.T @ err / total + 2 * decay * w)
        b -= rate * err.sum() / total
        w = np.where((s > 0) & (w < 0) | (s < 0) & (w > 0), 0.0, w)
    return {"beta_0": float(b)} | dict(zip(features, w.tolist()))
