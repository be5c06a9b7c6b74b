"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` words (null text: 0). Sources in
code-point order, null last, weigh 5, 2, 1, repeating, and share all words; a target stops
at three times its source's size and the excess is shared again by weight.

A source's budget is met by whole passes over its documents and one part of a pass. For
the part, documents are counted by exact length. Most of it takes each length in
proportion; a bounded-knapsack table over the lengths' remaining counts then fills the
rest, as near as the lengths that are left allow (the best sum of all documents may lie nearer).
Where one more copy of each document can't reach
the budget (the words left lie in too long ones), a further copy fills what is missing, up
to three copies in all. Documents of a length are taken in the order of a seeded hash of
doc_id, so reruns agree.

Sources and lengths are held as tables; one task sees at most one source's distinct
lengths. Rows that share doc_id, source and size are interchangeable. Null sources are one
source. A very long document counts whole; one that is longer than what its source may take is
left out, and its source then falls short. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import settle, shuffle_width
from .grouping import key_runs

WEIGHTS = (5, 2, 1)
MOST = 3
_RANKED = 2048


def fit_counts(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the words come to the budget, or as near below as the table finds."""
    take = np.zeros(len(length), np.int64)
    total = int((length * count).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return count.copy()
    order = np.argsort(length, kind="stable")
    length, count = length[order], count[order]
    n = int(count.sum())
    room = int(min(budget, max(4 * length[np.searchsorted(np.cumsum(count), n // 2)], 2 * length[0])))
    cum = np.cumsum(count)
    part = np.floor(cum * ((budget - room) / total)).astype(np.int64)
    take_s = np.diff(part, prepend=0)
    over = int((take_s * length).sum()) - budget
    for i in range(len(length) - 1, -1, -1):
        if over <= 0:
            break
        drop = min(int(take_s[i]), -(-over // int(length[i])))
        take_s[i] -= drop
        over -= drop * int(length[i])
    rest = -over
    extra = _knapsack(length, count - take_s, rest)
    take[order] = take_s + extra
    return take


def _knapsack(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts whose words sum to the largest reachable value up to the budget."""
    out = np.zeros(len(length), np.int64)
    if budget <= 0:
        return out
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in range(len(length) - 1, -1, -1):
        left = min(int(count[i]), budget // int(length[i]))
        k = 1
        while left > 0 and not reach[budget]:
            m = min(k, left)
            w = m * int(length[i])
            new = np.flatnonzero(reach[:-w] & ~reach[w:]) + w
            reach[new] = True
            by[new] = len(items)
            items.append((i, m))
            left -= m
            k *= 2
        if reach[budget]:
            break
    s = int(np.flatnonzero(reach)[-1])
    while s:
        i, m = items[by[s]]
        out[i] += m
        s -= m * int(length[i])
    return out


def _fit(batches):
    for t, at in key_runs(batches, ["rank"]):
        for lo, hi in zip(at[:-1], at[1:]):
            part = t.slice(lo, hi - lo)
            n, c = part.column("size").to_numpy(), part.column("n").to_numpy()
            target, words = part.column("target")[0].as_py(), int((n * c).sum())
            passes = min(MOST, int(target // words)) if words else 0
            budget = 0 if passes == MOST else int(round(target - passes * words))
            takes = []
            for _ in range(MOST):
                take = fit_counts(n, c, budget) if len(takes) < MOST - passes else np.zeros(len(n), np.int64)
                budget -= int((take * n).sum())
                takes.append(take)
            yield pa.RecordBatch.from_arrays(
                [part.column("rank").combine_chunks(), pa.array(n), pa.array(c), pa.array(np.full(len(n), passes, np.int64)), pa.array(list(np.stack(takes, axis=1)), pa.list_(pa.int64()))],
                names=["rank", "size", "n", "passes", "takes"],
            )


def source_targets(totals: DataFrame) -> DataFrame:
    """source, source_size, rank, target from source, source_size (one row a source)."""
    spark = totals.sparkSession
    by = F.col("source").asc_nulls_last()
    t = totals.repartitionByRange(shuffle_width(spark), by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id())
    t = settle(t, "sources")
    part = F.shiftright("at", 33)
    offset, seen = {}, 0
    for r in sorted(t.groupBy(part.alias("p")).count().collect()):
        offset[r.p] = seen
        seen += r["count"]
    if not offset:
        return t.select("source", "source_size", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("target"))
    low = F.element_at(F.map_from_arrays(F.array(*[F.lit(p).cast("long") for p in offset]), F.array(*[F.lit(v).cast("long") for v in offset.values()])), part.cast("long"))
    t = t.withColumn("rank", low + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size").cast("double"))
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * level <= F.col("most")
        s = t.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("most"))), F.sum(F.when(free, F.col("weight")))).first()
        nxt = (float(s[0]) - (s[1] or 0.0)) / s[2] if s[2] else level
        if nxt is None or level is not None and nxt <= level:
            break
        level = nxt
    return t.select("source", "source_size", "rank", F.least(F.col("weight") * float(level or 0.0), F.col("most")).alias("target"))


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the mix takes the document) for each row."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = settle(docs.select("doc_id", "source", F.coalesce(words, F.lit(0).cast("long")).alias("size")), "sizes")
    targets = settle(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    ranked = sizes.join(targets.withColumnRenamed("source", "s"), sizes.source.eqNullSafe(F.col("s"))).drop("s")
    hist = ranked.where("size > 0").groupBy("rank", "size").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    n = shuffle_width(docs.sparkSession)
    plan = hist.repartition(n, "rank").sortWithinPartitions("rank", "size").mapInArrow(_fit, "rank long, size long, n long, passes long, takes array<long>")
    plan = settle(plan, "plan")
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rows = ranked.join(plan, ["rank", "size"], "left").withColumn("order", unit).withColumn("bucket", F.floor(F.col("order") * F.ceil(F.col("n") / float(_RANKED))))
    # Times a rank is taken beyond the whole passes; a bucket needs ranks only where a take ends inside it.
    partly = F.exists("takes", lambda t: (t > 0) & (t < F.col("n")))
    full = F.coalesce(F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + (t > 0).cast("long")), F.lit(0))
    rows = settle(rows.withColumn("partly", F.coalesce(partly, F.lit(False))).withColumn("extra", full), "rows")
    part = rows.where("partly").drop("extra")
    upto = Window.partitionBy("rank", "size").orderBy("bucket")
    cut = part.groupBy("rank", "size", "bucket").agg(F.count("*").alias("held"), F.first("takes").alias("t"))
    cut = cut.withColumn("before", F.sum("held").over(upto) - F.col("held"))
    inside = F.exists("t", lambda t: (t > F.col("before")) & (t < F.col("before") + F.col("held")))
    cut = cut.select("rank", "size", "bucket", "before", inside.alias("inside"))
    part = part.join(cut, ["rank", "size", "bucket"])
    times = lambda place: F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + (place <= t).cast("long"))
    whole = part.where("not inside").withColumn("extra", times(F.col("before") + 1))
    place = F.row_number().over(Window.partitionBy("rank", "size", "bucket").orderBy("order", "doc_id"))
    split = part.where("inside").withColumn("place", F.col("before") + place).withColumn("extra", times(F.col("place")))
    cols = ["doc_id", "source", "size", "source_size", "target", (F.coalesce("passes", F.lit(0)) + F.col("extra")).alias("copies")]
    return rows.where("not partly").select(cols).unionByName(whole.select(cols)).unionByName(split.select(cols))
