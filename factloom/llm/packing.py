"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into full pieces of ``capacity`` and a remainder. Remainders are
counted by length class (``grain`` ids wide). A linear program over patterns of classes
covers these counts with the fewest sequences; a knapsack dynamic programme prices new
patterns from the dual values until none improves it. Rounded patterns, and a greedy
packing of the few remainders that rounding leaves, are dealt to the documents of each
class by rank. About one document in ``1 / filler_share`` isn't placed whole: these form a
stream of ids that fills the space the patterns leave, to the id, and then sequences of
its own. So only the last sequence has padding, unless the stream ends early.

The program sees at most ``capacity / grain`` counts, whatever the corpus size. Ranks,
running sums and the stream's intervals are computed over tables.

A null text is empty; an empty text has the closing id alone. Rows are packed each, repeats
too; a null doc_id is carried through. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .durable import settle, shuffle_width
from .tokens import shared_ids

CAPACITY, GRAIN, END_ID = 4096, 32, 2
_COLS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: class c (1-based) takes c units of ``room`` and is worth value[c-1]."""
    best = np.zeros(room + 1)
    pick = np.zeros(room + 1, np.int64)
    for r in range(1, room + 1):
        got = best[r - 1 :: -1][: len(value)][:r] + value[:r]
        k = int(np.argmax(got))
        best[r], pick[r] = got[k], k + 1
        if best[r - 1] > best[r]:
            best[r], pick[r] = best[r - 1], 0
    a = np.zeros(len(value), np.int64)
    r = room
    while r > 0:
        if pick[r]:
            a[pick[r] - 1] += 1
            r -= int(pick[r])
        else:
            r -= 1
    return float(best[room]), a


def cutting_patterns(count: np.ndarray, room: int, stalled: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (class counts, times used) that place every remainder once; count[c-1] is that of class c, c units wide.

    Pricing goes on to the optimum. A warning tells where it was given up, after ``stalled``
    rounds without a gain (a cycle); the patterns then still place everything.
    """
    used = np.flatnonzero(count)
    left = count.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if len(used):
        m = len(used)
        cols = np.zeros((m, m))
        np.fill_diagonal(cols, room // (used + 1))
        inverse, cost = np.diag(1.0 / np.diag(cols)), np.ones(m)
        x = inverse @ left[used]
        best, since = np.inf, 0
        while True:
            value = float(cost @ x)
            best, since = (value, 0) if value < best - 1e-9 else (best, since + 1)
            if since > stalled:
                warnings.warn(f"column generation stopped at {value:.3f} sequences short of its optimum", stacklevel=2)
                break
            dual = cost @ inverse
            low = int(np.argmin(dual))
            if dual[low] < -1e-9:
                # More of a class than there is costs nothing: its surplus enters.
                a, price = np.zeros(m), 0.0
                a[low] = -1
            else:
                value = np.zeros(len(count))
                value[used] = np.maximum(dual, 0)
                worth, a = _best_pattern(value, room)
                if worth <= 1 + 1e-9:
                    break
                a, price = a[used].astype(float), 1.0
            d = inverse @ a
            up = d > 1e-10
            if not up.any():
                break
            ratio = np.where(up, x / np.where(up, d, 1), np.inf)
            k = int(np.argmin(ratio))
            cols[:, k], cost[k] = a, price
            inverse[k] /= d[k]
            rest = np.arange(m) != k
            inverse[rest] -= np.outer(d[rest], inverse[k])
            x = np.maximum(inverse @ left[used], 0)
        x = x * cost
        for j in np.argsort(-x, kind="stable"):
            a = np.zeros(len(count), np.int64)
            a[used] = cols[:, j].astype(np.int64)
            times = min([int(x[j] + 1e-6), *(left[a > 0] // a[a > 0]).tolist()])
            if times > 0:
                out.append((a, times))
                left -= a * times
    while left.any():
        a, r = np.zeros(len(count), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            k = min(int(left[c]), r // (int(c) + 1))
            a[c], r = k, r - k * (int(c) + 1)
        times = int((left[a > 0] // a[a > 0]).min())
        out.append((a, times))
        left -= a * times
    return out


class _Deal:
    """Rank within a class to sequence and slot, from the patterns."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]], classes: int):
        self.start = [[] for _ in range(classes)]
        self.each = [[] for _ in range(classes)]
        self.base = [[] for _ in range(classes)]
        seen, seq = np.zeros(classes, np.int64), 0
        for a, times in patterns:
            for c in np.flatnonzero(a).tolist():
                self.start[c].append(int(seen[c]))
                self.each[c].append(int(a[c]))
                self.base[c].append(seq)
                seen[c] += a[c] * times
            seq += times
        self.sequences = seq

    def __call__(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cls), np.int64)
        for c in np.unique(cls).tolist():
            m = cls == c
            p = np.searchsorted(self.start[c - 1], rank[m], "right") - 1
            start, each, base = (np.array(x[c - 1], np.int64)[p] for x in (self.start, self.each, self.base))
            out[m] = base + (rank[m] - start) // each
        return out


def _pieces(path: str, capacity: int, share: float):
    end = np.array([END_ID], "<u4").tobytes()
    limit = int(share * (1 << 32))

    def fn(batches):
        code = shared_ids(path)
        for b in batches:
            ids_col, text = b.column(0), b.column(1)
            for lo, hi, data, offs in tk.blocks(text, 2 * tk.BLOCK):
                docs = code.encode(data, offs)
                out: list[list] = [[] for _ in range(7)]
                for i, ids in enumerate(docs):
                    ids += end
                    n, doc = len(ids) // 4, ids_col[lo + i].as_py()
                    key = zlib.crc32(str(doc).encode() if doc is not None else ids)
                    key = zlib.crc32(b"filler", key)
                    if key < limit:
                        rows = [(doc, 0, n, 0, n, True, ids)]
                    else:
                        rows = [(doc, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n, False, None) for s in range(0, n, capacity)]
                    for row in rows:
                        for c, v in zip(out, row):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "filler", "ids"],
                )

    return fn


def running_start(df: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """``to``: the sum of ``value`` over all rows with a smaller unique ``key``.

    Ranges of keys are summed each in its own task; only the ranges' totals meet.
    """
    n = shuffle_width(df.sparkSession)

    def within(batches):
        before = 0
        for b in batches:
            v = b.column(value).to_numpy()
            after = np.cumsum(v) + before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(after - v, pa.int64())], names=[*b.schema.names, to])
            before = int(after[-1]) if len(after) else before

    schema = T.StructType([*df.schema.fields, T.StructField(to, T.LongType())])
    part = df.repartitionByRange(n, key).sortWithinPartitions(key).mapInArrow(within, schema)
    part = settle(part.withColumn("range", F.spark_partition_id()), to)
    # As many rows as there are ranges, in the order of their keys.
    total = sorted((r.range, r.s) for r in part.groupBy("range").agg(F.sum(value).alias("s")).collect())
    base = np.cumsum([0] + [s for _, s in total]).tolist()
    rows = [(r, x) for (r, _), x in zip(total, base)]
    base = df.sparkSession.createDataFrame(rows, "range int, base long")
    return part.join(F.broadcast(base), "range").withColumn(to, F.col(to) + F.col("base")).drop("range", "base")


def _cuts(capacity: int, sequences: int, filled: int):
    def fn(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, n, at, ids, cuts in zip(*(b.column(c) for c in ("doc_id", "doc_tokens", "at", "ids", "cuts"))):
                doc, n, at, ids = doc.as_py(), n.as_py(), at.as_py(), ids.as_py()
                rows = [(c["lo"] - at, c["hi"] - c["lo"], c["seq"], c["off"]) for c in cuts.as_py() or []]
                p = max(at, filled)
                while p < at + n:
                    q = min(at + n, filled + ((p - filled) // capacity + 1) * capacity)
                    rows.append((p - at, q - p, sequences + (p - filled) // capacity, (p - filled) % capacity))
                    p = q
                for s, m, seq, off in sorted(rows):
                    for c, v in zip(out, (doc, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n, seq, off)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=_COLS)

    return fn


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, filler_share: float = 1 / 16) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, filler boolean, ids binary"
    piece = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, filler_share), schema)
    # The row id is written with the row, so that no later plan can number it otherwise.
    piece = settle(piece.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    rest = piece.where(f"not filler and length < {capacity}").drop("ids", "filler").withColumn("cls", F.ceil(F.col("length") / grain).cast("int"))
    classes = capacity // grain
    count = np.zeros(classes, np.int64)
    for r in rest.groupBy("cls").count().collect():
        count[r.cls - 1] = r["count"]
    deal = _Deal(cutting_patterns(count, classes), classes)
    buckets = int(count.sum() // 20_000 + 1)
    rest = settle(rest.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets))), "rest")
    base = rest.groupBy("cls", "bucket").agg(F.count("*").alias("n"))
    base = base.select("cls", "bucket", (F.sum("n").over(Window.partitionBy("cls").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy(F.desc("length"), "rid"))
    rest = rest.withColumn("place", place - 1).join(base, ["cls", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))

    def dealt(batches):
        for b in batches:
            seq = deal(b.column("cls").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _COLS[:5]), b.column("rid"), pa.array(seq)], names=[*_COLS[:5], "rid", "sequence_id"])

    rest = rest.select(*_COLS[:5], "rid", "cls", "rank").mapInArrow(dealt, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rid long, sequence_id long")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rid")) - F.col("length")
    rest = settle(rest.withColumn("offset", offset), "dealt")
    gap = rest.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("gap", capacity - F.col("used")).where("gap > 0")
    gap = settle(running_start(gap, "sequence_id", "gap", "at"), "gaps")
    stream = settle(running_start(piece.where("filler").select("rid", "doc_id", "doc_tokens"), "rid", "doc_tokens", "at"), "stream")
    space = gap.agg(F.sum("gap")).first()[0] or 0
    cell = 2 * capacity
    cells = lambda n: F.explode(F.sequence(F.floor(F.col("at") / cell), F.floor((F.col("at") + F.col(n) - 1) / cell)))
    a = stream.select("rid", F.col("at").alias("a_lo"), (F.col("at") + F.col("doc_tokens")).alias("a_hi"), cells("doc_tokens").alias("cell"))
    b = gap.select("sequence_id", "used", F.col("at").alias("b_lo"), (F.col("at") + F.col("gap")).alias("b_hi"), cells("gap").alias("cell"))
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    cut = a.join(b, "cell").where((lo < hi) & (F.floor(lo / cell) == F.col("cell")))
    cut = cut.select("rid", F.struct(lo.alias("lo"), hi.alias("hi"), F.col("sequence_id").alias("seq"), (F.col("used") + lo - F.col("b_lo")).alias("off")).alias("c"))
    cut = stream.join(cut.groupBy("rid").agg(F.collect_list("c").alias("cuts")), "rid", "left")
    cut = cut.join(piece.where("filler").select("rid", "ids"), "rid").select("doc_id", "doc_tokens", "at", "ids", "cuts")
    cut = cut.mapInArrow(_cuts(capacity, deal.sequences, space), ", ".join(f"{c} long" for c in _COLS))
    total = stream.agg(F.sum("doc_tokens")).first()[0] or 0
    first = deal.sequences + -(-max(0, total - space) // capacity)
    full = piece.where(f"not filler and length = {capacity}").withColumn("sequence_id", F.col("rid") + first).withColumn("offset", F.lit(0).cast("long"))
    return full.select(_COLS).unionByName(rest.select(_COLS)).unionByName(cut)
