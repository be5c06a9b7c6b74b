"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

MinHash samples of a document's shingle set are banded to find candidates and folded into
a parity bitmap (odd sketch). The population count of two bitmaps' XOR estimates how many
samples differ; pairs that differ in too many are dropped, the rest are confirmed on their
full shingle sets. Identical sets are one class, so copies are never compared.

Nulls, empty texts and texts without words have empty sets and link with nothing. A
document with fewer words than a shingle has one shingle, its whole word sequence. Rows
that share a doc_id are one document in the link graph; a null doc_id takes no part and
has component_id null and kept true. Very long texts are compared whole. Columns beyond doc_id and text are ignored. An empty
table gives an empty result.

With 30 bands of 5 samples a pair at 0.85 shares no band with probability 2e-8 (at 0.80 with
7e-6), and exceeds the sketch bound with probability below 1e-6. Candidates must also differ
in size by no more than the similarity allows, so that chains of loosely alike documents
don't grow together before they are confirmed.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .durable import components, join_by_share, settle
from .grouping import fixed_binary, link_groups

WIDTH = 5
BANDS, ROWS = 30, 5
BITS = 512
_K = BANDS * ROWS
_XOR = (tk.mix(np.arange(_K, dtype=np.uint64), 11) >> np.uint64(32)).astype(np.uint32)
_MUL = (tk.mix(np.arange(_K, dtype=np.uint64), 13) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def most_bits(percent: int) -> int:
    """Most bits by which sketches of sets at this similarity may differ: 5.5 deviations of differing samples above their mean."""
    apart = 1 - percent / 100
    samples_apart = _K * apart + 5.5 * math.sqrt(_K * apart * (1 - apart))
    return round(BITS / 2 * (1 - math.exp(-4 * samples_apart / BITS))) + 2


def shingle_rows(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a block."""
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, offs)
    w = tk.word_hashes(data, starts, ends)
    h = tk.window_hashes(w, width)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            s = np.sort(h[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(np.array([tk.sequence_hash(w[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row for each set; sets are not empty."""
    out = np.empty((len(sets), _K), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 200_000):
            n += len(sets[j])
            j += 1
        small = (np.concatenate(sets[i:j]) >> np.uint64(20)).astype(np.uint32)
        at = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        for k in range(_K):
            v = small ^ _XOR[k]
            v *= _MUL[k]
            v ^= v >> np.uint32(15)
            out[i:j, k] = np.minimum.reduceat(v, at)
        i = j
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.empty((len(m), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(m), b, np.uint64)
        for r in range(ROWS):
            h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, b * ROWS + r])
        keys[:, b] = h
    return keys.view(np.int64)


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample toggles the bit it hashes to."""
    where = tk.mix(m.astype(np.uint64) + (np.arange(_K, dtype=np.uint64) << np.uint64(32)), 5) % np.uint64(BITS)
    flat = (np.arange(len(m))[:, None] * BITS + where.astype(np.int64)).ravel()
    parity = np.bincount(flat, minlength=len(m) * BITS).reshape(len(m), BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches (rows of 64-bit words) differ, all of a against all of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return out


def estimate(bits: float) -> float:
    """Similarity for a number of differing bits."""
    return 1 + BITS / (4 * _K) * float(np.log(max(1e-9, 1 - 2 * bits / BITS)))


def _features(batches):
    kind = pa.list_(pa.int64())
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offs in tk.blocks(batch.column(1)):
            sets = shingle_rows(data, offs)
            full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            keys: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if len(full):
                m = samples([sets[i] for i in full])
                for i, k, o in zip(full, band_keys(m), odd_sketches(m)):
                    keys[i], sketch[i] = k, o.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.binary()), pa.array(keys, kind), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
            )


def _tree(near, n: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest; near(i, rest) says which of the rows ``rest`` link with row i."""
    todo = np.ones(n, bool)
    edges = []
    for s in range(n):
        if not todo[s]:
            continue
        todo[s] = False
        queue = deque([s])
        while queue:
            i = queue.popleft()
            rest = np.flatnonzero(todo if sides is None else todo & (sides != sides[i]))
            if not len(rest):
                continue
            found = near(i, rest)
            todo[found] = False
            edges += [(i, int(j)) for j in found]
            queue.extend(found.tolist())
    return edges


def _alike(table: pa.Table, percent: int):
    """near(i, rest): rows of ``rest`` that may be at the similarity by sketch and size."""
    sk = fixed_binary(table.column("sketch"), BITS // 8).view(np.uint64)
    size, most = table.column("n_shingles").to_numpy(), most_bits(percent)

    def near(i, rest):
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        return rest[differing(sk[i : i + 1], sk[rest])[0] <= most]

    return near


def _by_sketch(percent: int):
    def find(table: pa.Table, left: np.ndarray | None) -> list[tuple[int, int]]:
        ids = table.column("id").to_numpy()
        return [(int(ids[i]), int(ids[j])) for i, j in _tree(_alike(table, percent), len(ids), left)]

    def bulk(table: pa.Table, at: np.ndarray) -> list[tuple[int, int]]:
        ids, size = table.column("id").to_numpy(), table.column("n_shingles").to_numpy()
        sk = fixed_binary(table.column("sketch"), BITS // 8).view(np.uint64)
        lo = at[:-1][np.diff(at) == 2]
        near = np.bitwise_count(sk[lo] ^ sk[lo + 1]).sum(axis=1, dtype=np.int64) <= most_bits(percent)
        near &= 100 * np.minimum(size[lo], size[lo + 1]) >= percent * np.maximum(size[lo], size[lo + 1])
        out = list(zip(ids[lo[near]].tolist(), ids[lo[near] + 1].tolist()))
        for a, b in zip(at[:-1], at[1:]):
            if b - a > 2:
                out += find(table.slice(a, b - a), None)
        return out

    find.bulk = bulk
    return find


def _exact(percent: int):
    def find(table: pa.Table, left: np.ndarray | None) -> list[tuple[int, int]]:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        size = np.array([len(s) for s in sets])
        alike = _alike(table, percent)

        def near(i, rest):
            out = []
            for j in alike(i, rest):
                small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * both >= percent * (size[i] + size[j] - both):
                    out.append(j)
            return np.array(out, np.int64)

        return [(int(ids[i]), int(ids[j])) for i, j in _tree(near, len(ids), left)]

    return find


def _sets(batches):
    for batch in batches:
        doc, text, want, grp, sketch = (batch.column(c) for c in ("doc_id", "text", "set_hash", "comp", "sketch"))
        for lo, hi, data, offs in tk.blocks(text):
            sets = shingle_rows(data, offs)
            same = [i for i, s in enumerate(sets) if set_hash(s) == want[lo + i].as_py()]
            yield pa.RecordBatch.from_arrays(
                [grp.take(pa.array([lo + i for i in same], pa.int64())), doc.take(pa.array([lo + i for i in same], pa.int64())), pa.array([sets[i].tobytes() for i in same], pa.binary()), pa.array([len(sets[i]) for i in same], pa.int64()), sketch.take(pa.array([lo + i for i in same], pa.int64()))],
                names=["group", "id", "shingles", "n_shingles", "sketch"],
            )


def near_duplicates(docs: DataFrame, percent: int = 85, band_block: int = 4096, set_block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; links hold 100 * intersection >= percent * union (80 or more).

    One task compares at most about ``band_block`` sketches or ``set_block`` sets with as many.
    """
    if not 80 <= percent <= 100:
        raise ValueError("similarities under 0.8 need other bands")
    docs = docs.select("doc_id", "text")
    feats = settle(docs.mapInArrow(_features, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary"), "features")
    full = feats.where("doc_id is not null and n_shingles > 0")
    # One row a class, by an aggregate that combines before the shuffle, however many copies it has.
    one = F.struct("doc_id", "n_shingles", "bands", "sketch")
    reps = full.groupBy("set_hash").agg(F.min_by(one, "doc_id").alias("one"), F.count("*").alias("n"))
    reps = settle(reps.select("set_hash", "n", "one.*"), "reps")
    banded = reps.select(F.explode("bands").alias("group"), F.col("doc_id").alias("id"), "n_shingles", "sketch")
    coarse = components(link_groups(banded, ["n_shingles", "sketch"], _by_sketch(percent), band_block, "bands"))
    groups = coarse.join(reps.select(F.col("doc_id").alias("node"), "set_hash", "sketch"), "node").withColumnRenamed("node", "doc_id")
    sets = docs.join(groups, "doc_id").select("doc_id", "text", "set_hash", "comp", "sketch").mapInArrow(_sets, "group long, id long, shingles binary, n_shingles long, sketch binary")
    links = link_groups(settle(sets, "sets"), ["shingles", "n_shingles", "sketch"], _exact(percent), set_block, "sets")
    classes = reps.where("n > 1").select("set_hash", F.col("doc_id").alias("id"), "n")
    copies = join_by_share(full.select("set_hash", "doc_id"), classes, ["set_hash"], "n").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    label = components(links.unionByName(copies))
    out = feats.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("comp", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("comp", "doc_id"), F.lit(True)).alias("kept"),
    )
