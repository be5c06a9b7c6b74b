"""Runs (maximal periodic stretches) of words, found from a Lempel-Ziv factorisation.

A run is a stretch with smallest period q whose words q apart are equal, of at least
``least`` words and ``times`` periods, that no neighbouring word extends keeping q. Texts are
read as sequences of words, about a megabyte of texts at a time:

1. Reduction. A run holds each of its words ``times`` times at least, so rarer words part a text
   into segments, again until nothing changes; segments too short for a run go. This loses no
   run, and leaves little of ordinary prose.
2. Suffix array and LCP. Ranks of all stretches of 1, 2, 4, ... words, by doubling, until all
   suffixes differ. The ranks also answer how far two places agree forwards or backwards.
3. Longest previous factor of each place: its nearest neighbours in the suffix array that start
   earlier, with the least LCP between. Its jumps are the Lempel-Ziv blocks.
4. Main's extensions. A run that touches a block's border is found from there: for each
   period up to a third of the two blocks' lengths, extend to both sides. A later block start
   within a run, past its first period, begins a factor that reaches the run's end; so these
   periods suffice, and they add up to less than the text.
5. Bucketed copying. A run inside a block repeats a run at the block's earlier place; buckets
   of runs by their start are copied from there, in order, so that copies are copied on.

Equality of words is that of two independent 64-bit hashes.

A null or empty text has no words and no runs. Rows with a null doc_id are searched as they
are; repeated rows give a row each. Of equally long runs the one that starts first, then that of
the smaller period, is reported. A text is searched whole and in one task, whose memory follows the
longest text (up to 12 bytes a word and doubling). Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

LEAST, TIMES = 6, 4


def _grouped(key: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where a group of equal keys begins in it; rows of a group agree in ``same`` too, or are parted."""
    order = np.argsort(key)
    head = np.ones(len(key), bool)
    k = key[order]
    head[1:] = k[1:] != k[:-1]
    clash = np.zeros(len(key), bool)
    for s in same:
        clash[1:] |= s[order][1:] != s[order][:-1]
    if (clash & ~head).any():
        # Two words with one hash: order by everything.
        order = np.lexsort((*same, key))
        for s in (key, *same):
            head[1:] |= s[order][1:] != s[order][:-1]
    return order, head


def _segments(first: np.ndarray, h: np.ndarray, v: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (of all words) that a run can hold, their segment's number, and an id by segment and word."""
    at = np.arange(len(h))
    seg = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order, head = _grouped(h ^ tk.mix(seg.astype(np.uint64), 11), v, seg)
    ids = np.empty(len(h), np.int64)
    while len(at):
        group = np.cumsum(head) - 1
        ids[order] = group
        kept = np.bincount(group, minlength=len(at))[ids] >= times
        here, part = at[kept], seg[kept]
        if not len(here):
            return here, part, ids[:0]
        new = np.ones(len(here), bool)
        new[1:] = (here[1:] != here[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= least
        done = len(here) == len(at) and long.all()
        ids, at, seg = ids[kept][long], here[long], part[long]
        if done or not len(at):
            break
        order, head = _grouped(seg * (int(ids.max()) + 1) + ids)
    return at, seg, ids


def stretch_ranks(ids: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Level k ranks the stretches of 2**k ids; equal ranks are equal stretches. All ranks of the last level differ. One entry more: -1."""
    n = len(ids)
    rank = np.full(n + 1, -1, np.int32)
    order, head = _grouped(ids)
    i = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(head, i, 0))
    single = head & np.append(head[1:], True)
    live, width, levels = order[~single], 1, [rank]
    while len(live):
        after = live + width
        second = np.where(after < stop[live], rank[np.minimum(after, n)].astype(np.int64) + 1, 0)
        key = rank[live].astype(np.int64) * (n + 1) + second
        order, head = _grouped(key)
        live = live[order]
        old = rank[live]
        i = np.arange(len(live))
        was = np.ones(len(live), bool)
        was[1:] = old[1:] != old[:-1]
        rank = rank.copy()
        rank[live] = old + (np.maximum.accumulate(np.where(head, i, 0)) - np.maximum.accumulate(np.where(was, i, 0)))
        single = head & np.append(head[1:], True)
        live, width = live[~single], 2 * width
        levels.append(rank)
    return levels


def agree_forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    i, j = i.copy(), j.copy()
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        total += step
        i += step
        j += step
    return total


def agree_backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    i, j = i.copy(), j.copy()
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        w = 1 << k
        step = ((i >= w) & (levels[k][np.maximum(i - w, 0)] == levels[k][j - np.minimum(w, j)])).astype(np.int64) << k
        total += step
        i -= step
        j -= step
    return total


def _minima(x: np.ndarray, top: int) -> list[np.ndarray]:
    """Level k: least of x[i:i+2**k]."""
    out = [x]
    for k in range(top):
        w = 1 << k
        out.append(np.minimum(out[-1][:-w], out[-1][w:]) if len(out[-1]) > w else out[-1][:0])
    return out


def longest_previous(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of its longest factor that also starts earlier, and where."""
    n = len(levels[-1]) - 1
    suffix = np.empty(n, np.int64)
    suffix[levels[-1][:n]] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    if n > 1:
        a, b = suffix[:-1], suffix[1:]
        lcp[1:n] = agree_forward(levels, np.minimum(a, b), np.maximum(a, b))
    # Beyond the places that share a first word the factor is empty.
    top = int(np.bincount(levels[0][:n]).max()).bit_length()
    low, least = _minima(suffix.astype(np.int32), top), _minima(lcp.astype(np.int32), top)
    r = np.arange(n)
    length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for ahead in (False, True):
        pos, m = r + ahead, np.full(n, n, np.int64)
        for k in range(top, -1, -1):
            w = 1 << k
            if not len(low[k]):
                continue
            at = pos if ahead else pos - w
            ok = (at >= 0) & (at < len(low[k]))
            at = np.clip(at, 0, len(low[k]) - 1)
            ok &= low[k][at] > suffix
            side = np.clip(pos if ahead else pos - w + 1, 0, len(least[k]) - 1)
            m = np.where(ok, np.minimum(m, least[k][side]), m)
            pos = np.where(ok, pos + (w if ahead else -w), pos)
        m = np.minimum(m, lcp[np.minimum(pos, n)])
        other = pos if ahead else pos - 1
        m = np.where((other >= 0) & (other < n), m, 0)
        better = m > length
        length = np.where(better, m, length)
        place = np.where(better, suffix[np.clip(other, 0, n - 1)], place)
    lpf, src = np.empty(n, np.int64), np.empty(n, np.int64)
    lpf[suffix], src[suffix] = length, place
    return lpf, src


def _blocks(lpf: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    jump = (np.arange(len(lpf)) + np.maximum(lpf, 1)).tolist()
    out, i, n = [], 0, len(jump)
    while i < n:
        out.append(i)
        i = jump[i]
    return np.array([*out, n], np.int64)


def _border_runs(levels, start, stop, at, least: int, times: int) -> list[tuple[int, int, int]]:
    """Main's extensions at every border of blocks: (start, end, period) of runs that touch one."""
    n = len(start)
    length = np.diff(at)
    begins = start[at[:-1]] == at[:-1]
    # A border is a block's start, or the end of a segment.
    ends = np.flatnonzero(np.append(begins[1:], True))
    border = np.concatenate([at[:-1], at[ends + 1]])
    before = np.concatenate([np.where(begins, 0, np.append(0, length[:-1])), length[ends]])
    after = np.concatenate([length, np.zeros(len(ends), np.int64)])
    lo, hi = np.concatenate([start[at[:-1]], start[at[ends]]]), np.concatenate([stop[at[:-1]], stop[at[ends]]])
    most = (before + after) // (times - 1)
    row = np.repeat(np.arange(len(border)), most)
    q = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most) + 1
    x = np.concatenate([border[row], border[row] - q])
    row, q = np.tile(row, 2), np.tile(q, 2)
    ok = (x >= lo[row]) & (x + q <= hi[row])
    word = levels[0]
    ok[ok] = (word[x[ok]] == word[np.minimum(x[ok] + q[ok], n)]) | ((x[ok] > 0) & (word[x[ok] - 1] == word[x[ok] + q[ok] - 1]))
    x, q = x[ok], q[ok]
    s, t = x - agree_backward(levels, x, x + q), x + q + agree_forward(levels, x, x + q)
    ok = t - s >= np.maximum(least, times * q)
    s, t, q = s[ok], t[ok], q[ok]
    order = np.lexsort((q, t, s))
    s, t, q = s[order], t[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return list(zip(s[new].tolist(), t[new].tolist(), q[new].tolist()))


def _copied(runs: list[tuple[int, int, int]], at: np.ndarray, src: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``runs`` and those inside blocks, copied in order from the blocks' earlier places."""
    bucket: dict[int, dict[int, int]] = {}
    for s, t, q in runs:
        bucket.setdefault(s, {})[t] = q
    starts = sorted(bucket)
    length = np.diff(at)
    for k in np.flatnonzero(length >= least + 2).tolist():
        b, m = int(at[k]), int(length[k])
        j = int(src[b])
        i = bisect_left(starts, j + 1)
        while i < len(starts) and starts[i] < j + m:
            s = starts[i]
            for t, q in list(bucket[s].items()):
                if t < j + m:
                    to = s + b - j
                    if to not in bucket:
                        insort(starts, to)
                        bucket[to] = {}
                    bucket[to][t + b - j] = q
            i += 1
    return [(s, t, bucket[s][t]) for s in starts for t in sorted(bucket[s])]


def find_runs(first: np.ndarray, h: np.ndarray, v: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start; text k has the words first[k]:first[k+1], which are compared by two hashes."""
    place, seg, ids = _segments(first, h, v, least, times)
    n = len(place)
    if not n:
        return []
    size = np.bincount(seg)
    size = size[size > 0]
    begin = np.repeat(np.cumsum(size) - size, size)
    stop = begin + np.repeat(size, size)
    levels = stretch_ranks(ids, stop)
    lpf, src = longest_previous(levels)
    at = _blocks(lpf)
    runs = _copied(_border_runs(levels, begin, stop, at, least, times), at, src, least)
    return [(int(place[s]), int(place[t - 1]) + 1, q) for s, t, q in runs]


def as_given(doc_id: int | None, n: int) -> np.ndarray:
    """The words of a text as they are."""
    return np.arange(n)


def with_planted_periods(doc_id: int | None, n: int) -> np.ndarray:
    """For each place the place whose word it takes: of every tenth text, by the checksum of its id, a tail turns periodic."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, order: Callable[[int | None, int], np.ndarray] = as_given, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (by start, then period), collapsed_text (each run cut to its first period), a row for each row of docs(doc_id, text).

    ``order(doc_id, n)`` gives the places of the words that are searched, in their order.
    """
    kind = docs.schema["doc_id"].dataType

    def fn(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, data, offs in tk.blocks(b.column(1)):
                w0, w1, first = tk.words(data, offs)
                h, v = tk.word_hashes(data, w0, w1), tk.word_hashes(data, w0, w1, 1)
                places = [order(i, n) for i, n in zip(ids[lo:hi], np.diff(first).tolist())]
                to = np.concatenate([p + f for p, f in zip(places, first)])
                found: list[list[tuple[int, int, int]]] = [[] for _ in places]
                runs = find_runs(first, h[to], v[to], least, times)
                for k, (s, t, q) in zip((np.searchsorted(first, [r[0] for r in runs], "right") - 1).tolist(), runs):
                    found[k].append((s - int(first[k]), t - s, q))
                for r in found:
                    r.sort(key=lambda x: (x[0], x[2]))
                texts = [_collapse(data[offs[k] : offs[k + 1]].tobytes().split(), p, r) for k, (p, r) in enumerate(zip(places, found))]
                spans = [[dict(zip(("start", "length", "period"), x)) for x in r] for r in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spans, _SPANS), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed_text"])

    return docs.select("doc_id", "text").mapInArrow(fn, f"doc_id {kind.simpleString()}, runs {RUNS}, collapsed_text string")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapse(words: list[bytes], place: np.ndarray, runs: list[tuple[int, int, int]]) -> str:
    """The words outside all runs and in their first periods, joined by one space."""
    if runs:
        gone = np.zeros(len(place) + 1, np.int64)
        for s, m, q in runs:
            gone[s + q] += 1
            gone[s + m] -= 1
        place = place[np.cumsum(gone)[:-1] == 0]
    return b" ".join([words[i] for i in place.tolist()]).decode()


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (of several the first, then that of the smaller period), and digests of the runs and of the text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
