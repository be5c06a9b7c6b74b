import hashlib
import random
import zlib

import numpy as np

from factloom.llm import periodic as P
from factloom.llm import textkit as tk

from . import cases


def brute(w, least=6, times=4):
    """Every period, every stretch: the smallest period of each maximal stretch."""
    out, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, t, q) for (s, t), q in out.items())


def sequence(rng):
    k, n = rng.randrange(1, 4), rng.randrange(0, 60)
    w = [rng.randrange(k) for _ in range(n)]
    if n > 5 and rng.random() < 0.5:
        u = [rng.randrange(k) for _ in range(rng.randrange(1, 6))]
        w = w[: n // 2] + u * rng.randrange(3, 9) + w[n // 2 :]
    if rng.random() < 0.4:
        w = w * rng.randrange(1, 6)
    return w + [9] + w if rng.random() < 0.2 else w


def test_runs_match_brute_force():
    rng = random.Random(5)
    seen = 0
    for _ in range(600):
        docs = [sequence(rng) for _ in range(rng.randrange(1, 4))]
        first = np.cumsum([0] + [len(d) for d in docs])
        flat = np.array([x for d in docs for x in d], np.uint64)
        least, times = rng.choice([(6, 4), (2, 4), (6, 3)])
        want = sorted((s + f, t + f, q) for d, f in zip(docs, first.tolist()) for s, t, q in brute(d, least, times))
        assert sorted(P.find_runs(first, tk.mix(flat, 1), tk.mix(flat, 2), least, times)) == want
        seen += len(want)
    assert seen > 1000


def test_longest_previous_factor():
    rng = random.Random(6)
    for _ in range(200):
        w = sequence(rng) or [1]
        levels = P.stretch_ranks(np.array(w), np.full(len(w), len(w)))
        lpf, src = P.longest_previous(levels)

        def common(i, j, w=w):
            m = 0
            while j + m < len(w) and w[i + m] == w[j + m]:
                m += 1
            return m

        assert lpf.tolist() == [max([common(j, i) for j in range(i)], default=0) for i in range(len(w))]
        assert all(not m or (j < i and common(j, i) == m) for i, (m, j) in enumerate(zip(lpf.tolist(), src.tolist())))


def test_words_with_one_hash_are_told_apart():
    flat = np.array([1, 2] * 5, np.uint64)
    same = np.zeros(10, np.uint64)
    assert P.find_runs(np.array([0, 10]), same, tk.mix(flat, 2)) == [(0, 10, 2)]
    assert P.find_runs(np.array([0, 10]), same, np.arange(10, dtype=np.uint64)) == []


def expected(doc_id, text):
    w = cases.words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, t - s, q) for s, t, q in brute(w)), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
        sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, t if t is None or len(t) < 50_000 else t[:9000]) for i, t in cases.texts()]
    rows += [(100 + i, cases.sentence(rng, rng.randrange(1, 120), 3)) for i in range(150)]
    rows += [(300 + i, f"{cases.sentence(rng, 5)} " * rng.randrange(1, 9) + cases.sentence(rng, 9)) for i in range(60)]
    rows += [(None, "a b " * 9), (None, None), (301, "x " * 40), (301, "x " * 40)]
    got = P.digests(P.periodic_runs(cases.docs(spark, rows, extra=True), P.with_planted_periods)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 40


def test_long_text_and_empty_table(spark):
    rng = random.Random(8)
    part = cases.sentence(rng, 700)
    rows = [(1, f"{cases.sentence(rng, 40_000)} {' '.join([part] * 6)} {cases.sentence(rng, 500)}")]
    (r,) = P.periodic_runs(cases.docs(spark, rows)).collect()
    assert (40_000, 4200, 700) in {(x.start, x.length, x.period) for x in r.runs}
    w = cases.words(rows[0][1])
    for s, m, q in r.runs:
        assert w[s : s + m - q] == w[s + q : s + m] and (s == 0 or w[s - 1] != w[s + q - 1])
    assert P.periodic_runs(cases.docs(spark, [])).collect() == []
