import hashlib

import numpy as np

from factloom.llm import substring

from . import cases


def brute(rows, window=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = cases.words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t in rows:
        w = cases.words(t)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out.append((i, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest()))
    return sorted(out, key=str)


def got(spark, df):
    clean, cut = substring.substring_dedup(df)
    rows = [(r.doc_id, r.n_words, 0, r.kept_sha256) for r in clean.collect()]
    return sorted(rows + [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in cut.collect()], key=str)


def test_matches_brute_force(spark):
    rows = cases.texts()
    assert got(spark, cases.docs(spark, rows, extra=True)) == brute(rows)


def test_few_words_many_ties(spark):
    import random

    rng = random.Random(8)
    rows = [(i, cases.sentence(rng, rng.randrange(40, 160), 2)) for i in range(12)]
    rows += [(20 + i, " ".join(["a"] * n)) for i, n in enumerate((49, 50, 51, 200, 60))]
    rows += [(3, rows[5][1]), (None, rows[5][1]), (5, rows[5][1])]
    assert got(spark, cases.docs(spark, rows)) == brute(rows)


def test_empty(spark):
    assert got(spark, cases.docs(spark, [])) == []


def brute_parse(doc, place, found, window):
    """Word by word: of all blocks that hold the word, follow the match that reaches furthest."""
    out, word, n = [], 0, len(found) + window - 1
    while word < n:
        best = None
        for k in range(max(0, word - window + 1), min(word + 1, len(found))):
            if found[k]:
                e = k
                while e + 1 < len(found) and found[e + 1] and (doc[e + 1], place[e + 1]) == (doc[k], place[k] + e + 1 - k):
                    e += 1
                if best is None or e + window > best[0]:
                    best = (e + window, doc[k], place[k] + word - k)
        if best is None:
            word += 1
        else:
            out.append((word, best[0] - word, best[1], best[2]))
            word = best[0]
    return out


def test_factors():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, window = int(rng.integers(1, 60)), int(rng.integers(2, 12))
        found = rng.random(n) < rng.random()
        doc, place = rng.integers(0, 2, n), np.arange(n) + 3 * (rng.random(n) < 0.15).cumsum()
        got = substring.factors(doc, place, found, window)
        assert got == brute_parse(doc, place, found, window)
        held = np.zeros(n + window, bool)
        for s, m, _, _ in got:
            assert not held[s : s + m].any()
            held[s : s + m] = True
        want = np.zeros(n + window, bool)
        for k in np.flatnonzero(found):
            want[k : k + window] = True
        assert (held == want).all()


def test_factors_name_their_reference(spark):
    rows = [*cases.texts(), (900, cases.texts()[0][1] + " " + cases.texts()[41][1])]
    _, cut = substring.substring_dedup(cases.docs(spark, rows))
    word = {i: cases.words(t) for i, t in rows}
    seen = 0
    for r in cut.collect():
        end = 0
        for f in r.spans:
            assert f.start >= end and f.ref_doc_id < r.doc_id
            end = f.start + f.words
            assert word[r.doc_id][f.start : end] == word[f.ref_doc_id][f.ref_start : f.ref_start + f.words]
            seen += 1
        assert sum(f.words for f in r.spans) == r.n_removed
    assert seen > 20


def test_frequent_passage_in_many_contexts(spark):
    import random

    rng = random.Random(9)
    passage = cases.sentence(rng, 60, 10_000)
    rows = [(i, f"{cases.sentence(rng, rng.randrange(5, 30), 10_000)} {passage} {cases.sentence(rng, rng.randrange(5, 30), 10_000)}") for i in range(300)]
    assert got(spark, cases.docs(spark, rows)) == brute(rows)
