import itertools

import numpy as np

from factloom.llm import durable, minhash

from . import cases


def shingles(t):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in cases.words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in sets}


def got(df):
    return {tuple(r) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = cases.texts()
    assert got(minhash.near_duplicates(cases.docs(spark, rows, extra=True))) == brute(rows)


def test_split_groups_give_the_same(spark):
    rows = cases.texts(5)
    assert got(minhash.near_duplicates(cases.docs(spark, rows), band_block=4, set_block=3)) == brute(rows)


def test_empty_null_ids_and_repeats(spark):
    assert got(minhash.near_duplicates(cases.docs(spark, []))) == set()
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (9, None)]
    out = sorted(map(tuple, minhash.near_duplicates(cases.docs(spark, rows)).collect()), key=str)
    assert out == sorted([(None, 2, None, True), (7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)], key=str)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.85, 0.9, 0.97):
        both = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        k = int(4000 * (1 - share) / (1 + share))
        a, b = np.sort(both), np.sort(np.append(both[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = minhash.odd_sketches(minhash.samples([a, b]))
        bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert bits <= minhash.most_bits(85) and abs(minhash.estimate(bits) - true) < 0.12


def test_planted_pairs_pass_bands_and_sketch():
    """Recall of the candidate search, before anything is confirmed: pairs just above the least similarity."""
    rng = np.random.default_rng(6)
    for percent in (80, 85):
        sets, n = [], 1500
        for _ in range(n):
            size = int(rng.integers(20, 400))
            k = int(size * (1 - percent / 100) / (1 + percent / 100))
            both = rng.integers(0, 1 << 63, size).astype(np.uint64)
            sets += [np.sort(both), np.sort(np.append(both[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)))]
        m = minhash.samples(sets)
        keys, sk = minhash.band_keys(m), minhash.odd_sketches(m).view(np.uint64)
        shared = (keys[::2] == keys[1::2]).any(axis=1)
        bits = np.bitwise_count(sk[::2] ^ sk[1::2]).sum(axis=1)
        assert shared.mean() >= 0.999 and (bits <= minhash.most_bits(percent)).all()


def test_lower_similarity(spark):
    rows = cases.texts(7)
    assert got(minhash.near_duplicates(cases.docs(spark, rows), percent=80)) == brute(rows, 80)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    comp = {i: i for r in rows for i in r if r[0] != r[1]}
    for a, b in rows * 1:
        if a != b and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if v == hi else v for k, v in comp.items()}
    e = spark.createDataFrame(rows, "a long, b long")
    assert got(durable.components(e.repartition(7))) == got(durable.components(e)) == set(comp.items())
    assert got(durable.components(e.limit(0))) == set()
