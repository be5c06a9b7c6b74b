import math
import random
import zlib

import numpy as np

from factloom.llm import toxicity

from . import cases


def corpus(n=1500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = cases.sentence(rng, rng.randrange(20, 200)).split()
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(rng.randrange(3, 8)):
                w.insert(rng.randrange(len(w)), rng.choice(["Grub,", "vermin", "LOUT", "oaf.", "cad"]))
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df = cases.docs(spark, rows, extra=True)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text"), toxicity.fit(df, lab)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(400)
    df = cases.docs(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    models = [toxicity.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias


def test_awkward_rows(spark):
    df = cases.docs(spark, [(1, None), (1, ""), (None, "abc"), (2, "x " * 20000)])
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df.select("doc_id", "text"), toxicity.fit(df, none)).collect()
    assert len(got) == 4 and all(r.predicted == 0 for r in got)
    assert toxicity.score(df.limit(0).select("doc_id", "text"), toxicity.fit(df.limit(0), none)).collect() == []


def plain_nnpu(pos, unl, vocab, prior, steps=200, rate=0.1, decay=1e-5):
    """The estimator as its paper writes it, on dense rows, a sample at a time."""
    x = [[1.0 if v in set(r.tolist()) else 0.0 for v in vocab.tolist()] for r in pos + unl]
    sigma = lambda f: 1 / (1 + math.exp(-f))
    w = [0.0] * len(vocab) + [math.log(prior / (1 - prior))]
    mom, var = [0.0] * len(w), [0.0] * len(w)
    for t in range(1, steps + 1):
        f = [sum(a * b for a, b in zip(w, r)) + w[-1] for r in x]
        n_p, n_u = len(pos), len(unl)
        risk_neg = sum(math.log1p(math.exp(v)) for v in f[n_p:]) / n_u - prior * sum(math.log1p(math.exp(v)) for v in f[:n_p]) / n_p
        grad = [0.0] * len(w)
        for i, (r, v) in enumerate(zip(x, f)):
            up = sigma(v)
            if i < n_p:
                slope = -prior * (1 - up) / n_p - prior * up / n_p if risk_neg >= 0 else prior * up / n_p
            else:
                slope = up / n_u if risk_neg >= 0 else -up / n_u
            for j, a in enumerate([*r, 1.0]):
                grad[j] += slope * a
        for j in range(len(vocab)):
            grad[j] += decay * w[j]
        for j, g in enumerate(grad):
            mom[j] = 0.9 * mom[j] + 0.1 * g
            var[j] = 0.999 * var[j] + 0.001 * g * g
            w[j] -= rate * (mom[j] / (1 - 0.9**t)) / (math.sqrt(var[j] / (1 - 0.999**t)) + 1e-8)
    return w[:-1], x


def test_training_matches_plain_estimator():
    rng = np.random.default_rng(6)
    words = np.sort(rng.integers(1, 1 << 62, 40).astype(np.uint64))
    draw = lambda p: [np.sort(words[rng.random(40) < p]) for _ in range(60)]
    bad = np.where(np.arange(40) < 8, 0.6, 0.1)
    pos, unl = draw(bad), draw(0.1) + draw(np.where(np.arange(40) < 8, 0.2, 0.1))
    for prior in (0.1, 0.45):
        model = toxicity.train(pos, unl, prior, least_docs=2, least_g=8.0)
        assert 4 < len(model.vocab) < 40
        want, x = plain_nnpu(pos, unl, model.vocab, prior)
        assert np.allclose(model.weights, want, atol=1e-8)
        # The last intercept: unlabelled texts score the prior on average.
        score = [1 / (1 + math.exp(-(sum(a * b for a, b in zip(want, r)) + model.bias))) for r in x[len(pos) :]]
        assert abs(sum(score) / len(score) - prior) < 1e-9


def test_telling_words_match_the_likelihood_ratio():
    rng = np.random.default_rng(7)
    rows = [np.sort(rng.choice(np.arange(30, dtype=np.uint64), rng.integers(1, 15), replace=False)) for _ in range(80)]
    n_pos, want = 30, []
    for v in range(30):
        have = [sum(v in r for r in rows[:n_pos]), sum(v in r for r in rows[n_pos:])]
        g = 0.0
        for size, k in ((n_pos, have[0]), (50, have[1])):
            for seen, of in ((k, sum(have)), (size - k, 80 - sum(have))):
                if seen:
                    g += 2 * seen * math.log(seen / (of * size / 80))
        if sum(have) >= 5 and g >= 1.5:
            want.append(v)
    assert toxicity.telling(rows, n_pos, 5, 1.5, 4096).tolist() == want and want
