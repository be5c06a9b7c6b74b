"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of their first 3, 4 and 5 bytes (stems
of inflected words) is trained in numpy from texts confirmed
toxic and from texts without regard to any label. The risk is corrected by the class prior
p: p * E+[l(f)] + max(0, Eu[l(-f)] - p * E+[l(-f)]) with the logistic loss; where the
second part falls below zero, the step goes the other way, so the classifier doesn't
learn to call every unlabelled text clean.

The intercept is set after training so that unlabelled texts score the prior on average; a
threshold then parts texts by the weights that training found, at the rate the prior expects.

Fitting uses at most about ``positives`` and ``unlabelled`` texts, chosen by a hash of
doc_id; the prior is the share of toxic rows among all labelled rows of the training part.
Every whole text is scored. Words are runs of ASCII letters, digits and bytes from 128 on,
A-Z lower-cased. Labels, language, source and doc_id are no inputs of a score.

A null text counts as empty and gets the intercept's score. Without a positive or an
unlabelled text, all scores are the prior (0 without labels). A doc_id labelled more than
once is toxic if any of its labels says so; null labels and doc_ids are left out of
fitting. Repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

_TOKEN = np.full(256, 32, np.uint8)
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    _TOKEN[list(_r)] = list(_r)
_TOKEN[65:91] = range(97, 123)
STEMS = (3, 4, 5)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never read: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _tokens(column):
    for lo, _, data, offs in tk.blocks(column):
        data = _TOKEN[data]
        starts, ends, first = tk.words(data, offs)
        kinds = [tk.word_hashes(data, starts, ends)]
        for n in STEMS:
            kinds.append(tk.mix(tk.word_hashes(data, starts, np.minimum(starts + n, ends)), n))
        yield lo, kinds, first


@dataclass
class Model:
    vocab: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        out = np.zeros(len(column))
        n_vocab = len(self.vocab)
        # Most words fall through a bit table; only the others are looked up.
        seen = np.zeros(1 << 20, bool)
        low = np.uint64((1 << 20) - 1)
        seen[(self.vocab & low).astype(np.int64)] = True
        for lo, kinds, first in _tokens(column):
            pairs = []
            for w in kinds if n_vocab else ():
                pos = np.flatnonzero(seen[(w & low).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.vocab, w[pos]), n_vocab - 1)
                hit = self.vocab[at] == w[pos]
                pairs.append((np.searchsorted(first, pos[hit], "right") - 1) * n_vocab + at[hit])
            n = len(first) - 1
            if pairs:
                pair = np.unique(np.concatenate(pairs))
                out[lo : lo + n] = np.bincount(pair // n_vocab, weights=self.weights[pair % n_vocab], minlength=n)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def telling(rows: list[np.ndarray], n_pos: int, least_docs: int, least_g: float, most: int) -> np.ndarray:
    """Sorted words that tell positives from unlabelled texts: likelihood ratio G of ``least_g`` or more, the ``most`` clearest of them."""
    vocab, df = np.unique(np.concatenate(rows), return_counts=True)
    vocab, df = vocab[df >= least_docs], df[df >= least_docs]
    if not len(vocab):
        return vocab
    in_pos = np.zeros(len(vocab))
    for r in rows[:n_pos]:
        at = np.minimum(np.searchsorted(vocab, r), len(vocab) - 1)
        in_pos[at[vocab[at] == r]] += 1
    n = len(rows)
    g = np.zeros(len(vocab))
    for size, have in ((n_pos, in_pos), (n - n_pos, df - in_pos)):
        for seen, of in ((have, df), (size - have, n - df)):
            g += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(of * size / n, 1e-12))
    best = np.argsort(-g, kind="stable")[:most]
    return np.sort(vocab[best[g[best] >= least_g]])


def train(
    pos: list[np.ndarray], unl: list[np.ndarray], prior: float, least_docs: int = 5, least_g: float = 25.0, most: int = 4096, steps: int = 200, rate: float = 0.1, decay: float = 1e-5
) -> Model:
    """Fit on sets of word hashes; only words that tell the two kinds of text apart are inputs."""
    if not pos or not unl or not 0 < prior < 1:
        p = min(max(prior, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    rows = pos + unl
    vocab = telling(rows, len(pos), least_docs, least_g, most)
    if not len(vocab):
        return train([], [], prior)
    idx, length = [], []
    for r in rows:
        at = np.minimum(np.searchsorted(vocab, r), len(vocab) - 1)
        at = at[vocab[at] == r]
        idx.append(at)
        length.append(len(at))
    idx, length = np.concatenate(idx), np.array(length)
    row = np.repeat(np.arange(len(rows)), length)
    is_pos = np.arange(len(rows)) < len(pos)
    n_pos, n_unl = len(pos), len(unl)
    w, b = np.zeros(len(vocab)), float(np.log(prior / (1 - prior)))
    mom, var = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for t in range(1, steps + 1):
        f = np.bincount(row, weights=w[idx], minlength=len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(f, -60, 60)))
        loss_neg = np.logaddexp(0, f)
        negative = loss_neg[~is_pos].mean() - prior * loss_neg[is_pos].mean()
        grad_neg = np.where(is_pos, -prior * s / n_pos, s / n_unl)
        g = grad_neg - np.where(is_pos, prior * (1 - s) / n_pos, 0) if negative >= 0 else -grad_neg
        full = np.append(np.bincount(idx, weights=g[row], minlength=len(vocab)) + decay * w, g.sum())
        mom = 0.9 * mom + 0.1 * full
        var = 0.999 * var + 0.001 * full * full
        step = rate * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    # The intercept is set last: unlabelled texts score the prior on average.
    f = np.bincount(row, weights=w[idx], minlength=len(rows))[~is_pos]
    lo, hi = -60.0, 60.0
    for _ in range(80):
        b = (lo + hi) / 2
        lo, hi = (b, hi) if (1 / (1 + np.exp(-np.clip(f + b, -60, 60)))).mean() < prior else (lo, b)
    return Model(vocab, w, float(b))


def _word_sets(batches):
    for batch in batches:
        for lo, kinds, first in _tokens(batch.column("text")):
            n = len(first) - 1
            sets = [np.unique(np.concatenate([w[first[i] : first[i + 1]] for w in kinds])).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("toxic").slice(lo, n), pa.array(sets, pa.binary())], names=["doc_id", "toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000) -> Model:
    label = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = label.agg(F.avg((F.col("toxic") == 1).cast("double")), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior, n_pos = share[0] or 0.0, share[1] or 0
    base = docs.select("doc_id", "text").where("doc_id is not null").where(~held_out())
    n = base.count()
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    toxic = label.where("toxic = 1").where(unit < positives / max(1, n_pos)).select("doc_id", F.lit(1).alias("toxic"))
    some = base.join(toxic, "doc_id").unionByName(base.where(unit >= 1 - unlabelled / max(1, n)).withColumn("toxic", F.lit(0)))
    got = sorted((r.toxic, r.doc_id, bytes(r.words)) for r in some.mapInArrow(_word_sets, "doc_id long, toxic int, words binary").collect())
    sets = [[np.frombuffer(w, np.uint64) for t, _, w in got if t == k] for k in (1, 0)]
    return train(sets[0], sets[1], prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def fn(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column(b.schema.get_field_index("text"))))], names=[*b.schema.names, "score"])

    return docs.mapInArrow(fn, schema).withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
