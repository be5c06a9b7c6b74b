"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches by end, longest first. The
dynamic programme carries, for each end, the best score and the number of pieces on its
path, and no back-pointers. Ties are the tokenizer's: a later candidate replaces an
earlier one only if its score is greater, and at one end longer pieces come first; a
character without a piece of its own scores ten below the least score and counts its UTF-8
bytes (byte fallback).

The vocabulary is a file's text pieces: control names, the unknown piece and the names of
bytes are no pieces of text. A byte-pair file has ranks of merges for scores, which can't be
added up; its pieces are then given log-probabilities by Zipf's law, -log(rank + 2.7). These
are a rule, nothing is trained, and counts come near those of the file's own tokenizer.

A space starts a word, written as U+2581 before it; pieces don't cross words, so a word's
result is kept in a bounded memory. A null or empty text has no pieces; a very long one is
counted whole, a block of words at a time. Repeated rows are counted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN = 10.0
CACHED = 400_000


#: Offset of the rank in Zipf's law (Mandelbrot's form).
OFFSET = 2.7


def vocabulary(path: str, ranked: bool = True) -> list[tuple[str, float]]:
    """Text pieces of a sentencepiece file in id order; ``ranked``: scores by the rank of the file's own, for byte-pair files."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    at = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    own = [p.get_score(i) for i in at]
    if ranked:
        for rank, k in enumerate(sorted(range(len(at)), key=lambda k: (-own[k], k))):
            own[k] = -math.log(rank + OFFSET)
    return [(p.id_to_piece(i), s) for i, s in zip(at, own)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.seen: dict[str, tuple[int, float]] = {}

    def word(self, w: str) -> tuple[int, float]:
        """(pieces, best score) of one word."""
        n = len(w)
        score: list = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        done = 0
        single = False

        def close(end: int) -> None:
            # The last candidate at an end is its last character as unknown, if no piece is that character.
            base = score[end - 1]
            if not single:
                s = base + self.unknown
                if score[end] is None or s > score[end]:
                    score[end] = s
                    count[end] = count[end - 1] + len(w[end - 1].encode("utf-8", "surrogatepass"))

        for at, (size, s) in self.find.iter(w):
            end = at + 1
            while done < at:
                done += 1
                close(done)
                single = False
            start = end - size
            s += score[start]
            if score[end] is None or s > score[end]:
                score[end] = s
                count[end] = count[start] + 1
            if size == 1:
                single = True
        while done < n:
            done += 1
            close(done)
            single = False
        return count[n], score[n]

    def text(self, t: str) -> tuple[int, float]:
        if not t:
            return 0, 0.0
        t = t.replace(SPACE, " ")
        if t[0] != " ":
            t = " " + t
        if len(self.seen) > CACHED:
            self.seen.clear()
        seen, pieces, score = self.seen, 0, 0.0
        for w in t[1:].split(" "):
            r = seen.get(w)
            if r is None:
                r = self.word(SPACE + w)
                if len(w) < 64:
                    seen[w] = r
            pieces += r[0]
            score += r[1]
        return pieces, score


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score for each row; ``path`` is a vocabulary in sentencepiece's format."""

    def fn(batches):
        c = _counter(path)
        for b in batches:
            got = [c.text(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(fn, "doc_id long, n_tokens long, score double")
