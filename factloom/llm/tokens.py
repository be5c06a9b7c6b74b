"""Token ids by words: white space ends a word for these tokenizers, so a word's ids don't depend on its neighbours.

Case doesn't count for them, and a run of punctuation after a letter or digit is a token
group of its own; so A-Z are lower-cased first and such a run at a word's end is looked up
apart, which leaves fewer different words.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .textkit import LOWER, SPACE, mix, words

CACHED = 800_000
JOINED = 2000
#: Words looked up at once.
AT_ONCE = 400_000
#: A word's ending: punctuation other than an apostrophe, after an ASCII letter or digit.
_ENDING = np.zeros(256, bool)
_ENDING[list(b'%*&$#@!.,;:?()[]{}"/+=_~^-')] = True
_BEFORE = np.zeros(256, bool)
_BEFORE[[*range(48, 58), *range(97, 123)]] = True


def endings(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where a blank goes before the ending of a word, in lower-cased bytes of whole rows."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    mark = np.zeros(len(data) + 2, np.int8)
    mark[1:-1] = _ENDING[data]
    step = np.diff(mark)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inside = (start > 0) & ~edge[start]
    fine = inside & _BEFORE[data[np.maximum(start - 1, 0)]]
    fine &= edge[end] | SPACE[data[np.minimum(end, len(data) - 1)]]
    return start[fine]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordIds:
    """Little-endian 32-bit ids of texts (bytes), with a bounded memory of words already seen.

    A word of up to 16 bytes is two integers and its size, kept in an open hash table that is
    searched for many words at once; longer words are kept in a dictionary.
    """

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.count = 0
        self.slots = np.full(1 << 21, -1, np.int32)
        self.one, self.two, self.size = (np.zeros(1 << 12, np.uint64) for _ in range(3))
        self.at = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, "<u4")
        self.long: dict[bytes, int] = {}

    def _add(self, ids: np.ndarray, at: np.ndarray) -> None:
        """``ids[at[i]:at[i+1]]`` are the ids of the i-th of the words that come next."""
        n, more = self.count, len(at) - 1
        base = int(self.at[n])
        while len(self.at) <= n + more:
            self.at = np.append(self.at, np.zeros(len(self.at), np.int64))
        while len(self.flat) < base + len(ids):
            self.flat = np.append(self.flat, np.zeros(len(self.flat), "<u4"))
        self.flat[base : base + len(ids)] = ids
        self.at[n + 1 : n + 1 + more] = base + at[1:]
        self.count += more

    def learn(self, words: list[bytes]) -> None:
        """Look up words not seen yet, many in one text, those with a special token's mark last; a token belongs to the word in which it starts."""
        tok = _tokenizer(self.path)
        # A special token may reach over the blanks around it, so words with its mark stand alone.
        alone = next((i for i, w in enumerate(words) if b"<|" in w), len(words))
        for part in [words[i : min(i + JOINED, alone)] for i in range(0, alone, JOINED)] + [[w] for w in words[alone:]]:
            text = [w.decode("utf-8", "replace") for w in part]
            e = tok.encode(" ".join(text), add_special_tokens=False)
            start = np.cumsum([0] + [len(w) + 1 for w in text])
            at = np.searchsorted(np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], start)
            at[-1] = len(e.ids)
            self._add(np.array(e.ids, "<u4"), at)

    def _slot(self, one, two, size) -> np.ndarray:
        return (mix(one ^ mix(two + size, 1)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, one, two, size) -> np.ndarray:
        """Number of each word, -1 for a new one."""
        slot = self._slot(one, two, size)
        got = self.slots[slot]
        odd = np.flatnonzero((got >= 0) & ((self.one[got] != one) | (self.two[got] != two) | (self.size[got] != size)))
        while len(odd):
            slot[odd] = slot[odd] + 1 & len(self.slots) - 1
            n = got[odd] = self.slots[slot[odd]]
            odd = odd[(n >= 0) & ((self.one[n] != one[odd]) | (self.two[n] != two[odd]) | (self.size[n] != size[odd]))]
        return got

    def _insert(self, first: int, one, two, size) -> None:
        """Words numbered from ``first`` on."""
        while len(self.one) < first + len(one):
            self.one, self.two, self.size = (np.append(c, np.zeros(len(c), np.uint64)) for c in (self.one, self.two, self.size))
        for c, v in ((self.one, one), (self.two, two), (self.size, size)):
            c[first : first + len(v)] = v
        slot, todo = self._slot(one, two, size), np.arange(len(one))
        while len(todo):
            at = slot[todo]
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free] + first
            todo = todo[self.slots[at] != todo + first]
            slot[todo] = slot[todo] + 1 & len(self.slots) - 1

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each of these words stands in the memory."""
        n = ends - starts
        padded = np.concatenate([data[starts[0] : ends[-1]], np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        place = starts - starts[0]
        key = eight[place] & _LOW[np.minimum(n, 8)], eight[place + 8] & _LOW[np.clip(n - 8, 0, 8)], n.astype(np.uint64)
        got = self._find(*key)
        long = np.flatnonzero(n > 16)
        if len(long):
            raw = padded.tobytes()
            name = [raw[a:b] for a, b in zip(place[long].tolist(), (place + n)[long].tolist())]
            got[long] = [self.long.get(w, -1) for w in name]
        new = np.flatnonzero(got < 0)
        if len(new):
            if self.count > CACHED:
                self.forget()
                return self.numbers(data, starts, ends)
            raw = padded.tobytes()
            where: dict[bytes, int] = {}
            name = [raw[a:b] for a, b in zip(place[new].tolist(), (place + n)[new].tolist())]
            for w, i in zip(name, new.tolist()):
                where.setdefault(w, i)
            # Short words first, since their numbers follow one another in the table; a special token's mark is learnt apart.
            order = sorted(where, key=lambda w: (b"<|" in w, len(w) > 16))
            first = self.count
            self.learn(order)
            number = {w: first + k for k, w in enumerate(order)}
            short = [k for k, w in enumerate(order) if len(w) <= 16]
            for lo, hi in _ranges(short):
                at = np.array([where[w] for w in order[lo:hi]])
                self._insert(first + lo, *(c[at] for c in key))
            self.long.update((w, number[w]) for w in order if len(w) > 16)
            got[new] = [number[w] for w in name]
        return got

    def _ids(self, data: np.ndarray, offs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin); a word also ends at the places ``at``."""
        starts, ends, _ = words(data, offs)
        if len(at):
            to = np.searchsorted(starts, at)
            starts, ends = np.insert(starts, to, at), np.insert(ends, to - 1, at)
        ids, sizes = [], []
        for i in range(0, len(starts), AT_ONCE):
            word = self.numbers(data, starts[i : i + AT_ONCE], ends[i : i + AT_ONCE])
            begin = self.at[word]
            size = self.at[word + 1] - begin
            after = np.cumsum(size)
            ids.append(self.flat[np.repeat(begin - after + size, size) + np.arange(after[-1])])
            sizes.append(size)
        if not ids:
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        return np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(sizes)))[np.searchsorted(starts, offs)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each row of a block of bytes."""
        low = LOWER[data]
        ids, at = self._ids(low, offs, endings(low, offs) if len(data) else np.zeros(0, np.int64))
        raw, at = ids.tobytes(), (4 * at).tolist()
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
        plain = data.tobytes()
        if b"<|" in plain:
            # Where a special token's mark occurs, the text is left as it is.
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                if plain.find(b"<|", a, b) >= 0:
                    out[i] = self._ids(data[a:b], np.array([0, b - a]), np.zeros(0, np.int64))[0].tobytes()
        return out


def _ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs of following numbers as (first, after last)."""
    out: list[tuple[int, int]] = []
    for k in numbers:
        if out and out[-1][1] == k:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


@lru_cache(maxsize=2)
def shared_ids(path: str) -> WordIds:
    """One memory a worker process, which its later tasks find filled."""
    return WordIds(path)
