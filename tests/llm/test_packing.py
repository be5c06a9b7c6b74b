import zlib
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import packing, tokens

from . import cases

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, got, capacity):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    by_doc = defaultdict(list)
    for i, t in rows:
        by_doc[i].append(ids_of(t))
    for i, many in by_doc.items():
        assert len(many) == 1
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(many[0])
            assert r.ids_crc32 == zlib.crc32(np.array(many[0][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(many[0])
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append(r)
    short = 0
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        short += at < capacity
    return short, len(seq)


@pytest.mark.parametrize("capacity,grain", [(4096, 32), (128, 8)])
def test_every_id_once(spark, capacity, grain):
    rows = [*cases.texts(), (500, "Hello, World! don't <|endoftext|> it's 12 café İstanbul"), (501, "a　b c\x85d\x1ce")]
    got = packing.pack(cases.docs(spark, rows, extra=True), PATH, capacity, grain, 0.2).collect()
    short, n = check(rows, got, capacity)
    if capacity == 128:
        assert short <= 1, (short, n)


def test_repeats_null_ids_and_empty(spark):
    got = packing.pack(cases.docs(spark, [(1, "a b"), (1, "a b"), (None, None), (None, "c")]), PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in got if r.length == r.doc_tokens) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert packing.pack(cases.docs(spark, []), PATH).collect() == []


def first_fit(count, room):
    bins = []
    for size in range(room, 0, -1):
        for _ in range(int(count[size - 1])):
            for k, left in enumerate(bins):
                if left >= size:
                    bins[k] -= size
                    break
            else:
                bins.append(room - size)
    return len(bins)


def test_patterns_place_each_remainder_once():
    rng = np.random.default_rng(0)
    for room, most in ((16, 16), (128, 128), (128, 30)):
        count = np.zeros(room, np.int64)
        count[:most] = rng.integers(0, 60, most)
        got = packing.cutting_patterns(count, room)
        assert (sum(a * t for a, t in got) == count).all()
        assert all((a * np.arange(1, room + 1)).sum() <= room and t > 0 for a, t in got)
        used = sum(t for _, t in got)
        volume = (count * np.arange(1, room + 1)).sum() / room
        assert used <= first_fit(count, room) + 1 and (most != 30 or used <= volume * 1.02 + 2)


def test_word_ids_equal_whole_texts():
    code = tokens.WordIds(PATH)
    odd = ["don't Stop. it's x…. a.b. (x) 'quoted'. l'été. ÷. ñ! _a_ U.S. 5% ½% 日本. <|endoftext|> A.", "x." * 30 + " .", "...", "a.", ".a", "end-", "é.", "<|EndOfText|>", "a<|startoftext|> b"]
    rows = [t or "" for _, t in cases.texts()[-14:]] + odd
    raw = [r.encode() for r in rows]
    offs = np.cumsum([0] + [len(r) for r in raw])
    got = code.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    for g, r in zip(got, rows):
        assert np.frombuffer(g, "<u4").tolist() == ids_of(r)[:-1], r[:80]
