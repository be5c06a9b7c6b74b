import hashlib
import random
import zlib

import numpy as np
import pytest

from factloom.llm import media, webp

from . import cases
from .webp_writer import write


def same(data, px, width, height):
    got = webp.decode(data)
    assert got.shape == (height, width, 4)
    want = np.array(px, np.uint32).reshape(height, width)
    for c, s in enumerate((16, 8, 0, 24)):
        assert (got[..., c] == (want >> s & 255)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 9, 60, 2000])
@pytest.mark.parametrize("seed", range(4))
def test_every_feature(colours, seed):
    rng = random.Random(100 * colours + seed)
    width, height = rng.randrange(1, 40), rng.randrange(1, 25)
    few = [rng.getrandbits(32) for _ in range(colours)]
    px = [rng.choice(few) for _ in range(width * height)]
    for k in range(20, len(px) - 20, 37):
        px[k : k + 15] = px[k - 19 : k - 4]
    kinds = ["predictor", "cross", "green"] + ["palette"] * (colours <= 60)
    chosen = rng.sample(kinds, rng.randrange(len(kinds) + 1))
    if "palette" in chosen:
        # The palette comes first; what follows works on its indices.
        chosen = ["palette"] + [c for c in chosen if c not in ("palette", "green")]
    same(write(px, width, height, rng, chosen, cache_bits=rng.choice([0, 1, 4, 8]), copies=rng.random() < 0.6, groups=rng.choice([0, 2, 3])), px, width, height)


def test_predictors_alone():
    rng = random.Random(9)
    px = [rng.getrandbits(32) for _ in range(33 * 40)]
    same(write(px, 33, 40, rng, ["predictor"]), px, 33, 40)
    same(write(px, 33, 40, rng, ["cross", "predictor", "green"]), px, 33, 40)


@pytest.mark.parametrize("n", [1, 575, 576, 577, 5000, 576 * 70])
def test_round_trip_of_grey(n):
    rng = np.random.default_rng(n)
    for raw in (rng.integers(0, 256, n).astype(np.uint8), rng.choice([97, 98], n).astype(np.uint8), np.full(n, 255, np.uint8), (rng.geometric(0.5, n) % 256).astype(np.uint8)):
        p = media.payload(raw)
        back, _ = media.load(media.store(p), len(p))
        assert (back == p).all()


def test_very_long_text_is_wide():
    assert webp.shape_of(576 * 16385, 576) == (1152, 8193)


def test_bad_streams_raise():
    good = media.store(media.payload(np.arange(200, dtype=np.uint8)))
    for bad in (b"", good[:12], good[:-60], good.replace(b"VP8L", b"VP8X")):
        with pytest.raises((ValueError, IndexError, webp.struct.error)):
            webp.decode(bad)


def test_media_columns(spark):
    rows = cases.texts() + [(3, "twice"), (None, "twice")]
    got = media.media_columns(cases.docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = {}
    for _, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        want[hashlib.sha256(p).hexdigest()] = (len(p), zlib.crc32(p[-32:]))
    stored = {}
    for r in got:
        assert want[r.payload_sha256] == (r.payload_bytes, r.tail_crc32)
        assert stored.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    kept = media.media_columns(cases.docs(spark, rows[:3]), keep_media=True).collect()
    assert all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes for r in kept)
    assert media.media_columns(cases.docs(spark, [])).collect() == []


def test_runs_are_references_and_read_back():
    from factloom.llm import media

    rng = np.random.default_rng(3)
    for n, run in ((576, 300), (5760, 16), (576 * 20, 9000), (1152, 2), (576, 575)):
        x = rng.integers(97, 110, n).astype(np.uint8)
        x[n - run :] = 255
        x[n // 3 : n // 3 + run // 4] = 65
        refs = webp.runs(x)
        assert all((x[at : at + k] == x[at - 1]).all() and 0 < k <= webp.LONGEST for at, k in refs)
        assert not refs if run < webp.RUN else sum(k for _, k in refs) >= run - 3 - run // 4
        w, h = webp.shape_of(n, media.ROW)
        file = webp.encode_grey(x, w, h)
        assert (webp.decode(file)[..., 1].ravel() == x).all() and (webp.decode(file)[..., 3] == 255).all()
    for v in (1, 2, 4, 5, 100, 4096):
        p, value, bits = webp.prefix(v)
        stream = webp.Bits(int(value).to_bytes(4, "little"))
        assert webp._prefixed(stream, p) == v and stream.at == bits


def test_texts_meet_references_and_long_ones_several_images(spark):
    from factloom.llm import media

    rows = [(i, t) for i, t in cases.texts()]
    met = sum(bool(webp.runs(media.payload(np.frombuffer((t or "").encode(), np.uint8)))) for _, t in rows)
    assert met > len(rows) // 2
    x = np.frombuffer(("abc" * 2000).encode(), np.uint8)
    p = media.payload(x)
    back, greys = media.load(media.store(p, 1152), len(p), 1152)
    assert (back == p).all() and len(greys) == -(-len(p) // 1152)
    got = media.media_columns(cases.docs(spark, rows), keep_media=True).collect()
    want = {i: media.payload(np.frombuffer((t or "").encode(), np.uint8)).tobytes() for i, t in rows}
    assert {r.doc_id: bytes(r.pixels) for r in got} == want


@pytest.mark.parametrize("span,part", [(8, 1), (64, 7), (264, 100)])
def test_spans_and_parts_of_any_size(monkeypatch, span, part):
    rng = np.random.default_rng(span)
    texts = [rng.choice([97, 98, 99], 3000, p=[0.9, 0.09, 0.01]), rng.integers(0, 256, 2000), np.repeat(rng.integers(97, 110, 90), rng.integers(1, 60, 90)), (rng.geometric(0.02, 4000) % 256)]
    payloads = [media.payload(x.astype(np.uint8)) for x in texts]
    whole = [media.store(p) for p in payloads]
    monkeypatch.setattr(webp, "SPAN", span)
    monkeypatch.setattr(webp, "PART", part)
    for p, file in zip(payloads, whole):
        assert media.store(p) == file
        assert (media.load(file, len(p))[0] == p).all()


def test_code_lengths_are_huffman_and_limited():
    import heapq

    rng = np.random.default_rng(5)
    for n in (2, 3, 19, 60, 280):
        count = np.zeros(280, np.int64)
        count[rng.permutation(280)[:n]] = rng.integers(1, 1000, n)
        got = webp.code_lengths(count, 40)
        heap, cost = sorted(count[count > 0].tolist()), 0
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert int((got * count).sum()) == cost and sum(2.0 ** -got[got > 0]) == 1
    steep = np.array([2**k for k in range(40)])
    short = webp.code_lengths(steep, 7)
    assert short.max() <= 7 and sum(2.0**-short) == 1


def test_feature_against_loops():
    rng = np.random.default_rng(2)
    for h, w in ((1, 576), (3, 576), (17, 576), (40, 1152)):
        g = rng.integers(0, 256, (h, w)).astype(np.uint8)
        v = g.tolist()
        cells = []
        for i in range(8):
            top, below = h * i // 8, h * (i + 1) // 8
            for j in range(8):
                left, right = w * j // 8, w * (j + 1) // 8
                # A band without rows takes the row at its place.
                cells.append(sum(v[y][x] for y in range(top, max(below, top + 1)) for x in range(left, right)) // (max(1, below - top) * (right - left)))
        bits = "".join("1" if c * 64 > sum(cells) else "0" for c in cells)
        dx = sum(abs(a - b) for r in v for a, b in zip(r, r[1:]))
        dy = sum(abs(a - b) for r, q in zip(v, v[1:]) for a, b in zip(r, q))
        assert media.describe(g) == f"{w}x{h};{sum(map(sum, v))};{dx};{dy};{int(bits, 2):016x}"
