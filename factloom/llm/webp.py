"""Lossless WebP (VP8L): a decoder of the whole format and an encoder of grey images.

The decoder reads prefix codes, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Literals whose red, blue and
alpha codes hold one symbol each are found for a span of the stream at once: from every bit the
place of the next literal is looked up, and by doubling those of the second, fourth and eighth,
so a loop takes a step for eight samples. Prefix codes met before are recognised by their bits
and not built again.

The encoder writes grey images: samples as literals, a run of equal samples as one literal and
back-references to the sample before, with a Huffman code of the image's own. On grey images of
texts the colour cache and the cross-colour transform can't save a bit, for red, blue and alpha
take none; these and the predictor and palette are for images of other writers.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (x, y) of the 120 near distances.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        byte = self.at >> 3
        v = int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return v & ((1 << n) - 1)


#: 15-bit numbers with their bits turned round.
_TURNED = np.zeros(1 << 15, np.int64)
for _k in range(15):
    _TURNED |= (np.arange(1 << 15) >> _k & 1) << (14 - _k)


def _ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in the order of their codes, the codes' lengths, and the codes as 15-bit numbers, first bit highest."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used]
    part = np.int64(1) << (15 - n)
    return used, n, np.cumsum(part) - part


def canonical(lengths: np.ndarray) -> dict[int, int]:
    """Codes by symbol, first bit lowest."""
    used, _, code = _ordered(np.asarray(lengths, np.int64))
    return dict(zip(used.tolist(), _TURNED[code].tolist()))


class Code:
    """A prefix code as a table over the next ``width`` bits."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        used, n, _ = _ordered(lengths)
        self.single = None
        if len(used) <= 1:
            self.single, self.width = int(used[0]) if len(used) else 0, 0
            return
        self.width = w = int(n[-1])
        span = 1 << (w - n)
        if int(span.sum()) != 1 << w:
            raise ValueError("a prefix code is incomplete or over-full")
        turned = _TURNED[: 1 << w] >> (15 - w)
        self.symbol = np.repeat(used, span).astype(np.uint16)[turned]
        self.length = np.repeat(n, span).astype(np.uint8)[turned]
        # Bits to go on; none where another symbol than a literal stands.
        self.step = np.where(self.symbol < 256, self.length, 0)
        self._s = self._n = None
        self.reads = 0

    @classmethod
    def of_one(cls, symbol: int) -> "Code":
        c = cls.__new__(cls)
        c.single, c.width = symbol, 0
        return c

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        byte = bits.at >> 3
        v = (int.from_bytes(bits.data[byte : byte + 4], "little") >> (bits.at & 7)) & ((1 << self.width) - 1)
        if self._s is None:
            # Lists are quicker, once there is much to read.
            self.reads += 1
            if self.reads < 100:
                bits.at += int(self.length[v])
                if bits.at > 8 * len(bits.data):
                    raise ValueError("the stream ends early")
                return int(self.symbol[v])
            self._s, self._n = self.symbol.tolist(), self.length.tolist()
        bits.at += self._n[v]
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        return self._s[v]


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return Code.of_one(first)
        lengths[first] = 1
        lengths[bits.read(8)] = 1
        return Code(lengths)
    outer = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        outer[k] = bits.read(3)
    code = Code(outer)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if code.single is None:
        symbol, step, mask = code.symbol.tolist(), code.length.tolist(), (1 << code.width) - 1
    else:
        symbol, step, mask = [code.single], [0], 0
    i, before, data, at = 0, 8, bits.data, bits.at
    while i < size and most:
        most -= 1
        # A code of at most 7 bits and its at most 7 extra bits.
        v = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        s, n = symbol[v & mask], step[v & mask]
        at += n
        if s < 16:
            lengths[i] = s
            i += 1
            before = s or before
            continue
        v >>= n
        if s == 16:
            n, value, at = 3 + (v & 3), before, at + 2
        elif s == 17:
            n, value, at = 3 + (v & 7), 0, at + 3
        else:
            n, value, at = 11 + (v & 127), 0, at + 7
        if i + n > size:
            raise ValueError("code lengths overrun the alphabet")
        lengths[i : i + n] = [value] * n
        i += n
    bits.at = at
    if at > 8 * len(data):
        raise ValueError("the stream ends early")
    return Code(lengths)


def _prefixed(bits: Bits, p: int) -> int:
    if p < 4:
        return p + 1
    extra = (p - 2) >> 1
    return ((2 + (p & 1)) << extra) + bits.read(extra) + 1


_met: dict[bytes, list[tuple[int, int, list]]] = {}


def _codes(bits: Bits, sizes: tuple) -> list[Code]:
    """Five prefix codes; equal bits give the codes built for them before."""
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 512], "little") >> (bits.at & 7)
    near = (ahead & ((1 << 96) - 1)).to_bytes(12, "little") + repr(sizes).encode()
    for n, value, codes in _met.get(near, ()):
        if ahead & ((1 << n) - 1) == value and bits.at + n <= 8 * len(bits.data):
            bits.at += n
            return codes
    start = bits.at
    codes = [read_code(bits, n) for n in sizes]
    n = bits.at - start
    if n < 4000:
        if len(_met) > 256:
            _met.clear()
        _met.setdefault(near, []).append((n, ahead & ((1 << n) - 1), codes))
    return codes


#: Bits of a stream that are looked at together.
SPAN = 1 << 18


class Literals:
    """Literals of one code, found by following the code lengths from every bit of a span at once."""

    def __init__(self, bits: Bits, code: Code):
        self.bits, self.code, self.first, self.end = bits, code, 0, 0

    def look(self) -> None:
        """Tables over the bits from the reader's place on: the places one, two, four and eight literals further, or of the symbol that is none."""
        data, code = self.bits.data, self.code
        start = self.bits.at >> 3
        raw = np.frombuffer(data[start : start + SPAN // 8 + 3], np.uint8).astype(np.uint32)
        size = min(SPAN // 8, len(raw))
        raw = np.append(raw, np.zeros(3, np.uint32))
        word = raw[: size] | raw[1 : size + 1] << np.uint32(8) | raw[2 : size + 2] << np.uint32(16)
        look = ((word[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.width) - 1)).ravel().astype(np.intp)
        self.first, self.end = 8 * start, 8 * start + len(look)
        self.window = look
        # A literal that leaves the span ends in the places behind it, which stay where they are.
        hop = np.arange(len(look) + 16)
        hop[: len(look)] += code.step[look]
        self.hops = [hop]
        for _ in range(3):
            self.hops.append(self.hops[-1][self.hops[-1]])
        self.leap = memoryview(self.hops.pop())

    def take(self, most: int) -> np.ndarray:
        """The literals from the reader's place on, ``most`` at most, up to another symbol or the end of the span."""
        if not self.first <= self.bits.at < self.end:
            self.look()
        at = self.bits.at - self.first
        leap, last, seen = self.leap, self.end - self.first, []
        for _ in range(-(-most // 8)):
            seen.append(at)
            to = leap[at]
            if to == at:
                break
            at = to
            if at >= last:
                break
        place = np.array(seen)[:, None]
        for hop in self.hops[::-1]:
            place = np.concatenate([place, hop[place]], axis=1)
        # Places in order: by eights, then fours, twos and ones.
        place = place[:, (0, 4, 2, 6, 1, 5, 3, 7)].ravel()
        moved = np.append(place[1:] > place[:-1], leap[place[-1]] > place[-1])
        n = min(most, int(moved.sum()) if moved.all() else int(np.argmin(moved)))
        got = self.code.symbol[self.window[place[:n]]]
        self.bits.at = self.first + (int(place[n]) if n < len(place) else at)
        if self.bits.at > 8 * len(self.bits.data):
            raise ValueError("the stream ends early")
        return got


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Spatially coded image as 32-bit ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, which = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        w = (width + (1 << block) - 1) >> block
        h = (height + (1 << block) - 1) >> block
        which = ((_image(bits, w, h, False) >> 8) & 0xFFFF).reshape(h, w)
        groups = int(which.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [_codes(bits, sizes) for _ in range(groups)]
    total = width * height
    out = np.zeros(total, np.uint32)
    green, red, blue, alpha, far = codes[0]
    plain = which is None and not cache_bits and None not in (red.single, blue.single, alpha.single)
    fixed = (alpha.single or 0) << 24 | (red.single or 0) << 16 | (blue.single or 0) if plain else 0
    if plain and green.single is not None and green.single < 256:
        out[:] = fixed | green.single << 8
        return out
    literals = Literals(bits, green) if plain and green.single is None else None
    cache = [0] * (1 << cache_bits) if cache_bits else None
    done = 0
    n = 0
    while n < total:
        if literals:
            got = literals.take(total - n)
            if len(got):
                out[n : n + len(got)] = got.astype(np.uint32) << np.uint32(8) | np.uint32(fixed)
                n += len(got)
                continue
        if which is not None:
            y, x = divmod(n, width)
            green, red, blue, alpha, far = codes[which[y >> block, x >> block]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[n] = a << 24 | r << 16 | s << 8 | b
            n += 1
        elif s < 280:
            length, code = _prefixed(bits, s - 256), _prefixed(bits, far.read(bits))
            if code > 120:
                dist = code - 120
            else:
                dist = max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if dist > n or n + length > total:
                raise ValueError("a back-reference leaves the image")
            if dist == 1:
                out[n : n + length] = out[n - 1]
            elif dist >= length:
                out[n : n + length] = out[n - dist : n - dist + length]
            else:
                out[n : n + length] = np.resize(out[n - dist : n], length)
            n += length
        else:
            while done < n:
                v = int(out[done])
                cache[((CACHE_FACTOR * v) & 0xFFFFFFFF) >> (32 - cache_bits)] = v
                done += 1
            out[n] = cache[s - 280]
            n += 1
    return out


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(v: int) -> tuple[int, int, int, int]:
    return v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255


def _select(left: int, top: int, corner: int) -> int:
    near_left = near_top = 0
    for a, b, c in zip(_channels(left), _channels(top), _channels(corner)):
        near_left += abs(b - c)
        near_top += abs(a - c)
    return left if near_left < near_top else top


def _clamped(left: int, top: int, corner: int, half: bool) -> int:
    out = 0
    if half:
        left = _average(left, top)
    for a, b, c in zip(_channels(left), _channels(top), _channels(corner)):
        # Halving truncates toward zero.
        d = a + int((a - c) / 2) if half else a + b - c
        out = out << 8 | min(255, max(0, d))
    return out


def _predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _clamped(left, top, corner, False)
    if mode == 13:
        return _clamped(left, top, corner, True)
    return 0xFF000000


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _unpredict(px: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    v = px.tolist()
    row = (width + (1 << block) - 1) >> block
    mode = (modes >> 8 & 15).tolist()
    for i in range(width * height):
        y, x = divmod(i, width)
        if not y:
            guess = v[i - 1] if x else 0xFF000000
        elif not x:
            guess = v[i - width]
        else:
            # Above the right of the last column lies the row's own first pixel.
            guess = _predicted(mode[(y >> block) * row + (x >> block)], v[i - 1], v[i - width], v[i - width + 1], v[i - width - 1])
        v[i] = _add(v[i], guess)
    return np.array(v, np.uint32)


def _uncross(px: np.ndarray, width: int, height: int, block: int, data: np.ndarray) -> np.ndarray:
    row = (width + (1 << block) - 1) >> block
    y, x = np.divmod(np.arange(width * height), width)
    e = data[(y >> block) * row + (x >> block)]
    byte = lambda v, s: (v >> np.uint32(s) & np.uint32(255)).astype(np.uint8).astype(np.int8).astype(np.int32)
    green_red, green_blue, red_blue = byte(e, 0), byte(e, 8), byte(e, 16)
    g = byte(px, 8)
    red = (px >> np.uint32(16) & np.uint32(255)).astype(np.int32) + (green_red * g >> 5) & 255
    blue = (px & np.uint32(255)).astype(np.int32) + (green_blue * g >> 5)
    blue = blue + (red_blue * red.astype(np.uint8).astype(np.int8).astype(np.int32) >> 5) & 255
    return px & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _add_green(px: np.ndarray) -> np.ndarray:
    g = px >> np.uint32(8) & np.uint32(255)
    return px & np.uint32(0xFF00FF00) | (px & np.uint32(0x00FF00FF)) + (g << np.uint32(16) | g) & np.uint32(0x00FF00FF)


def _unindex(px: np.ndarray, narrow: int, width: int, height: int, shift: int, table: np.ndarray) -> np.ndarray:
    index = (px >> np.uint32(8) & np.uint32(255)).reshape(height, narrow)
    if shift:
        depth = 8 >> shift
        x = np.arange(width)
        index = index[:, x >> shift] >> ((x & (1 << shift) - 1) * depth).astype(np.uint32) & np.uint32((1 << depth) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


def _add_channels(v: np.ndarray) -> np.ndarray:
    """Running sums of each byte of 32-bit pixels."""
    return np.cumsum(v.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view("<u4").ravel()


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) samples, red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        at += 8 + n + (n & 1)
    n = struct.unpack("<I", data[at + 4 : at + 8])[0]
    bits = Bits(data[at + 8 : at + 8 + n])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            sub = _image(bits, (w + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append(lambda px, f=(_unpredict, _uncross)[kind], w=w, b=block, s=sub: f(px, w, height, b, s))
        elif kind == 2:
            undo.append(_add_green)
        else:
            colours = bits.read(8) + 1
            table = _add_channels(_image(bits, colours, 1, False))
            shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            narrow = (w + (1 << shift) - 1) >> shift
            undo.append(lambda px, n=narrow, w=w, s=shift, t=table: _unindex(px, n, w, height, s, t))
            w = narrow
    px = _image(bits, w, height, True)
    for f in reversed(undo):
        px = f(px)
    out = px.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
    if not alpha:
        out = out.copy()
        out[..., 3] = 255
    return out


def code_lengths(count: np.ndarray, most: int = 12) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; rare counts are raised until the code is short enough."""
    used = np.flatnonzero(count)
    used = used[np.argsort(count[used], kind="stable")]
    leaves, n = count[used].tolist(), len(used)
    out = np.zeros(len(count), np.int64)
    floor = 1
    while n > 1:
        # Sums arise in rising order, so two rising rows, leaves and sums, are merged without a heap.
        weight, parent = [x if x > floor else floor for x in leaves], [0] * (2 * n - 1)
        leaf, inner = 0, n
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (inner == k or weight[leaf] <= weight[inner]):
                    total += weight[leaf]
                    parent[leaf] = k
                    leaf += 1
                else:
                    total += weight[inner]
                    parent[inner] = k
                    inner += 1
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            out[used] = depth[:n]
            break
        floor *= 2
    return out


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n


def write_one(w: Writer, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    w.write(0b101 | symbol << 3, 11)


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        w.write(1, 1)
        w.write(len(used) == 2, 1)
        w.write(1, 1)
        for s in used.tolist() or [0]:
            w.write(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []
    n, end = len(lengths), int(used[-1]) + 1
    edge = [0, *(np.flatnonzero(np.diff(lengths[:end])) + 1).tolist(), end]
    for i, j, v in zip(edge, edge[1:], lengths[edge[:-1]].tolist()):
        run = j - i
        if v:
            tokens += [(v, 0, 0)] * run
            continue
        while run >= 11:
            k = min(run, 138)
            tokens.append((18, k - 11, 7))
            run -= k
        if run >= 3:
            tokens.append((17, run - 3, 3))
            run = 0
        tokens += [(0, 0, 0)] * run
    outer = np.bincount([t[0] for t in tokens], minlength=19)
    if np.count_nonzero(outer) == 1:
        outer[0 if not outer[0] else 1] += 1
    inner = code_lengths(outer, 7)
    codes = canonical(inner)
    inner = inner.tolist()
    last = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if inner[s]) + 1
    w.write(0, 1)
    w.write(max(last, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(last, 4)]:
        w.write(inner[s], 3)
    if len(tokens) >= 2 and end < n:
        need = (len(tokens) - 2).bit_length()
        k = max(0, -(-(need - 2) // 2))
        w.write(1, 1)
        w.write(k, 3)
        w.write(len(tokens) - 2, 2 + 2 * k)
    else:
        w.write(0, 1)
        if end < n:
            # One token only: the rest of the alphabet follows as zeros of their own.
            raise ValueError("a code of one length")
    for s, extra, bits in tokens:
        w.write(codes[s] | extra << inner[s], inner[s] + bits)


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def shape_of(samples: int, row: int) -> tuple[int, int]:
    """Width, a multiple of ``row``, and height of an image that holds so many samples."""
    rows = -(-samples // row)
    wide = -(-rows // 16384)
    if wide * row > 16384:
        raise ValueError("more samples than an image can hold")
    return wide * row, -(-rows // wide)


#: Runs of at least so many equal samples become back-references of at most LONGEST.
RUN, LONGEST = 16, 4096


def runs(samples: np.ndarray) -> list[tuple[int, int]]:
    """(place, length) of back-references to the sample before: the rest of each long run of equal samples."""
    same = np.empty(len(samples) + 1, np.int8)
    same[0] = same[-1] = 0
    np.equal(samples[1:], samples[:-1], out=same[1:-1].view(bool))
    step = np.diff(same)
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    out = []
    for k in np.flatnonzero(end - start >= RUN - 1).tolist():
        for at in range(int(start[k]), int(end[k]), LONGEST):
            out.append((at, min(LONGEST, int(end[k]) - at)))
    return out


def prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol of a length or distance code, and its extra bits (value, number)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    return 2 * top + (v >> (top - 1) & 1), v & ((1 << (top - 1)) - 1), top - 1


def encode_grey(samples: np.ndarray, width: int, height: int) -> bytes:
    """A grey image: subtract-green leaves red and blue at one symbol, green has a prefix code, runs refer back."""
    w = Writer()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(0, 1)
    w.write(0, 3)
    w.write(1, 1)
    w.write(2, 2)
    w.write(0, 1)
    w.write(0, 1)
    w.write(0, 1)
    single = not (samples != samples[0]).any()
    refs = [] if single else runs(samples)
    symbol, extra = samples, np.zeros((0, 3), np.int64)
    if refs:
        parts, done, place, found = [], 0, 0, []
        for at, n in refs:
            p, value, bits = prefix(n)
            parts += [samples[done:at], np.array([256 + p], np.uint16)]
            place += at - done + 1
            found.append((place - 1, value, bits))
            done = at + n
        symbol, extra = np.concatenate([*parts, samples[done:]]), np.array(found, np.int64)
    if single:
        write_one(w, int(samples[0]))
    else:
        count = sum(np.bincount(symbol[at : at + PART], minlength=280) for at in range(0, len(symbol), PART))
        lengths = code_lengths(count)
        write_code(w, lengths)
    # The only distance is 1, which is the second of the near ones.
    for only in (0, 0, 255, prefix(2)[0] if refs else 0):
        write_one(w, only)
    if single:
        return container(w.value.to_bytes(-(-w.n // 8), "little"))
    return container(_packed(w, symbol, lengths, extra, w.n + int((count * lengths).sum() + extra[:, 2].sum())))


#: Symbols that are packed at a time.
PART = 1 << 20


def _packed(w: Writer, symbol: np.ndarray, lengths: np.ndarray, extra: np.ndarray, total: int) -> bytes:
    """The header's bits and then each symbol's code with its extra bits (place, value, number)."""
    table = np.zeros(len(lengths), np.int64)
    for s, c in canonical(lengths).items():
        table[s] = c
    out = np.zeros(-(-total // 32) + 2, np.uint64)
    head = np.frombuffer(w.value.to_bytes(4 * -(-w.n // 32), "little"), "<u4")
    out[: len(head)] = head
    begin = w.n
    for lo in range(0, len(symbol), PART):
        part = symbol[lo : lo + PART]
        code, size = table[part], lengths[part]
        a, b = np.searchsorted(extra[:, 0], (lo, lo + PART))
        if b > a:
            at = extra[a:b, 0] - lo
            code[at] |= extra[a:b, 1] << size[at]
            size[at] += extra[a:b, 2]
        at = np.cumsum(size)
        end = begin + int(at[-1])
        at += begin - size
        # Bits of one word never overlap, and codes end below bit 53, so their sum is exact as a float.
        first = begin >> 5
        word = np.bincount((at >> 5) - first, weights=code << (at & 31)).astype(np.uint64)
        out[first : first + len(word)] += word & np.uint64(0xFFFFFFFF)
        out[first + 1 : first + 1 + len(word)] += word >> np.uint64(32)
        begin = end
    return out.astype("<u4").tobytes()[: -(-total // 8)]
