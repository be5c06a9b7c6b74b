"""A slow writer of lossless WebP that uses every feature, to test the decoder with."""

import numpy as np

from factloom.llm import webp


def prefix(v):
    """(prefix code, extra bits, their number) of a length or distance code from 1."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, v & ((1 << (n - 1)) - 1), n - 1


def tokens(px, width, cache_bits, copies, rng):
    """Literals, copies and colour cache hits for a list of 32-bit pixels."""
    out, i, cache = [], 0, {}
    slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    seen = {}
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(webp.NEAR)))}
    while i < len(px):
        n, at = 0, seen.get(px[i])
        if copies and at is not None:
            while i + n < len(px) and px[at + n] == px[i + n] and n < 4096:
                n += 1
        if n >= 3:
            d = i - at
            out.append(("copy", n, near[d] if d in near and rng.random() < 0.7 else d + 120))
        elif cache_bits and cache.get(slot(px[i])) == px[i]:
            out.append(("cache", slot(px[i])))
            n = 1
        else:
            out.append(("lit", px[i]))
            n = 1
        for k in range(i, i + n):
            seen[px[k]] = k
            if cache_bits:
                cache[slot(px[k])] = px[k]
        i += n
    return out


def image(w, px, width, height, main, rng, cache_bits=0, copies=False, groups=0):
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    which = None
    if main:
        w.write(1 if groups else 0, 1)
        if groups:
            w.write(0, 3)
            gw, gh = -(-width // 4), -(-height // 4)
            which = [rng.randrange(groups) for _ in range(gw * gh)]
            which[-1] = groups - 1
            image(w, [g << 8 for g in which], gw, gh, False, rng)
    toks = tokens(px, width, cache_bits, copies, rng)
    place, at = [], 0
    for t in toks:
        y, x = divmod(at, width)
        place.append(which[(y // 4) * -(-width // 4) + x // 4] if which else 0)
        at += t[1] if t[0] == "copy" else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    count = np.zeros((max(1, groups), 5, max(sizes)), np.int64)
    for t, g in zip(toks, place):
        if t[0] == "lit":
            for c, v in enumerate((t[1] >> 8 & 255, t[1] >> 16 & 255, t[1] & 255, t[1] >> 24)):
                count[g, c, v] += 1
        elif t[0] == "cache":
            count[g, 0, 280 + t[1]] += 1
        else:
            count[g, 0, 256 + prefix(t[1])[0]] += 1
            count[g, 4, prefix(t[2])[0]] += 1
    lengths, codes = [], []
    for g in range(max(1, groups)):
        row = []
        for c, n in enumerate(sizes):
            k = count[g, c, :n].copy()
            if not k.any():
                k[0] = 1
            if np.count_nonzero(k) == 1 and np.flatnonzero(k)[0] > 255:
                k[0] += 1
            length = webp.code_lengths(k, 15) if np.count_nonzero(k) > 1 else (k > 0).astype(np.int64)
            webp.write_code(w, length)
            row.append(length)
        lengths.append(row)
        codes.append([webp.canonical(x) if np.count_nonzero(x) > 1 else None for x in row])

    def put(g, c, s):
        if codes[g][c] is not None:
            w.write(codes[g][c][s], int(lengths[g][c][s]))

    for t, g in zip(toks, place):
        if t[0] == "lit":
            for c, v in enumerate((t[1] >> 8 & 255, t[1] >> 16 & 255, t[1] & 255, t[1] >> 24)):
                put(g, c, v)
        elif t[0] == "cache":
            put(g, 0, 280 + t[1])
        else:
            for c, base, v in ((0, 256, t[1]), (4, 0, t[2])):
                p, extra, n = prefix(v)
                put(g, c, base + p)
                w.write(extra, n)


def ch(v):
    return [v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255]


def pack(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def guess(mode, L, T, TR, TL):
    """The format's predictors, channel by channel."""
    av = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        est = [a + b - c for a, b, c in zip(L, T, TL)]
        return L if sum(abs(e - a) for e, a in zip(est, L)) < sum(abs(e - b) for e, b in zip(est, T)) else T
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(L, T, TL)]
    if mode == 13:
        return [clip(a + int((a - c) / 2)) for a, c in zip(av(L, T), TL)]
    return {
        0: [255, 0, 0, 0], 1: L, 2: T, 3: TR, 4: TL, 5: av(av(L, TR), T), 6: av(L, TL), 7: av(L, T), 8: av(TL, T), 9: av(T, TR), 10: av(av(L, TL), av(T, TR)),
    }[mode]


def signed(v):
    return v - 256 if v > 127 else v


def write(px, width, height, rng, transforms=(), **how):
    """File of the 32-bit pixels; transforms among predictor, cross, green, palette."""
    w = webp.Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.write(v, n)
    px, wide = list(px), width
    for t in transforms:
        w.write(1, 1)
        bw, bh = -(-wide // 4), -(-height // 4)
        if t == "predictor":
            w.write(0, 2)
            w.write(0, 3)
            modes = [rng.randrange(14) for _ in range(bw * bh)]
            image(w, [m << 8 for m in modes], bw, bh, False, rng)
            new = []
            for i, v in enumerate(px):
                y, x = divmod(i, wide)
                if y == 0:
                    g = ch(px[i - 1]) if x else [255, 0, 0, 0]
                elif x == 0:
                    g = ch(px[i - wide])
                else:
                    g = guess(modes[y // 4 * bw + x // 4], ch(px[i - 1]), ch(px[i - wide]), ch(px[i - wide + 1]), ch(px[i - wide - 1]))
                new.append(pack([(a - b) & 255 for a, b in zip(ch(v), g)]))
            px = new
        elif t == "cross":
            w.write(1, 2)
            w.write(0, 3)
            parts = [[rng.randrange(256) for _ in range(3)] for _ in range(bw * bh)]
            image(w, [255 << 24 | a << 16 | b << 8 | c for a, b, c in parts], bw, bh, False, rng)
            new = []
            for i, v in enumerate(px):
                y, x = divmod(i, wide)
                rb, gb, gr = parts[y // 4 * bw + x // 4]
                a, r, g, b = ch(v)
                b = b - (signed(gb) * signed(g) >> 5) - (signed(rb) * signed(r) >> 5) & 255
                r = r - (signed(gr) * signed(g) >> 5) & 255
                new.append(pack([a, r, g, b]))
            px = new
        elif t == "green":
            w.write(2, 2)
            px = [pack([a, r - g & 255, g, b - g & 255]) for a, r, g, b in map(ch, px)]
        else:
            w.write(3, 2)
            table = sorted(set(px))
            w.write(len(table) - 1, 8)
            delta = [pack([(a - b) & 255 for a, b in zip(ch(v), ch(table[k - 1]) if k else [0] * 4)]) for k, v in enumerate(table)]
            image(w, delta, len(table), 1, False, rng)
            shift = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            narrow, new = (wide + (1 << shift) - 1) >> shift, []
            for y in range(height):
                row = [table.index(v) for v in px[y * wide : (y + 1) * wide]]
                for x in range(narrow):
                    part = row[x << shift : (x + 1) << shift]
                    new.append(255 << 24 | sum(v << (k * (8 >> shift)) for k, v in enumerate(part)) << 8)
            px, wide = new, narrow
    w.write(0, 1)
    image(w, px, wide, height, True, rng, **how)
    return webp.container(w.value.to_bytes(-(-w.n // 8), "little"))
