"""Media columns: texts stored as lossless WebP images, read back, and described.

A text's UTF-8 bytes, with bytes 255 up to a positive multiple of ``ROW``, are the samples
of a grey image ``ROW`` wide (a multiple of it for very long texts, whose last row is
filled with 255 and cut again on reading). Texts longer than an image can hold are stored as
several images in a row. Null is stored as the empty text. Equal texts have equal images. Repeated rows are stored each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from . import webp

ROW = 576


def payload(raw: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(raw) // ROW)) * ROW
    out = np.full(n, 255, np.uint8)
    out[: len(raw)] = raw
    return out


#: Samples that one image holds at most.
MOST = 16384 // ROW * ROW * 16384


def store(samples: np.ndarray, most: int = MOST) -> bytes:
    """One image file, or several one after another."""
    out = []
    for at in range(0, len(samples), most):
        part = samples[at : at + most]
        width, height = webp.shape_of(len(part), ROW)
        if width * height > len(part):
            part = np.append(part, np.full(width * height - len(part), 255, np.uint8))
        out.append(webp.encode_grey(part, width, height))
    return b"".join(out)


def load(media: bytes, n: int, most: int = MOST) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first n samples, and the grey images."""
    greys, parts, at = [], [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        grey = webp.decode(media[at:end])[..., 1]
        greys.append(grey)
        parts.append(np.ascontiguousarray(grey).ravel()[: min(most, n - most * (len(greys) - 1))])
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts), greys


def describe(grey: np.ndarray) -> str:
    """Width, height, sum, horizontal and vertical change, and an 8 by 8 mean hash."""
    g = grey.astype(np.int32)
    h, w = g.shape
    rows, cols = np.arange(9) * h // 8, np.arange(9) * w // 8
    total = np.add.reduceat(np.add.reduceat(g, np.minimum(rows[:-1], h - 1), axis=0), np.minimum(cols[:-1], w - 1), axis=1)
    area = np.maximum(1, rows[1:] - rows[:-1])[:, None] * np.maximum(1, cols[1:] - cols[:-1])[None, :]
    cell = total // area
    bits = np.packbits(cell.ravel() * 64 > cell.sum()).tobytes().hex()
    dx = int(np.abs(g[:, 1:] - g[:, :-1]).sum())
    dy = int(np.abs(g[1:] - g[:-1]).sum())
    return f"{w}x{h};{int(g.sum())};{dx};{dy};{bits}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, sizes and digests of what was read back, feature; with the image and the pixels decoded from it where ``keep_media``."""

    def fn(batches):
        for b in batches:
            for lo, hi, data, offs in tk.blocks(b.column(1)):
                out: list[list] = [[] for _ in range(7 + 2 * keep_media)]
                for i in range(hi - lo):
                    raw = data[offs[i] : offs[i + 1]]
                    size = max(1, -(-len(raw) // ROW)) * ROW
                    media = store(payload(raw))
                    back, greys = load(media, size)
                    back = back.tobytes()
                    row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), "|".join(map(describe, greys))]
                    for c, v in zip(out, [*row, media, back] if keep_media else row):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "pixels"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names[: 8 + 2 * keep_media])

    return docs.select("doc_id", "text").mapInArrow(fn, SCHEMA + (", media binary, pixels binary" if keep_media else ""))
