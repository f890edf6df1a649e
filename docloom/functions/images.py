"""Pictures: PNG, base64 and perceptual hashes, without a picture library.

PNG is read and written for 8 bits a sample, grey or in colour, with or without alpha, not interlaced;
other files have no pixels here (None), and callers may hash those by a reader of their own.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the colour type of the file.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Side of the picture that is hashed, and of the block of low frequencies that gives the bits.
SIDE, LOW = 32, 8


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of an array of bytes (height, width) or (height, width, samples)."""
    p = np.ascontiguousarray(pixels, np.uint8)
    p = p[:, :, None] if p.ndim == 2 else p
    h, w, n = p.shape
    kind = next(k for k, v in SAMPLES.items() if v == n)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, w * n)], axis=1).tobytes()
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels (height, width, samples) of a PNG file; None for what can't be read here."""
    if not data.startswith(SIGNATURE):
        return None
    at, packed, head = 8, [], None
    try:
        while at < len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif name == b"IDAT":
                packed.append(body)
            at += 12 + size
        w, h, depth, kind, _, _, laced = head
        n = SAMPLES[kind]
        if depth != 8 or laced or not w or not h:
            return None
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
    except (struct.error, zlib.error, KeyError, TypeError, ValueError):
        return None
    out = np.zeros((h + 1, w + 1, n), np.int64)  # a row and a column of zeros before the picture
    for y in range(1, h + 1):
        way, line = rows[y - 1, 0], rows[y - 1, 1:].reshape(w, n).astype(np.int64)
        if way == 0:
            out[y, 1:] = line
        elif way == 1:
            out[y, 1:] = np.cumsum(line, axis=0) % 256
        elif way == 2:
            out[y, 1:] = (line + out[y - 1, 1:]) % 256
        else:
            for x in range(1, w + 1):
                a, b, c = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                if way == 3:
                    guess = (a + b) // 2
                else:
                    d = [np.abs(a + b - c - v) for v in (a, b, c)]
                    guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], b, c))
                out[y, x] = (line[x - 1] + guess) % 256
    return out[1:, 1:].astype(np.uint8)


def hash_pixels(pixels: np.ndarray) -> int:
    """64 bits: which of the low frequencies of the grey picture, brought to SIDE pixels a side, lie above their median."""
    p = pixels.astype(float)
    grey = p if p.ndim == 2 else p[:, :, :3].mean(axis=2) if p.shape[2] > 2 else p[:, :, 0]

    def shrink(n: int) -> np.ndarray:
        """Share of each old pixel in each new one."""
        edges = np.arange(SIDE + 1) * n / SIDE
        lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(n) + 1)
        return np.maximum(hi - lo, 0) * SIDE / n

    small = shrink(grey.shape[0]) @ grey @ shrink(grey.shape[1]).T
    wave = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))
    low = (wave @ small @ wave.T).ravel().round(6)
    bits = low > np.median(low)
    return int(sum(1 << i for i in np.flatnonzero(bits).tolist()))


def _hashes(data: pd.Series) -> pd.Series:
    def one(x):
        try:
            pixels = decode_png(base64.b64decode(x)) if x else None
        except ValueError:
            pixels = None
        h = hash_pixels(pixels) if pixels is not None else None
        return None if h is None else h - (1 << 64) if h >> 63 else h

    return pd.Series([one(x) for x in data], dtype="Int64")


def perceptual_hash(b64: Column) -> Column:
    """64-bit hash of a PNG picture in base64; null for anything else."""
    return F.pandas_udf(_hashes, "long")(b64)


def _info(data: pd.Series) -> pd.DataFrame:
    def one(x):
        try:
            head = base64.b64decode(x[:64]) if x else b""
        except ValueError:
            head = b""
        if not head.startswith(SIGNATURE) or len(head) < 24:
            return None, None, None
        return ("image/png", *struct.unpack(">II", head[16:24]))

    rows = [one(x) for x in data]
    return pd.DataFrame({"mimetype": [r[0] for r in rows], "width": pd.array([r[1] for r in rows], "Int32"), "height": pd.array([r[2] for r in rows], "Int32")})


def info(b64: Column) -> Column:
    """Struct of mimetype, width and height of a PNG picture in base64; nulls for anything else."""
    return F.pandas_udf(_info, "mimetype string, width int, height int")(b64)


def to_base64(data: Column) -> Column:
    return F.base64(data)


def from_base64(text: Column) -> Column:
    """Bytes of a base64 text; null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))
