"""PNG images as NumPy arrays, from bytes: grey, RGB, palette and alpha, 1 to 16 bits, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel of each colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = len(MAGIC)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("PNG ends within a chunk")
        yield kind, body
        at += size + 12


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the rows without their prediction from the pixel to the left, above, or both."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1), np.uint8)
    for y, (kind, row) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:]), 1):
        above = out[y - 1]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            out[y] = np.pad(row, (0, -len(row) % step)).reshape(-1, step).cumsum(0, np.uint8).ravel()[: len(row)]
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            line, up = bytearray(row.tobytes()), above.tolist()
            for x in range(len(line)):
                a, b, c = (line[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
            out[y] = np.frombuffer(bytes(line), np.uint8)
        else:
            raise ValueError("unknown PNG filter")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """The image of a PNG file; grey images have two dimensions, palettes are resolved."""
    if not data.startswith(MAGIC):
        raise ValueError("not a PNG file")
    parts: dict[bytes, bytes] = {}
    for kind, body in _chunks(data):
        parts[kind] = parts.get(kind, b"") + body
    w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if interlaced or colour not in _SAMPLES or bits not in (1, 2, 4, 8, 16):
        raise ValueError("unsupported PNG layout")
    n = _SAMPLES[colour]
    width = -(-w * n * bits // 8)
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)
    if raw.size != h * (width + 1):
        raise ValueError("PNG data of the wrong size")
    rows = _unfiltered(raw.reshape(h, width + 1), max(1, n * bits // 8))
    if bits == 16:
        a = rows.view(">u2").astype(np.uint16)
    elif bits == 8:
        a = rows
    else:
        split = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
        a = (split * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)[:, : w * n]
        a = a if colour == 3 else (a * (255 // ((1 << bits) - 1))).astype(np.uint8)
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[a]
    return a if n == 1 else a.reshape(h, w, n)
