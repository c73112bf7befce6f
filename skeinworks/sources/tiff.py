"""TIFF pages as NumPy arrays, from bytes: strips or tiles, plain, PackBits, LZW or Deflate."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Size in bytes and struct letter of the TIFF field types used here.
_TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 16: (8, "Q")}
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT = 322, 323, 324, 325, 339


def _lzw(data: bytes) -> bytes:
    out, table, width, prev = bytearray(), [], 9, None
    bits = held = 0
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if prev is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out += entry
        prev = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return _lzw(data)
    if compression == 32773:
        return _packbits(data)
    raise ValueError(f"unsupported TIFF compression {compression}")


def _directories(data: bytes):
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in _TYPES:
                continue
            size, letter = _TYPES[kind]
            where = at + 10 + 12 * i
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(order + letter * count, data, where)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, order: str, tags: dict) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, spp, comp = one(_WIDTH, 0), one(_LENGTH, 0), one(_SAMPLES, 1), one(_COMPRESSION, 1)
    bits, form, predictor = one(_BITS, 1), one(_FORMAT, 1), one(_PREDICTOR, 1)
    if bits not in (8, 16, 32, 64) or not w or not h:
        raise ValueError(f"unsupported TIFF page {h} x {w} of {bits} bits")
    if one(_PLANAR, 1) != 1 and spp > 1:
        raise ValueError("unsupported planar TIFF")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}.get(form, "u") + str(bits // 8))
    tiled = _TILE_OFFSETS in tags
    tw, th = (one(_TILE_W, w), one(_TILE_H, h)) if tiled else (w, min(one(_ROWS, h), h))
    offsets, counts = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_STRIPS], tags[_COUNTS])
    out = np.empty((h, w, spp), dtype.newbyteorder("="))
    across = -(-w // tw)
    for i, (o, n) in enumerate(zip(offsets, counts)):
        y, x = i // across * th, i % across * tw
        rows = th if tiled else min(th, h - y)
        part = np.frombuffer(_unpacked(data[o : o + n], comp), dtype, rows * tw * spp).reshape(rows, tw, spp)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        fit = part[: min(rows, h - y), : min(tw, w - x)]
        out[y : y + fit.shape[0], x : x + fit.shape[1]] = fit
    if one(_PHOTOMETRIC, 1) == 0 and out.dtype == np.uint8:
        out = 255 - out
    return out[:, :, 0] if spp == 1 else out


def read_pages(data: bytes) -> list[np.ndarray]:
    """All pages of a TIFF; ValueError for other or damaged bytes and for no pages."""
    try:
        pages = [_page(data, order, tags) for order, tags in _directories(data)]
    except (struct.error, KeyError, IndexError, zlib.error) as e:
        raise ValueError(f"damaged TIFF: {e}") from e
    if not pages:
        raise ValueError("no frames found")
    return pages


def write_pages(pages: list[np.ndarray], compress: bool = False, description: str = "") -> bytes:
    """A little-endian TIFF of 2-D or 3-D arrays, one strip per page."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        a = np.ascontiguousarray(page)
        spp = 1 if a.ndim == 2 else a.shape[2]
        raw = a.astype(a.dtype.newbyteorder("<")).tobytes()
        raw = zlib.compress(raw) if compress else raw
        at = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        tags = [(_WIDTH, 4, a.shape[1]), (_LENGTH, 4, a.shape[0]), (_COMPRESSION, 3, 8 if compress else 1), (_PHOTOMETRIC, 3, 1 if spp == 1 else 2), (_STRIPS, 4, at), (_SAMPLES, 3, spp), (_ROWS, 4, a.shape[0]), (_COUNTS, 4, len(raw))]
        tags.append((_FORMAT, 3, {"u": 1, "i": 2, "f": 3}[a.dtype.kind]))
        bits = [a.dtype.itemsize * 8] * spp
        text = description.encode() + b"\0"
        extra = len(out)
        out += struct.pack("<" + "H" * spp, *bits) + b"\0\0" * (spp % 2)
        note = len(out)
        out += text + b"\0" * (len(text) % 2)
        entries = [struct.pack("<HHII", t, k, 1, v) for t, k, v in tags]
        entries.append(struct.pack("<HHII", _BITS, 3, spp, extra if spp > 2 else sum(b << 16 * i for i, b in enumerate(bits))))
        entries.append(struct.pack("<HHII", 270, 2, len(text), note) if len(text) > 4 else struct.pack("<HHI4s", 270, 2, len(text), text))
        entries.sort(key=lambda e: struct.unpack_from("<H", e)[0])
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
