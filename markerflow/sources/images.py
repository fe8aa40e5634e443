"""Mask images: PNG with 8 or fewer bits a pixel, grey or palette, as arrays of grey values or palette numbers, after the public
specification (W3C, PNG). Coloured images are read as their brightness; interlaced ones are not."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filters by row; step is the bytes of a pixel."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for i, (row, kind) in enumerate(zip(rows, kinds)):
        if kind == 0:
            line = row
        elif kind == 2:
            line = row + above
        elif kind == 1:
            line = row.copy()
            for k in range(step):
                line[k::step] = np.cumsum(row[k::step], dtype=np.uint8)
        else:
            line = row.copy()
            for x in range(len(row)):
                a, b = int(line[x - step]) if x >= step else 0, int(above[x])
                c = int(above[x - step]) if x >= step else 0
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = (int(row[x]) + guess) & 255
        out[i] = above = line
    return out


def read_png(data: bytes) -> np.ndarray | None:
    """(height, width) of 8-bit values, None for what is no such image."""
    if not data.startswith(SIGNATURE):
        return None
    head, body = None, b""
    try:
        for kind, part in _chunks(data):
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"IDAT":
                body += part
        width, height, bits, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if bits > 8 or interlaced or not width or not height:
            return None
        line = (width * bits * channels + 7) // 8
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, line + 1)
    except (zlib.error, struct.error, KeyError, ValueError, TypeError):
        return None
    pixels = _unfilter(raw[:, 1:], raw[:, 0], max(1, bits * channels // 8))
    if bits < 8:
        spread = np.unpackbits(pixels, axis=1).reshape(height, -1, bits)
        pixels = (spread << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, :width]
        return pixels * (255 // (2**bits - 1)) if colour == 0 else pixels
    if channels == 1:
        return pixels.copy()
    parts = pixels.reshape(height, width, channels).astype(float)
    return parts[:, :, 0].astype(np.uint8) if channels == 2 else np.rint(parts[:, :, :3] @ [0.299, 0.587, 0.114]).astype(np.uint8)


def write_png(pixels: np.ndarray, palette: list[tuple[int, int, int]] | None = None) -> bytes:
    """An 8-bit grey image, or a palette image of up to 256 colours."""
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    rows = np.zeros((pixels.shape[0], pixels.shape[1] + 1), np.uint8)
    rows[:, 1:] = pixels
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 3 if palette else 0, 0, 0, 0)
    colours = chunk(b"PLTE", bytes(v for c in palette for v in c)) if palette else b""
    return SIGNATURE + chunk(b"IHDR", head) + colours + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
