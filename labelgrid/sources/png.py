"""PNG structure in numpy and zlib: images of 8 and 16 bits, row by row in both directions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the PNG specification.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, RGB, PALETTE, GREY_ALPHA, RGBA = 0, 2, 3, 4, 6
SAMPLES = {GREY: 1, RGB: 3, PALETTE: 1, GREY_ALPHA: 2, RGBA: 4}


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        yield kind, raw[at + 8 : at + 8 + size]
        at += size + 12


def header(raw: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits of a sample and colour type, from the first 33 bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack_from(">IIBB", raw, 16)


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Samples' bytes of filtered rows, the filter's number first in each."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for r, line in enumerate(rows):
        how, x, above = line[0], line[1:], out[r]
        if how == 0:
            out[r + 1] = x
        elif how == 1:
            out[r + 1] = np.cumsum(x.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif how == 2:
            out[r + 1] = x + above
        elif how in (3, 4):
            now, up, given = [0] * (len(x) + step), [0] * step + above.tolist(), x.tolist()
            for k, v in enumerate(given):
                a, b, c = now[k], up[k + step], up[k]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p, q, s = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= s else b if q <= s else c
                now[k + step] = (v + guess) & 255
            out[r + 1] = now[step:]
        else:
            raise ValueError(f"row filter {how} is not known")
    return out[1:]


def decoded(raw: bytes) -> np.ndarray:
    """Rows, columns and samples of an image; a palette's numbers stay numbers."""
    width, height, bits, colour = header(raw)
    if bits not in (8, 16) or raw[28]:
        raise ValueError("images of fewer than 8 bits and interlaced ones are not read")
    samples = SAMPLES[colour]
    step = samples * bits // 8
    data = zlib.decompress(b"".join(body for kind, body in _chunks(raw) if kind == b"IDAT"))
    out = _unfiltered(np.frombuffer(data, np.uint8, height * (1 + width * step)).reshape(height, -1), step)
    return out.view(">u2").astype(np.uint16).reshape(height, width, samples) if bits == 16 else out.reshape(height, width, samples)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


class Writer:
    """The bytes of an image whose rows come one at a time; holds one row and what the compressor does."""

    def __init__(self, width: int, height: int, samples: int):
        self.colour = {1: GREY, 2: GREY_ALPHA, 3: RGB, 4: RGBA}[samples]
        self.width, self.height, self.samples = width, height, samples
        self.pack = zlib.compressobj(6)
        self.before = np.zeros(width * samples, np.uint8)

    def head(self) -> bytes:
        return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", self.width, self.height, 8, self.colour, 0, 0, 0))

    def row(self, samples: np.ndarray) -> bytes:
        """A row of 8-bit samples, as differences to the row above."""
        line = samples.astype(np.uint8).reshape(-1)
        body = self.pack.compress(b"\2" + (line - self.before).tobytes())
        self.before = line
        return _chunk(b"IDAT", body) if body else b""

    def end(self) -> bytes:
        return _chunk(b"IDAT", self.pack.flush()) + _chunk(b"IEND", b"")
