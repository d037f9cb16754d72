"""TIFF structure in numpy and zlib: the layout of a file's blocks (strips or tiles), their coding, and its directory.

Read: classic and big files of either byte order, strips and tiles, interleaved and separate bands, uncompressed, deflate and
LZW, with horizontal or floating-point predictor. Written: interleaved bands, deflate, horizontal predictor for integers.
"""

from __future__ import annotations

import dataclasses
import struct
import zlib
from collections.abc import Callable

import numpy as np

# Fixed values of the TIFF 6.0, BigTIFF and GeoTIFF specifications.
WIDTH, LENGTH, SAMPLE_BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_SIZES, EXTRA, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
MODEL_KEY, RASTER_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 1025, 2048, 3072


@dataclasses.dataclass(frozen=True)
class Layout:
    width: int
    height: int
    bands: int
    dtype: np.dtype
    block_width: int
    block_height: int
    tiled: bool
    separate: bool
    compression: int
    predictor: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    nodata: float | None = None
    epsg: int | None = None
    #: x and y of the outer corner of the first pixel, and a pixel's size; dy is positive where rows go down.
    x0: float | None = None
    y0: float | None = None
    dx: float | None = None
    dy: float | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    def place(self, k: int) -> tuple[int, int, int, int]:
        """First row, first column, height and width, within the image, of the block k of a plane."""
        by, bx = divmod(k, self.across)
        row, col = by * self.block_height, bx * self.block_width
        return row, col, min(self.block_height, self.height - row), min(self.block_width, self.width - col)


def layout(read_at: Callable[[int, int], bytes]) -> Layout:
    """The layout of the file's first image; read_at(position, n) gives n of its bytes."""
    head = read_at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), read_at(at, 8 if big else 2))[0]
    entry, at = (20, at + 8) if big else (12, at + 2)
    raw, tags = read_at(at, n * entry), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * entry)
        if kind not in _KINDS:
            continue
        value = raw[k * entry + (12 if big else 8) : (k + 1) * entry]
        form = _KINDS[kind]
        size = struct.calcsize("<" + form) * count
        if size > len(value):
            value = read_at(struct.unpack(order + ("Q" if big else "I"), value)[0], size)
        tags[tag] = value[:size] if form == "s" else struct.unpack(order + form * count, value[:size])
    one = lambda tag, usual: tags.get(tag, (usual,))[0]
    bits = set(tags.get(SAMPLE_BITS, (1,)))
    form = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if len(bits) != 1 or form is None or (width := bits.pop()) not in ((8, 16, 32, 64) if form != "f" else (32, 64)):
        raise ValueError("samples of this kind are not read")
    tiled = TILE_WIDTH in tags
    scale, tie = tags.get(PIXEL_SCALE), tags.get(TIE_POINT)
    geo = {}
    if scale and tie:
        geo = {"dx": scale[0], "dy": scale[1], "x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1]}
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = tags.get(NODATA, b"").split(b"\0")[0].decode("ascii", "replace").strip()
    return Layout(
        one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), np.dtype(f"{order}{form}{width // 8}"),
        one(TILE_WIDTH, 0) if tiled else one(WIDTH, 0), one(TILE_LENGTH, 0) if tiled else min(one(STRIP_ROWS, one(LENGTH, 0)), one(LENGTH, 0)),
        tiled, one(PLANAR, 1) == 2, one(COMPRESSION, NONE), one(PREDICTOR, 1),
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES],
        float(nodata) if nodata else None, codes.get(PROJECTED_KEY, codes.get(GEOGRAPHIC_KEY)), **geo,
    )


def _lzw(raw: bytes) -> bytes:
    """LZW of 9 to 12 bits, most significant first, whose width grows one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(first), [], 9, 0, 0, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        now = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + now[:1])
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        out.append(now)
        last = now
    return b"".join(out)


def decoded(of: Layout, raw: bytes, k: int) -> np.ndarray:
    """Rows, columns and samples of the block k of a plane, without what lies outside the image."""
    _, _, height, width = of.place(k)
    rows = of.block_height if of.tiled else height
    samples = 1 if of.separate else of.bands
    if of.compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif of.compression == LZW:
        raw = _lzw(raw)
    elif of.compression != NONE:
        raise ValueError(f"compression {of.compression} is not read")
    size = of.dtype.itemsize
    if of.predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * of.block_width * samples * size).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, of.block_width * samples)
        block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, of.block_width, samples)
    else:
        block = np.frombuffer(raw, of.dtype, rows * of.block_width * samples).reshape(rows, of.block_width, samples)
        if of.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=of.dtype.newbyteorder("="))
    return block[:height, :width].astype(of.dtype.newbyteorder("="))


def encoded(block: np.ndarray) -> bytes:
    """A block of rows, columns and samples as deflate; of integers the differences along rows."""
    if block.dtype.kind in "iu":
        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
    return zlib.compress(block.astype(block.dtype.newbyteorder("<")).tobytes(), 6)


def directory(of: Layout, at: int, big: bool) -> bytes:
    """The directory of a tiled, interleaved file that encoded() made, to stand at byte at; big: with 8-byte places."""
    samples = of.bands
    form = {"u": 1, "i": 2, "f": 3}[of.dtype.kind]
    place = "Q" if big else "I"
    tags: list[tuple[int, int, list]] = [
        (WIDTH, 4, [of.width]), (LENGTH, 4, [of.height]), (SAMPLE_BITS, 3, [8 * of.dtype.itemsize] * samples), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]),
        (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [2 if of.dtype.kind in "iu" else 1]), (TILE_WIDTH, 4, [of.block_width]), (TILE_LENGTH, 4, [of.block_height]),
        (TILE_OFFSETS, 16 if big else 4, list(of.offsets)), (TILE_SIZES, 16 if big else 4, list(of.sizes)), (SAMPLE_FORMAT, 3, [form] * samples),
    ]
    if samples > 1:
        tags.append((EXTRA, 3, [0] * (samples - 1)))
    if of.dx is not None:
        tags += [(PIXEL_SCALE, 12, [of.dx, of.dy, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, of.x0, of.y0, 0.0])]
    if of.epsg is not None:
        geographic = 4000 <= of.epsg < 5000
        keys = [(MODEL_KEY, 2 if geographic else 1), (RASTER_KEY, 1), (GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, of.epsg)]
        tags.append((GEO_KEYS, 3, [1, 1, 0, len(keys), *[x for key, value in keys for x in (key, 0, 1, value)]]))
    if of.nodata is not None:
        tags.append((NODATA, 2, [(f"{of.nodata:g}" + "\0").encode()]))
    entries, beyond = [], b""
    slot, entry = struct.calcsize("<" + place), 20 if big else 12
    after = at + (8 if big else 2) + entry * len(tags) + slot
    for tag, kind, values in sorted(tags):
        count = len(values[0]) if kind == 2 else len(values)
        value = values[0] if kind == 2 else struct.pack("<" + _KINDS[kind] * count, *values)
        if len(value) > slot:
            beyond += b"\0" * (-(after + len(beyond)) % 8)
            value, beyond = struct.pack("<" + place, after + len(beyond)), beyond + value
        entries.append(struct.pack("<HH" + place, tag, kind, count) + value.ljust(slot, b"\0"))
    return struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + b"\0" * slot + beyond


def header(at: int, big: bool) -> bytes:
    """The first bytes of a file whose directory stands at byte at."""
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
