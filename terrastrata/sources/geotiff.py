"""GeoTIFF files as rasters, read by executors file by file, and written from the driver.

Read are classic and big TIFF, strips and tiles, any planar configuration, without compression or with deflate, LZW or
PackBits, with no or horizontal prediction. A folder of files is one raster: each file is placed by its own geotransform,
which must have the pixel size and bands of the others. Written are deflated strips.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape, unescape

import numpy as np
import pandas as pd

# Field types of TIFF as struct letters, and the tags that matter here.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, TRANSFORM = 322, 323, 324, 325, 339, 33550, 33922, 34264
GEO_KEYS, GEO_TEXT, METADATA, NODATA = 34735, 34737, 42112, 42113
PIXELS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


class Tiff:
    """The first image of a file."""

    def __init__(self, data: bytes):
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None:
            raise ValueError("this is no TIFF file")
        self.data, self.order = data, order
        big = self._at("H", 2)[0] == 43
        at = self._at("Q", 8)[0] if big else self._at("I", 4)[0]
        count, at = (self._at("Q", at)[0], at + 8) if big else (self._at("H", at)[0], at + 2)
        self.tags: dict[int, tuple] = {}
        for k in range(count):
            self._entry(at + k * (20 if big else 12), big)
        self.width, self.height = self.tags[WIDTH][0], self.tags[HEIGHT][0]
        self.samples = self.tags.get(SAMPLES, (1,))[0]
        kind = (self.tags.get(FORMAT, (1,))[0], self.tags.get(BITS, (1,))[0])
        if kind not in PIXELS:
            raise ValueError(f"unsupported pixels: format {kind[0]}, {kind[1]} bits")
        self.dtype = np.dtype(self.order + PIXELS[kind])

    def _at(self, letters: str, at: int) -> tuple:
        return struct.unpack_from(self.order + letters, self.data, at)

    def _entry(self, at: int, big: bool) -> None:
        tag, kind = self._at("HH", at)
        n = self._at("Q" if big else "I", at + 4)[0]
        letters = TYPES.get(kind)
        if letters is None:
            return
        size, room = struct.calcsize("=" + letters) * n, 8 if big else 4
        place = at + (12 if big else 8)
        if size > room:
            place = self._at("Q" if big else "I", place)[0]
        self.tags[tag] = (self.data[place : place + n],) if letters == "s" else self._at(letters * n if len(letters) > 1 else f"{n}{letters}", place)

    def text(self, tag: int) -> str:
        return self.tags[tag][0].rstrip(b"\0").decode("utf-8", "replace") if tag in self.tags else ""

    @property
    def geotransform(self) -> tuple[float, ...]:
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return (m[3], m[0], m[1], m[7], m[4], m[5])
        if SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIEPOINT]
            return (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
        return (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)

    @property
    def crs(self) -> str:
        """EPSG code of the projected or geographic system, else the file's own text."""
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        for key in (3072, 2048):
            if 0 < codes.get(key, 0) < 32767:
                return f"EPSG:{codes[key]}"
        return self.text(GEO_TEXT).strip("|")

    @property
    def names(self) -> list[str]:
        out = [f"band_{k + 1}" for k in range(self.samples)]
        for part in self.text(METADATA).split("<Item ")[1:]:
            head, _, rest = part.partition(">")
            if 'role="description"' in head and 'sample="' in head:
                k, name = int(head.split('sample="')[1].split('"')[0]), unescape(rest.split("</Item>")[0])
                if k < self.samples and name:
                    out[k] = name
        return out

    @property
    def nodata(self) -> float | None:
        text = self.text(NODATA).strip()
        return float(text) if text else None

    def _plain(self, offset: int, size: int) -> bytes:
        raw, how = self.data[offset : offset + size], self.tags.get(COMPRESSION, (1,))[0]
        if how == 1:
            return raw
        if how in (8, 32946):
            return zlib.decompress(raw)
        if how == 5:
            return _lzw(raw)
        if how == 32773:
            return _packbits(raw)
        raise ValueError(f"unsupported compression {how}")

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, pixels as (bands, rows, columns)) of each strip or tile."""
        tiled = TILES in self.tags
        wide = self.tags[TILE_WIDTH][0] if tiled else self.width
        high = self.tags[TILE_HEIGHT][0] if tiled else min(self.height, self.tags.get(ROWS, (self.height,))[0])
        offsets, sizes = (self.tags[TILES], self.tags[TILE_SIZES]) if tiled else (self.tags[STRIPS], self.tags[STRIP_SIZES])
        across, down = -(-self.width // wide), -(-self.height // high)
        apart = self.tags.get(PLANAR, (1,))[0] == 2
        each = 1 if apart else self.samples
        for n in range(across * down):
            row, col = n // across * high, n % across * wide
            rows = high if tiled else min(high, self.height - row)
            parts = []
            for plane in range(self.samples if apart else 1):
                k = plane * across * down + n
                if not sizes[k]:
                    parts.append(np.full((each, rows, wide), 0 if self.nodata is None else self.nodata, self.dtype))
                    continue
                block = np.frombuffer(self._plain(offsets[k], sizes[k]), self.dtype, rows * wide * each).reshape(rows, wide, each)
                if self.tags.get(PREDICTOR, (1,))[0] == 2:
                    block = np.cumsum(block, axis=1, dtype=self.dtype)
                elif self.tags.get(PREDICTOR, (1,))[0] != 1:
                    raise ValueError("unsupported predictor")
                parts.append(block.transpose(2, 0, 1))
            yield row, col, np.concatenate(parts)[:, : self.height - row, : self.width - col]


def _packbits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 empties the table, 257 ends the data."""
    fresh = [bytes([b]) for b in range(256)] + [b"", b""]
    table, out, before, width, held, bits = list(fresh), bytearray(), b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, before, width = list(fresh), b"", 9
            continue
        found = table[code] if code < len(table) else before + before[:1]
        out += found
        if before:
            table.append(before + found[:1])
        before = found
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def describe(data: bytes) -> dict:
    t = Tiff(data)
    return {"width": t.width, "height": t.height, "geotransform": t.geotransform, "crs": t.crs, "names": t.names, "nodata": t.nodata, "dtype": t.dtype.newbyteorder("=").name}


def read(spark, path: str):
    """A Raster of the file, or of all files that the path names (a folder or a pattern)."""
    from .raster import PIXEL_TYPES, Raster

    files = spark.read.format("binaryFile").load(path)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"meta": [json.dumps(describe(c)) for c in rows["content"]]})

    metas = [json.loads(r[0]) for r in files.select("content").mapInPandas(heads, "meta string").collect()]
    if not metas:
        raise ValueError(f"no file at {path}")
    first = metas[0]
    steps = first["geotransform"][1:3] + first["geotransform"][4:6]
    for m in metas:
        if m["names"] != first["names"] or m["dtype"] != first["dtype"] or not np.allclose(m["geotransform"][1:3] + m["geotransform"][4:6], steps):
            raise ValueError("the files differ in bands, type or pixel size")
    if first["dtype"] not in PIXEL_TYPES:
        raise ValueError(f"unsupported pixel type {first['dtype']}")
    base = first["geotransform"]
    inverse = np.linalg.inv(np.array([[base[1], base[2]], [base[4], base[5]]]))

    def place(gt) -> tuple[int, int]:
        c, r = inverse @ (gt[0] - base[0], gt[3] - base[3])
        return round(c), round(r)

    places = [place(m["geotransform"]) for m in metas]
    left, top = min(c for c, _ in places), min(r for _, r in places)
    width = max(c + m["width"] for (c, _), m in zip(places, metas, strict=True)) - left
    height = max(r + m["height"] for (_, r), m in zip(places, metas, strict=True)) - top
    origin = (base[0] + left * base[1] + top * base[2], *base[1:3], base[3] + left * base[4] + top * base[5], *base[4:6])
    kind = {"uint16": np.int32, "uint32": np.int64}.get(first["dtype"], first["dtype"])
    columns = [f"b{k}" for k in range(len(first["names"]))]

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for content in rows["content"]:
                t = Tiff(content)
                c0, r0 = place(t.geotransform)
                for row, col, block in t.blocks():
                    r, c = np.indices(block.shape[1:], np.int32)
                    own = {n: band.ravel().astype(kind) for n, band in zip(columns, block, strict=True)}
                    yield pd.DataFrame({"row": (r + row + r0 - top).ravel(), "col": (c + col + c0 - left).ravel()} | own)

    schema = "row int, col int" + "".join(f", {c} {PIXEL_TYPES[first['dtype']]}" for c in columns)
    df = files.select("content").mapInPandas(pixels, schema).toDF("row", "col", *first["names"])
    return Raster.from_dataframe(df, width, height, origin, first["crs"], first["names"], first["nodata"])


def encode(array: np.ndarray, geotransform, names: list[str], nodata: float | None = None, crs: str = "", rows_per_strip: int = 64) -> bytes:
    """A GeoTIFF of an array (bands, rows, columns): deflated strips, bands apart."""
    array = np.ascontiguousarray(array.astype(array.dtype.newbyteorder("<")))
    count, height, width = array.shape
    form = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    strips = [zlib.compress(band[r : r + rows_per_strip].tobytes()) for band in array for r in range(0, height, rows_per_strip)]
    meta = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(n)}</Item>' for k, n in enumerate(names)) + "</GDALMetadata>"
    entries: list[tuple[int, str, tuple | bytes]] = [
        (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (array.dtype.itemsize * 8,) * count), (COMPRESSION, "H", (8,)), (262, "H", (1,)),
        (STRIPS, "I", ()), (SAMPLES, "H", (count,)), (ROWS, "I", (rows_per_strip,)), (STRIP_SIZES, "I", tuple(map(len, strips))), (PLANAR, "H", (2,)),
        (FORMAT, "H", (form,) * count), (TRANSFORM, "d", (geotransform[1], geotransform[2], 0.0, geotransform[0], geotransform[4], geotransform[5], 0.0, geotransform[3], *[0.0] * 7, 1.0)),
    ]
    if crs.upper().startswith("EPSG:") and crs[5:].isdigit():
        key = 2048 if 4000 <= int(crs[5:]) < 5000 else 3072
        entries.append((GEO_KEYS, "H", (1, 1, 0, 2, 1024, 0, 1, 2 if key == 2048 else 1, key, 0, 1, int(crs[5:]))))
    elif crs:
        entries.append((GEO_TEXT, "s", crs.encode() + b"|\0"))
    entries.append((METADATA, "s", meta.encode() + b"\0"))
    if nodata is not None:
        entries.append((NODATA, "s", (repr(nodata) if nodata == nodata else "nan").encode() + b"\0"))
    codes = {"B": 1, "s": 2, "H": 3, "I": 4, "d": 12}
    after = 8 + 2 + 12 * len(entries) + 4
    pack = lambda kind, v: v if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
    extra = sum(len(p) + len(p) % 2 for t, kind, v in entries for p in [pack(kind, v if t != STRIPS else (0,) * len(strips))] if len(p) > 4)
    starts = after + extra + np.concatenate([[0], np.cumsum([len(s) for s in strips])[:-1]])
    if starts[-1] + len(strips[-1]) >= 1 << 32:
        raise ValueError("the file would be larger than 4 GB")
    head, tail = b"II" + struct.pack("<HIH", 42, 8, len(entries)), b""
    for tag, kind, value in entries:
        value = tuple(map(int, starts)) if tag == STRIPS else value
        packed = pack(kind, value)
        head += struct.pack("<HHI", tag, codes[kind], len(value))
        if len(packed) > 4:
            head += struct.pack("<I", after + len(tail))
            tail += packed + b"\0" * (len(packed) % 2)
        else:
            head += packed.ljust(4, b"\0")
    return head + b"\0\0\0\0" + tail + b"".join(strips)
