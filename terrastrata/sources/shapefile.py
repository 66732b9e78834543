"""Shapefiles: points, lines and polygons with their fields, read from and written as .shp with .shx and .dbf."""

from __future__ import annotations

import json
import struct

# Shape types, without their Z and M variants.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8


def _area(ring: list[list[float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _inside(point: list[float], ring: list[list[float]]) -> bool:
    x, y = point
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            inside = not inside
    return inside


def shapes(data: bytes) -> list[tuple[str, list] | None]:
    """(kind, coordinates) of each record; None for an empty shape. Polygons: clockwise rings are outer ones, the others holes."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("this is no shapefile")
    out: list[tuple[str, list] | None] = []
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack_from("<i", body)[0]
        base = kind % 10
        if not kind:
            out.append(None)
        elif base == POINT:
            out.append(("Point", list(struct.unpack_from("<2d", body, 4))))
        elif base == MULTIPOINT:
            n = struct.unpack_from("<i", body, 36)[0]
            v = struct.unpack_from(f"<{2 * n}d", body, 40)
            out.append(("MultiPoint", [list(v[k : k + 2]) for k in range(0, 2 * n, 2)]))
        elif base in (LINE, POLYGON):
            parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            v = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
            lines = [[list(v[2 * k : 2 * k + 2]) for k in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            out.append((("LineString", lines[0]) if len(lines) == 1 else ("MultiLineString", lines)) if base == LINE else _polygon(lines))
        else:
            raise ValueError(f"unsupported shape type {kind}")
    return out


def _polygon(rings: list) -> tuple[str, list]:
    outer = [[r] for r in rings if _area(r) <= 0] or [[r] for r in rings]
    for hole in (r for r in rings if _area(r) > 0):
        home = next((p for p in outer if _inside(hole[0], p[0])), None)
        if home is not None and home[0] is not hole:
            home.append(hole)
    return ("Polygon", outer[0]) if len(outer) == 1 else ("MultiPolygon", outer)


def table(data: bytes, encoding: str = "utf-8") -> tuple[list[str], list[list[str | None]]]:
    """Names and rows of a .dbf, values as text; empty ones are None."""
    count, start, size = struct.unpack_from("<IHH", data, 4)
    names, sizes, at = [], [], 32
    while data[at] != 0x0D:
        names.append(data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"))
        sizes.append(data[at + 16])
        at += 32
    rows = []
    for k in range(count):
        record, place, row = data[start + k * size : start + (k + 1) * size], 1, []
        for n in sizes:
            text = record[place : place + n].decode(encoding, "replace").strip(" \0")
            row.append(text or None)
            place += n
        rows.append(row)
    return names, rows


def read(spark, path: str, layer: str, crs: str = ""):
    """A Vector of a .shp, and of the .dbf and .prj beside it where there are any."""
    from .vector import Vector, field_column

    def content(end: str) -> bytes | None:
        try:
            got = spark.read.format("binaryFile").load(path[:-4] + end).select("content").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return bytes(got[0][0]) if got else None

    data = content(".shp")
    if data is None:
        raise FileNotFoundError(path)
    found, dbf, prj = shapes(data), content(".dbf"), content(".prj")
    names, values = table(dbf) if dbf else ([], [[] for _ in found])
    columns = [field_column(n) for n in names]
    rows = [(k, s[0], json.dumps(s[1]), *v) for k, (s, v) in enumerate(zip(found, values, strict=True)) if s is not None]
    schema = ", ".join(["fid long", "kind string", "geometry string", *(f"`{n}` string" for n in columns)])
    return Vector({layer: spark.createDataFrame(rows, schema)}, crs or (prj.decode("utf-8", "replace").strip() if prj else ""), "ESRI Shapefile", {layer: columns})


def encode_points(points: list[tuple[float, float]], fields: dict[str, list]) -> tuple[bytes, bytes, bytes]:
    """.shp, .shx and .dbf of points."""
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    box = struct.pack("<8d", min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, POINT) + box
    shp = b"".join(struct.pack(">2i", k + 1, 10) + struct.pack("<i2d", POINT, *p) for k, p in enumerate(points))
    shx = b"".join(struct.pack(">2i", 50 + 14 * k, 10) for k in range(len(points)))
    texts = {n[:10]: ["" if v is None else str(v) for v in values] for n, values in fields.items()} or {"FID": [str(k) for k in range(len(points))]}
    wide = {n: max([1, *(len(v.encode()) for v in values)]) for n, values in texts.items()}
    if any(w > 254 for w in wide.values()):
        raise ValueError("a field is longer than 254 bytes")
    columns = b"".join(struct.pack("<11sc4xBB14x", n.encode()[:11], b"C", w, 0) for n, w in wide.items())
    records = b"".join(b" " + b"".join(texts[n][k].encode().ljust(w) for n, w in wide.items()) for k in range(len(points)))
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(points), 33 + len(columns), 1 + sum(wide.values())) + columns + b"\r" + records + b"\x1a"
    return head((100 + len(shp)) // 2) + shp, head((100 + len(shx)) // 2) + shx, dbf
