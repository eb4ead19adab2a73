"""Geometries as plain tuples, and their WKB and WKT forms.

A geometry is (kind, body): a point's body is (x, y) or None if empty; a line
string's a list of points; a polygon's a list of rings; a multi geometry's a
list of bodies; a collection's a list of geometries. Z and M are dropped.
"""

from __future__ import annotations

import re
import struct

import numpy as np

KINDS = ("", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
CODES = {k: i for i, k in enumerate(KINDS) if k}
_PARTS = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


class BadGeometry(ValueError):
    pass


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise BadGeometry("short WKB")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def geometry(self, depth: int = 0) -> tuple:
        if depth > 16:
            raise BadGeometry("nested too deep")
        order = self.take("B")[0]
        if order > 1:
            raise BadGeometry("byte order")
        e = "<" if order else ">"
        code = self.take(f"{e}I")[0]
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(f"{e}I")
        code &= 0x0FFFFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
        code %= 1000
        if not 1 <= code <= 7:
            raise BadGeometry("kind")
        kind = KINDS[code]
        if kind == "Point":
            p = self.take(f"{e}{dims}d")[:2]
            return kind, None if any(c != c for c in p) else p
        n = self.take(f"{e}I")[0]
        if n > len(self.data):
            raise BadGeometry("count")
        if kind == "LineString":
            return kind, self.points(e, n, dims)
        if kind == "Polygon":
            return kind, [self.points(e, self.take(f"{e}I")[0], dims) for _ in range(n)]
        parts = [self.geometry(depth + 1) for _ in range(n)]
        return kind, parts if kind == "GeometryCollection" else [b for _, b in parts]

    def points(self, e: str, n: int, dims: int) -> list[tuple[float, float]]:
        flat = self.take(f"{e}{n * dims}d")
        return list(zip(flat[0::dims], flat[1::dims]))


def decode(data: bytes | None) -> tuple | None:
    """The geometry, or None for null and undecodable bytes."""
    if data is None:
        return None
    try:
        return _Reader(bytes(data)).geometry()
    except (BadGeometry, struct.error, MemoryError):
        return None


def _points(points) -> bytes:
    flat = [c for p in points for c in p]
    return struct.pack(f"<I{len(flat)}d", len(points), *flat)


def encode(g: tuple | None) -> bytes | None:
    if g is None:
        return None
    kind, body = g
    head = struct.pack("<BI", 1, CODES[kind])
    if kind == "Point":
        return head + struct.pack("<2d", *(body or (float("nan"), float("nan"))))
    if kind == "LineString":
        return head + _points(body)
    if kind == "Polygon":
        return head + struct.pack("<I", len(body)) + b"".join(map(_points, body))
    parts = body if kind == "GeometryCollection" else [(_PARTS[kind], b) for b in body]
    return head + struct.pack("<I", len(parts)) + b"".join(map(encode, parts))


def point_column(x: np.ndarray, y: np.ndarray) -> list[bytes]:
    """WKB points of two float arrays at once."""
    rows = np.zeros(len(x), np.dtype([("o", "u1"), ("k", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    rows["o"], rows["k"], rows["x"], rows["y"] = 1, 1, x, y
    flat = rows.tobytes()
    return [flat[i : i + 21] for i in range(0, len(flat), 21)]


_BOX = np.dtype([("o", "u1"), ("k", "<u4"), ("r", "<u4"), ("n", "<u4"), ("c", "<f8", (5, 2))])


def box_column(x0, y0, x1, y1) -> list[bytes]:
    """WKB rectangles of four float arrays; swapped corners are put in order."""
    a, c = np.minimum(x0, x1), np.maximum(x0, x1)
    b, d = np.minimum(y0, y1), np.maximum(y0, y1)
    rows = np.zeros(len(a), _BOX)
    rows["o"], rows["k"], rows["r"], rows["n"] = 1, 3, 1, 5
    for i, (x, y) in enumerate(((c, b), (c, d), (a, d), (a, b), (c, b))):
        rows["c"][:, i, 0], rows["c"][:, i, 1] = x, y
    flat = rows.tobytes()
    return [flat[i : i + _BOX.itemsize] for i in range(0, len(flat), _BOX.itemsize)]


def bounds_column(data: list[bytes | None]) -> np.ndarray:
    """xmin, ymin, xmax, ymax of each geometry; nan where there is none. Columns of like points or boxes take one step."""
    out = np.full((len(data), 4), np.nan)
    sizes = {len(d) for d in data if d is not None}
    if sizes in ({21}, {93}):
        at = [i for i, d in enumerate(data) if d is not None]
        raw = b"".join(data[i] for i in at)
        size = sizes.pop()
        rows = np.frombuffer(raw, np.uint8).reshape(-1, size)
        head = 5 if size == 21 else 13
        lead = bytes([1, 1, 0, 0, 0]) if size == 21 else bytes([1, 3, 0, 0, 0, 1, 0, 0, 0, 5, 0, 0, 0])
        if (rows[:, :head] == np.frombuffer(lead, np.uint8)).all():
            c = np.ascontiguousarray(rows[:, head:]).view("<f8").reshape(len(at), -1, 2)
            out[at] = np.concatenate([c.min(axis=1), c.max(axis=1)], axis=1)
            return out
    for i, d in enumerate(data):
        b = bounds(decode(d))
        if b:
            out[i] = b
    return out


def simple_shapes(data: list[bytes | None]) -> tuple[np.ndarray, np.ndarray] | None:
    """Bounds and whether each is a point, if all of a column are points and upright rectangles (null: nan); else None."""
    sizes = np.fromiter((-1 if d is None else len(d) for d in data), np.int64, len(data))
    if not np.isin(sizes, (-1, 21, 93)).all():
        return None
    out, is_point = np.full((len(data), 4), np.nan), sizes == 21
    for size, lead in ((21, b"\1\1\0\0\0"), (93, b"\1\3\0\0\0\1\0\0\0\5\0\0\0")):
        at = np.flatnonzero(sizes == size)
        if not len(at):
            continue
        rows = np.frombuffer(b"".join([data[i] for i in at]), np.uint8).reshape(-1, size)
        if (rows[:, : len(lead)] != np.frombuffer(lead, np.uint8)).any():
            return None
        c = np.ascontiguousarray(rows[:, len(lead) :]).view("<f8").reshape(len(at), -1, 2)
        b = np.concatenate([c.min(axis=1), c.max(axis=1)], axis=1)
        if size == 93:
            x, y = c[:, :4, 0], c[:, :4, 1]
            turned = (x[:, 0] == x[:, 1]) & (x[:, 2] == x[:, 3]) & (y[:, 1] == y[:, 2]) & (y[:, 3] == y[:, 0])
            level = (y[:, 0] == y[:, 1]) & (y[:, 2] == y[:, 3]) & (x[:, 1] == x[:, 2]) & (x[:, 3] == x[:, 0])
            if not ((turned | level) & (c[:, 0] == c[:, 4]).all(axis=1) & (b[:, 0] < b[:, 2]) & (b[:, 1] < b[:, 3])).all():
                return None
        elif np.isnan(c).any():
            return None
        out[at] = b
    return out, is_point


def coordinates(g: tuple):
    """All points of a geometry, closing ones included."""
    kind, body = g
    if kind == "Point":
        if body is not None:
            yield body
    elif kind in ("LineString", "MultiPoint"):
        yield from (p for p in body if p is not None)
    elif kind in ("Polygon", "MultiLineString"):
        for ring in body:
            yield from ring
    elif kind == "MultiPolygon":
        for rings in body:
            for ring in rings:
                yield from ring
    else:
        for part in body:
            yield from coordinates(part)


def bounds(g: tuple | None) -> tuple[float, float, float, float] | None:
    if g is None:
        return None
    points = list(coordinates(g))
    if not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def polygons_of(g: tuple) -> list:
    kind, body = g
    if kind == "Polygon":
        return [body] if body else []
    if kind == "MultiPolygon":
        return [b for b in body if b]
    if kind == "GeometryCollection":
        return [p for part in body for p in polygons_of(part)]
    return []


def lines_of(g: tuple) -> list:
    kind, body = g
    if kind == "LineString":
        return [body]
    if kind == "MultiLineString":
        return list(body)
    if kind == "GeometryCollection":
        return [p for part in body for p in lines_of(part)]
    return []


def points_of(g: tuple) -> list:
    kind, body = g
    if kind == "Point":
        return [body] if body is not None else []
    if kind == "MultiPoint":
        return [b for b in body if b is not None]
    if kind == "GeometryCollection":
        return [p for part in body for p in points_of(part)]
    return []


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e16 else repr(float(x))


def to_wkt(g: tuple) -> str:
    kind, body = g
    name = kind.upper()
    p = lambda q: f"{_number(q[0])} {_number(q[1])}"
    run = lambda r: "(" + ",".join(map(p, r)) + ")"
    runs = lambda rs: "(" + ",".join(map(run, rs)) + ")"
    if not body:
        return f"{name} EMPTY"
    if kind == "Point":
        return f"{name}({p(body)})"
    if kind == "LineString":
        return name + run(body)
    if kind == "MultiPoint":
        return name + "(" + ",".join(f"({p(q)})" for q in body) + ")"
    if kind in ("Polygon", "MultiLineString"):
        return name + runs(body)
    if kind == "MultiPolygon":
        return name + "(" + ",".join(map(runs, body)) + ")"
    return name + "(" + ",".join(map(to_wkt, body)) + ")"


_WKT = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def from_wkt(text: str) -> tuple:
    """The geometry of a WKT text; BadGeometry if it is none."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _WKT.match(text, at)
        if not m:
            raise BadGeometry("invalid WKT")
        tokens.append(m[1])
        at = m.end()
    tokens += ["", "", ""]
    pos = 0

    def next_() -> str:
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def want(t: str) -> None:
        if next_() != t:
            raise BadGeometry("invalid WKT")

    def listed(item):
        want("(")
        out = [item()]
        while tokens[pos] == ",":
            next_()
            out.append(item())
        want(")")
        return out

    def point() -> tuple[float, float]:
        c = []
        while tokens[pos] and tokens[pos] not in "(),":
            try:
                c.append(float(next_()))
            except ValueError as e:
                raise BadGeometry("invalid WKT") from e
        if not 2 <= len(c) <= 4:
            raise BadGeometry("invalid WKT")
        return c[0], c[1]

    def loose() -> tuple[float, float]:
        return listed(point)[0] if tokens[pos] == "(" else point()

    def geometry() -> tuple:
        name = next_().upper()
        if tokens[pos].upper() in ("Z", "M", "ZM"):
            next_()
        kind = next((k for k in KINDS if k.upper() == name and k), None)
        if kind is None:
            raise BadGeometry("invalid WKT")
        if tokens[pos].upper() == "EMPTY":
            next_()
            return kind, None if kind == "Point" else []
        if kind == "Point":
            return kind, listed(point)[0]
        if kind == "LineString":
            return kind, listed(point)
        if kind == "MultiPoint":
            return kind, listed(loose)
        if kind in ("Polygon", "MultiLineString"):
            return kind, listed(lambda: listed(point))
        if kind == "MultiPolygon":
            return kind, listed(lambda: listed(lambda: listed(point)))
        return kind, listed(geometry)

    out = geometry()
    if tokens[pos]:
        raise BadGeometry("invalid WKT")
    return out
