"""The ST functions as columns and as SQL functions.

Null and undecodable geometries give null. A geometry that repeats within a
batch is decoded once, which makes constants cheap. Number arguments are cast
to double first, as SQL literals like 1.5 are decimals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import kernels as k
from terrane.functions import overlay as o
from terrane.functions import wkb
from terrane.functions.crs import lookup, transform


# Type objects, as workers import this module without a session that could read type names.
_TYPES = {"double": T.DoubleType(), "string": T.StringType(), "bigint": T.LongType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def _udf(f, kind: str, *more):
    return F.pandas_udf(f, _TYPES[kind], *more)


class _Decoded(dict):
    def __missing__(self, data):
        g = self[data] = wkb.decode(data)
        return g


def _floats(s: pd.Series) -> np.ndarray:
    return pd.to_numeric(s, errors="coerce").to_numpy(float)


def _unary(f, kind: str):
    def run(g: pd.Series) -> pd.Series:
        seen = _Decoded()
        return pd.Series([None if d is None or (x := seen[d]) is None else f(x) for d in g], dtype=object)

    return _udf(run, kind)


def _meet(a, pa, b, pb):
    return (a[:, 0] <= b[:, 2]) & (b[:, 0] <= a[:, 2]) & (a[:, 1] <= b[:, 3]) & (b[:, 1] <= a[:, 3])


def _cover(a, pa, b, pb):
    inside = (a[:, 0] <= b[:, 0]) & (a[:, 1] <= b[:, 1]) & (b[:, 2] <= a[:, 2]) & (b[:, 3] <= a[:, 3])
    within = (a[:, 0] < b[:, 0]) & (a[:, 1] < b[:, 1]) & (b[:, 2] < a[:, 2]) & (b[:, 3] < a[:, 3])
    return np.where(pb & ~pa, within, inside)  # a point on the edge is not contained


def _part(a, pa, b, pb):
    return _cover(b, pb, a, pa)


def _gap(a, pa, b, pb):
    """The distance of points and filled upright rectangles: none where they meet."""
    dx = np.maximum(0.0, np.maximum(b[:, 0] - a[:, 2], a[:, 0] - b[:, 2]))
    dy = np.maximum(0.0, np.maximum(b[:, 1] - a[:, 3], a[:, 1] - b[:, 3]))
    return np.hypot(dx, dy)


def _binary(f, kind: str, quick=None):
    """quick: the same on bounds, for columns of points and upright rectangles."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if quick and (x := wkb.simple_shapes(list(a))) and (y := wkb.simple_shapes(list(b))):
            none = np.isnan(x[0][:, 0]) | np.isnan(y[0][:, 0])
            return pd.Series(quick(*x, *y)).astype(object).where(~none, None)
        seen = _Decoded()
        return pd.Series([None if p is None or q is None or (x := seen[p]) is None or (y := seen[q]) is None else f(x, y) for p, q in zip(a, b)], dtype=object)

    return _udf(run, kind)


def _with_number(f, kind: str):
    def run(g: pd.Series, n: pd.Series) -> pd.Series:
        seen = _Decoded()
        return pd.Series([None if d is None or v != v or (x := seen[d]) is None else f(x, float(v)) for d, v in zip(g, _floats(n))], dtype=object)

    return _udf(run, kind)


def _edge(i: int):
    def run(g: pd.Series) -> pd.Series:
        v = wkb.bounds_column(list(g))[:, i]
        return pd.Series(v).astype(object).where(~np.isnan(v), None)

    return _udf(run, "double")


def _point_part(i: int):
    def run(g: pd.Series) -> pd.Series:
        shapes = wkb.simple_shapes(list(g))
        if shapes and (shapes[1] | np.isnan(shapes[0][:, 0])).all():
            v = shapes[0][:, i]
            return pd.Series(v).astype(object).where(~np.isnan(v), None)
        seen = _Decoded()
        found = [None if d is None else seen[d] for d in g]
        return pd.Series([float(x[1][i]) if x and x[0] == "Point" and x[1] is not None else None for x in found], dtype=object)

    return _udf(run, "double")


def _st_point(x: pd.Series, y: pd.Series) -> pd.Series:
    a, b = _floats(x), _floats(y)
    out = pd.Series(wkb.point_column(a, b), dtype=object)
    return out.where(~(np.isnan(a) | np.isnan(b)), None)


def _st_makeenvelope(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    c = [_floats(s) for s in (x0, y0, x1, y1)]
    return pd.Series(wkb.box_column(*c), dtype=object).where(~np.isnan(np.stack(c)).any(axis=0), None)


def _st_geomfromtext(t: pd.Series) -> pd.Series:
    out = []
    for x in t:
        try:
            out.append(None if x is None else wkb.encode(wkb.from_wkt(x)))
        except wkb.BadGeometry:
            out.append(None)
    return pd.Series(out, dtype=object)


def _moved(g, source, target):
    points = list(wkb.coordinates(g))
    if not points:
        return g
    x, y = transform(np.array([p[0] for p in points]), np.array([p[1] for p in points]), source, target)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None
    new = iter(zip(x.tolist(), y.tolist()))

    def walk(kind, body):
        if kind == "Point":
            return None if body is None else next(new)
        if kind in ("LineString", "MultiPoint"):
            return [None if p is None else next(new) for p in body]
        if kind == "GeometryCollection":
            return [(c, walk(c, b)) for c, b in body]
        inner = {"Polygon": "LineString", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}[kind]
        return [walk(inner, b) for b in body]

    return g[0], walk(*g)


def _st_transform(g: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    seen = _Decoded()
    out = []
    for d, a, b in zip(g, source, target):
        x = None if d is None else seen[d]
        out.append(None if x is None or a is None or b is None else wkb.encode(_moved(x, lookup(a), lookup(b))))
    return pd.Series(out, dtype=object)


def _st_area(g: pd.Series) -> pd.Series:
    if shapes := wkb.simple_shapes(list(g)):
        b, _ = shapes
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        return pd.Series(area).astype(object).where(~np.isnan(area), None)
    seen = _Decoded()
    return pd.Series([None if d is None or (x := seen[d]) is None else float(k.area(x)) for d in g], dtype=object)


def _point_or_none(p):
    return None if p is None else wkb.encode(("Point", p))


FUNCTIONS = {
    "st_area": _udf(_st_area, "double"),
    "st_length": _unary(lambda g: float(k.length(g)), "double"),
    "st_x": _point_part(0),
    "st_y": _point_part(1),
    "st_xmin": _edge(0),
    "st_ymin": _edge(1),
    "st_xmax": _edge(2),
    "st_ymax": _edge(3),
    "st_geometrytype": _unary(lambda g: g[0], "string"),
    "st_npoints": _unary(k.n_points, "bigint"),
    "st_astext": _unary(wkb.to_wkt, "string"),
    "st_geomfromtext": _udf(_st_geomfromtext, "binary"),
    "st_point": _udf(_st_point, "binary"),
    "st_makeenvelope": _udf(_st_makeenvelope, "binary"),
    "st_centroid": _unary(lambda g: _point_or_none(k.centroid(g)), "binary"),
    "st_convexhull": _unary(lambda g: wkb.encode(("Polygon", [h] if (h := k.convex_hull(list(wkb.coordinates(g)))) else [])), "binary"),
    "st_union": _binary(lambda a, b: wkb.encode(o.set_operation(a, b, "union")), "binary"),
    "st_intersection": _binary(lambda a, b: wkb.encode(o.set_operation(a, b, "intersection")), "binary"),
    "st_difference": _binary(lambda a, b: wkb.encode(o.set_operation(a, b, "difference")), "binary"),
    "st_symdifference": _binary(lambda a, b: wkb.encode(o.set_operation(a, b, "symdifference")), "binary"),
    "st_buffer": _with_number(lambda g, d: wkb.encode(o.buffer(g, d)), "binary"),
    "st_simplify": _with_number(lambda g, t: wkb.encode(k.simplify(g, t)), "binary"),
    "st_transform": _udf(_st_transform, "binary"),
    "st_intersects": _binary(lambda a, b: bool(k.intersects(a, b)), "boolean", _meet),
    "st_contains": _binary(lambda a, b: bool(k.contains(a, b)), "boolean", _cover),
    "st_within": _binary(lambda a, b: bool(k.contains(b, a)), "boolean", _part),
    "st_distance": _binary(k.distance, "double", _gap),
}


def _st_dwithin(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
    if (x := wkb.simple_shapes(list(a))) and (y := wkb.simple_shapes(list(b))):
        far = _gap(*x, *y)
        return pd.Series(far <= _floats(d)).astype(object).where(~(np.isnan(far) | np.isnan(_floats(d))), None)
    seen = _Decoded()
    out = []
    for p, q, v in zip(a, b, _floats(d)):
        x, y = (None if z is None else seen[z] for z in (p, q))
        far = None if x is None or y is None or v != v else k.distance(x, y)
        out.append(None if far is None else bool(far <= v))
    return pd.Series(out, dtype=object)


FUNCTIONS["st_dwithin"] = _udf(_st_dwithin, "boolean")


def _st_union_agg(g: pd.Series) -> bytes:
    polygons = [p for d in dict.fromkeys(g) if d is not None and (x := wkb.decode(d)) for p in wkb.polygons_of(x)]
    return wkb.encode(("MultiPolygon", o.union_all(polygons))) if polygons else None


def _st_collect(g: pd.Series) -> bytes:
    parts = [x for d in g if d is not None and (x := wkb.decode(d)) is not None]
    flat = [q for p in parts for q in (p[1] if p[0] == "GeometryCollection" else [p])]
    return wkb.encode(("GeometryCollection", flat)) if parts else None


def _st_extent(g: pd.Series) -> bytes:
    b = wkb.bounds_column(list(g))
    b = b[~np.isnan(b).any(axis=1)]
    return wkb.box_column(*(np.array([v]) for v in (b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max())))[0] if len(b) else None


def _aggregate(f):
    def run(g: pd.Series) -> bytes:
        return f(g)

    return _udf(run, "binary", F.PandasUDFType.GROUPED_AGG)


AGGREGATES = {"st_union_agg": _aggregate(_st_union_agg), "st_extent": _aggregate(_st_extent), "st_collect": _aggregate(_st_collect)}


def register_all(spark: SparkSession) -> None:
    """The 28 functions and 3 aggregates under their names in SQL."""
    for name, f in {**FUNCTIONS, **AGGREGATES}.items():
        spark.udf.register(name, f)


def st(name: str, *args) -> Column:
    """A function on columns and constants: st("st_area", "geometry"), st("st_point", 1, F.col("y")).

    Constant geometries, (kind, body) or bytes, are encoded on the driver.
    """
    def column(a):
        if isinstance(a, Column):
            return a
        if isinstance(a, tuple):
            return F.lit(wkb.encode(a))
        if isinstance(a, (bytes, bytearray)):
            return F.lit(bytes(a))
        return F.col(a) if isinstance(a, str) else F.lit(float(a))

    if name == "st_transform":
        for crs in args[1:]:
            if isinstance(crs, str):
                lookup(crs)  # an unknown constant CRS is an error before anything runs
        args = [args[0], *(F.lit(a) if isinstance(a, str) else a for a in args[1:])]
    return FUNCTIONS[name](*map(column, args))


def geom_from_text(text: str) -> Column:
    """A constant geometry; a bad text is an error here, while in a column it is null."""
    try:
        return F.lit(wkb.encode(wkb.from_wkt(text)))
    except wkb.BadGeometry as e:
        raise ValueError(f"invalid WKT: {text[:60]!r}") from e


def bounds_struct(geometry: str | Column) -> Column:
    """struct<xmin,ymin,xmax,ymax> of a geometry column, decoded once; null without coordinates."""
    def run(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(wkb.bounds_column(list(g)), columns=["xmin", "ymin", "xmax", "ymax"])

    return F.pandas_udf(run, "xmin double, ymin double, xmax double, ymax double")(geometry)


def extent_by(df: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """keys and xmin, ymin, xmax, ymax of each group, with built-in aggregates and so with partial aggregation."""
    boxes = df.select(*keys, bounds_struct(geometry).alias("__b"))
    pick = lambda agg, c: agg(F.nanvl(F.col(f"__b.{c}"), F.lit(None).cast("double"))).alias(c)
    return boxes.groupBy(*keys).agg(pick(F.min, "xmin"), pick(F.min, "ymin"), pick(F.max, "xmax"), pick(F.max, "ymax"))


def union_by(df: DataFrame, keys: list[str], geometry: str, salts: int = 16) -> DataFrame:
    """keys and the dissolved geometry. Groups are first dissolved in salted parts, as a union of unions is the union."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(geometry), F.lit(salts)))
    part = salted.groupBy(*keys, "__salt").agg(AGGREGATES["st_union_agg"](F.col(geometry)).alias("__part"))
    return part.groupBy(*keys).agg(AGGREGATES["st_union_agg"](F.col("__part")).alias(geometry))


def ground_distance(lon1: float, lat1: float, lon2: float, lat2: float, radius: float = 6371008.8) -> float:
    """Metres along the sphere between two places."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))
