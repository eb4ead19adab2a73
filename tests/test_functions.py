import math
import random

import pytest

from terrane.functions import kernels as k
from terrane.functions import overlay as o
from terrane.functions import wkb
from terrane.functions.crs import UnknownCrs, best_fit, from_projjson, lookup, transform
from terrane.functions.spatial import FUNCTIONS, geom_from_text, register_all, st

A, B = "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((1 0,3 0,3 2,1 2,1 0))"


@pytest.mark.parametrize("text", ["POINT(1 2)", "LINESTRING(0 0,1.5 2)", A, "POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT((1 2),(3 4))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "POINT EMPTY"])
def test_wkt_and_wkb_round_trip(text):
    g = wkb.from_wkt(text)
    assert wkb.to_wkt(g) == text and wkb.decode(wkb.encode(g)) == g


def test_bad_bytes_are_null():
    assert [wkb.decode(x) for x in (None, b"", b"\1", b"\1\3\0\0\0\xff\xff\xff\x7f", b"\7" * 30)] == [None] * 5
    for text in ("", "POINT", "POINT(1)", "POINT(1 2", "CIRCLE(1 2)", "POINT(a b)", "POINT(1 2) x"):
        with pytest.raises(wkb.BadGeometry):
            wkb.from_wkt(text)


def test_set_operations_of_overlapping_squares():
    a, b = wkb.from_wkt(A), wkb.from_wkt(B)
    assert [k.area(o.set_operation(a, b, n)) for n in o.RULES] == [6, 2, 2, 4]
    assert o.set_operation(a, wkb.from_wkt("LINESTRING(0 0,1 1)"), "union") is None
    far = o.set_operation(a, wkb.from_wkt("POLYGON((9 9,10 9,10 10,9 9))"), "intersection")
    assert far == ("MultiPolygon", []) and k.area(far) == 0


def test_set_operations_keep_areas():
    r = random.Random(1)
    for _ in range(60):
        p = [[k.convex_hull([(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(8)])] for _ in range(2)]
        u, i, d, x = (k.area(("MultiPolygon", o.overlay(p[:1], p[1:], f))) for f in o.RULES.values())
        a, b = map(k.polygon_area, p)
        assert abs(u + i - a - b) < 1e-6 and abs(d - a + i) < 1e-6 and abs(x - u + i) < 1e-6


def test_union_with_hole_and_itself():
    ring = [[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]] for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    u = o.union_all(ring)
    assert len(u) == 1 and len(u[0]) == 2 and k.area(("MultiPolygon", u)) == 8
    assert k.area(("MultiPolygon", o.union_all(u + u))) == 8


def test_buffer():
    assert round(k.area(o.buffer(("Point", (0, 0)), 1))) == 3
    assert k.area(o.buffer(wkb.from_wkt(A), 1)) == pytest.approx(4 + 8 + math.pi, abs=0.02)
    assert k.area(o.buffer(wkb.from_wkt("POLYGON((0 0,10 0,10 10,0 10,0 0))"), -1)) == pytest.approx(64, abs=1e-6)


def test_measures_and_predicates():
    a, b = wkb.from_wkt(A), wkb.from_wkt(B)
    assert k.distance(("Point", (0, 0)), ("Point", (3, 4))) == 5
    assert k.length(a) == 0 and k.length(wkb.from_wkt("LINESTRING(0 0,3 4)")) == 5
    assert k.centroid(a) == (1, 1) and k.n_points(a) == 5
    assert k.intersects(a, b) and k.contains(a, ("Point", (1, 1))) and not k.contains(a, ("Point", (0, 0))) and not k.contains(a, b) and k.contains(a, a)
    holed = wkb.from_wkt("POLYGON((0 0,9 0,9 9,0 9,0 0),(3 3,6 3,6 6,3 6,3 3))")
    assert not k.contains(holed, wkb.from_wkt("POLYGON((2 2,7 2,7 7,2 7,2 2))")) and not k.intersects(holed, ("Point", (4, 4))) and k.distance(holed, ("Point", (4, 4))) == 1
    assert len(k.simplify(wkb.from_wkt("LINESTRING(0 0,1 0.01,2 0)"), 0.5)[1]) == 2


def test_projections():
    x, y = transform(2.349014, 48.864716, lookup(4326), lookup("epsg:2154"))
    assert abs(x - 652242.70) < 1 and abs(y - 6862939.61) < 1
    for code in (3857, 3395, 2154, 3035, 3034, 5070, 6933, 32631, 32733, 27700):
        lon, lat = transform(*transform(2.0, 48.0, lookup(4326), lookup(code)), lookup(code), lookup(4326))
        assert abs(lon - 2) < 1e-6 and abs(lat - 48) < 1e-6, code
    with pytest.raises(UnknownCrs):
        lookup("EPSG:999999")
    assert from_projjson(None, missing=True).epsg == 4326 and from_projjson(None).epsg is None and from_projjson({"id": {"authority": "EPSG", "code": 3857}}).epsg == 3857
    assert best_fit(-180, -80, 180, 80) is None and "laea" in best_fit(0, 75, 10, 89) and "cea" in best_fit(-20, -2, 20, 2) and "aea" in best_fit(-20, 40, 20, 50)


def test_sql_names(spark):
    register_all(spark)
    assert len(FUNCTIONS) == 28
    row = spark.sql(f"""SELECT st_area(st_union(st_geomfromtext('{A}'), st_geomfromtext('{B}'))) u, st_astext(st_point(1, 2)) p, st_geometrytype(st_buffer(st_point(0, 0), 1.5)) b,
        st_area(NULL) n, st_geomfromtext('nonsense') bad, st_area(X'00') broken, st_area(st_makeenvelope(3, 2, 1, 0)) e, st_within(st_point(1, 1), st_geomfromtext('{A}')) w, st_dwithin(st_point(0, 0), st_point(3, 4), 5) d""").first()
    assert tuple(row) == (6.0, "POINT(1 2)", "MultiPolygon", None, None, None, 4.0, True, True)
    none = spark.sql("SELECT st_union_agg(g) u, st_extent(g) e, st_collect(g) c FROM (SELECT st_geomfromtext('bad') g)").first()
    assert tuple(none) == (None, None, None)
    with pytest.raises(ValueError):
        geom_from_text("nonsense")
    with pytest.raises(UnknownCrs):
        st("st_transform", "g", "EPSG:4326", "EPSG:999999")


def test_quick_paths_agree_with_the_kernels():
    import numpy as np
    import pandas as pd

    r = random.Random(3)
    shapes = [("Point", (r.randint(0, 5), r.randint(0, 5))) for _ in range(60)] + [wkb.decode(wkb.box_column(*(np.array([float(v)]) for v in (x, y, x + r.randint(1, 3), y + r.randint(1, 3))))[0]) for x, y in ((r.randint(0, 4), r.randint(0, 4)) for _ in range(60))]
    pairs = [(r.choice(shapes), r.choice(shapes)) for _ in range(600)]
    a, b = (pd.Series([wkb.encode(p[i]) for p in pairs]) for i in (0, 1))
    assert FUNCTIONS["st_intersects"].func(a, b).tolist() == [k.intersects(*p) for p in pairs]
    assert FUNCTIONS["st_contains"].func(a, b).tolist() == [k.contains(*p) for p in pairs]
    assert FUNCTIONS["st_within"].func(a, b).tolist() == [k.contains(q, p) for p, q in pairs]


def test_points_and_rectangles_in_arrays_as_one_by_one(spark):
    """Columns of points and upright rectangles take another way than mixed ones; a line among them forces the other way."""
    r = random.Random(4)

    def shape():
        x, y, w, h = (float(r.randint(0, 9)) for _ in range(4))
        return r.choice([None, f"POINT ({x} {y})", f"POLYGON (({x} {y}, {x + w + 1} {y}, {x + w + 1} {y + h + 1}, {x} {y + h + 1}, {x} {y}))"])

    pairs = [(i, shape(), shape()) for i in range(300)]
    ask = "id", "st_x(a) as x", "st_y(a) as y", "st_distance(a, b) as d", "st_dwithin(a, b, 3) as n", "st_dwithin(a, b, null) as none"
    register_all(spark)

    def rows(extra):
        df = spark.createDataFrame([*pairs, *extra], "id long, s string, t string").coalesce(1)
        return {x.id: tuple(round(v, 9) if isinstance(v, float) else v for v in x[1:]) for x in df.selectExpr("id", "st_geomfromtext(s) as a", "st_geomfromtext(t) as b").selectExpr(*ask).collect()}

    quick, slow = rows([]), rows([(-1, "LINESTRING (0 0, 1 1)", "LINESTRING (0 0, 1 1)")])
    assert slow.pop(-1) == (None, None, 0.0, True, None)
    assert quick == slow
    assert {v[4] for v in quick.values()} == {None} and any(v[2] == 0 for v in quick.values())
