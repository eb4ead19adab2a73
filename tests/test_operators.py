import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from terrane.functions import wkb
from terrane.operators import classify, grid, layout, relational
from terrane.sources import tabular, vector


def cells(spark, rows):
    return spark.createDataFrame([(i, j, float(v), 1.0) for i, j, v in rows], "ix bigint, iy bigint, value double, count double")


def values(df):
    return {(r.ix, r.iy): r.value for r in df.collect()}


def test_smoothing(spark):
    c = cells(spark, [(0, 0, 10), (1, 0, 30), (50, 50, 100)])
    assert values(grid.smooth(c)) == {(0, 0): 20, (1, 0): 20, (50, 50): 100}
    assert values(grid.smooth(c, gauss=True))[0, 0] == pytest.approx((10 * 4 + 30 * 2) / 6)
    assert values(grid.focal_std(c))[50, 50] == 0 and values(grid.opened(c))[1, 0] == 10


def test_weighted_median_and_density(spark):
    w = spark.createDataFrame([(0, 0, 1e6, 0.01, 1.0, 1), (0, 0, 10.0, 1.0, 1.0, 2), (0, 0, 20.0, 1.0, 1.0, 3)], "ix bigint, iy bigint, v double, w double, q double, row bigint")
    assert values(grid.summarise(w, "median", 1, 1)) == {(0, 0): 20}
    half = w.where("row = 1").withColumn("w", F.lit(0.5))
    assert values(grid.summarise(half, "density", 100, 100))[0, 0] == 50


def test_text_takes_majority_only(spark):
    trees = spark.createDataFrame([(1.0, 1.0, " Acer "), (2.0, 2.0, "Betula"), (3.0, 3.0, "Acer"), (4.0, 4.0, None), (5.0, 5.0, " "), (150.0, 1.0, "Cornus")], "x double, y double, species string")
    w = grid.point_weights(trees, "x", "y", "species", 100, 100)
    assert values(grid.summarise(w, "majority", 100, 100)) == {(0, 0): "Acer", (1, 0): "Cornus"}
    assert values(grid.summarise(w, "minority", 100, 100))[0, 0] == "Betula"
    with pytest.raises(ValueError):
        grid.summarise(w, "mean", 100, 100)


def test_polygons_share_out_their_area(spark):
    g = [("POLYGON((0 0,30 0,30 10,0 10,0 0))", 6.0, 1), ("POLYGON((0 0,20 0,20 20,0 20,0 0),(5 5,15 5,15 15,5 15,5 5))", 3.0, 2), ("POLYGON((0 0,30 30,0 30,30 0,0 0))", 1.0, 3), ("LINESTRING(0 0,4 4)", 2.0, 4)]
    df = spark.createDataFrame([(bytearray(wkb.encode(wkb.from_wkt(t))), v, r) for t, v, r in g], "geometry binary, v double, r int")
    w = grid.polygon_weights(df, "geometry", "v", 10.0, 10.0, "r").collect()
    by = {r: [x for x in w if x.row == r] for r in (1, 2, 3, 4)}
    assert [x.w for x in by[1]] == pytest.approx([1 / 3] * 3) and [x.q for x in by[2]] == pytest.approx([75] * 4)
    assert sum(x.w for x in by[3]) == pytest.approx(1) and [(x.ix, x.w) for x in by[4]] == [(0, 1.0)]


def test_contours(spark):
    c = cells(spark, [(i, j, i) for i in range(5) for j in range(5)])
    assert grid.contour_levels(c, 3) == [1, 2, 3]
    lines = grid.contour_lines(c, [1.5], 1.0, 1.0).collect()
    assert len(lines) == 1
    points = list(wkb.coordinates(wkb.decode(lines[0].geometry)))
    assert {p[0] for p in points} == {2.0} and sorted(p[1] for p in points)[0] == 0.5 and max(p[1] for p in points) == 4.5
    with pytest.raises(ValueError):
        grid.contour_levels(cells(spark, [(0, 0, 1), (1, 0, 1)]), 3)


def test_class_breaks(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100, 101, 102, 1000]] + [(None,), (float("nan"),)], "v double")
    assert classify.breaks(df, "v", "equal", 3) == [334, 667]
    assert classify.breaks(df, "v", "quantile", 4) == [3, 100, 102]
    assert classify.breaks(df, "v", "jenks", 3) == [100, 1000]
    assert classify.breaks(df, "v", "headtail", 5)[0] == pytest.approx(1313 / 8)
    # The mean is in the head, which therefore never is empty; a head of 40 % or more ends the list.
    assert classify.breaks(spark.createDataFrame([(1.0,), (1.0,), (4.0,)], "v double"), "v", "headtail", 5) == [2]
    same = df.where("v = 1")
    assert classify.breaks(same, "v", "equal", 4) == classify.breaks(same, "v", "headtail", 4) == [1.25, 1.5, 1.75]
    assert classify.breaks(same, "v", "quantile", 4) == [1, 1, 1] and classify.breaks(same, "v", "geometric", 3) == pytest.approx([4 / 3, 5 / 3])
    assert classify.breaks(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (7.0,)], "v double"), "v", "quantile", 4) == [1, 1, 7]
    assert classify.breaks(df.where("v < 0"), "v", "quantile", 4) == [0.25, 0.5, 0.75]
    bins = [r[0] for r in df.select(classify.bin_of("v", [3, 100])).collect()]
    assert bins == [0, 0, 1, 1, 2, 2, 2, 2, 0, 0]
    assert [r[0] for r in df.select(classify.category_of("v", ["2.0"])).limit(2).collect()] == [63, 0]


def test_hilbert_neighbours_are_near(spark):
    side = spark.range(4096).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    code = sorted((r.d, r.x, r.y) for r in side.select("x", "y", layout.hilbert(F.col("x") * 1024, F.col("y") * 1024).alias("d")).collect())
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(code, code[1:]))


def test_levels_place_every_row_once(spark):
    p = spark.range(500).select("id", F.struct((F.col("id") % 25).cast("double").alias("xmin"), F.floor(F.col("id") / 25).cast("double").alias("ymin"), (F.col("id") % 25).cast("double").alias("xmax"), F.floor(F.col("id") / 25).cast("double").alias("ymax")).alias("bbox"))
    rows = layout.cogp_levels(p, "bbox", [4.0, 2.0, 0.1], "id", rank="id").collect()
    assert sorted(r.id for r in rows) == list(range(500))
    assert sorted(r.id for r in rows if r.level == 0) == [0, 16, 400, 416]
    with pytest.raises(ValueError):
        layout.cogp_levels(p, "bbox", [1.0, 2.0], "id")


def test_geoparquet_file_and_scorecard(spark, tmp_path):
    from terrane.functions.spatial import st

    df = spark.range(4000).select("id", st("st_point", F.col("id") % 63, F.floor(F.col("id") / 63)).alias("geometry"))
    path = str(tmp_path / "out")
    assert layout.write_geoparquet(df, "geometry", path, row_group_rows=200, files=2)["rows"] == 4000
    card = layout.scorecard(path)
    assert card["C1"] == card["C2"] == "pass" and card["indexable"] and card["rows"] == 4000 and card["C7"] == "pass"
    groups = layout.footer(path)
    plan = layout.plan_viewport(groups, (0, 0, 3, 3))
    assert plan["mode"] == "rect" and 0 < len(plan["groups"]) < len(groups)
    back = spark.read.parquet(path)
    view = ("Polygon", [[(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)]])
    found = relational.where_spatial(back, "st_intersects", "geometry", view, box="bbox")
    assert found.count() == 16 == relational.where_spatial(back, "st_intersects", "geometry", view).count()
    assert "PushedFilters: [IsNotNull" in found._jdf.queryExecution().toString() or "bbox" in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="no rows"):
        layout.write_geoparquet(df.limit(0), "geometry", str(tmp_path / "none"))


def test_partition_values_survive(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b"), (2, ""), (3, None), (4, "__HIVE_DEFAULT_PARTITION__"), (5, "1%00"), (6, "01")], "id int, k string")
    layout.write_partitioned(df, ["k"], f"{tmp_path}/p")
    assert {(r.id, r.k) for r in layout.read_partitioned(spark, f"{tmp_path}/p", ["k"]).collect()} == {tuple(r) for r in df.collect()}


def test_names_and_ranges(spark):
    assert relational.sql_column_names(["NAME", "name", 'va"l', "name_2"]) == ["name", "name_2", 'va"l', "name_2_2"]
    assert [relational.sql_table_name(n, ["layer"]) for n in ("My Layer", "3d", "")] == ["my_layer", "t3d", "layer_2"]
    df = spark.createDataFrame([(i,) for i in [0, 1, 2, 5, 65535, 65536, 65537, 90000]], "r long")
    assert sorted(map(tuple, relational.row_ranges(df, "r").collect())) == [(0, 2), (5, 5), (65535, 65537), (90000, 90000)]


def test_merge_drops_conflicting_columns(spark):
    a = spark.createDataFrame([(1, 2, "x")], "a int, b int, c string")
    b = spark.createDataFrame([(1.5, True, "y")], "a double, b boolean, d string")
    assert sorted(relational.merge_layers([a, b]).dtypes) == [("a", "double"), ("c", "string"), ("d", "string")]


def test_delimited_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Code;Preis;lon;lat;ok\n007;1 234;2.5;48;yes\n010;x;;47;no\n")
    df = tabular.read_delimited(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"Code": "string", "Preis": "string", "lon": "double", "lat": "bigint", "ok": "boolean"}
    assert [r.geometry is None for r in tabular.points_of(df, "lon", "lat").collect()] == [False, True]
    assert tabular.coordinate_columns(df.columns) == ("lon", "lat") and tabular.clean_names(["a b", "a-b", ""]) == ["a_b", "a_b_2", "column_3"]
    bad = tabular.bad_values(spark.createDataFrame([("1",), ("x",), ("",)], "v string"), {"v": "integer"}).first()
    assert bad.v == 1


def test_geojson(spark):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.35, 48.85]}, "properties": {"region": "north", "n": 1, "x": {"a": 1}}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": []}, "properties": {"region": None, "n": 2.5}}]}
    rows = vector.geojson(spark, json.dumps(doc)).collect()
    assert wkb.decode(rows[0].geometry) == ("Point", (2.35, 48.85)) and rows[0].x == '{"a": 1}' and rows[1].geometry is None and rows[1].n == 2.5


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "p.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("create table gpkg_contents(table_name, data_type); create table gpkg_geometry_columns(table_name, column_name); create table places(fid integer, geom blob, name text, big boolean); insert into gpkg_contents values ('places', 'features'); insert into gpkg_geometry_columns values ('places', 'geom')")
        db.execute("insert into places values (1, ?, 'x', 1), (2, null, null, null)", (b"GP\0\1" + struct.pack("<i", 4326) + wkb.encode(("Point", (1.0, 2.0))),))
    rows = vector.read_geopackage(spark, path, "PLACES").collect()
    assert wkb.decode(rows[0].geometry) == ("Point", (1.0, 2.0)) and rows[0].big is True and rows[1].geometry is None
    with pytest.raises(ValueError, match="places"):
        vector.read_geopackage(spark, path, "other")


def test_shapefile(spark, tmp_path):
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    hole = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, 9, 0, 5) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    (tmp_path / "A.SHP").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    fields = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in ((b"NAME", b"C", 5, 0), (b"N", b"N", 5, 0)))
    (tmp_path / "A.DBF").write_bytes(b"\3" * 4 + struct.pack("<IHH", 1, 33 + len(fields), 11) + b"\0" * 20 + fields + b"\r" + b" abc  " + b"   42")
    row = vector.read_shapefile(spark, str(tmp_path / "A.SHP")).first()
    kind, rings = wkb.decode(row.geometry)
    assert kind == "Polygon" and len(rings) == 2 and (row.NAME, row.N) == ("abc", 42)


def test_stac_parts():
    c = vector.stac_collection("x", [{"href": "a", "bbox": [0, 0, 1, 1], "rows": 1}, {"href": "b", "bbox": [5, 5, 9, 9], "rows": 2}, {"href": "c", "rows": 3}])
    assert vector.stac_parts(c, (0.5, 0.5, 2, 2)) == ["c", "a"] and c["summaries"]["rows"] == 6


def test_streamed_grid_equals_the_batch(spark, tmp_path):
    from terrane.streaming.grid import windowed_cells

    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("v"))
    rows.write.parquet(f"{tmp_path}/in")
    make = lambda df: windowed_cells(df, "ts", F.col("x"), F.col("v"), "v", 2.0, 2.0)
    stream = make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from cells").collect())) == sorted(map(tuple, make(rows).collect()))


def test_queries_match_their_sql(spark):
    import duckdb
    import pandas as pd

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        db.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    oracles = entry.oracle_sql()
    for name in ("flagship", "st_box_predicates", "admin_join_boxes", "grid_majority", "grid_apportion_boxes", "hilbert_code", "rollup", "row_filter_ranges"):
        got, want = entry.queries()[name](spark, d).toPandas(), db.sql(oracles[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        text = lambda f: sorted(str([None if pd.isna(v) else round(float(v), 4) if isinstance(v, (int, float)) else v for v in r]) for r in f[columns].astype(object).itertuples(index=False))
        assert text(got) == text(want), name


def test_command_line(spark, tmp_path, capsys):
    from terrane import cli

    (tmp_path / "two.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": c}, "properties": {"region": r}} for c, r in (([2.35, 48.85], "north"), ([5.37, 43.3], "south"))]}))
    assert cli.main(["--input", str(tmp_path / "two.geojson"), "--output", str(tmp_path / "out"), "--files", "1"]) == 0
    assert capsys.readouterr().out.strip().endswith(" kB | 1 file(s)")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    for bad in (["--input", "a.geojson"], ["--input", "a.geojson", "--output", "o", "--layer", "x"], ["--input", "a.geojson", "--output", "o", "--row-group-size", "0"], ["--input", "a.geojson", "--output", "o", "--row-group-mib", "0"],
                *[["--input", "a.geojson", "--output", "o", "--cogp", *more] for more in (["--no-hilbert"], ["--no-covering"], ["--partition-by", "k"])]):
        with pytest.raises(SystemExit):
            cli.options(bad)


def test_scorecard_and_split_beyond_4096(spark, monkeypatch):
    group = {"file": "f", "rows": 1, "bytes": 1, "geo": {}, "box": (0.0, 0.0, 1.0, 1.0), "codec": "ZSTD", "indexed": True}
    monkeypatch.setattr(layout, "footer", lambda path: [group] * 5000)
    card = layout.scorecard("")
    assert card["overlaps"] == 4095 and card["C2"] == "fail"
    monkeypatch.setattr(layout, "MAX_PARTS", 2)
    df = spark.range(400).selectExpr("(id % 4) * 2 + 0.5D as x", "0.5D as y")
    with pytest.raises(ValueError):
        layout.adaptive_split(df, F.col("x"), F.col("y"), 8.0, 50, 3)
    monkeypatch.setattr(layout, "MAX_PARTS", 4)
    rows = layout.adaptive_split(df.union(spark.sql("SELECT NULL, 1D")), F.col("x"), F.col("y"), 8.0, 50, 3)
    assert {r.part: r["count"] for r in rows.groupBy("part").count().collect()} == {f"3/{i}/0": 100 for i in (0, 2, 4, 6)} | {None: 1}


def test_light_comes_from_the_azimuth(spark):
    rising = cells(spark, [(x, y, 5 * y) for x in range(5) for y in range(5)])  # higher to the north: faces south
    south, north = (values(grid.hillshade(rising, 1.0, 1.0, a))[2, 2] for a in (180.0, 0.0))
    assert south > 250 and north < 5
    east = cells(spark, [(x, y, -3 * x) for x in range(5) for y in range(5)])  # falls to the east
    assert values(grid.hillshade(east, 1.0, 1.0, 90.0))[2, 2] > 250 > 5 > values(grid.hillshade(east, 1.0, 1.0, 270.0))[2, 2]


def test_grids_take_finite_values_only(spark):
    inf = float("inf")
    rows = [(1.0, 1.0, 5.0, 1), (inf, 1.0, 5.0, 2), (1.0, 1.0, inf, 3), (1.0, -inf, 5.0, 4), (1.0, float("nan"), 5.0, 5), (1.0, None, 5.0, 6), (1.0, 1.0, None, 7)]
    df = spark.createDataFrame(rows, "x double, y double, v double, id int")
    assert [tuple(r) for r in grid.summarise(grid.point_weights(df, "x", "y", "v", 2.0, 2.0), "sum", 2.0, 2.0).collect()] == [(0, 0, 5.0, 1.0)]
    boxed = df.withColumn("x1", F.col("x") + 0.5).withColumn("y1", F.col("y") + 0.5)
    assert [tuple(r) for r in grid.summarise(grid.box_weights(boxed, ("x", "y", "x1", "y1"), "v", 2.0, 2.0, "id"), "sum", 2.0, 2.0).collect()] == [(0, 0, 5.0, 1.0)]


def test_points_on_an_edge_are_not_contained(spark):
    from terrane.functions.spatial import st

    areas = spark.createDataFrame([(1, 0.0), (2, 4.0)], "id int, x double").select("id", st("st_makeenvelope", F.col("x"), F.lit(0.0), F.col("x") + 4, F.lit(4.0)).alias("g"))
    p = spark.createDataFrame([(2.0, 2.0), (4.0, 2.0), (5.0, 2.0), (5.0, 2.0), (5.0, 4.0), (None, 1.0)], "x double, y double")
    got = relational.first_containing(p, areas, "x", "y", "id", "g", "id", 3.0).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2.0, 2.0, 1), (4.0, 2.0, None), (5.0, 2.0, 2), (5.0, 2.0, 2), (5.0, 4.0, None), (None, 1.0, None)], key=str)


def test_spatial_join_against_all_pairs(spark):
    import random

    from terrane.functions.spatial import st

    r = random.Random(4)
    sides = [[(i, r.uniform(-9, 9), r.uniform(-9, 9), r.choice([0.0, 1.0, 6.0]), r.choice([0.0, 2.0])) for i in range(60)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "id int, x double, y double, w double, h double").withColumn("g", st("st_makeenvelope", F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))) for s in sides)
    a, b = a.where("w > 0 and h > 0"), b.where("w > 0 and h > 0")
    flat = [[s for s in side if s[3] and s[4]] for side in sides]
    meets = lambda p, q, by: p[1] - by <= q[1] + q[3] and q[1] <= p[1] + p[3] + by and p[2] - by <= q[2] + q[4] and q[2] <= p[2] + p[4] + by
    got = sorted((x.left.id, x.right.id) for x in relational.spatial_join(a, b, "st_intersects", "g", "g", 2.5).collect())
    assert got == sorted((p[0], q[0]) for p in flat[0] for q in flat[1] if meets(p, q, 0))
    gap = lambda p, q: sum(max(0.0, p[i] - q[i] - q[i + 2], q[i] - p[i] - p[i + 2]) ** 2 for i in (1, 2)) ** 0.5
    got = sorted((x.left.id, x.right.id) for x in relational.spatial_join(a, b, "st_dwithin", "g", "g", 2.5, distance=1.5).collect())
    assert got == sorted((p[0], q[0]) for p in flat[0] for q in flat[1] if gap(p, q) <= 1.5)


def thinned(points, sides):
    """Level by level, the smallest id of each cell that holds no earlier winner."""
    level, won = {}, []
    for i, side in enumerate(sides):
        cell = lambda p: (p[1] // side, p[2] // side)  # noqa: B023, E731
        taken, new = {cell(p) for p in won}, {}
        for p in sorted(points):
            if p[0] not in level and cell(p) not in taken:
                new.setdefault(cell(p), p)
        for p in new.values():
            level[p[0]] = i
            won.append(p)
    return level


@pytest.mark.parametrize("gsds", [[8.0, 4.0, 2.0, 0.5], [7.0, 4.0, 3.0, 0.5]])
def test_levels_of_points_against_brute_force(spark, gsds):
    import random

    r = random.Random(2)
    points = [(i, float(r.randrange(64)), float(r.randrange(64))) for i in range(200)]
    df = spark.createDataFrame(points, "id int, x double, y double").select("id", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")).alias("bbox"))
    want = thinned(points, [4 * g for g in gsds[:-1]])
    assert {x.id: x.level for x in layout.cogp_levels(df, "bbox", gsds, "id", rank="id").collect()} == {p[0]: want.get(p[0], 3) for p in points}


def test_all_zoom_levels_are_planned_at_once(spark):
    df = spark.range(50).select("id", F.struct(*[(F.col("id") * 1000.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("bbox"))
    plan = layout.cogp_levels(df, "bbox", layout.web_mercator_gsds(), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2


def test_row_groups_hold_the_rows_asked_for(spark, tmp_path):
    from terrane.functions.spatial import st

    df = spark.range(25_000).select("id", st("st_point", F.col("id") % 250, F.floor(F.col("id") / 250)).alias("geometry"))
    layout.write_geoparquet(df, "geometry", str(tmp_path / "a"), row_group_rows=12_000, files=1)
    assert [g["rows"] for g in layout.footer(str(tmp_path / "a"))] == [12_000, 12_000, 1_000]
    layout.write_geoparquet(df, "geometry", str(tmp_path / "b"), row_group_rows=12_000, files=1, row_group_bytes=100_000)
    groups = layout.footer(str(tmp_path / "b"))
    assert sum(g["rows"] for g in groups) == 25_000 and max(g["rows"] for g in groups) < 2_000
