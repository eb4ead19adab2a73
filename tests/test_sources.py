"""GeoParquet layers, attribute tables, folders of several datasets, number formats, national grids."""

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrane.functions import crs, wkb
from terrane.functions.spatial import st
from terrane.operators import layout, view
from terrane.sources import geoparquet, tabular, vector


def tagged(path, table, column=None, **geo):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    document = {"version": "1.1.0", "primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "geometry_types": []} | (column or {})}} | geo
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(document)}), path)
    return path


def points(n):
    return pa.array([wkb.encode(("Point", (float(i), float(i)))) for i in range(n)], pa.binary())


def test_a_written_layer_opens_with_its_covering(spark, tmp_path):
    df = spark.range(1000).select("id", F.lit("a").alias("bbox"), st("st_point", F.col("id") % 100, F.floor(F.col("id") / 100)).alias("geometry"))
    path = str(tmp_path / "out")
    layout.write_geoparquet(df, "geometry", path, row_group_rows=100, files=2)
    assert sorted(os.listdir(tmp_path)) == ["out"] and len(os.listdir(path)) == 2
    layer = geoparquet.open_layer(spark, path)
    assert layer.covering == ("bbox_2", "xmin", "ymin", "xmax", "ymax") and layer.version == "1.1.0" and layer.crs.is_latlong
    assert layer.extent() == (0, 0, 99, 9) and layer.column["geometry_types"] == ["Point"]
    found = layer.within((10, 2, 12, 3))
    assert sorted(r.id for r in found.collect()) == [210, 211, 212, 310, 311, 312]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = layer.within((10, 2, 12, 3)).select("id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(bbox_2.xmin,12.0)" in plan
    # Across the antimeridian: both ends of the row.
    assert layer.within((98, 0, 1, 0)).count() == 4
    with pytest.raises(FileExistsError):
        layout.write_geoparquet(df, "geometry", path)
    with pytest.raises(ValueError, match="no rows"):
        layout.write_geoparquet(df.limit(0), "geometry", str(tmp_path / "none"))
    assert os.listdir(tmp_path) == ["out"] and layout.scorecard(f"file:{path}")["rows"] == 1000
    assert geoparquet.layer_of(spark, spark.read.parquet(path).where("id < 0")).df.count() == 0


def test_stored_boxes_across_the_antimeridian(spark, tmp_path):
    box = pa.StructArray.from_arrays([pa.array([170.0, 0.0, None]), pa.array([0.0, 0, None]), pa.array([-170.0, 1.0, None]), pa.array([1.0, 1, None])], names=["xmin", "ymin", "xmax", "ymax"])
    table = pa.table({"id": [1, 2, 3], "geom": pa.array([None, None, None], pa.binary()), "b": box})
    named = {c: ["b", c] for c in geoparquet.CORNERS}
    layer = geoparquet.open_layer(spark, tagged(str(tmp_path / "a/x.parquet"), table, {"covering": {"bbox": named}}))
    assert [r.id for r in layer.within((175, 0, 179, 1)).collect()] == []
    assert [r.id for r in layer.within((175, 0, 179, 1), wraps=True).collect()] == [1]
    assert [r.id for r in layer.within((-5, 0, 5, 1), wraps=True).collect()] == [2]
    # A covering that is not what it says is ignored; boxes come from the geometry then, and there is none.
    for bad in ({c: ["geom", c] for c in geoparquet.CORNERS}, named | {"xmax": ["c", "xmax"]}, named | {"xmax": ["b"]}):
        layer = geoparquet.open_layer(spark, tagged(str(tmp_path / "b/x.parquet"), table, {"covering": {"bbox": bad}}))
        assert layer.covering is None and layer.extent() is None and layer.within((-180, -90, 180, 90)).count() == 0


def test_what_metadata_says(spark, tmp_path):
    table = pa.table({"id": range(3), "geom": points(3)})
    path = str(tmp_path / "t.parquet")
    named = {"crs": {"type": "ProjectedCRS", "name": "x", "id": {"authority": "EPSG", "code": 2154}}, "edges": "spherical"}
    layer = geoparquet.open_layer(spark, tagged(path, table, named))
    assert layer.crs.epsg == 2154 and layer.spherical and layer.within((1, 1, 2, 2)).count() == 2
    assert geoparquet.open_layer(spark, tagged(path, table, {"crs": None})).crs.name == "undefined"
    for column, more in (({"encoding": "TWKB"}, {}), ({}, {"primary_column": "shape"})):
        with pytest.raises(ValueError):
            geoparquet.open_layer(spark, tagged(path, table, column, **more))
    with pytest.raises(ValueError, match="layer"):
        geoparquet.attribute_table(spark, path)
    plain = str(tmp_path / "plain.parquet")
    pq.write_table(pa.table({"a": [1], "b": ["x"]}), plain)
    assert geoparquet.attribute_table(spark, plain, ["b"]).columns == ["b"]


def test_geoarrow_columns_become_wkb(spark, tmp_path):
    xy = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    at = [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 2.0}, {"x": 3.0, "y": 5.0}, {"x": 1.0, "y": 2.0}]
    for encoding, kind, value in (("point", xy, at[0]), ("linestring", pa.list_(xy), at), ("polygon", pa.list_(pa.list_(xy)), [at]), ("multipolygon", pa.list_(pa.list_(pa.list_(xy))), [[at]])):
        path = tagged(str(tmp_path / f"{encoding}.parquet"), pa.table({"geom": pa.array([value, None], kind)}), {"encoding": encoding})
        rows = geoparquet.open_layer(spark, path).df.select(st("st_geometrytype", F.col("geom")).alias("t"), F.col("geom").isNull().alias("none")).collect()
        assert [r.none for r in rows] == [False, True] and encoding in rows[0].t.lower()


def test_untagged_files(spark, tmp_path):
    def kind(**columns):
        path = str(tmp_path / f"{'-'.join(columns)}.parquet")
        pq.write_table(pa.table(columns), path)
        layer = geoparquet.open_layer(spark, path)
        return layer.geometry, layer.df.select(F.count(layer.geometry)).first()[0]

    import base64

    text = [base64.b64encode(g).decode().rstrip("=") for g in points(2).to_pylist()]
    assert kind(thumbnail=pa.array([b"\x89PNG", b"x"]), outline=points(2)) == ("outline", 2)
    assert kind(blob=pa.array([b"x", b"y"]), geom=text) == ("geom", 2)
    assert kind(lon=[1.0, float("nan")], lat=[2.0, 3.0], name=["a", "b"]) == ("geometry", 1)
    with pytest.raises(ValueError, match="no geo metadata"):
        kind(hash=pa.array([b"x"]), name=["a"])


def test_folders_and_collections(spark, tmp_path):
    assert geoparquet.datasets(["part-0001.parquet", "x.parquet"]) == {"": ["part-0001.parquet", "x.parquet"]}
    assert [geoparquet.is_part(s) for s in ("part-00001-abc", "data_0", "chunk3", "00003", "PART7", "parts", "data", "roads2")] == [True, True, True, True, True, False, False, False]
    assert geoparquet.datasets(["k=1/a.parquet", "k=2/a.parquet"]) == {"": ["k=1/a.parquet", "k=2/a.parquet"]}
    assert geoparquet.datasets(["k=1/a.parquet", "k=2/b.parquet"]) == {"": ["k=1/a.parquet", "k=2/b.parquet"]}
    two = {"roads": ["k=1/roads.parquet", "k=2/roads.parquet"], "water": ["k=1/water.parquet"]}
    assert geoparquet.datasets(["k=1/roads.parquet", "k=1/water.parquet", "k=2/roads.parquet"]) == two
    for i, names in two.items():
        for f in names:
            tagged(str(tmp_path / "f" / f), pa.table({"geom": points(len(i))}))
    layers = geoparquet.layers_in(spark, str(tmp_path / "f"))
    assert {n: (x.df.count(), sorted(x.df.columns)) for n, x in layers.items()} == {"roads": (10, ["geom", "k"]), "water": (5, ["geom", "k"])}
    path = str(tmp_path / "f/k=1/roads.parquet")
    assert geoparquet.open_layer(spark, path, str(tmp_path / "gone.parquet")).df.count() == 5
    with pytest.raises(FileNotFoundError):
        geoparquet.open_layer(spark, str(tmp_path / "g1"), str(tmp_path / "g2"))
    with pytest.raises(ValueError):
        geoparquet.open_layer(spark, *["x"] * 65)
    parts = [{"href": "./a.parquet", "bbox": [0, 0, 4, 4], "rows": 5}, {"href": "b.parquet", "bbox": [50, 50, 60, 60], "rows": 3}]
    tagged(str(tmp_path / "c/a.parquet"), pa.table({"geom": points(5)}))
    tagged(str(tmp_path / "c/b.parquet"), pa.table({"geom": points(3)}))
    listed = str(tmp_path / "c/collection.json")
    with open(listed, "w") as f:
        json.dump(vector.stac_collection("c", parts), f, indent=1)
    assert [geoparquet.open_collection(spark, listed, r).df.count() for r in (None, (1, 1, 2, 2), (55, 0, 56, 55))] == [8, 5, 3]
    with pytest.raises(ValueError):
        geoparquet.open_collection(spark, listed, (70, 70, 80, 80))


@pytest.mark.parametrize("values, commas", [(["3,5", "4,25"], False), (["3,739", "12"], False), (["1 234,56", "7 000,1"], True), (["1'234.56"], False), (["1.234,5", "1 000"], True), ([None, ""], False), (["1 234,5" + "0" * 40], False)])
def test_decimal_commas(spark, values, commas):
    assert tabular.has_decimal_commas(spark.createDataFrame([(v,) for v in values], "`a b` string"), ["a b"]) is commas


def test_a_table_with_decimal_commas(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n;v\n1;1 234,5\n2;2 000,25\n", encoding="utf-8")
    assert [tuple(r) for r in tabular.read_delimited(spark, str(tmp_path / "t.csv")).collect()] == [(1, 1234.5), (2, 2000.25)]


def test_rows_and_values_by_area(spark):
    df = spark.createDataFrame([("x\ty", 8.0), (None, 3.0)], "n string, v double").withColumn("g", F.when(F.col("n").isNotNull(), st("st_makeenvelope", F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))))
    assert [r.per_area for r in view.per_area(df, "v", "g", latlong=False).collect()] == [2.0, None]
    ground = view.per_area(df, "v", "g", latlong=True).first().per_area
    assert 8 / ground == pytest.approx((2 * 111_195) ** 2, rel=1e-3)
    assert [r.line for r in view.tsv(df.drop("g")).collect()] == ["x y\t8.0", "\t3.0"]


def test_oblique_projections_and_national_grids():
    # The published example of the Dutch grid, and a Swiss survey point; degrees of the grids' own datums.
    for code, lon, lat, x, y, near in ((28992, 6, 53, 196105.283, 557057.739, 0.01), (2056, 8 + 29 / 60 + 11.111272 / 3600, 47 + 3 / 60 + 28.956592 / 3600, 2679520.05, 1212273.44, 0.05)):
        proj = crs.lookup(code).proj4
        assert np.allclose(crs.project(np.array([lon]), np.array([lat]), proj), [[x], [y]], atol=near)
    for _, code, (w, s, e, n) in crs.NATIONAL:
        if code != 5514:
            proj, lon, lat = crs.lookup(code).proj4, np.array([(w + e) / 2, w]), np.array([(s + n) / 2, s])
            assert np.allclose(crs.unproject(*crs.project(lon, lat, proj), proj), [lon, lat], atol=1e-6), code
    assert crs.national_grid(5.8, 49.5, 6.5, 50.1) == ("Luxembourg", 2169) and crs.national_grid(-60, -20, -50, -10) is None
    assert crs.best_fit(-4, 42, 8, 51) == crs.lookup(2154).proj4 and "laea" in crs.best_fit(14, 49, 16.5, 50.5)
    with pytest.raises(crs.UnknownCrs):
        crs.project(1.0, 1.0, "+proj=tmerc +ellps=none")


def test_view_box():
    x0, y0, x1, y1 = crs.view_box((0, 0, 111_319.49, 111_325.14), crs.lookup(3857), crs.lookup(4326))
    assert (x0, y0, x1, y1) == pytest.approx((-0.05, -0.05, 1.05, 1.05), abs=1e-4)
    assert crs.view_box((float("nan"),) * 4, crs.lookup(3857), crs.lookup(4326)) is None


def test_levels_by_kind_and_degrees(spark):
    def level(box, kind, **more):
        df = spark.createDataFrame([(1, box and tuple(map(float, box)), kind)], "id long, b struct<xmin: double, ymin: double, xmax: double, ymax: double>, k string")
        return layout.cogp_levels(df, "b", [100.0, 10.0, 1.0], "id", kind="k", **more).first().level

    # 250 long: 2 pixels of 100 are enough for a line, a polygon needs 4.
    assert [level((0, 0, 250, 0), k) for k in ("line", "polygon", "point")] == [0, 1, 0]
    assert level((5, 5, 5, 5), "polygon") == 0 and level(None, "point") == 2 and level((0, 0, 3, 0), "polygon") == 2
    # A thousandth of a degree is 111 m wide at the equator, 56 m at 60 degrees.
    assert [level((0, y, 0.001, y), "polygon", latlong=True, polygon=1.0) for y in (0.0, 60.0)] == [0, 1]


def test_points_in_degrees_are_thinned_on_one_plane(spark):
    def won(gsds):
        df = spark.range(400).select("id", (F.col("id") % 20 / 1000).alias("x"), (60 + F.floor(F.col("id") / 20) / 1000).alias("y")).withColumn("b", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")))
        return {r.id: r.level for r in layout.cogp_levels(df, "b", gsds, "id", rank="id", latlong=True).collect()}

    def brute(gsds):
        level, at = {}, {i: ((i % 20) / 1000, 60 + (i // 20) / 1000) for i in range(400)}
        flat = {i: (x * 111_320 * np.cos(np.radians(y)), y * 110_540) for i, (x, y) in at.items()}
        for n, g in enumerate(gsds[:-1]):
            cell = lambda i: (flat[i][0] // (4 * g), flat[i][1] // (4 * g))  # noqa: B023, E731
            taken = {cell(i) for i in level}
            for i in range(400):
                if i not in level and cell(i) not in taken:
                    taken.add(cell(i))
                    level[i] = n
        return {i: level.get(i, len(gsds) - 1) for i in range(400)}

    for gsds in ([200.0, 100.0, 50.0, 1.0], [200.0, 70.0, 1.0]):
        assert won(gsds) == brute(gsds)


def test_levels_in_a_file(spark, tmp_path, capsys):
    from terrane import cli

    rows = [("POINT (1 1)", 1), ("POINT (1.000001 1)", 2), ("LINESTRING (0 0, 50 0)", 3), ("POLYGON ((0 0, 0.001 0, 0 0.001, 0 0))", 4), (None, 5)]
    df = spark.createDataFrame(rows, "w string, id int").select("id", st("st_geomfromtext", F.col("w")).alias("geometry"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    layout.write_geoparquet(df, "geometry", source, crs={"type": "GeographicCRS", "name": "x", "id": {"authority": "EPSG", "code": 4326}}, compression="snappy")
    assert cli.main(["--input", source, "--output", out, "--cogp", "--files", "1"]) == 0 and "5 rows | 3 row groups" in capsys.readouterr().out
    (name,) = os.listdir(out)
    meta = pq.read_metadata(f"{out}/{name}")
    levels = json.loads(meta.metadata[b"cogp"])["levels"]
    assert [v["row_group_end"] for v in levels] == [1, 2, 3] and view.cogp_problems(meta.metadata[b"cogp"].decode(), 3) == []
    first = pq.ParquetFile(f"{out}/{name}").read_row_group(0).column("id").to_pylist()
    assert 3 in first and len(first) == 2 and "level" not in meta.schema.to_arrow_schema().names
    layer = geoparquet.open_layer(spark, out)
    assert layer.column["bbox"] == [0, 0, 50, 1] and layer.column["geometry_types"] == ["LineString", "Point", "Polygon"]
    assert layer.crs.epsg == 4326 and layer.covering and sorted(r.id for r in layer.df.collect()) == [1, 2, 3, 4, 5] and layout.scorecard(out)["C8"] == "pass"
    assert layout.footer(source)[0]["codec"] == "SNAPPY"
    with pytest.raises(ValueError, match="levels need"):
        layout.write_geoparquet(df, "geometry", str(tmp_path / "x"), sort=False, gsds=[1.0])
    layout.write_geoparquet(df, "geometry", str(tmp_path / "bare"), covering=False)
    assert spark.read.parquet(str(tmp_path / "bare")).columns == ["id", "geometry"] and layout.scorecard(str(tmp_path / "bare"))["C1"] == "fail"


def test_crs_of_imports(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "p.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("create table gpkg_contents(table_name, data_type); create table gpkg_geometry_columns(table_name, column_name, srs_id); create table gpkg_spatial_ref_sys(srs_id, organization, organization_coordsys_id);"
                         "insert into gpkg_contents values ('a', 'features'); insert into gpkg_geometry_columns values ('a', 'g', 7), ('b', 'g', 0), ('c', 'g', 9); insert into gpkg_spatial_ref_sys values (7, 'epsg', 2154), (0, 'NONE', 0), (9, 'ESRI', 1)")
    assert vector.geopackage_crs(path, "A").epsg == 2154 and vector.geopackage_crs(path, "b") is None and vector.geopackage_crs(path, "d") is None
    with pytest.raises(crs.UnknownCrs):
        vector.geopackage_crs(path, "c")
    assert vector.shapefile_crs(str(tmp_path / "x.shp")) is None
    france = 'PROJCS["L93",GEOGCS["RGF",DATUM["D",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",700000.0],PARAMETER["False_Northing",6600000.0],PARAMETER["Central_Meridian",3.0],PARAMETER["Standard_Parallel_1",44.0],PARAMETER["Standard_Parallel_2",49.0],PARAMETER["Latitude_Of_Origin",46.5],UNIT["Meter",1.0]]'
    (tmp_path / "X.PRJ").write_text(france)
    found = vector.shapefile_crs(str(tmp_path / "x.shp"))
    at = np.array([2.35]), np.array([48.86])
    assert np.allclose(crs.project(*at, found.proj4), crs.project(*at, crs.lookup(2154).proj4), atol=1e-6) and not found.is_latlong
    assert crs.from_wkt(france[:-1] + ',AUTHORITY["EPSG","2154"]]').epsg == 2154
    assert crs.from_wkt('GEOGCS["w",DATUM["D",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]').is_latlong
    for bad in (france.replace("Lambert_Conformal_Conic", "Krovak"), france.replace('"Meter",1.0', '"Foot_US",0.3048006'), france.replace("GRS_1980", "Moon"), ""):
        with pytest.raises(crs.UnknownCrs):
            crs.from_wkt(bad)
    x, y = crs.project(*at, found.proj4)
    df = spark.createDataFrame([(bytearray(wkb.encode(("Point", (float(x[0]), float(y[0]))))),), (None,)], "geometry binary")
    rows = vector.to_lonlat(df, "geometry", found).collect()
    assert wkb.decode(rows[0][0])[1] == pytest.approx((2.35, 48.86), abs=1e-7) and rows[1][0] is None
    assert vector.to_lonlat(df, "geometry", None) is df
