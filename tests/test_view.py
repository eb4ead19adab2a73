import base64

import pytest
from pyspark.sql import functions as F

from terrane.functions import wkb
from terrane.functions.spatial import register_all, st
from terrane.operators import view


def test_capped(spark):
    assert [(len(r), more) for r, more in (view.capped(spark.range(5), 3), view.capped(spark.range(3), 3))] == [(3, True), (3, False)]


def test_sql_texts_run(spark):
    register_all(spark)
    spark.createDataFrame([(1, "x"), (2, "y")], "`k` int, `my col` string").withColumn("geometry", st("st_point", F.col("k"), F.col("k"))).createOrReplaceTempView("left_t")
    spark.createDataFrame([(1, 9), (3, 8)], "id int, `v``w` int").createOrReplaceTempView("right_t")
    rows = spark.sql(view.join_text("left_t", "right_t", "k", "id", {"v`w": "out"})).orderBy("k").collect()
    assert [r.out for r in rows] == [9, None]
    assert tuple(spark.sql(view.match_count_text("left_t", "right_t", "k", "id")).first()) == (2, 1)
    assert [r.k for r in spark.sql(view.browse_text("left_t", "k > 0", (0, 0, 1.5, 1.5))).collect()] == [1]


def test_pick_takes_the_topmost(spark):
    df = spark.range(6).select("id", st("st_makeenvelope", F.lit(0.0), F.lit(0.0), F.col("id") + 1.0, F.col("id") + 1.0).alias("geometry"))
    assert [r.id for r in view.pick(df, "geometry", 0.5, 0.5, 0.0, "id").collect()] == [5]
    assert view.pick(df, "geometry", 9, 9, 1.0, "id").count() == 0


def test_thinning(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("g"), F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.col("id").cast("double").alias("xmax"), F.lit(0.0).alias("ymax")).alias("b"))
    assert sorted(r.id for r in view.thinned(df, ["g"], "b", "id").collect()) == [6, 7, 8, 9]
    assert [r.id for r in view.one_in(df, "id", 4).collect()] == [0, 4, 8]


def test_density_takes_the_upper_median(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (0.7,), (2.5,), (8.5,), (8.6,), (9.1,)], "x double")
    row = view.density_table(df, F.col("x"), F.lit(0.0), 8.0, range(3, 4), 2).first()
    assert (row.cells, row["median"], row.largest, row.files) == (4, 2, 3, 5)


def test_levels_block():
    doc = view.cogp_document([8.0, 4.0, 2.0], [2, 2, 5])
    assert view.cogp_problems(doc, 5) == [] and view.cogp_problems(doc, 6) == ["row groups are not covered"] and view.cogp_problems("x", 1) == ["unreadable"]
    assert view.level_for(doc, 3)["row_group_end"] == 2 and view.level_for(doc, 1)["row_group_end"] == 5 and view.level_for(doc, 99)["row_group_end"] == 2


def test_encodings(spark):
    df = spark.createDataFrame([([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]],), ([],), (None,)], "g array<array<struct<x:double,y:double>>>")
    got = [r[0] for r in df.select(st("st_area", st("st_geomfromtext", view.geoarrow_text("g", "Polygon")))).collect()]
    assert got == [2.0, 0.0, None]
    raw = wkb.encode(("Point", (1.0, 2.0)))
    text = base64.b64encode(raw).decode()
    rows = spark.createDataFrame([(text,), (text.rstrip("="),), ("not base64!",), (None,)], "t string").select(st("st_astext", view.base64_wkb("t"))).collect()
    assert [r[0] for r in rows] == ["POINT(1 2)", "POINT(1 2)", None, None]


def test_ground_area_of_a_degree():
    assert view.ground_area([[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]) == pytest.approx(1.2364e10, rel=1e-3)


def test_colours(spark):
    table = view.colour_table("# map\n111,230,0,77,255,Urban\n112,255,0,0\nbad,1,2\n")
    assert table == {"111": (230, 0, 77), "112": (255, 0, 0)}
    assert view.colours_cover(spark.createDataFrame([(111,), (112,), (None,)], "c int"), "c", table) and not view.colours_cover(spark.range(5), "id", table)
