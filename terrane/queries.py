"""The queries of the library, each with its SQL for DuckDB where there is one.

The driver's tables hold no geometry, so queries make points, boxes and lines of
their keys. The SQL sides use closed forms, never spatial functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.spatial import AGGREGATES, FUNCTIONS, extent_by, geom_from_text, register_all, st, union_by
from terrane.operators import classify, grid, layout, relational
from terrane.plans.storage import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(*pairs):
    """Name and value rows of single-row results."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(v.cast("double"), 6).alias("value")) for n, v in pairs]))


# -- shared inputs ------------------------------------------------------------

def boxes(spark, d) -> DataFrame:
    l = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")  # noqa: E741
    x0, y0 = F.col("l_linenumber") * 10.0, F.round(F.col("l_discount") * 100)
    return l.select("*", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + F.round(F.col("l_tax") * 100) + 1).alias("y1")).withColumn("geometry", st("st_makeenvelope", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


BOXES = """(SELECT *, l_linenumber*10.0::DOUBLE AS x0, round(l_discount*100) AS y0, l_linenumber*10.0::DOUBLE + l_quantity AS x1, round(l_discount*100) + round(l_tax*100) + 1 AS y1 FROM lineitem)"""


def points(spark, d) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", (F.col("c_custkey") % 200).cast("double").alias("x"), (F.col("c_acctbal") / 50).alias("y"))


POINTS = "(SELECT *, (c_custkey % 200)::DOUBLE AS x, c_acctbal / 50 AS y FROM customer)"


# -- flagship and predicates ----------------------------------------------------

@query(f"""SELECT c_name, 4.0::DOUBLE AS m2 FROM {POINTS} WHERE x - 1 <= 120 AND x + 1 >= 20 AND y - 1 <= 100 AND y + 1 >= 10 ORDER BY m2 DESC, c_name LIMIT 100""")
def flagship(spark, d):
    register_all(spark)
    points(spark, d).createOrReplaceTempView("customer_points")
    return spark.sql("""
        SELECT c_name, m2 FROM (
          SELECT c_name, st_area(geometry) AS m2, geometry FROM (SELECT c_name, st_makeenvelope(x - 1, y - 1, x + 1, y + 1) AS geometry FROM customer_points))
        WHERE st_intersects(geometry, st_makeenvelope(20, 10, 120, 100)) ORDER BY round(m2, 6) DESC, c_name LIMIT 100""").select("c_name", F.round("m2", 6).alias("m2"))


@query(f"SELECT l_orderkey, l_linenumber, round((x1-x0)*(y1-y0), 4) AS area, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM {BOXES}")
def st_envelope_area(spark, d):
    return boxes(spark, d).select("l_orderkey", "l_linenumber", F.round(st("st_area", "geometry"), 4).alias("area"), *[st(f"st_{e}", "geometry").alias(e) for e in ("xmin", "ymin", "xmax", "ymax")])


@query(f"SELECT c_custkey, x AS px, y AS py, 'Point' AS kind, 1::BIGINT AS n, 'POINT(' || (c_custkey % 200)::VARCHAR || ' ' || (c_nationkey)::VARCHAR || ')' AS wkt FROM {POINTS}")
def st_point_parts(spark, d):
    g = st("st_point", F.col("x"), F.col("y"))
    return points(spark, d).withColumn("g", g).select("c_custkey", st("st_x", "g").alias("px"), st("st_y", "g").alias("py"), st("st_geometrytype", "g").alias("kind"), st("st_npoints", "g").alias("n"),
                                                      st("st_astext", st("st_point", F.col("x"), F.col("c_nationkey").cast("double"))).alias("wkt"))


@query("SELECT o_orderkey, round(sqrt(100 + (o_totalprice/1000)*(o_totalprice/1000)), 6) AS len, 2::BIGINT AS n FROM orders")
def st_length_segment(spark, d):
    o = t(spark, d, "orders")
    wkt = F.concat(F.lit("LINESTRING("), F.col("o_custkey") % 100, F.lit(" 0, "), F.col("o_custkey") % 100 + 10, F.lit(" "), (F.col("o_totalprice") / 1000).cast("string"), F.lit(")"))
    return o.select("o_orderkey", st("st_geomfromtext", wkt).alias("g")).select("o_orderkey", F.round(st("st_length", "g"), 6).alias("len"), st("st_npoints", "g").alias("n"))


@query(f"SELECT c_custkey, round(sqrt((x-50)*(x-50) + (y-50)*(y-50)), 6) AS dist, sqrt((x-50)*(x-50) + (y-50)*(y-50)) <= 60 AS near FROM {POINTS}")
def st_distance_points(spark, d):
    g, c = st("st_point", F.col("x"), F.col("y")), geom_from_text("POINT(50 50)")
    return points(spark, d).withColumn("g", g).select("c_custkey", F.round(st("st_distance", "g", c), 6).alias("dist"), st("st_dwithin", "g", c, 60).alias("near"))


@query(f"SELECT l_orderkey, l_linenumber, (x0 <= 40 AND x1 >= 15 AND y0 <= 8 AND y1 >= 3) AS meets, (x0 >= 15 AND x1 <= 40 AND y0 >= 3 AND y1 <= 8) AS inside, (x0 <= 22 AND x1 >= 25 AND y0 <= 4 AND y1 >= 5) AS covers FROM {BOXES}")
def st_box_predicates(spark, d):
    a, b = geom_from_text("POLYGON((15 3,40 3,40 8,15 8,15 3))"), geom_from_text("POLYGON((22 4,25 4,25 5,22 5,22 4))")
    return boxes(spark, d).select("l_orderkey", "l_linenumber", st("st_intersects", "geometry", a).alias("meets"), st("st_within", "geometry", a).alias("inside"), st("st_contains", "geometry", b).alias("covers"))


@query(f"SELECT l_orderkey, l_linenumber, round((x0+x1)/2, 6) AS cx, round((y0+y1)/2, 6) AS cy, 5::BIGINT AS n, round((x1-x0)*(y1-y0), 4) AS hull FROM {BOXES}")
def st_centroid_hull(spark, d):
    b = boxes(spark, d).withColumn("c", st("st_centroid", "geometry"))
    return b.select("l_orderkey", "l_linenumber", F.round(st("st_x", "c"), 6).alias("cx"), F.round(st("st_y", "c"), 6).alias("cy"), st("st_npoints", "geometry").alias("n"), F.round(st("st_area", st("st_convexhull", "geometry")), 4).alias("hull"))


_I = "greatest(0, least(x1, 45) - greatest(x0, 15)) * greatest(0, least(y1, 8) - greatest(y0, 2))"


@query(f"SELECT l_orderkey, l_linenumber, round((x1-x0)*(y1-y0) + 180 - i, 4) AS u, round(i, 4) AS i, round((x1-x0)*(y1-y0) - i, 4) AS d, round((x1-x0)*(y1-y0) + 180 - 2*i, 4) AS x FROM (SELECT *, {_I} AS i FROM {BOXES})")
def st_set_operations(spark, d):
    w = geom_from_text("POLYGON((15 2,45 2,45 8,15 8,15 2))")
    return boxes(spark, d).select("l_orderkey", "l_linenumber", *[F.round(st("st_area", st(f"st_{n}", "geometry", w)), 4).alias(a) for n, a in (("union", "u"), ("intersection", "i"), ("difference", "d"), ("symdifference", "x"))])


@query("SELECT c_custkey, 3.0::DOUBLE AS disc, 3::BIGINT AS kept FROM customer")
def st_buffer_simplify(spark, d):
    p = points(spark, d)
    line = F.concat(F.lit("LINESTRING("), F.col("x"), F.lit(" 0,"), F.col("x") + 1, F.lit(" 0.01,"), F.col("x") + 2, F.lit(" 5,"), F.col("x") + 3, F.lit(" 10)"))
    kept = st("st_npoints", st("st_simplify", st("st_geomfromtext", line), 0.5))
    return p.select("c_custkey", F.round(st("st_area", st("st_buffer", st("st_point", F.col("x"), F.col("y")), 1))).alias("disc"), kept.alias("kept"))


@query(f"SELECT c_custkey, round(lon * 20037508.342789244 / 180, 3) AS mx, round(ln(tan(pi()/4 + radians(lat)/2)) * 6378137, 3) AS my FROM (SELECT c_custkey, x - 100 AS lon, y * 0.3 AS lat FROM {POINTS})")
def st_transform_webmercator(spark, d):
    g = st("st_transform", st("st_point", F.col("x") - 100, F.col("y") * 0.3), "EPSG:4326", "EPSG:3857")
    return points(spark, d).withColumn("g", g).select("c_custkey", F.round(st("st_x", "g"), 3).alias("mx"), F.round(st("st_y", "g"), 3).alias("my"))


# -- spatial aggregates -----------------------------------------------------------

@query(f"SELECT l_returnflag, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM {BOXES} GROUP BY 1")
def st_extent_by_group(spark, d):
    return extent_by(boxes(spark, d), ["l_returnflag"], "geometry")


@query("SELECT c_nationkey, round(sum(1.0::DOUBLE), 6) AS collected, count(DISTINCT c_custkey % 40)::DOUBLE AS dissolved FROM customer GROUP BY 1")
def st_collect_and_union(spark, d):
    p = points(spark, d).withColumn("cx", F.col("c_custkey") % 40.0).withColumn("geometry", st("st_makeenvelope", F.col("cx") * 2, F.lit(0.0), F.col("cx") * 2 + 1, F.lit(1.0)))
    union = union_by(p.select("c_nationkey", "geometry"), ["c_nationkey"], "geometry", salts=4).select("c_nationkey", F.round(st("st_area", "geometry"), 6).alias("dissolved"))
    collect = p.groupBy("c_nationkey").agg(AGGREGATES["st_collect"](F.col("geometry")).alias("g")).select("c_nationkey", F.round(st("st_area", "g"), 6).alias("collected"))
    return collect.join(union, "c_nationkey")


# -- joins and relational core ------------------------------------------------------

@query("SELECT c.*, n_name AS nation FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def join_left_attr(spark, d):
    return relational.join_attributes(t(spark, d, "customer"), t(spark, d, "nation").where("n_regionkey < 3"), "c_nationkey", "n_nationkey", {"n_name": "nation"})


@query("SELECT c.*, n_name AS nation FROM customer c JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def join_inner_attr(spark, d):
    return relational.join_attributes(t(spark, d, "customer"), t(spark, d, "nation").where("n_regionkey < 3"), "c_nationkey", "n_nationkey", {"n_name": "nation"}, "inner")


@query("SELECT count(*) AS total, count(n_nationkey) AS matched FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def join_match_count(spark, d):
    return relational.match_counts(t(spark, d, "customer"), t(spark, d, "nation").where("n_regionkey < 3"), "c_nationkey", "n_nationkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 200000")
    c = t(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT n_name, s_name FROM nation FULL JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) ON n_nationkey = s_nationkey")
def join_full(spark, d):
    n, s = t(spark, d, "nation"), t(spark, d, "supplier").where("s_nationkey < 20")
    return n.join(s, n.n_nationkey == s.s_nationkey, "full").select("n_name", "s_name")


_JOINED_BOXES = "SELECT c.c_custkey, z.zone FROM {p} c JOIN (SELECT i::BIGINT AS zone, i*20.0::DOUBLE AS a, i*20.0::DOUBLE + 12 AS b FROM range(10) r(i)) z ON x >= a AND x <= b AND y >= 0 AND y <= 150"


def zones(spark) -> DataFrame:
    z = spark.range(10).select(F.col("id").alias("zone"), (F.col("id") * 20.0).alias("a"))
    return z.withColumn("geometry", st("st_makeenvelope", F.col("a"), F.lit(0.0), F.col("a") + 12, F.lit(150.0)))


@query(f"SELECT c.c_custkey, z.zone FROM {POINTS} c LEFT JOIN (SELECT i::BIGINT AS zone, i*20.0::DOUBLE AS a, i*20.0::DOUBLE + 12 AS b FROM range(10) r(i)) z ON x > a AND x < b AND y > 0 AND y < 150")
def admin_join_boxes(spark, d):
    p = points(spark, d)
    return relational.first_containing(p.select("c_custkey", "x", "y"), zones(spark), "x", "y", "zone", "geometry", "zone", 20.0).select("c_custkey", "zone")


@query(f"SELECT z.zone, count(*) AS n, sum(l_quantity) AS quantity FROM {BOXES} l JOIN (SELECT i::BIGINT AS zone, i*20.0::DOUBLE AS a, i*20.0::DOUBLE + 12 AS b FROM range(10) r(i)) z ON x1 >= a AND x0 <= b AND y1 >= 0 AND y0 <= 150 GROUP BY 1")
def spatial_join_boxes(spark, d):
    met = relational.spatial_join(boxes(spark, d), zones(spark), "st_intersects", "geometry", "geometry", 20.0)
    return met.groupBy("right.zone").agg(F.count(F.lit(1)).alias("n"), F.sum("left.l_quantity").alias("quantity"))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey, l_quantity * l_extendedprice * (1 - l_discount) AS amount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A','R') AND l_discount < 0.05")
def filter_project(spark, d):
    l = t(spark, d, "lineitem").where("l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A','R') AND l_discount < 0.05")  # noqa: E741
    return l.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey", (F.col("l_quantity") * F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))


@query("SELECT count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus, count(DISTINCT l_suppkey) AS l_suppkey FROM lineitem")
def distinct_counts(spark, d):
    return relational.distinct_counts(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


@query("SELECT p_brand AS v, count(*) AS c FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY c DESC, v LIMIT 10")
def top_values(spark, d):
    return relational.top_values(t(spark, d, "part"), "p_brand", 10)


_AGG = "count(*) AS n, round(sum(l_quantity), 2) AS q"


@query(f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    t(spark, d, "lineitem").createOrReplaceTempView("lineitem_gs")
    return spark.sql(f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem_gs GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


@query("SELECT l_returnflag, count(*) AS n, round(stddev_pop(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var, quantile_cont(l_quantity, 0.5) AS med FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def having_statistics(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.round(F.var_samp("l_quantity"), 6).alias("var"), F.percentile("l_quantity", 0.5).alias("med"))
    return g.where("n > 10")


@query("""SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,
          ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def window_rank(spark, d):
    w, u = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice")), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.row_number().over(u).cast("bigint").alias("rn"), F.ntile(4).over(u).alias("q"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("run"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.first("o_orderkey").over(w).alias("first"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(t(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_name AS name, c_nationkey::DOUBLE AS key, c_acctbal AS bal, c_mktsegment AS seg, 'customers' AS source_layer FROM customer UNION ALL SELECT s_name, s_nationkey + 0.5, s_acctbal, NULL, 'suppliers' FROM supplier")
def layer_merge_widen(spark, d):
    c = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = t(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_nationkey") + F.lit(0.5).cast("double")).alias("key"), F.col("s_acctbal").alias("bal"))
    return relational.merge_layers([c, s], ["customers", "suppliers"])


@query("SELECT min(r) AS first, max(r) AS last FROM (SELECT c_custkey AS r, c_custkey - row_number() OVER (ORDER BY c_custkey) AS g FROM customer WHERE c_acctbal > 0) GROUP BY g")
def row_filter_ranges(spark, d):
    return relational.row_ranges(t(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").select("first", "last")


@query(f"SELECT l_orderkey, l_linenumber FROM {BOXES} WHERE x0 <= 35 AND x1 >= 21 AND y0 <= 6 AND y1 >= 5")
def viewport_select(spark, d):
    b = boxes(spark, d).withColumn("bbox", F.struct(F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax")))
    view = ("Polygon", [[(21, 5), (35, 5), (35, 6), (21, 6), (21, 5)]])
    return relational.where_spatial(b, "st_intersects", "geometry", view, box="bbox").select("l_orderkey", "l_linenumber")


# -- grid -------------------------------------------------------------------------

_CELL = f"(SELECT floor(x/10)::BIGINT AS ix, floor(y/10)::BIGINT AS iy, c_acctbal AS v, c_mktsegment AS seg, c_custkey AS id FROM {POINTS})"


def _weights(spark, d, value="c_acctbal"):
    return grid.point_weights(points(spark, d), "x", "y", value, 10.0, 10.0, row="c_custkey")


def _rounded(cells):
    return cells.select("ix", "iy", F.round("value", 7).alias("value"), F.round("count", 6).alias("count"))


def _grid(name: str, sql: str):
    def run(spark, d):
        return _rounded(grid.summarise(_weights(spark, d), name, 10.0, 10.0))

    run.__name__ = f"grid_{name}"
    query(f"SELECT ix, iy, round({sql}, 7) AS value, count(*)::DOUBLE AS count FROM {_CELL} GROUP BY 1, 2")(run)


for _name, _sql in (("mean", "avg(v)"), ("sum", "sum(v)"), ("count", "count(*)::DOUBLE"), ("density", "sum(v) / 100"), ("median", "quantile_disc(v, 0.5)")):
    _grid(_name, _sql)


def _category(name: str, order: str):
    def run(spark, d):
        return grid.summarise(_weights(spark, d, "c_mktsegment"), name, 10.0, 10.0)

    run.__name__ = f"grid_{name}"
    query(f"""SELECT ix, iy, seg AS value, n::DOUBLE AS count FROM (SELECT ix, iy, seg, sum(c) OVER (PARTITION BY ix, iy) AS n, row_number() OVER (PARTITION BY ix, iy ORDER BY c {order}, seen) AS rn
              FROM (SELECT ix, iy, seg, count(*) AS c, min(id) AS seen FROM {_CELL} GROUP BY 1, 2, 3)) WHERE rn = 1""")(run)


_category("majority", "DESC")
_category("minority", "ASC")

_SHARES = f"""(SELECT ix, iy, v, (least(x1, (ix+1)*7) - greatest(x0, ix*7)) * (least(y1, (iy+1)*3) - greatest(y0, iy*3)) / ((x1-x0)*(y1-y0)) AS w
  FROM (SELECT x0, y0, x1, y1, l_extendedprice AS v, unnest(generate_series(floor(x0/7)::BIGINT, floor(x1/7)::BIGINT)) AS ix FROM {BOXES}) a, LATERAL (SELECT unnest(generate_series(floor(y0/3)::BIGINT, floor(y1/3)::BIGINT)) AS iy) b
  WHERE least(x1, (ix+1)*7) > greatest(x0, ix*7) AND least(y1, (iy+1)*3) > greatest(y0, iy*3))"""


@query(f"SELECT ix, iy, round(sum(w*v), 2) AS value, round(sum(w), 6) AS count FROM {_SHARES} GROUP BY 1, 2")
def grid_apportion_boxes(spark, d):
    w = grid.box_weights(boxes(spark, d), ("x0", "y0", "x1", "y1"), "l_extendedprice", 7.0, 3.0, "l_orderkey")
    return grid.summarise(w, "sum", 7.0, 3.0).select("ix", "iy", F.round("value", 2).alias("value"), F.round("count", 6).alias("count"))


@query(f"SELECT ix, iy, round(sum(w*v), 2) AS value, round(sum(w), 6) AS count FROM {_SHARES} GROUP BY 1, 2")
def grid_apportion_polygons(spark, d):
    w = grid.polygon_weights(boxes(spark, d), "geometry", "l_extendedprice", 7.0, 3.0, "l_orderkey")
    return grid.summarise(w, "sum", 7.0, 3.0).select("ix", "iy", F.round("value", 2).alias("value"), F.round("count", 6).alias("count"))


# Sums of whole numbers are the same in any order.
_SURFACE = f"(SELECT ix, iy, sum(floor(v)) AS value, count(*)::DOUBLE AS count FROM {_CELL} GROUP BY 1, 2)"


def _near(value: str, base: str = _SURFACE) -> str:
    return f"SELECT a.ix, a.iy, {value} AS value, max(a.count) AS count FROM {base} a JOIN {base} b ON b.ix BETWEEN a.ix-1 AND a.ix+1 AND b.iy BETWEEN a.iy-1 AND a.iy+1 GROUP BY 1, 2"


def _final(sql: str) -> str:
    return f"SELECT ix, iy, round(value, 7) AS value, round(count, 6) AS count FROM ({sql})"


def _cells(spark, d):
    whole = _weights(spark, d).withColumn("v", F.floor("v").cast("double"))
    return grid.summarise(whole, "sum", 10.0, 10.0)


@query(_final(_near("avg(b.value)")))
def grid_smooth_box(spark, d):
    return _rounded(grid.smooth(_cells(spark, d)))


_K = "(4.0 / pow(2, abs(b.ix-a.ix) + abs(b.iy-a.iy)))"


@query(_final(_near(f"sum(b.value*{_K}) / sum({_K})")))
def grid_smooth_gauss(spark, d):
    return _rounded(grid.smooth(_cells(spark, d), gauss=True))


@query(_final(_near("stddev_pop(b.value)")))
def grid_focal_std(spark, d):
    return _rounded(grid.focal_std(_cells(spark, d)))


@query(_final(_near("max(b.value)", f"({_near('min(b.value)')})")))
def grid_open(spark, d):
    return _rounded(grid.opened(_cells(spark, d)))


@query(_final(_near("min(b.value)", f"({_near('max(b.value)')})")))
def grid_close(spark, d):
    return _rounded(grid.closed(_cells(spark, d)))


_D = {n: f"max(CASE WHEN b.ix = a.ix + {dx} AND b.iy = a.iy + {dy} THEN b.value END)" for n, (dx, dy) in {
    "nw": (-1, 1), "n": (0, 1), "ne": (1, 1), "w": (-1, 0), "e": (1, 0), "sw": (-1, -1), "s": (0, -1), "se": (1, -1)}.items()}
_SHADE = f"""WITH a AS (SELECT * FROM {_SURFACE}),
  n AS (SELECT a.ix, a.iy, max(a.count) AS count, {", ".join(f"coalesce({v}, max(a.value)) AS {k}" for k, v in _D.items())}
        FROM a JOIN a b ON b.ix BETWEEN a.ix-1 AND a.ix+1 AND b.iy BETWEEN a.iy-1 AND a.iy+1 GROUP BY 1, 2),
  g AS (SELECT ix, iy, count, ((ne+2*e+se)-(nw+2*w+sw))/80.0 AS gx, ((nw+2*n+ne)-(sw+2*s+se))/80.0 AS gy FROM n),
  m AS (SELECT m FROM (SELECT sqrt(gx*gx+gy*gy) AS m, row_number() OVER (ORDER BY sqrt(gx*gx+gy*gy)) AS r, count(*) OVER () AS k FROM g WHERE gx <> 0 OR gy <> 0) WHERE r = k // 2 + 1)
  SELECT ix, iy, 255 * greatest(0, least(1, sin(radians(45)) * cos(t) + cos(radians(45)) * sin(t) * cos(radians(315) - atan2(-gx, -gy)))) AS value, count
  FROM (SELECT *, atan(sqrt(gx*gx+gy*gy) / (SELECT m FROM m)) AS t FROM g)"""


@query(_final(_SHADE))
def grid_hillshade(spark, d):
    return _rounded(grid.hillshade(_cells(spark, d), 10.0, 10.0))


@query(f"SELECT i AS n, round(lo + (hi-lo)*i/6, 6) AS level FROM (SELECT min(value) AS lo, max(value) AS hi FROM {_SURFACE}), range(1, 6) r(i)")
def contour_levels_equal(spark, d):
    levels = grid.contour_levels(_cells(spark, d), 5)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(levels, 1)], "n bigint, level double")


@query(f"SELECT i AS n, round(quantile_cont(value, [1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0])[i], 6) AS level FROM {_SURFACE}, range(1, 6) r(i) GROUP BY i")
def contour_levels_quantile(spark, d):
    levels = grid.contour_levels(_cells(spark, d), 5, quantile=True)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(levels, 1)], "n bigint, level double")


@query()
def contour_lines(spark, d):
    cells = _cells(spark, d)
    return grid.contour_lines(cells, grid.contour_levels(cells, 3), 10.0, 10.0).select("level", st("st_length", "geometry").alias("length"))


@query(f"SELECT (ix::VARCHAR || ':' || iy::VARCHAR) AS cell, count, 100.0::DOUBLE AS area FROM {_SURFACE}")
def grid_cell_geometry(spark, d):
    return grid.cell_geometry(_cells(spark, d), 10.0, 10.0).select("cell", "count", F.round(st("st_area", "geometry"), 6).alias("area"))


# -- classification ------------------------------------------------------------------

def _breaks(name: str, sql: str | None):
    def run(spark, d):
        found = classify.breaks(t(spark, d, "customer"), "c_acctbal", name, 5)
        return spark.createDataFrame([(i, round(b, 6)) for i, b in enumerate(found, 1)], "n bigint, brk double")

    run.__name__ = f"class_{name}"
    query(sql and f"SELECT i AS n, round({sql}, 6) AS brk FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_acctbal) FILTER (c_acctbal > 0) AS base FROM customer), range(1, 5) r(i)")(run)


for _name, _sql in (("equal", "lo + (hi-lo)*i/5"), ("arithmetic", "lo + (hi-lo)/15 * (i*(i+1)/2)"), ("stddev", "m + 0.5*s*(i - 2.5)"), ("geometric", "base * pow(pow(hi/base, 0.2), i)"), ("jenks", None)):
    _breaks(_name, _sql)


@query("SELECT i AS n, (SELECT c_acctbal FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) - 1 AS r FROM customer) WHERE r = least(i * (SELECT count(*) FROM customer) // 5, (SELECT count(*) FROM customer) - 1)) AS brk FROM range(1, 5) t(i)")
def class_quantile(spark, d):
    found = classify.breaks(t(spark, d, "customer"), "c_acctbal", "quantile", 5)
    return spark.createDataFrame(list(enumerate(found, 1)), "n bigint, brk double")


@query("""WITH RECURSIVE h(i, m, prev) AS (
  SELECT 1, avg(o_totalprice), '-inf'::DOUBLE FROM orders
  UNION ALL
  SELECT i + 1, (SELECT avg(o_totalprice) FROM orders WHERE o_totalprice >= h.m), m FROM h
  WHERE i < 5 AND (SELECT count(*) FROM orders WHERE o_totalprice >= h.m) < 0.4 * (SELECT count(*) FROM orders WHERE o_totalprice >= h.prev))
  SELECT i::BIGINT AS n, round(m, 4) AS brk FROM h""")
def class_headtail(spark, d):
    found = classify.breaks(t(spark, d, "orders"), "o_totalprice", "headtail", 6)
    return spark.createDataFrame([(i, round(b, 4)) for i, b in enumerate(found, 1)], "n bigint, brk double")


@query("SELECT (c_acctbal >= 0)::INT + (c_acctbal >= 2500)::INT + (c_acctbal >= 7500)::INT AS bin, count(*) AS n FROM customer GROUP BY 1")
def class_bin_counts(spark, d):
    return t(spark, d, "customer").groupBy(classify.bin_of("c_acctbal", [0, 2500, 7500]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# -- layout ------------------------------------------------------------------------------

@query("""WITH RECURSIVE h(id, x, y, s, d) AS (
  SELECT c_custkey, (c_custkey * 37) % 65536, (c_nationkey * 2621) % 65536, 32768::BIGINT, 0::BIGINT FROM customer
  UNION ALL
  SELECT id, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN s-1-(y & (s-1)) ELSE y & (s-1) END ELSE x & (s-1) END,
             CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN s-1-(x & (s-1)) ELSE x & (s-1) END ELSE y & (s-1) END,
         s // 2, d + s * s * (CASE WHEN (x & s) > 0 THEN CASE WHEN (y & s) > 0 THEN 2 ELSE 3 END WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0)
  SELECT id AS c_custkey, d AS code FROM h WHERE s = 0""")
def hilbert_code(spark, d):
    return t(spark, d, "customer").select("c_custkey", layout.hilbert(F.col("c_custkey") * 37 % 65536, F.col("c_nationkey") * 2621 % 65536).alias("code"))


@query(f"SELECT l_orderkey, l_linenumber, (CASE WHEN sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) >= 40 THEN 0 WHEN sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) >= 20 THEN 1 ELSE 2 END)::INT AS level FROM {BOXES}")
def cogp_levels_boxes(spark, d):
    b = boxes(spark, d).withColumn("bbox", F.struct(F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax"))).withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return layout.cogp_levels(b, "bbox", [10.0, 5.0, 1.0], "row").select("l_orderkey", "l_linenumber", "level")


_METRES = "sqrt(pow((x1-x0)/100 * 111320 * cos(radians((y0+y1)/200)), 2) + pow((y1-y0)/100 * 110540, 2))"


@query(f"SELECT l_orderkey, l_linenumber, (CASE WHEN m >= p * 10000 THEN 0 WHEN m >= p * 5000 THEN 1 WHEN m >= p * 3000 THEN 2 ELSE 3 END)::INT AS level FROM (SELECT *, {_METRES} AS m, CASE WHEN l_linenumber % 2 = 1 THEN 2 ELSE 4 END AS p FROM {BOXES})")
def cogp_levels_degrees(spark, d):
    b = boxes(spark, d).withColumn("bbox", F.struct(*[(F.col(c) / 100).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax"))]))
    b = b.withColumn("kind", F.when(F.col("l_linenumber") % 2 == 1, "line").otherwise("polygon")).withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return layout.cogp_levels(b, "bbox", [10000.0, 5000.0, 3000.0, 1.0], "row", kind="kind", latlong=True).select("l_orderkey", "l_linenumber", "level")


_BEST = [f"row_number() OVER (PARTITION BY floor(x / {4.0 * g}), floor(y / {4.0 * g}) ORDER BY c_custkey) = 1" for g in (20.0, 10.0, 5.0)]


@query(f"SELECT (CASE WHEN a THEN 0 WHEN b THEN 1 WHEN c THEN 2 ELSE 3 END)::INT AS level, count(*) AS n FROM (SELECT {_BEST[0]} AS a, {_BEST[1]} AS b, {_BEST[2]} AS c FROM {POINTS}) GROUP BY 1")
def cogp_levels_points(spark, d):
    p = points(spark, d).withColumn("bbox", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")))
    return layout.cogp_levels(p, "bbox", [20.0, 10.0, 5.0, 1.0], "c_custkey", rank="c_custkey").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT round((SELECT count(*) FROM b a JOIN b c ON a.id <> c.id AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1) / (SELECT count(*) FROM b), 6) AS avg_overlaps FROM (SELECT 1)".replace("SELECT round(", f"WITH b AS (SELECT l_orderkey*10+l_linenumber AS id, x0, y0, x1, y1 FROM {BOXES} ORDER BY id LIMIT 4096) SELECT round(", 1))
def bbox_overlap_metric(spark, d):
    b = boxes(spark, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return layout.overlap_metric(b, "x0", "y0", "x1", "y1", "id").select(F.round("avg_overlaps", 6).alias("avg_overlaps"))


@query("SELECT k AS part, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN NULL ELSE c_mktsegment || '/' || (c_custkey % 7)::VARCHAR END AS k FROM customer) GROUP BY 1")
def hive_partition_roundtrip(spark, d):
    path = shared_path(spark, "parts")
    k = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 7 == 1, F.lit(None)).otherwise(F.concat_ws("/", "c_mktsegment", F.col("c_custkey") % 7))
    layout.write_partitioned(t(spark, d, "customer").select("c_custkey", k.alias("part")), ["part"], path)
    return layout.read_partitioned(spark, path, ["part"]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_orderkey, l_linenumber, x0, y1, (SELECT round(max(x1), 6) FROM {BOXES}) AS east FROM {BOXES} WHERE x0 <= 33 AND x1 >= 21 AND y0 <= 6 AND y1 >= 3""")
def geoparquet_viewport(spark, d):
    from terrane.sources import geoparquet

    path = shared_path(spark, "layer")
    layout.write_geoparquet(boxes(spark, d).select("l_orderkey", "l_linenumber", "x0", "y1", "geometry"), "geometry", path)
    layer = geoparquet.open_layer(spark, path)
    return layer.within((21.0, 3.0, 33.0, 6.0)).select("l_orderkey", "l_linenumber", "x0", "y1", F.lit(round(layer.extent()[2], 6)).alias("east"))


@query(f"SELECT c_custkey, x, y FROM {POINTS} WHERE x BETWEEN 50 AND 90 AND y BETWEEN 0 AND 40")
def untagged_points_viewport(spark, d):
    from terrane.sources import geoparquet

    path = shared_path(spark, "plain")
    points(spark, d).select("c_custkey", "x", "y").write.parquet(path)
    return geoparquet.open_layer(spark, path).within((50.0, 0.0, 90.0, 40.0)).select("c_custkey", "x", "y")


_PATHS = [f"'{d}/' || floor(x / {256.0 / 2**d})::BIGINT || '/' || floor(y / {256.0 / 2**d})::BIGINT" for d in range(6)]


@query(f"""SELECT CASE {" ".join(f"WHEN n{d} <= 200 THEN p{d}" for d in range(5))} ELSE p5 END AS part, count(*) AS n FROM (
  SELECT *, {", ".join(f"count(*) OVER (PARTITION BY p{d}) AS n{d}" for d in range(5))} FROM (SELECT {", ".join(f"{p} AS p{d}" for d, p in enumerate(_PATHS))} FROM {POINTS})) GROUP BY 1""")
def adaptive_split(spark, d):
    p = points(spark, d)
    return layout.adaptive_split(p, F.col("x"), F.col("y"), 256.0, 200, 5).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# -- import --------------------------------------------------------------------------------

@query("SELECT 'code' AS \"column\", 'text' AS type UNION ALL SELECT 'flag', 'boolean' UNION ALL SELECT 'price', 'float' UNION ALL SELECT 'qty', 'integer' UNION ALL SELECT 'seg', 'text'")
def csv_infer_types(spark, d):
    from terrane.sources import tabular

    text = t(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("flag"), F.format_number("c_acctbal", 2).alias("price"), F.col("c_nationkey").cast("string").alias("qty"), F.col("c_mktsegment").alias("seg"))
    return tabular.infer_types(text, text.columns)


@query("SELECT c_custkey, round(c_acctbal, 2) AS plain, round(c_acctbal, 2) AS comma FROM customer")
def number_normalise(spark, d):
    from terrane.sources import tabular

    text = t(spark, d, "customer").select("c_custkey", F.format_number("c_acctbal", 2).alias("a")).withColumn("b", F.translate("a", ",.", " ,"))
    return text.select("c_custkey", F.round(tabular.cast_as("a", "float"), 2).alias("plain"), F.round(tabular.cast_as("b", "float", decimal_comma=True), 2).alias("comma"))


@query(r"""SELECT c_custkey, concat_ws(chr(9), c_custkey::VARCHAR, c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN 'a b' ELSE '' END, 'POINT(' || (c_custkey % 200)::VARCHAR || ' ' || c_nationkey::VARCHAR || ')') AS line FROM customer""")
def rows_as_tsv(spark, d):
    from terrane.operators import view

    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.lit("a\tb")).alias("note"), st("st_point", F.col("c_custkey") % 200, F.col("c_nationkey")).alias("geometry"))
    return view.tsv(c, "geometry").select(F.split("line", "\t")[0].cast("bigint").alias("c_custkey"), "line")


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice / ((x1 - x0) * (y1 - y0)) AS per_area FROM {BOXES}")
def value_per_area(spark, d):
    from terrane.operators import view

    return view.per_area(boxes(spark, d), "l_extendedprice", "geometry", latlong=False).select("l_orderkey", "l_linenumber", "per_area")


@query()
def dcat_explode(spark, d):
    import json

    from terrane.sources import vector

    doc = {"dataset": [{"title": "Parcels", "description": "<p>All parcels</p>", "spatial": "-5,41,10,51", "distribution": [{"format": "CSV", "downloadURL": "u1"}, {"format": "GeoParquet", "downloadURL": "u2"}]}, {"title": "Report", "distribution": [{"format": "PDF", "downloadURL": "u3"}]}]}
    return vector.catalog_rows(spark.createDataFrame([(json.dumps(doc),)], "json string"))


@query("SELECT date_trunc('day', ts) AS start, floor((event_id % 360 - 180) / 30.0)::BIGINT AS ix, floor(value / 20)::BIGINT AS iy, round(sum(value), 4) AS value, count(value) AS count FROM events GROUP BY 1, 2, 3")
def windowed_grid(spark, d):
    from terrane.streaming.grid import windowed_cells

    e = t(spark, d, "events")
    cells = windowed_cells(e, "ts", F.col("event_id") % 360 - 180, F.col("value"), "value", 30.0, 20.0, width="1 day")
    return cells.select(F.col("start").cast("timestamp_ntz").alias("start"), "ix", "iy", F.round("value", 4).alias("value"), "count")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
