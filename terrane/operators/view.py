"""Reading layers for display: capped results, picking, thinning, density, level choice and file information."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators.relational import quoted

RESULT_ROWS = 500_000


def capped(df: DataFrame, rows: int = RESULT_ROWS) -> tuple[list, bool]:
    """At most `rows` rows for display, and whether there were more. Exports are never capped."""
    got = df.limit(rows + 1).collect()
    return got[:rows], len(got) > rows


def join_text(layer: str, table: str, layer_key: str, table_key: str, columns: dict[str, str], inner: bool = False) -> str:
    """The SQL of an attribute join."""
    picked = "".join(f", t.{quoted(c)} AS {quoted(n)}" for c, n in columns.items())
    return f"SELECT l.*{picked} FROM {quoted(layer)} l {'INNER' if inner else 'LEFT'} JOIN {quoted(table)} t ON l.{quoted(layer_key)} = t.{quoted(table_key)}"


def match_count_text(layer: str, table: str, layer_key: str, table_key: str) -> str:
    return f"SELECT count(*) AS total, count(t.{quoted(table_key)}) AS matched FROM {quoted(layer)} l LEFT JOIN {quoted(table)} t ON l.{quoted(layer_key)} = t.{quoted(table_key)}"


def browse_text(layer: str, where: str | None = None, rect: tuple[float, float, float, float] | None = None, geometry: str = "geometry") -> str:
    """The SQL of a layer's rows under a filter and within a rectangle."""
    parts = ([f"({where})"] if where else []) + ([f"st_intersects({quoted(geometry)}, st_makeenvelope({', '.join(map(repr, rect))}))"] if rect else [])
    return f"SELECT * FROM {quoted(layer)}" + (" WHERE " + " AND ".join(parts) if parts else "")


def pick(df: DataFrame, geometry: str, x: float, y: float, tolerance: float, row: str) -> DataFrame:
    """The topmost feature at a place: of those that hold it or are within the tolerance, the one of the highest row."""
    from terrane.functions.spatial import st

    near = df.where(st("st_dwithin", F.col(geometry), ("Point", (float(x), float(y))), tolerance))
    return near.orderBy(F.desc(row)).limit(1)


def thinned(df: DataFrame, group: list[str], box: str, row: str, share: float = 0.25, rank: str | None = None) -> DataFrame:
    """The largest ceil(n * share) rows of each group by rank, or by their boxes' diagonals; ties go to the lower row.

    Rows are ranked from their numbers alone; wide columns do not move with the window.
    """
    size = F.col(rank).cast("double") if rank else F.sqrt((F.col(f"{box}.xmax") - F.col(f"{box}.xmin")) ** 2 + (F.col(f"{box}.ymax") - F.col(f"{box}.ymin")) ** 2)
    slim = df.select(*group, F.col(row).alias("__row"), size.alias("__size"))
    w = Window.partitionBy(*group)
    kept = slim.withColumn("__n", F.row_number().over(w.orderBy(F.desc_nulls_last("__size"), "__row"))).withColumn("__all", F.count(F.lit(1)).over(w)).where(F.col("__n") <= F.ceil(F.col("__all") * share))
    return df.join(kept.select(F.col("__row").alias(row)), row, "left_semi")


def one_in(df: DataFrame, row: str, n: int) -> DataFrame:
    return df.where(F.pmod(F.col(row), F.lit(n)) == 0)


def density_table(df: DataFrame, x: Column, y: Column, side: float, depths: range, target_rows: int) -> DataFrame:
    """For each cell size side / 2^depth: cells, the upper median and largest rows of a cell, and the files a split to target_rows would make."""
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.floor(x / (side / 2**d)).alias("cx"), F.floor(y / (side / 2**d)).alias("cy")) for d in depths]))
    counts = df.select(at.alias("c")).groupBy("c.depth", "c.cx", "c.cy").agg(F.count(F.lit(1)).alias("n"))
    # Cells of one size are first counted by their rows, so that the median needs no window over all cells.
    sizes = counts.groupBy("depth", "n").agg(F.count(F.lit(1)).alias("cells"))
    run = F.sum("cells").over(Window.partitionBy("depth").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("cells").over(Window.partitionBy("depth"))
    ranked = sizes.withColumn("run", run).withColumn("whole", whole)
    return ranked.groupBy("depth").agg(
        F.sum("cells").alias("cells"), F.min(F.when(F.col("run") > F.floor(F.col("whole") / 2), F.col("n"))).alias("median"), F.max("n").alias("largest"),
        F.sum(F.col("cells") * F.ceil(F.col("n") / target_rows)).alias("files"),
    )


def metres_per_degree(latitude: Column) -> tuple[Column, Column]:
    """Metres of a degree of longitude and of latitude."""
    return F.lit(111_320.0) * F.cos(F.radians(latitude)), F.lit(110_540.0)


def ground_area(rings: list, radius: float = 6_371_007.181) -> float:
    """Square metres of a polygon in degrees on the sphere, holes taken out."""
    def ring(r):
        total = 0.0
        for (x0, y0), (x1, y1) in zip(r, [*r[1:], r[0]]):
            total += math.radians(x1 - x0) * (math.sin(math.radians(y0)) + math.sin(math.radians(y1))) / 2
        return abs(total) * radius * radius

    return max(0.0, ring(rings[0]) - sum(map(ring, rings[1:]))) if rings else 0.0


def cogp_document(gsds: list[float], row_group_ends: list[int]) -> str:
    """The footer block of a levelled file; levels without row groups are left out."""
    levels, last = [], 0
    for gsd, end in zip(gsds, row_group_ends):
        if end > last:
            levels.append({"gsd": gsd, "row_group_end": end})
            last = end
    return json.dumps({"version": "0.1.0", "levels": levels})


def cogp_problems(document: str, row_groups: int) -> list[str]:
    """What is wrong with a levels block: ends must rise and cover all row groups, scales must fall."""
    try:
        levels = json.loads(document)["levels"]
        ends, gsds = [int(v["row_group_end"]) for v in levels], [float(v["gsd"]) for v in levels]
    except (ValueError, KeyError, TypeError):
        return ["unreadable"]
    out = []
    if not levels:
        out.append("no levels")
    if any(b <= a for a, b in zip([0, *ends], ends)):
        out.append("row group ends do not rise")
    if any(b >= a for a, b in zip(gsds, gsds[1:])):
        out.append("scales do not fall")
    if ends and ends[-1] != row_groups:
        out.append("row groups are not covered")
    return out


def level_for(document: str, gsd: float) -> dict | None:
    """The coarsest level that is at least as fine as a scale is the last one read: levels are prefixes of row groups."""
    levels = json.loads(document)["levels"]
    fit = [v for v in levels if v["gsd"] >= gsd]
    return fit[-1] if fit else levels[0] if levels else None


def geoarrow_point(column: str) -> Column:
    """WKB of a GeoArrow point column, struct<x, y>."""
    from terrane.functions.spatial import st

    return F.when(F.col(column).isNotNull(), st("st_point", F.col(f"{column}.x"), F.col(f"{column}.y")))


def geoarrow_text(column: str, kind: str) -> Column:
    """WKT of a GeoArrow column of nested lists of struct<x, y>, for st_geomfromtext: kind is LineString, Polygon or a Multi of them."""
    depth = {"LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}[kind]

    def walk(c: Column, d: int) -> Column:
        item = (lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))) if d == 1 else (lambda p: walk(p, d - 1))
        return F.concat(F.lit("("), F.array_join(F.transform(c, item), ","), F.lit(")"))

    c = F.col(column)
    return F.when(c.isNotNull(), F.when(F.size(c) == 0, F.lit(f"{kind.upper()} EMPTY")).otherwise(F.concat(F.lit(kind.upper()), walk(c, depth))))


def base64_wkb(column: str) -> Column:
    """WKB of base64 text, padded or not; null for other text."""
    text = F.regexp_replace(F.trim(column), "=+$", "")
    padded = F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    return F.when(text.rlike("^[A-Za-z0-9+/]+$"), F.unbase64(padded))


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group of a dataset: file, rows, bytes, codec and box."""
    from terrane.operators.layout import footer

    rows = [(g["file"], g["rows"], g["bytes"], g["codec"], list(map(float, g["box"])) if g["box"] else None) for g in footer(path)]
    return spark.createDataFrame(rows, "file string, rows bigint, bytes bigint, codec string, box array<double>")


def colour_table(text: str) -> dict[str, tuple[int, int, int]]:
    """A colour map of lines `value,red,green,blue[,alpha[,label]]`, as desktop tools export it."""
    out = {}
    for line in text.splitlines():
        parts = [p.strip() for p in line.split(",")]
        if len(parts) >= 4 and not line.startswith("#") and all(p.isdigit() and int(p) < 256 for p in parts[1:4]):
            out[parts[0]] = tuple(map(int, parts[1:4]))
    return out


def colours_cover(df: DataFrame, column: str, table: dict, least: float = 0.9) -> bool:
    """Whether a table names at least a share of a column's distinct values; only two counts leave the executors."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    n, known = values.agg(F.count(F.lit(1)), F.count(F.when(F.col("v").isin(*table), 1))).first()
    return n > 0 and known >= least * n


def per_area(df: DataFrame, value: str, geometry: str, latlong: bool) -> DataFrame:
    """df with per_area: the value by square metre of ground where coordinates are degrees, else by square unit; null without an area."""
    from terrane.functions import wkb
    from terrane.functions.spatial import st

    @F.pandas_udf("double")
    def on_ground(g: pd.Series) -> pd.Series:
        def area(shape):
            if shape is None or shape[0] not in ("Polygon", "MultiPolygon"):
                return 0.0
            return sum(ground_area(p) for p in ([shape[1]] if shape[0] == "Polygon" else shape[1]))

        return pd.Series([area(wkb.decode(b)) for b in g], dtype="float64")

    area = on_ground(geometry) if latlong else st("st_area", geometry)
    return df.withColumn("per_area", F.when(area > 0, F.col(value) / area))


def tsv(df: DataFrame, geometry: str | None = None) -> DataFrame:
    """A column line: each row's values between tabs, the geometry as WKT; tabs and line ends inside values become blanks, nulls empty."""
    from terrane.functions.spatial import st
    from terrane.operators.relational import quoted

    text = [(st("st_astext", F.col(quoted(c))) if c == geometry else F.col(quoted(c))).cast("string") for c in df.columns]
    return df.select(F.concat_ws("\t", *[F.coalesce(F.regexp_replace(v, "[\t\r\n]", " "), F.lit("")) for v in text]).alias("line"))
