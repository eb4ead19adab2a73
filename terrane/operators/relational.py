"""Query builders around joins and summaries, and the rules for names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.plans.storage import kept

#: Bytes up to which an attribute table is broadcast to a join; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_column_names(names: list[str]) -> list[str]:
    """Lower-cased names; those that collide get _2, _3 and so on."""
    out: list[str] = []
    for n in names:
        base, i = n.lower(), 2
        name = base
        while name in out:
            name, i = f"{base}_{i}", i + 1
        out.append(name)
    return out


def sql_table_name(name: str, taken: list[str] = ()) -> str:
    base = re.sub(r"[^a-z0-9_]", "_", name.lower()) or "layer"
    base = f"t{base}" if base[0].isdigit() else base
    out, i = base, 2
    while out in taken:
        out, i = f"{base}_{i}", i + 1
    return out


def small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def join_attributes(layer: DataFrame, table: DataFrame, layer_key: str, table_key: str, columns: dict[str, str], how: str = "left") -> DataFrame:
    """All of layer and the named columns of table (column: new name); rows multiply where a key repeats in table."""
    picked = table.select(F.col(table_key).alias("__key"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    joined = layer.join(F.broadcast(picked) if small(picked) else picked, F.col(layer_key) == F.col("__key"), how)
    return joined.select(*[F.col(quoted(c)) for c in layer.columns], *[F.col(f"__{i}").alias(n) for i, n in enumerate(columns.values())])


def match_counts(layer: DataFrame, table: DataFrame, layer_key: str, table_key: str) -> DataFrame:
    """total rows of the join, and matched ones among them."""
    picked = table.select(F.col(table_key).alias("__key"))
    joined = layer.select(F.col(layer_key).alias("__own")).join(picked, F.col("__own") == F.col("__key"), "left")
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count("__key").alias("matched"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(c) for c in columns])


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """v and c: the k most frequent values as text, ties in the order of the text."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return counts.orderBy(F.desc("c"), "v").limit(k)


def sorted_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Nulls come last either way."""
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))


def page(df: DataFrame, size: int, number: int) -> DataFrame:
    return df.offset(size * number).limit(size)


def row_ranges(df: DataFrame, row: str, group: str | None = None) -> DataFrame:
    """Runs of consecutive row numbers, within a row group if one is given: first, last (inclusive)."""
    from pyspark.sql import Window

    keys = [group] if group else []
    # Rows are numbered in chunks of a fixed width, so that no window holds a whole file; runs are then joined across chunks.
    chunked = df.select(*keys, F.col(row).cast("long").alias("r")).withColumn("chunk", F.floor(F.col("r") / 65536))
    w = Window.partitionBy(*keys, "chunk").orderBy("r")
    runs = chunked.withColumn("island", F.col("r") - F.row_number().over(w)).groupBy(*keys, "chunk", "island").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    # Only runs that touch a chunk's border can go on in the next chunk: two a chunk at most.
    edge = (F.col("first") == F.col("chunk") * 65536) | (F.col("last") == F.col("chunk") * 65536 + 65535)
    inner = runs.where(~edge).select(*keys, "first", "last")
    w2 = Window.partitionBy(*keys).orderBy("first")
    marked = runs.where(edge).withColumn("starts", (F.coalesce(F.lag("last").over(w2), F.lit(-2)) + 1 != F.col("first")).cast("int"))
    numbered = marked.withColumn("n", F.sum("starts").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    return inner.unionByName(numbered.groupBy(*keys, "n").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("n"))


def merge_layers(layers: list[DataFrame], source_names: list[str] | None = None) -> DataFrame:
    """The rows of all layers by exact column names. Integers widen to doubles; columns whose types differ otherwise are left out."""
    kinds: dict[str, str] = {}
    dropped: set[str] = set()
    for df in layers:
        for name, kind in df.dtypes:
            kind = "bigint" if kind in ("tinyint", "smallint", "int") else "double" if kind == "float" else kind
            if kinds.setdefault(name, kind) != kind:
                if {kinds[name], kind} == {"bigint", "double"}:
                    kinds[name] = "double"
                else:
                    dropped.add(name)
    out = None
    for i, df in enumerate(layers):
        part = df.select(*[F.col(quoted(c)).cast(kinds[c]).alias(c) for c in df.columns if c not in dropped])
        if source_names:
            part = part.withColumn("source_layer", F.lit(source_names[i]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def in_box(box: str, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a covering struct meets a rectangle; plain comparisons, which reach the Parquet reader."""
    return (F.col(f"{box}.xmin") <= x1) & (F.col(f"{box}.xmax") >= x0) & (F.col(f"{box}.ymin") <= y1) & (F.col(f"{box}.ymax") >= y0)


def where_spatial(df: DataFrame, predicate: str, geometry: str, constant: tuple, box: str | None = None, distance: float | None = None) -> DataFrame:
    """Rows whose geometry satisfies a predicate with a constant geometry.

    If the layer has a covering struct, rows are first cut down by its numbers; the exact predicate always follows.
    """
    from terrane.functions.spatial import FUNCTIONS
    from terrane.functions.wkb import bounds, encode

    b = bounds(constant)
    if b is None:
        return df.where(F.lit(False))
    pad = distance or 0.0
    if box:
        df = df.where(in_box(box, b[0] - pad, b[1] - pad, b[2] + pad, b[3] + pad))
    args = [F.col(geometry), F.lit(encode(constant))] + ([F.lit(float(distance))] if predicate == "st_dwithin" else [])
    return df.where(FUNCTIONS[predicate](*args))


def first_containing(points: DataFrame, areas: DataFrame, x: str, y: str, area_id: str, geometry: str, value: str, cell: float) -> DataFrame:
    """points with the value of the containing area of the lowest area_id, or null; a point on an area's edge is not contained.

    Boxes of areas are dealt to the cells of a square grid that they meet, and points join on their cell, so that only
    areas near a point are tested. cell should be about the size of an area.
    """
    from terrane.functions.spatial import FUNCTIONS, bounds_struct, st

    cells = areas.select(F.col(area_id).alias("__id"), F.col(geometry).alias("__g"), F.col(value).alias("__v"), bounds_struct(geometry).alias("b"))
    index = lambda c: F.floor(c / F.lit(float(cell)))
    cells = cells.withColumn("__cx", F.explode(F.sequence(index(F.col("b.xmin")), index(F.col("b.xmax")))))
    cells = cells.withColumn("__cy", F.explode(F.sequence(index(F.col("b.ymin")), index(F.col("b.ymax")))))
    # Row numbers are used twice, so they are fixed first.
    keyed = kept(points.withColumn("__row", F.monotonically_increasing_id()))
    near = keyed.select("__row", F.col(x).alias("__x"), F.col(y).alias("__y"), index(F.col(x)).alias("__cx"), index(F.col(y)).alias("__cy")).join(cells, ["__cx", "__cy"])
    near = near.where((F.col("__x") > F.col("b.xmin")) & (F.col("__x") < F.col("b.xmax")) & (F.col("__y") > F.col("b.ymin")) & (F.col("__y") < F.col("b.ymax")))
    inside = near.where(FUNCTIONS["st_contains"](F.col("__g"), st("st_point", F.col("__x"), F.col("__y"))))
    hit = inside.groupBy("__row").agg(F.min(F.struct("__id", "__v"))["__v"].alias("__value"))
    return keyed.join(hit, "__row", "left").select(*[F.col(quoted(c)) for c in points.columns], F.col("__value").alias(value))


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, left_geometry: str, right_geometry: str, cell: float, distance: float | None = None) -> DataFrame:
    """All pairs of rows whose geometries satisfy a predicate: struct columns `left` and `right`.

    Both sides are dealt to the cells of a square grid that their boxes meet and joined on cells. A pair whose boxes meet in
    several cells is kept in the first of them only, so no distinct is needed; the exact predicate follows. cell should be about the
    size of the larger geometries. Rows without a box have no partner; repeated rows pair each.
    """
    from terrane.functions.spatial import FUNCTIONS, bounds_struct

    index = lambda c: F.floor(c / F.lit(float(cell)))
    pad = float(distance or 0.0)

    def dealt(df: DataFrame, geometry: str, side: str, by: float) -> DataFrame:
        b = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(side), F.col(quoted(geometry)).alias(f"{side}_g"), bounds_struct(geometry).alias("b")).where("b.xmin is not null")
        edges = [(F.col(f"b.{n}") + F.lit(by if n.endswith("max") else -by)).alias(f"{side}_{n}") for n in ("xmin", "ymin", "xmax", "ymax")]
        b = b.select(side, f"{side}_g", *edges)
        b = b.withColumn("cx", F.explode(F.sequence(index(F.col(f"{side}_xmin")), index(F.col(f"{side}_xmax")))))
        return b.withColumn("cy", F.explode(F.sequence(index(F.col(f"{side}_ymin")), index(F.col(f"{side}_ymax")))))

    met = dealt(left, left_geometry, "left", pad).join(dealt(right, right_geometry, "right", 0.0), ["cx", "cy"])
    x0, y0 = F.greatest("left_xmin", "right_xmin"), F.greatest("left_ymin", "right_ymin")
    met = met.where((x0 <= F.least("left_xmax", "right_xmax")) & (y0 <= F.least("left_ymax", "right_ymax")) & (F.col("cx") == index(x0)) & (F.col("cy") == index(y0)))
    args = [F.col("left_g"), F.col("right_g")] + ([F.lit(pad)] if predicate == "st_dwithin" else [])
    return met.where(FUNCTIONS[predicate](*args)).select("left", "right")
