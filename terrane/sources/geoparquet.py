"""GeoParquet datasets: what a footer says of geometry, CRS and covering decides the plan; the scan is Spark's own."""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import crs as crs_of
from terrane.functions import wkb
from terrane.functions.spatial import bounds_struct, st
from terrane.operators.relational import quoted
from terrane.operators.view import base64_wkb, geoarrow_point, geoarrow_text
from terrane.sources import tabular
from terrane.sources.vector import stac_parts

LISTS = {"linestring": "LineString", "multipoint": "MultiPoint", "polygon": "Polygon", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon"}
USUAL_NAMES = ("geometry", "geom", "wkb_geometry", "wkb", "the_geom", "shape")
CORNERS = ("xmin", "ymin", "xmax", "ymax")
MOST_PATHS = 64
PROBED = 64

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Layer:
    """A dataset with its geometry as WKB in the column `geometry`; covering is (struct, xmin, ymin, xmax, ymax) by their names."""

    df: DataFrame
    geometry: str
    crs: crs_of.Crs
    covering: tuple[str, str, str, str, str] | None
    spherical: bool
    version: str | None
    column: dict

    def box(self) -> list[Column]:
        """xmin, ymin, xmax, ymax of a row: stored numbers where there is a covering, else of the geometry."""
        if self.covering:
            root, *names = self.covering
            return [F.col(f"{quoted(root)}.{quoted(n)}") for n in names]
        b = bounds_struct(F.col(quoted(self.geometry)))
        return [b[n] for n in CORNERS]

    def within(self, rect: tuple[float, float, float, float], wraps: bool = False) -> DataFrame:
        """Rows whose box meets a rectangle, edges included; rows without a box are left out.

        The comparisons with a covering reach the Parquet reader. A rectangle of xmin > xmax goes across the antimeridian. With
        wraps, so do stored boxes of xmin > xmax; that test compares two columns, so x then prunes no row groups, but y does.
        """
        x0, y0, x1, y1 = map(float, rect)
        west, south, east, north = self.box()
        high = (south <= y1) & (north >= y0)
        wide = (west <= x1) | (east >= x0) if x0 > x1 else (west <= x1) & (east >= x0)
        if wraps and self.crs.is_latlong:
            wide = wide | ((west > east) & (F.lit(x0 > x1) | (west <= x1) | (east >= x0)))
        return self.df.where(high & wide)

    def extent(self) -> tuple[float, float, float, float] | None:
        """The box of all rows, or None without any; four columns are read where there is a covering."""
        w, s, e, n = self.df.select(*[c.cast("double").alias(k) for c, k in zip(self.box(), CORNERS)]).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
        return None if w is None else (w, s, e, n)

    def register(self, name: str) -> None:
        self.df.createOrReplaceTempView(quoted(name))


def footer_metadata(spark: SparkSession, df: DataFrame) -> dict[str, str]:
    """The key-value metadata of a dataset's first file, through Hadoop, so from any store that Spark reads; empty without files."""
    files = df._jdf.inputFiles()
    if not len(files):
        return {}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0]))
    source = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(hadoop, spark._jsc.hadoopConfiguration())
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()


def geo_of(metadata: dict[str, str]) -> dict | None:
    try:
        found = json.loads(metadata.get("geo", ""))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def covering_of(column: dict, schema: T.StructType) -> tuple[str, str, str, str, str] | None:
    """The covering that a column's metadata names, if it is one root struct with four numeric children; else None."""
    paths = (column.get("covering") or {}).get("bbox") or {}
    places = [paths.get(c) for c in CORNERS]
    if not all(isinstance(p, list) and len(p) == 2 for p in places) or len({p[0] for p in places}) != 1:
        return None
    root = places[0][0]
    kind = schema[root].dataType if root in schema.names else None
    children = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    if not all(isinstance(children.get(p[1]), T.NumericType) for p in places):
        log.warning("covering %s is not a struct of four numbers; the geometry is used", root)
        return None
    return (root, *[p[1] for p in places])


def _reads_as_wkb(df: DataFrame, value: Column) -> bool:
    """Whether the first values there are all decode; a name alone proves nothing."""
    values = [r[0] for r in df.select(value.alias("v")).where("v is not null").limit(PROBED).collect()]
    return bool(values) and all(wkb.decode(v) is not None for v in values)


def _untagged(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with WKB, the column's name and how it was found: a binary column, base64 text, or coordinate columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    binary = [n for n, k in kinds.items() if isinstance(k, T.BinaryType)]
    for name in sorted(binary, key=lambda n: n.lower() not in USUAL_NAMES):
        if _reads_as_wkb(df, F.col(quoted(name))):
            return df, name, "WKB"
    for name in [n for n, k in kinds.items() if isinstance(k, T.StringType) and n.lower() in USUAL_NAMES]:
        if _reads_as_wkb(df, base64_wkb(quoted(name))):
            return df.withColumn(name, base64_wkb(quoted(name))), name, "base64"
    pair = tabular.coordinate_columns([n for n, k in kinds.items() if isinstance(k, T.NumericType)])
    if pair is None:
        raise ValueError("no geo metadata, no column of WKB and no coordinate columns")
    if "geometry" in kinds:
        raise ValueError("coordinate columns beside a column named geometry that is none")
    return tabular.points_of(df, *pair), "geometry", "coordinates"


def layer_of(spark: SparkSession, df: DataFrame) -> Layer:
    """The layer of a Parquet scan: by its geo metadata, or found among its columns and taken as lon/lat.

    Undecodable geometries are null. A named geometry column that is missing, an unknown encoding and an unknown CRS are errors.
    """
    geo = geo_of(footer_metadata(spark, df))
    if geo is None:
        found, name, _ = _untagged(df)
        return Layer(found, name, crs_of.lookup("OGC:CRS84"), None, False, None, {})
    name = geo.get("primary_column") or "geometry"
    if name not in df.columns:
        raise ValueError(f"geometry column {name!r} not found")
    column = (geo.get("columns") or {}).get(name) or {}
    encoding = str(column.get("encoding") or "WKB").lower()
    if encoding == "point":
        df = df.withColumn(name, geoarrow_point(quoted(name)))
    elif encoding in LISTS:
        df = df.withColumn(name, st("st_geomfromtext", geoarrow_text(quoted(name), LISTS[encoding])))
    elif encoding != "wkb":
        raise ValueError(f"geometry encoding {column.get('encoding')!r} is not known")
    known = crs_of.from_projjson(column.get("crs"), missing="crs" not in column)
    return Layer(df, name, known, covering_of(column, df.schema), column.get("edges") == "spherical", geo.get("version"), column)


def open_layer(spark: SparkSession, *paths: str) -> Layer:
    """One layer of files, globs or folders, whose key=value parts are columns.

    Of several paths those that are not there are left out with a warning; none at all, and more than MOST_PATHS, are errors.
    """
    if len(paths) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} paths")
    there = [p for p in paths if len(paths) == 1 or _matches(spark, p)]
    for p in paths:
        if p not in there:
            log.warning("%s is not there", p)
    if not there:
        raise FileNotFoundError(", ".join(paths))
    return layer_of(spark, spark.read.option("mergeSchema", len(there) > 1).parquet(*there))


def _matches(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def open_collection(spark: SparkSession, path: str, rect: tuple[float, float, float, float] | None = None) -> Layer:
    """A layer of a collection.json's parts: all of them, or those that stac_parts() picks for a rectangle. Relative parts lie beside it."""
    text = spark.read.text(path, wholetext=True).first()
    document = json.loads(text[0])
    parts = stac_parts(document, rect) if rect else [a["href"] for _, a in sorted((document.get("assets") or {}).items())]
    if not parts:
        raise ValueError("no part of the collection meets the rectangle")
    folder = path.rsplit("/", 1)[0]
    full = [p if "://" in p or p.startswith("/") else f"{folder}/{p.removeprefix('./')}" for p in parts]
    return layer_of(spark, spark.read.option("mergeSchema", len(full) > 1).parquet(*full))


def attribute_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table without geometry; a GeoParquet one is refused, as it is a layer."""
    df = spark.read.parquet(path)
    if geo_of(footer_metadata(spark, df)) is not None:
        raise ValueError(f"{path} is GeoParquet; open it as a layer")
    return df.select(*[quoted(c) for c in columns]) if columns else df


def is_part(stem: str) -> bool:
    """Whether a file's name without its ending is that of a part (part-0001-x, data_0, chunk3, 00003), not of a dataset."""
    return bool(re.match(r"[0-9]*$|(?:part|data|chunk)[-_.]*[0-9]", stem, re.I))


def datasets(files: list[str]) -> dict[str, list[str]]:
    """The files of a folder (relative paths) by dataset, in order of first sight; {"": files} if they are one.

    They are one if any is named as a part, or if no folder holds two names.
    """
    named: dict[str, list[str]] = {}
    beside: dict[str, set[str]] = {}
    for f in files:
        folder, _, name = f.rpartition("/")
        stem = name.rpartition(".")[0] or name
        if is_part(stem):
            return {"": list(files)}
        named.setdefault(stem, []).append(f)
        beside.setdefault(folder, set()).add(stem)
    return named if any(len(s) > 1 for s in beside.values()) else {"": list(files)}


def layers_in(spark: SparkSession, folder: str) -> dict[str, Layer]:
    """The layers of a folder by name, one named "" if all its files are one dataset; hidden and staged files do not count."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    root, walk, found = system.makeQualified(base).toString().rstrip("/"), system.listFiles(base, True), []
    while walk.hasNext():
        path = walk.next().getPath().toString()
        if path.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in path[len(root) + 1:].split("/")):
            found.append(path[len(root) + 1:])
    groups = datasets(sorted(found))
    if "" in groups:
        return {"": open_layer(spark, folder)}
    return {name: layer_of(spark, spark.read.option("basePath", folder).parquet(*[f"{root}/{f}" for f in files])) for name, files in groups.items()}
