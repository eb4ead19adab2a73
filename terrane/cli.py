"""python -m terrane.cli --input FILE --output FOLDER: rewrite a file or dataset for reading by area."""

from __future__ import annotations

import argparse
import os
import sys

FORMATS = {".geojson": "geojson", ".json": "geojson", ".gpkg": "gpkg", ".shp": "shp", ".csv": "csv", ".tsv": "csv", ".txt": "csv"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrane")
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--layer", help="the layer of a GeoPackage, in any case")
    p.add_argument("--geometry", help="the geometry column; of GeoParquet, the one it names")
    p.add_argument("--row-group-size", type=int, default=65_536, help="most rows of a row group")
    p.add_argument("--row-group-mib", type=int, default=16, help="most MiB of a row group")
    p.add_argument("--compression", choices=("zstd", "snappy", "none"), default="zstd")
    p.add_argument("--files", type=int)
    p.add_argument("--no-hilbert", action="store_true")
    p.add_argument("--no-covering", action="store_true")
    p.add_argument("--partition-by", help="columns between commas: hive folders instead of files in order")
    p.add_argument("--cogp", action="store_true", help="levels from coarse to fine in each file")
    p.add_argument("--list-layers", action="store_true")
    return p


def options(argv: list[str]) -> argparse.Namespace:
    """Parsed flags; combinations that cannot work are refused before anything is read."""
    p = parser()
    o = p.parse_args(argv)
    kind = FORMATS.get(os.path.splitext(o.input)[1].lower())
    if o.row_group_size < 1 or o.row_group_mib < 1 or o.files is not None and o.files < 1:
        p.error("row groups and files must be positive")
    if (o.layer or o.list_layers) and kind != "gpkg":
        p.error("only GeoPackages have layers")
    if not o.list_layers and not o.output:
        p.error("--output is needed")
    if o.cogp and (o.partition_by or o.no_hilbert or o.no_covering):
        p.error("--cogp needs the sort and the covering, and no partitions")
    return o


def load(spark, path: str, layer: str | None, geometry: str | None = None):
    """The rows of an input, its geometry column, its CRS as of geo metadata ("" for lon/lat) and whether coordinates are degrees.

    Layers of GeoPackages and shapefiles come in degrees; where these do not name their CRS, it is written as unknown.
    """
    from terrane.sources import geoparquet, tabular, vector

    kind, named = FORMATS.get(os.path.splitext(path)[1].lower()), geometry or "geometry"
    if kind == "geojson":
        return vector.read_geojson(spark, path), named, "", True
    if kind == "gpkg":
        names = vector.geopackage_layers(path)
        pick = layer or (names[0] if names else "")
        known = vector.geopackage_crs(path, pick)
        return vector.to_lonlat(vector.read_geopackage(spark, path, layer), named, known), named, "" if known else None, True
    if kind == "shp":
        known = vector.shapefile_crs(path)
        return vector.to_lonlat(vector.read_shapefile(spark, path), named, known), named, "" if known else None, True
    if kind == "csv":
        df = tabular.read_delimited(spark, path)
        pair = tabular.coordinate_columns(df.columns)
        if pair is None:
            raise ValueError("no coordinate columns")
        return tabular.points_of(df, *pair), named, "", True
    found = geoparquet.open_layer(spark, path)
    df = found.df.drop(found.covering[0]) if found.covering else found.df
    if geometry and geometry != found.geometry:
        return df, geometry, "", True
    return df, found.geometry, found.column.get("crs", ""), found.crs.is_latlong


def levelled(df, geometry: str, latlong: bool, gsds: list[float]):
    """df with level, by boxes and kinds of its geometries. Rows are numbered and stored first, as numbers must not change."""
    from pyspark.sql import functions as F

    from terrane.functions.spatial import bounds_struct, st
    from terrane.operators import layout
    from terrane.plans.storage import kept

    name = F.lower(st("st_geometrytype", F.col(geometry)))
    kind = F.when(name.endswith("point"), "point").when(name.endswith("linestring"), "line").otherwise("polygon")
    rows = kept(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__box", bounds_struct(geometry)).withColumn("__kind", kind))
    return layout.cogp_levels(rows, "__box", gsds, "__row", kind="__kind", latlong=latlong).drop("__row", "__box", "__kind")


def size(n: int) -> str:
    return f"{n / 1e6:.1f} MB" if n >= 1e6 else f"{n / 1e3:.1f} kB"


def main(argv: list[str] | None = None) -> int:
    o = options(sys.argv[1:] if argv is None else argv)
    from terrane.operators import layout
    from terrane.sources import vector

    if o.list_layers:
        print("\n".join(vector.geopackage_layers(o.input)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    df, geometry, crs, latlong = load(spark, o.input, o.layer, o.geometry)
    if o.partition_by:
        columns = o.partition_by.split(",")
        layout.write_partitioned(df if o.no_covering else layout.covered(df, geometry), columns, o.output)
        print(f"{df.count()} rows")
        return 0
    gsds = layout.web_mercator_gsds() if o.cogp else None
    out = levelled(df, geometry, latlong, gsds) if gsds else df
    done = layout.write_geoparquet(out, geometry, o.output, o.row_group_size, not o.no_hilbert, o.files, o.row_group_mib << 20, o.compression, not o.no_covering, crs, gsds)
    groups = layout.footer(o.output)
    shown = f"{done['rows']} rows | {len(groups)} row groups | {size(sum(g['bytes'] for g in groups))} | {done['files']} file(s)"
    print(shown + (" | levels" if gsds else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main())
