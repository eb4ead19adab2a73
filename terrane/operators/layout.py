"""Layout of spatial files: curve order, levels, partitions, writing, and a scorecard."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans.storage import kept

ORDER = 16
MAX_PARTS = 4096
# Metres of a degree of longitude at the equator, and of latitude.
METRES_PER_DEGREE = (111_320.0, 110_540.0)
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


def _turns() -> int:
    """The curve's steps, four bits each, in one signed number: for a state (axes swapped, mirrored) and a quadrant (x bit, y bit), the digit and the next state."""
    packed = 0
    for state in range(4):
        swapped, mirrored = state >> 1, state & 1
        for quadrant in range(4):
            bits = (quadrant >> 1, quadrant & 1)
            rx, ry = (b ^ mirrored for b in (bits[::-1] if swapped else bits))
            # A quadrant below is turned, one on the right of them mirrored as well.
            following = state if ry else (swapped ^ 1) << 1 | mirrored ^ rx
            packed |= (((3 * rx) ^ ry) << 2 | following) << 4 * (4 * state + quadrant)
    return packed - (1 << 64) if packed >> 63 else packed


def hilbert(x: Column, y: Column) -> Column:
    """The place on a Hilbert curve of order 16 of integer columns in 0..65535, as one expression of built-in functions."""
    turns, x, y = F.lit(_turns()).cast("long"), x.cast("long"), y.cast("long")

    def step(acc: Column, i: Column) -> Column:
        bit = lambda c: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1))
        place = (acc.bitwiseAND(F.lit(3)) * 4 + bit(x) * 2 + bit(y)) * 4
        return (acc.bitwiseAND(F.lit(-4)) * 4).bitwiseOR(F.call_function("shiftrightunsigned", turns, place.cast("int")).bitwiseAND(F.lit(15)))

    # The digits so far above the state's two bits.
    return F.aggregate(F.array(*[F.lit(i) for i in range(ORDER - 1, -1, -1)]), F.lit(0).cast("long"), step, lambda acc: F.shiftright(acc, 2))


def hilbert_of_box(df: DataFrame, box: str) -> DataFrame:
    """df with hilbert: the code of the box's centre, quantised to the extent of all boxes; null without a box."""
    cx, cy = (F.col(f"{box}.xmin") + F.col(f"{box}.xmax")) / 2, (F.col(f"{box}.ymin") + F.col(f"{box}.ymax")) / 2
    x0, y0, x1, y1 = df.agg(F.min(f"{box}.xmin"), F.min(f"{box}.ymin"), F.max(f"{box}.xmax"), F.max(f"{box}.ymax")).first()
    if x0 is None:
        return df.withColumn("hilbert", F.lit(None).cast("long"))
    top = float((1 << ORDER) - 1)
    q = lambda c, a, b: F.floor((c - a) / (b - a) * top) if b > a else F.lit(0)
    return df.withColumn("hilbert", F.when(cx.isNotNull() & cy.isNotNull(), hilbert(q(cx, x0, x1), q(cy, y0, y1))))


def covered(df: DataFrame, geometry: str) -> DataFrame:
    """df with a covering struct bbox; an existing one of numbers is rebuilt, and an attribute of that name stays beside bbox_2."""
    from terrane.functions.spatial import bounds_struct

    name, i = "bbox", 2
    kinds = dict(df.dtypes)
    if kinds.get(name, "").startswith("struct<xmin"):
        df = df.drop(name)
    while name in df.columns:
        name, i = f"bbox_{i}", i + 1
    b = bounds_struct(geometry)
    return df.withColumn(name, b)


def cogp_levels(df: DataFrame, box: str, gsds: list[float], row: str, rank: str | None = None, polygon: float = 4.0, point: float = 4.0, line: float = 2.0, kind: str | None = None, latlong: bool = False) -> DataFrame:
    """df with level: the coarsest of the scales (ground metres a pixel, falling) at which a row is shown.

    A box goes to the first scale at which its diagonal is at least `polygon` pixels, or `line` pixels for lines. Points are thinned by
    their box's centre: at each scale one row, the best by rank and a hash, wins each cell of `point` pixels that no earlier winner took.
    The rest, and rows without a box, go to the finest. kind is a column of point, line and polygon; by it, a line or polygon without
    extent goes to the first scale. Without it, boxes without extent are the points and there are no lines. latlong: boxes are in degrees,
    lengths are taken at a box's own latitude, and cells lie on one plane for all, so that neighbours agree on their edges.

    Where scales divide each other, so that cells nest, a row's level is the first at which it is the best of its cell: an earlier winner of a
    larger cell is the best of all cells in it that hold it. One pass finds that for all scales. Other scales go one by one, stored in between.
    """
    if any(b >= a for a, b in zip(gsds, gsds[1:])):
        raise ValueError("scales must fall")
    w, h = F.col(f"{box}.xmax") - F.col(f"{box}.xmin"), F.col(f"{box}.ymax") - F.col(f"{box}.ymin")
    x, y = (F.col(f"{box}.xmin") + F.col(f"{box}.xmax")) / 2, (F.col(f"{box}.ymin") + F.col(f"{box}.ymax")) / 2
    if latlong:
        across = F.cos(F.radians(y)) * METRES_PER_DEGREE[0]
        w, h, x, y = w * F.abs(across), h * METRES_PER_DEGREE[1], x * across, y * METRES_PER_DEGREE[1]
    diagonal = F.sqrt(w * w + h * h)
    last = len(gsds) - 1
    pixels = F.when(F.col(kind) == "line", line).otherwise(polygon) if kind else F.lit(polygon)
    level = F.lit(last)
    for i in range(last, -1, -1):
        level = F.when(diagonal >= pixels * gsds[i], i).otherwise(level)
    points = F.coalesce(F.col(kind) == "point", F.lit(False)) if kind else diagonal == 0
    sized = df.withColumn("level", F.when(diagonal.isNull(), last).when(points, F.lit(None)).when(diagonal > 0, level).otherwise(0))
    out, left = sized.where("level is not null"), sized.where("level is null").drop("level")
    best = F.struct((F.col(rank) if rank else F.lit(0)).alias("r"), F.xxhash64(row).alias("h"), F.col(row).alias("id")).alias("o")
    places = left.select(best, x.alias("x"), y.alias("y"))
    nested = all((a / b).is_integer() for a, b in zip(gsds, gsds[1:]))
    won = _first_won(places, [point * g for g in gsds[:-1]]) if nested else _won_in_turn(places, [point * g for g in gsds[:-1]])
    won = won.select(F.col("id").alias(row), "level")
    return out.unionByName(left.join(won, row, "left").withColumn("level", F.coalesce("level", F.lit(last))).select(*out.columns))


def _first_won(places: DataFrame, sides: list[float]) -> DataFrame:
    """id and level of the rows that are the best of a cell of nested sizes: the first such size."""
    if not sides:
        return places.select(F.col("o.id").alias("id"), F.lit(0).alias("level")).limit(0)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("x") / s).alias("cx"), F.floor(F.col("y") / s).alias("cy")) for i, s in enumerate(sides)])
    best = places.select("o", F.explode(cells).alias("c")).groupBy("c").agg(F.min("o").alias("o"))
    return best.groupBy(F.col("o.id").alias("id")).agg(F.min("c.i").alias("level"))


def _won_in_turn(places: DataFrame, sides: list[float]) -> DataFrame:
    """The same for any sizes: size by size, cells that hold an earlier winner are blocked."""
    won = None
    for i, side in enumerate(sides):
        cell = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        dealt = places.select("o", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
        if won is not None:
            dealt = dealt.join(won.select(cell("x").alias("cx"), cell("y").alias("cy")).distinct(), ["cx", "cy"], "left_anti")
        new = dealt.groupBy("cx", "cy").agg(F.min(F.struct("o", "x", "y")).alias("w")).select("w.o", "w.x", "w.y", F.lit(i).alias("level"))
        won = kept(new if won is None else won.unionByName(new))
    return places.select(F.col("o.id").alias("id"), F.lit(0).alias("level")).limit(0) if won is None else won.select(F.col("o.id").alias("id"), "level")


def web_mercator_gsds(zooms=range(17), resolution: int = 1024) -> list[float]:
    return [40_075_016.6856 / (resolution * 2**z) for z in zooms]


def partition_text(column: str) -> Column:
    """A partition value as text that keeps null, the empty text and the null mark apart."""
    v = F.col(column).cast("string")
    return F.when(v == "", F.lit("%00")).when(v == NULL_PART, F.lit("%5F" + NULL_PART[1:])).otherwise(F.regexp_replace(v, "%", "%25"))


def partition_value(column: str) -> Column:
    v = F.col(column)
    return F.when(v == "%00", F.lit("")).when(v == "%5F" + NULL_PART[1:], F.lit(NULL_PART)).otherwise(F.regexp_replace(v, "%25", "%"))


def write_partitioned(df: DataFrame, columns: list[str], path: str) -> None:
    """Hive folders for the values of columns; more than MAX_PARTS of them are refused before anything is written."""
    parts = df.select(*columns).distinct().limit(MAX_PARTS + 1).count()
    if parts > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} partitions")
    text = df.select(*[c for c in df.columns if c not in columns], *[partition_text(c).alias(c) for c in columns])
    text.write.partitionBy(*columns).parquet(path)


def read_partitioned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    old = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", old)
    return df.select(*[c for c in df.columns if c not in columns], *[partition_value(c).alias(c) for c in columns])


def adaptive_split(df: DataFrame, x: Column, y: Column, side: float, target_rows: int, max_depth: int) -> DataFrame:
    """df with part: the largest square of a quadtree that holds at most target_rows rows, or one of max_depth. Null places have part null.

    Rows are counted once, in the smallest squares. Every larger square's count follows from those, and a row lies as deep as there are
    squares around it that hold too many. More than MAX_PARTS parts are refused, as in write_partitioned().
    """
    top = side / 2**max_depth
    placed = df.withColumn("__ix", F.floor(x / top)).withColumn("__iy", F.floor(y / top))
    cells = placed.where("__ix is not null and __iy is not null").groupBy("__ix", "__iy").agg(F.count(F.lit(1)).alias("n"))
    around = F.array(*[F.struct(F.lit(d).alias("d"), F.floor(F.col("__ix") / 2 ** (max_depth - d)).alias("cx"), F.floor(F.col("__iy") / 2 ** (max_depth - d)).alias("cy")) for d in range(max_depth)]) if max_depth else None
    if max_depth:
        above = cells.withColumn("a", F.explode(around))
        big = above.groupBy("a").agg(F.sum("n").alias("all")).where(F.col("all") > target_rows).select("a")
        depth = kept(above.join(big, "a", "left_semi").groupBy("__ix", "__iy").agg(F.count(F.lit(1)).cast("int").alias("__d")))
        parts = cells.join(depth, ["__ix", "__iy"], "left").withColumn("__d", F.coalesce("__d", F.lit(0)))
        scale = F.pow(F.lit(2.0), F.lit(max_depth) - F.col("__d"))
        n = parts.select("__d", F.floor(F.col("__ix") / scale), F.floor(F.col("__iy") / scale)).distinct().limit(MAX_PARTS + 1).count()
        if n > MAX_PARTS:
            raise ValueError(f"more than {MAX_PARTS} partitions")
        placed = placed.join(depth, ["__ix", "__iy"], "left").withColumn("__d", F.coalesce("__d", F.lit(0)))
    else:
        placed = placed.withColumn("__d", F.lit(0))
    scale = F.pow(F.lit(2.0), F.lit(max_depth) - F.col("__d"))
    path = F.concat_ws("/", "__d", F.floor(F.col("__ix") / scale), F.floor(F.col("__iy") / scale))
    return placed.withColumn("part", F.when(F.col("__ix").isNotNull() & F.col("__iy").isNotNull(), path)).select(*df.columns, "part")


def overlap_metric(boxes: DataFrame, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax", id_="id", most: int = 4096) -> DataFrame:
    """avg_overlaps: how many others each of the first `most` boxes meets on average, touching included."""
    a = boxes.orderBy(id_).limit(most).select(F.col(id_).alias("i"), *[F.col(c).alias(f"a{n}") for n, c in enumerate((xmin, ymin, xmax, ymax))])
    b = a.select(F.col("i").alias("j"), *[F.col(f"a{n}").alias(f"b{n}") for n in range(4)])
    # At most 4096 boxes on either side.
    met = a.join(F.broadcast(b), (F.col("i") != F.col("j")) & (F.col("a0") <= F.col("b2")) & (F.col("b0") <= F.col("a2")) & (F.col("a1") <= F.col("b3")) & (F.col("b1") <= F.col("a3")))
    n = a.count()
    return met.agg((F.count(F.lit(1)) / F.lit(max(1, n))).alias("avg_overlaps"))


def geo_document(primary: str, types: list[str], bbox: tuple | None, projjson=None, missing_crs: bool = True, covering: str | None = None) -> str:
    column: dict = {"encoding": "WKB", "geometry_types": sorted(types)}
    if not missing_crs:
        column["crs"] = projjson
    if bbox:
        column["bbox"] = list(bbox)
    if covering:
        column["covering"] = {"bbox": {c: [covering, c] for c in ("xmin", "ymin", "xmax", "ymax")}}
    return json.dumps({"version": "1.1.0", "primary_column": primary, "columns": {primary: column}})


def store_of(path: str):
    """The pyarrow file system of a path or address, and the path in it."""
    import os

    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def write_geoparquet(df: DataFrame, geometry: str, path: str, row_group_rows: int = 65_536, sort: bool = True, files: int | None = None, row_group_bytes: int = 128 << 20, compression: str = "zstd", covering: bool = True,
                     crs: dict | None | str = "", gsds: list[float] | None = None) -> dict:
    """Write a GeoParquet 1.1 dataset with a covering and, if sorted, in Hilbert order; path must be a folder all executors reach.

    Files go to a staging folder beside path, which takes its name when all are there: a failed job leaves nothing, a task that
    runs again replaces its own file. A folder with files in it is refused. Row groups hold row_group_rows rows, or fewer where
    those would be more than row_group_bytes. crs is a PROJJSON object, or None for an unknown one; left out, it is lon/lat.
    With gsds, df has a column level as of cogp_levels(), which is not written: each file goes from its coarsest level to its finest,
    no row group holds two, and the footer tells where each ends. Returns rows and files.
    """
    import numpy as np
    from pyarrow import fs
    from pyspark.sql.pandas.types import to_arrow_schema

    if gsds and not (sort and covering):
        raise ValueError("levels need the sort and the covering")
    boxed = covered(df, geometry) if covering or sort else df
    box = [c for c in boxed.columns if c not in df.columns or c == "bbox"][-1] if covering or sort else None
    out = hilbert_of_box(boxed, box) if sort else boxed
    if sort:
        near = F.col("hilbert").asc_nulls_last()
        ranges = out.repartitionByRange(files, near) if files else out.repartitionByRange(near)
        out = ranges.sortWithinPartitions(*(["level"] if gsds else []), near).drop("hilbert")
    elif files:
        out = out.repartition(files)
    if box and not covering:
        out = out.drop(box)
    if gsds:
        out = out.select(*[c for c in out.columns if c != "level"], F.col("level").alias("__level"))
    target = to_arrow_schema(out.drop("__level").schema)
    store, base = store_of(path)
    base = base.rstrip("/")
    if store.get_file_info(base).type != fs.FileType.NotFound and store.get_file_info(fs.FileSelector(base)):
        raise FileExistsError(path)
    staging = f"{base}.{uuid.uuid4().hex}.partial"

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        from terrane.functions import wkb
        from terrane.operators.view import cogp_document

        here, _ = store_of(path)
        final = f"{staging}/part-{TaskContext.get().partitionId():05d}.parquet"
        staged = f"{final}.{uuid.uuid4().hex}.partial"
        types, bounds, rows, writer = set(), None, 0, None
        at = target.get_field_index(geometry)
        held: list = []
        groups, current, ends = 0, 0, [0] * len(gsds or ())

        def flush(everything: bool) -> None:
            """Write full row groups, and what is left at the end."""
            nonlocal writer, groups
            table = pa.Table.from_batches(held)
            held.clear()
            n = row_group_rows
            if table.nbytes > row_group_bytes:
                n = max(1, min(n, table.num_rows * row_group_bytes // table.nbytes))
            end = table.num_rows if everything else table.num_rows // n * n
            writer = writer or pq.ParquetWriter(staged, target, filesystem=here, compression=compression, write_page_index=True)
            for start in range(0, end, n):
                writer.write_table(table.slice(start, min(n, end - start)), row_group_size=n)
                groups += 1
            if end < table.num_rows:
                held.extend(table.slice(end).to_batches())

        for batch in batches:
            part = pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, target)], schema=target)
            shapes = part.column(at).to_pylist()
            if simple := wkb.simple_shapes(shapes):
                edges, is_point = simple
                there = ~np.isnan(edges[:, 0])
                found = [n for n, some in (("Point", is_point), ("Polygon", there & ~is_point)) if some.any()]
                edges = edges[there]
                met = [(*edges[:, :2].min(axis=0).tolist(), *edges[:, 2:].max(axis=0).tolist())] if len(edges) else []
            else:
                decoded = [g for g in map(wkb.decode, shapes) if g]
                found, met = {g[0] for g in decoded}, [b for b in map(wkb.bounds, decoded) if b]
            types.update(found)
            for b in met:
                bounds = b if bounds is None else (min(b[0], bounds[0]), min(b[1], bounds[1]), max(b[2], bounds[2]), max(b[3], bounds[3]))
            rows += part.num_rows
            # Runs of one level; a batch is one run without levels.
            marks = batch.column(len(target)).to_numpy() if gsds else np.zeros(part.num_rows)
            starts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), part.num_rows]
            for start, end in zip(starts, starts[1:]):
                if end > start and gsds and marks[start] != current:
                    if held:
                        flush(True)
                    ends[current : marks[start]] = [groups] * (marks[start] - current)
                    current = int(marks[start])
                held.append(part.slice(start, end - start))
                if sum(p.num_rows for p in held) >= row_group_rows or sum(p.nbytes for p in held) >= row_group_bytes:
                    flush(False)
        if held:
            flush(True)
        if writer is not None:
            described = {"projjson": None if crs == "" else crs, "missing_crs": crs == ""}
            writer.add_key_value_metadata({"geo": geo_document(geometry, list(types), bounds, covering=box if covering else None, **described)})
            if gsds:
                ends[current:] = [groups] * (len(ends) - current)
                writer.add_key_value_metadata({"cogp": cogp_document(gsds, ends)})
            writer.close()
            here.move(staged, final)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    store.create_dir(staging)
    try:
        counts = out.mapInArrow(write, "rows long").agg(F.sum("rows"), F.count("rows")).first()
        if not counts[0]:
            raise ValueError("no rows to export")
        # What tasks that were lost on the way left behind.
        for left in store.get_file_info(fs.FileSelector(staging)):
            if left.path.endswith(".partial"):
                store.delete_file(left.path)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)
        store.move(staging, base)
    except BaseException:
        store.delete_dir(staging)
        raise
    return {"rows": counts[0], "files": counts[1]}


def footer(path: str) -> list[dict]:
    """Each row group of a dataset: file, rows, bytes, codec of the geometry and its box from the covering's statistics."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    from terrane.operators.view import cogp_problems

    store, base = store_of(path)
    inside = store.get_file_info(fs.FileSelector(base)) if store.get_file_info(base).type == fs.FileType.Directory else [store.get_file_info(base)]
    out = []
    for p in sorted(f.path for f in inside if f.path.endswith(".parquet") or len(inside) == 1):
        meta = pq.read_metadata(p, filesystem=store)
        geo = json.loads((meta.metadata or {}).get(b"geo", b"{}"))
        levels = (meta.metadata or {}).get(b"cogp")
        problems = cogp_problems(levels.decode(errors="replace"), meta.num_row_groups) if levels else []
        primary = geo.get("primary_column")
        cover = next(iter(((geo.get("columns") or {}).get(primary, {}).get("covering") or {}).get("bbox", {"": [None]}).values()))[0]
        for g in range(meta.num_row_groups):
            group, stats = meta.row_group(g), {}
            for c in range(group.num_columns):
                col = group.column(c)
                if cover and col.path_in_schema.startswith(f"{cover}.") and col.statistics and col.statistics.has_min_max:
                    name = col.path_in_schema.rsplit(".", 1)[1]
                    stats[name] = col.statistics.min if name.endswith("min") else col.statistics.max
                if col.path_in_schema == primary:
                    stats |= {"codec": col.compression, "indexed": col.has_offset_index}
            out.append({"file": p, "rows": group.num_rows, "bytes": group.total_byte_size, "geo": geo, "box": tuple(stats[k] for k in ("xmin", "ymin", "xmax", "ymax")) if {"xmin", "ymin", "xmax", "ymax"} <= stats.keys() else None, "problems": problems} | {k: stats.get(k) for k in ("codec", "indexed")})
    return out


def scorecard(path: str) -> dict:
    """Checks C1 to C8 of a dataset by its footers (levels that are not there are no fault), and whether it can be read by area: no gating check fails."""
    groups = footer(path)
    boxes = [g["box"] for g in groups if g["box"]]
    n = len(boxes)
    meets = sum(1 for i, a in enumerate(boxes[:4096]) for j, b in enumerate(boxes[:4096]) if i != j and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3])
    overlaps = meets / min(n, 4096) if n else 0.0
    column = next(iter((groups[0]["geo"].get("columns") or {}).values()), {}) if groups else {}
    mean_rows = sum(g["rows"] for g in groups) / max(1, len(groups))
    small = len(groups) > 1 and mean_rows < 16_000 and max(g["bytes"] for g in groups) < 4 << 20
    checks = {
        "C1": "pass" if n == len(groups) and n else "fail",
        "C2": "pass" if overlaps <= max(2.0, 0.3 * (n - 1)) else "fail",
        "C3": "fail" if any(g["rows"] > 512_000 or g["bytes"] > 128 << 20 for g in groups) else "warn" if small else "pass",
        "C4": "warn" if column.get("encoding", "WKB") == "WKB" else "pass",
        "C5": "pass" if all(g["indexed"] for g in groups) else "warn",
        "C6": "warn" if any(g["codec"] == "UNCOMPRESSED" for g in groups) else "pass",
        "C7": "pass" if column.get("geometry_types") and column.get("bbox") else "warn",
        "C8": "warn" if any(g.get("problems") for g in groups) else "pass",
    }
    return checks | {"overlaps": overlaps, "row_groups": len(groups), "rows": sum(g["rows"] for g in groups), "indexable": "fail" not in (checks["C1"], checks["C2"], checks["C3"])}


def plan_viewport(groups: list[dict], rect: tuple[float, float, float, float]) -> dict:
    """What to read for a rectangle: the row groups it meets, and a stride if they are too many to show."""
    met = [i for i, g in enumerate(groups) if g["box"] is None or (g["box"][0] <= rect[2] and rect[0] <= g["box"][2] and g["box"][1] <= rect[3] and rect[1] <= g["box"][3])]
    rows, size = sum(groups[i]["rows"] for i in met), sum(groups[i]["bytes"] for i in met)
    if rows > 2_500_000 or size > 256 << 20:
        return {"groups": met, "mode": "preview", "stride": max(-(-rows // 1_200_000), -(-size // (128 << 20)), 2)}
    return {"groups": met, "mode": "rect" if len(met) < len(groups) else "all", "stride": 1}
