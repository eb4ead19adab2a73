"""Grid summaries: square cells, statistics, smoothing, focal operators and contours.

Cells are a DataFrame (ix, iy, value, count). All steps are DataFrame algebra
on cell keys; only contour lines are stitched in Python, level by level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATISTICS = ("mean", "sum", "count", "density", "median", "majority", "minority")


def degrees_for(metres: float, latitude: float) -> tuple[float, float]:
    """The cell size in degrees, (sx, sy), for one in metres at a latitude."""
    return metres / (111_195 * max(math.cos(math.radians(latitude)), 0.01)), metres / 111_195


def point_weights(df: DataFrame, x: str | Column, y: str | Column, value: str, sx: float, sy: float, row: str | None = None) -> DataFrame:
    """Points as shares: ix, iy, v, w (1), q (1), row. Rows without finite place or value are left out; text values are trimmed."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    text = dict(df.dtypes)[value] == "string"
    v = F.trim(value) if text else F.col(value).cast("double")
    finite = lambda c: F.abs(F.col(c)) < float("inf")  # noqa: E731  nan is above all numbers
    good = finite("x") & finite("y") & ((F.col("v") != "") if text else finite("v"))
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"), v.alias("v"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row")).where(good)
    return rows.select(F.floor(F.col("x") / sx).alias("ix"), F.floor(F.col("y") / sy).alias("iy"), "v", F.lit(1.0).alias("w"), F.lit(1.0).alias("q"), "row")


def box_weights(df: DataFrame, edges: tuple[str, str, str, str], value: str, sx: float, sy: float, row: str) -> DataFrame:
    """Rectangles dealt to cells by their areas: w is the share of the rectangle in the cell, q the area there (1 without area)."""
    x0, y0, x1, y1 = (F.col(e) for e in edges)
    rows = df.select(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.col(value).alias("v"), F.col(row).alias("row"))
    whole = [F.abs(F.col(c)) < float("inf") for c in ("x0", "y0", "x1", "y1")]
    rows = rows.where(whole[0] & whole[1] & whole[2] & whole[3] & (F.col("v").isNotNull() if dict(df.dtypes)[value] == "string" else F.abs("v") < float("inf")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    flat = rows.where(area <= 0).select(F.floor((F.col("x0") + F.col("x1")) / 2 / sx).alias("ix"), F.floor((F.col("y0") + F.col("y1")) / 2 / sy).alias("iy"), "v", F.lit(1.0).alias("w"), F.lit(1.0).alias("q"), "row")
    cells = rows.where(area > 0).withColumn("ix", F.explode(F.sequence(F.floor(F.col("x0") / sx), F.floor(F.col("x1") / sx))))
    cells = cells.withColumn("iy", F.explode(F.sequence(F.floor(F.col("y0") / sy), F.floor(F.col("y1") / sy))))
    across = F.least("x1", (F.col("ix") + 1) * sx) - F.greatest("x0", F.col("ix") * sx)
    down = F.least("y1", (F.col("iy") + 1) * sy) - F.greatest("y0", F.col("iy") * sy)
    shares = cells.withColumn("q", across * down).where("q > 0").select("ix", "iy", "v", (F.col("q") / area).alias("w"), "q", "row")
    return shares.unionByName(flat)


def polygon_weights(df: DataFrame, geometry: str, value: str, sx: float, sy: float, row: str, sampled_beyond: int = 100_000) -> DataFrame:
    """Geometries dealt to cells by clipped area, holes taken out. Those without area go to the cell of their box's centre.

    A geometry over more than sampled_beyond cells is dealt by the cells' centres instead.
    """
    import pandas as pd

    from terrane.functions import kernels as k
    from terrane.functions import wkb

    def clip(ring, axis, at, keep_above):
        out = []
        for a, b in zip(ring, [*ring[1:], *ring[:1]]):
            ia, ib = (a[axis] >= at) == keep_above, (b[axis] >= at) == keep_above
            if ia:
                out.append(a)
            if ia != ib:
                t = (at - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(at if j == axis else a[j] + t * (b[j] - a[j]) for j in (0, 1)))
        return out

    def deal(batches):
        for pdf in batches:
            rows = []
            for data, v, r in zip(pdf[geometry], pdf[value], pdf[row]):
                g = wkb.decode(data)
                box = wkb.bounds(g)
                if box is None or v is None or not all(map(math.isfinite, box)) or not isinstance(v, str) and not math.isfinite(v):
                    continue
                got, polygons = {}, wkb.polygons_of(g)
                i0, i1, j0, j1 = (math.floor(c / s) for c, s in ((box[0], sx), (box[2], sx), (box[1], sy), (box[3], sy)))
                many = (i1 - i0 + 1) * (j1 - j0 + 1) > sampled_beyond
                if (upright := k.upright(polygons)) and not many:
                    for i in range(i0, i1 + 1):
                        across = min(box[2], (i + 1) * sx) - max(box[0], i * sx)
                        for j in range(j0, j1 + 1):
                            down = min(box[3], (j + 1) * sy) - max(box[1], j * sy)
                            if across > 0 and down > 0:
                                got[i, j] = across * down
                for rings in polygons if not upright or many else ():
                    for n, ring in enumerate(rings):
                        sign = -1 if n else 1
                        for i in range(i0, i1 + 1):
                            strip = ring if many else clip(clip(ring, 0, i * sx, True), 0, (i + 1) * sx, False)
                            for j in range(j0, j1 + 1) if len(strip) > 2 else ():
                                if many:
                                    part = sx * sy * (k.in_ring(((i + 0.5) * sx, (j + 0.5) * sy), ring) > 0)
                                else:
                                    cell = clip(clip(strip, 1, j * sy, True), 1, (j + 1) * sy, False)
                                    part = abs(k.ring_area(cell)) if len(cell) > 2 else 0.0
                                if part:
                                    got[i, j] = got.get((i, j), 0.0) + sign * part
                total = sum(max(q, 0.0) for q in got.values())
                if total > 0:
                    rows += [(i, j, v, q / total, q, r) for (i, j), q in got.items() if q > 0]
                else:
                    rows.append((math.floor((box[0] + box[2]) / 2 / sx), math.floor((box[1] + box[3]) / 2 / sy), v, 1.0, 1.0, r))
            yield pd.DataFrame(rows, columns=["ix", "iy", "v", "w", "q", "row"])

    kinds = dict(df.dtypes)
    return df.select(geometry, value, row).mapInPandas(deal, f"ix bigint, iy bigint, v {kinds[value]}, w double, q double, row {kinds[row]}")


def summarise(weights: DataFrame, statistic: str, sx: float, sy: float) -> DataFrame:
    """ix, iy, value and count (the sum of shares) of each cell.

    majority and minority go by the covered quantity, ties to the value seen first; the median is the first value at
    which half of the weight is reached. Text takes majority and minority only.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"no statistic {statistic!r}")
    if dict(weights.dtypes)["v"] == "string" and statistic not in ("majority", "minority"):
        raise ValueError("text values take majority or minority")
    keys = ["ix", "iy"]
    wv = F.sum(F.col("w") * F.col("v")) if statistic in ("mean", "sum", "density") else None
    count = F.sum("w").alias("count")
    if statistic in ("mean", "sum", "count", "density"):
        value = {"mean": lambda: wv / F.greatest(F.sum("w"), F.lit(1e-300)), "sum": lambda: wv, "count": lambda: F.sum("w"), "density": lambda: wv / F.lit(sx * sy)}[statistic]()
        return weights.groupBy(*keys).agg(value.alias("value"), count)
    if statistic == "median":
        # Equal values are summed before any window, so that a cell's window holds its distinct values only.
        by_value = weights.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
        order = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        reached = by_value.withColumn("run", F.sum("w").over(order)).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
        return reached.groupBy(*keys).agg(F.min(F.when(F.col("run") >= F.col("all") / 2, F.col("v"))).alias("value"), F.sum("w").alias("count"))
    by_value = weights.groupBy(*keys, "v").agg(F.sum("q").alias("q"), F.sum("w").alias("w"), F.min("row").alias("seen"))
    sign = -1 if statistic == "majority" else 1
    best = F.min(F.struct((F.col("q") * sign).alias("q"), F.col("seen"), F.col("v")))["v"]
    return by_value.groupBy(*keys).agg(best.alias("value"), F.sum("w").alias("count"))


def _around(cells: DataFrame, weight=lambda dx, dy: 1.0) -> DataFrame:
    """Each present cell with itself and its present neighbours: ix, iy, dx, dy, nv, k. One shuffle: a cell is sent to its nine places."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(weight(dx, dy))).alias("k")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    sent = cells.select("ix", "iy", F.col("value").alias("nv"), "count", F.explode(offsets).alias("o"))
    return sent.select((F.col("ix") - F.col("o.dx")).alias("ix"), (F.col("iy") - F.col("o.dy")).alias("iy"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), "nv", F.col("o.k").alias("k"), "count")


def _own() -> Column:
    return F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("count"))).alias("count")


def _focal(cells: DataFrame, value: Column, weight=lambda dx, dy: 1.0) -> DataFrame:
    return _around(cells, weight).groupBy("ix", "iy").agg(value.alias("value"), _own()).where("count is not null")


def smooth(cells: DataFrame, passes: int = 1, gauss: bool = False) -> DataFrame:
    """Box or binomial (4, 2, 1) means over the present cells around."""
    weight = (lambda dx, dy: 4.0 / 2 ** (abs(dx) + abs(dy))) if gauss else (lambda dx, dy: 1.0)
    for _ in range(passes):
        cells = _focal(cells, F.sum(F.col("nv") * F.col("k")) / F.sum("k"), weight)
    return cells


def focal_std(cells: DataFrame) -> DataFrame:
    return _focal(cells, F.stddev_pop("nv"))


def opened(cells: DataFrame) -> DataFrame:
    return _focal(_focal(cells, F.min("nv")), F.max("nv"))


def closed(cells: DataFrame) -> DataFrame:
    return _focal(_focal(cells, F.max("nv")), F.min("nv"))


def hillshade(cells: DataFrame, sx: float, sy: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Light from a compass azimuth on the surface of values, whose iy grow northwards, 0 to 255. A missing neighbour counts as the cell itself; heights are scaled by the
    upper median of the gradients that are not zero."""
    at = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("nv")))
    names = {(dx, dy): f"n{dx + 1}{dy + 1}" for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    rows = _around(cells).groupBy("ix", "iy").agg(*[at(*d).alias(n) for d, n in names.items()], _own()).where("count is not null")
    v = {d: F.coalesce(n, names[0, 0]) for d, n in names.items()}
    gx = ((v[1, 1] + 2 * v[1, 0] + v[1, -1]) - (v[-1, 1] + 2 * v[-1, 0] + v[-1, -1])) / (8 * sx)
    gy = ((v[-1, 1] + 2 * v[0, 1] + v[1, 1]) - (v[-1, -1] + 2 * v[0, -1] + v[1, -1])) / (8 * sy)
    sloped = rows.select("ix", "iy", "count", gx.alias("gx"), gy.alias("gy")).withColumn("mag", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))
    steep = sloped.where("mag > 0")
    n = steep.count()
    middle = steep.orderBy("mag").offset(n // 2).limit(1).first() if n else None
    z = 1 / middle["mag"] if middle else 1.0
    az, alt = math.radians(azimuth), math.radians(altitude)
    slope, aspect = F.atan(F.col("mag") * z), F.atan2(-F.col("gx"), -F.col("gy"))  # the compass direction that falls most
    light = F.sin(F.lit(alt)) * F.cos(slope) + F.cos(F.lit(alt)) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    return sloped.select("ix", "iy", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), light)) * 255).alias("value"), "count")


def contour_levels(cells: DataFrame, n: int, quantile: bool = False) -> list[float]:
    """Up to n levels strictly inside the range of values: equal steps, or interpolated quantiles without repeats."""
    n = min(64, max(1, n))
    low, high = cells.agg(F.min("value"), F.max("value")).first()
    if low is None or low == high:
        raise ValueError("the surface is flat")
    if quantile:
        levels = cells.agg(F.percentile("value", F.array(*[F.lit(i / (n + 1)) for i in range(1, n + 1)]))).first()[0]
    else:
        levels = [low + (high - low) * i / (n + 1) for i in range(1, n + 1)]
    return sorted({v for v in levels if low < v < high})


def contour_lines(cells: DataFrame, levels: list[float], sx: float, sy: float) -> DataFrame:
    """level and geometry (WKB LineString) of the surface through the cells' centres; lines are stitched from the segments of cell squares."""
    import pandas as pd

    from terrane.functions import wkb

    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    sent = cells.select("ix", "iy", "value", corner.alias("o")).select((F.col("ix") - F.col("o.dx")).alias("ix"), (F.col("iy") - F.col("o.dy")).alias("iy"), "o.dx", "o.dy", "value")
    pick = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("value")))
    squares = sent.groupBy("ix", "iy").agg(pick(0, 0).alias("a"), pick(1, 0).alias("b"), pick(1, 1).alias("c"), pick(0, 1).alias("d")).dropna()
    crossed = squares.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where((F.least("a", "b", "c", "d") < F.col("level")) & (F.greatest("a", "b", "c", "d") >= F.col("level")))

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        level, ends = float(pdf["level"].iloc[0]), {}
        segments = []
        for ix, iy, a, b, c, d in pdf[["ix", "iy", "a", "b", "c", "d"]].itertuples(index=False):
            corners = [(ix + 0.5, iy + 0.5, a), (ix + 1.5, iy + 0.5, b), (ix + 1.5, iy + 1.5, c), (ix + 0.5, iy + 1.5, d)]
            cuts = []
            for i in range(4):
                p, q = corners[i], corners[(i + 1) % 4]
                if (p[2] >= level) != (q[2] >= level):
                    t = (level - p[2]) / (q[2] - p[2])
                    cuts.append((round((p[0] + t * (q[0] - p[0])) * sx, 9), round((p[1] + t * (q[1] - p[1])) * sy, 9)))
            if len(cuts) == 2:
                segments.append((cuts[0], cuts[1]))
            elif len(cuts) == 4:  # a saddle goes by its middle
                same = ((a + b + c + d) / 4 >= level) == (a >= level)
                segments += [(cuts[0], cuts[1]), (cuts[2], cuts[3])] if same else [(cuts[3], cuts[0]), (cuts[1], cuts[2])]
        for i, s in enumerate(segments):
            for p in s:
                ends.setdefault(p, []).append(i)
        used, out = set(), []
        for i in sorted(range(len(segments)), key=lambda i: min(len(ends[p]) for p in segments[i])):
            if i in used:
                continue
            used.add(i)
            line = list(segments[i])
            for _ in (0, 1):
                while (j := next((j for j in ends[line[-1]] if j not in used), None)) is not None:
                    used.add(j)
                    line.append(segments[j][1] if segments[j][0] == line[-1] else segments[j][0])
                line.reverse()
            out.append((level, wkb.encode(("LineString", line))))
        return pd.DataFrame(out, columns=["level", "geometry"])

    return crossed.groupBy("level").applyInPandas(stitch, "level double, geometry binary")


def cell_geometry(cells: DataFrame, sx: float, sy: float) -> DataFrame:
    """geometry, value, count and cell (ix:iy) of each cell."""
    from terrane.functions.spatial import st

    x, y = F.col("ix") * F.lit(sx), F.col("iy") * F.lit(sy)
    return cells.select(st("st_makeenvelope", x, y, x + sx, y + sy).alias("geometry"), "value", F.col("count").cast("double").alias("count"), F.concat_ws(":", "ix", "iy").alias("cell"))
