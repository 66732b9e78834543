"""Constraints on where samples may lie: access, existing plots, minimum distance, focal windows, quotas."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..session import checkpointed
from ..sources.raster import GridMeta, Raster, same_crs
from ..sources.vector import Vector

#: Candidates that one task thins at most; larger pools are thinned in rounds by joins.
KERNEL_LIMIT = 50_000
#: Existing plots, and vertices of polygons over all cells, that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_PLOTS, BROADCAST_VERTICES = 1_000_000, 1_000_000


# ---------------------------------------------------------------------- access


def check_buffers(buff_inner: float | None, buff_outer: float | None) -> tuple[float, float]:
    inner = 0.0 if buff_inner is None or buff_inner < 0 else float(buff_inner)
    if buff_outer is None or buff_outer <= 0:
        raise ValueError("buff_outer must be given, and above 0, with access lines")
    if inner >= buff_outer:
        raise ValueError("buff_outer must be larger than buff_inner")
    return inner, float(buff_outer)


def within(points: DataFrame, segments: DataFrame, distance: float, how: str) -> DataFrame:
    """The points (x, y and other columns) that lie (left_semi) or don't lie (left_anti) within a distance of a segment.

    Segments are dealt to all square cells that their box, widened by the distance, touches; points meet only those of their cell.
    """
    size = distance * 4
    cell = lambda v: F.floor(v / F.lit(size)).cast("long")
    near = segments.select("x1", "y1", "x2", "y2")
    d = F.lit(distance)
    near = near.withColumn("cx", F.explode(F.sequence(cell(F.least("x1", "x2") - d), cell(F.greatest("x1", "x2") + d))))
    near = near.withColumn("cy", F.explode(F.sequence(cell(F.least("y1", "y2") - d), cell(F.greatest("y1", "y2") + d))))
    close = geometry.segment_distance_squared(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) <= F.lit(distance * distance)
    rows = points.withColumns({"px__": cell(F.col("x")), "py__": cell(F.col("y"))})
    return rows.join(near, (F.col("px__") == F.col("cx")) & (F.col("py__") == F.col("cy")) & close, how).drop("px__", "py__")


def accessible(points: DataFrame, meta: GridMeta, access: Vector, layer: str | None, buff_inner: float | None, buff_outer: float | None, mode: str = "centre") -> DataFrame:
    """The points within buff_outer, and not within buff_inner, of the access lines.

    mode: centre tests the points alone; all_touched asks that a pixel's whole square be accessible, by narrowing both
    distances by half its diagonal.
    """
    if not same_crs(meta.crs, access.crs):
        raise ValueError("the raster and the access lines have different coordinate systems")
    if mode not in ("centre", "all_touched"):
        raise ValueError("mode is centre or all_touched")
    inner, outer = check_buffers(buff_inner, buff_outer)
    half = math.hypot(meta.pixel_width, meta.pixel_height) / 2 if mode == "all_touched" else 0.0
    segments = access.segments(layer)
    if outer - half <= 0:
        return points.where(F.lit(False))
    points = within(points, segments, outer - half, "left_semi")
    return within(points, segments, inner + half, "left_anti") if inner + half > 0 and inner > 0 else points


def accessible_area(raster: Raster, access: Vector, layer: str | None, buff_inner: float | None, buff_outer: float | None, mode: str = "centre") -> DataFrame:
    """One row: accessible pixels and their area."""
    rows = accessible(placed(raster), raster.meta, access, layer, buff_inner, buff_outer, mode)
    area = abs(raster.meta.geotransform[1] * raster.meta.geotransform[5] - raster.meta.geotransform[2] * raster.meta.geotransform[4])
    return rows.agg(F.count("*").alias("pixels")).select("pixels", (F.col("pixels") * F.lit(area)).alias("area"))


def placed(raster: Raster, *bands: str) -> DataFrame:
    """row, col, pix, x and y of the pixels, and the named bands."""
    gt = raster.meta.geotransform
    x, y = geometry.pixel_x(gt, F.col("col"), F.col("row")), geometry.pixel_y(gt, F.col("col"), F.col("row"))
    return raster.pixels(*bands).withColumns({"x": x, "y": y})


def existing_pixels(raster: Raster, existing: Vector, layer: str | None = None) -> DataFrame:
    """fid, x, y, row, col and pix of the existing plots inside the grid: of several in a pixel, the one with the smallest fid."""
    if not same_crs(raster.meta.crs, existing.crs):
        raise ValueError("the raster and the existing plots have different coordinate systems")
    gt, m = raster.meta.geotransform, raster.meta
    rows = existing.points(layer).select("fid", "x", "y")
    rows = rows.withColumns({"row": geometry.point_row(gt, F.col("x"), F.col("y")), "col": geometry.point_col(gt, F.col("x"), F.col("y"))})
    rows = rows.where(F.col("row").between(0, m.height - 1) & F.col("col").between(0, m.width - 1))
    rows = rows.withColumn("pix", F.col("row").cast("long") * m.width + F.col("col"))
    first = F.min_by(F.struct("fid", "x", "y", "row", "col"), F.struct("fid", "x", "y")).alias("p")
    return rows.groupBy("pix").agg(first).select("p.*", "pix")


# ---------------------------------------------------------------------- minimum distance


def _greedy(mindist: float, most: int | None):
    limit = mindist * mindist

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows:
            return
        pool = pd.concat(rows, ignore_index=True).sort_values(["priority", "pix"], kind="stable")
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        kept = []
        for k, x, y in zip(pool.index, pool["x"], pool["y"], strict=True):
            if most is not None and len(kept) >= most:
                break
            a, b = math.floor(x / mindist), math.floor(y / mindist)
            near = (p for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for p in cells.get((i, j), ()))
            if all((x - u) ** 2 + (y - v) ** 2 >= limit for u, v in near):
                kept.append(k)
                cells.setdefault((a, b), []).append((x, y))
        yield pool.loc[kept]

    return run


def _conflicts(pool: DataFrame, mindist: float) -> DataFrame:
    """Pairs of pixels too close to each other: first comes before second in priority."""
    cell = lambda v: F.floor(F.col(v) / F.lit(mindist)).cast("long")
    own = pool.select("pix", "x", "y", "priority", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = own.select(F.col("pix").alias("second"), F.col("x").alias("u"), F.col("y").alias("v"), F.struct("priority", "pix").alias("q"), F.explode(around).alias("c"))
    spread = spread.select("second", "u", "v", "q", "c.cx", "c.cy")
    close = (F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2 < F.lit(mindist * mindist)
    return own.join(spread, ["cx", "cy"]).where(close & (F.struct("priority", "pix") < F.col("q"))).select(F.col("pix").alias("first"), "second")


def thinned(pool: DataFrame, mindist: float, kernel_limit: int = KERNEL_LIMIT, size: int | None = None) -> DataFrame:
    """The pixels (pix, x, y, priority and others) that a pass in order of priority accepts, none closer to another than mindist.

    Small pools: one task. Larger ones: rounds that accept every open pixel without an open neighbour of higher priority and
    reject its neighbours, with the same result.
    """
    if mindist <= 0:
        return pool
    if (pool.count() if size is None else size) <= kernel_limit:
        return pool.repartition(1).mapInPandas(_greedy(mindist, None), pool.schema)
    pool = checkpointed(pool)
    edges = checkpointed(_conflicts(pool, mindist))
    open_, accepted = pool.select("pix"), []
    while not open_.isEmpty():
        won = checkpointed(open_.join(edges.select(F.col("second").alias("pix")), "pix", "left_anti"))
        lost = edges.join(won.select(F.col("pix").alias("first")), "first", "left_semi").select(F.col("second").alias("pix")).distinct()
        accepted.append(won)
        gone = checkpointed(won.unionByName(lost).distinct())
        open_ = checkpointed(open_.join(gone, "pix", "left_anti"))
        edges = edges.join(gone.select(F.col("pix").alias("first")), "first", "left_anti")
        edges = checkpointed(edges.join(gone.select(F.col("pix").alias("second")), "second", "left_anti").select("first", "second"))
    won = accepted[0]
    for more in accepted[1:]:
        won = won.unionByName(more)
    return pool.join(won, "pix", "left_semi")


def first_thinned(candidates: DataFrame, mindist: float, n: int, kernel_limit: int = KERNEL_LIMIT) -> DataFrame:
    """The first n pixels that a pass over all candidates in order of priority accepts.

    The pass depends only on what comes before, so a prefix of the order is enough as long as it yields n; it grows until it does.
    """
    if n <= 0:
        return candidates.where(F.lit(False))
    if mindist <= 0:
        return candidates.orderBy("priority", "pix").limit(n)
    total, size = candidates.count(), max(4096, 16 * n)
    while True:
        pool = candidates.orderBy("priority", "pix").limit(size) if size < total else candidates
        kept = checkpointed(thinned(pool, mindist, kernel_limit, min(size, total)))
        if size >= total or kept.count() >= n:
            return kept.orderBy("priority", "pix").limit(n)
        size *= 8


# ---------------------------------------------------------------------- focal windows


def focal(strata: DataFrame, wrow: int = 3, wcol: int = 3, strat: str = "strat", others: Sequence[str] = ()) -> DataFrame:
    """The data pixels with row, col, strat, the named other columns, and eligible: whether the window of wrow x wcol pixels about it is full of its stratum.

    Two passes of window functions: along rows, then along columns. Pixels at the edge and beside nodata never are.
    """
    for w in (wrow, wcol):
        if w not in (3, 5, 7):
            raise ValueError("wrow and wcol are 3, 5 or 7")
    rows = strata.where(F.col(strat).isNotNull()).select("row", "col", F.col(strat).alias("strat"), *others)
    h, v = wcol // 2, wrow // 2
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-h, h)
    rows = rows.withColumn("hok", (F.count("*").over(along) == wcol) & (F.min("strat").over(along) == F.max("strat").over(along)))
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-v, v)
    full = (F.count("*").over(down) == wrow) & F.bool_and("hok").over(down) & (F.min("strat").over(down) == F.max("strat").over(down))
    return rows.withColumn("eligible", full).drop("hok")


# ---------------------------------------------------------------------- quotas


def quota_fill(pool: DataFrame, quotas: list[int], mindist: float, total: int, taken: DataFrame | None = None) -> DataFrame:
    """Round-robin: each open stratum tries its next candidate in turn, until its quota or its candidates are used up.

    pool: pix, x, y, strat, priority, stage (earlier stages go first, each as a pass of its own); bounded by the caller. taken: the
    same columns, accepted beforehand: they count for the quotas and keep their distance.
    """
    limit = mindist * mindist
    kind = pool.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True).sort_values(["stage", "priority", "pix"], kind="stable").reset_index(drop=True)
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        count, kept, pixels = [0] * len(quotas), [], set()

        def free(x: float, y: float) -> bool:
            if not mindist:
                return True
            a, b = math.floor(x / mindist), math.floor(y / mindist)
            return all((x - u) ** 2 + (y - v) ** 2 >= limit for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for u, v in cells.get((i, j), ()))

        def take(k: int) -> None:
            x, y = rows.at[k, "x"], rows.at[k, "y"]
            count[int(rows.at[k, "strat"])] += 1
            pixels.add(rows.at[k, "pix"])
            if mindist:
                cells.setdefault((math.floor(x / mindist), math.floor(y / mindist)), []).append((x, y))

        for stage in sorted(rows["stage"].unique()):
            mine = rows[rows["stage"] == stage]
            if stage < 0:
                for k in mine.index:
                    take(k)
                continue
            queues = {int(s): iter(part.index) for s, part in mine.groupby("strat", sort=True)}
            open_ = sorted(queues)
            while open_ and sum(count) < total:
                for s in list(open_):
                    if count[s] >= quotas[s] or sum(count) >= total:
                        open_.remove(s)
                        continue
                    k = next(queues[s], None)
                    if k is None:
                        open_.remove(s)
                    elif rows.at[k, "pix"] not in pixels and free(rows.at[k, "x"], rows.at[k, "y"]):
                        take(k)
                        kept.append(k)
        yield rows.loc[kept]

    if taken is not None:
        pool = pool.unionByName(taken.withColumn("stage", F.lit(-1)).select(*pool.columns))
    return pool.repartition(1).mapInPandas(run, kind)


def _in_cells(polygons: DataFrame, cell: float | None, *columns: str) -> tuple[DataFrame, float]:
    """The polygons (fid, rings, named columns) once for each square cell (cx, cy) that their boxes touch, and the side of the cells."""
    xs, ys = F.flatten(F.col("rings"))["x"], F.flatten(F.col("rings"))["y"]
    boxes = polygons.select("fid", "rings", *columns, F.array_min(xs).alias("x1"), F.array_max(xs).alias("x2"), F.array_min(ys).alias("y1"), F.array_max(ys).alias("y2"))
    if cell is None:
        got = boxes.agg(F.max("x2") - F.min("x1"), F.max("y2") - F.min("y1")).first()
        cell = max(got[0] or 0.0, got[1] or 0.0) / 100 or 1.0
    at = lambda v: F.floor(v / F.lit(cell)).cast("long")
    boxes = boxes.withColumn("cx", F.explode(F.sequence(at(F.col("x1")), at(F.col("x2")))))
    return boxes.withColumn("cy", F.explode(F.sequence(at(F.col("y1")), at(F.col("y2"))))), cell


def with_polygon(points: DataFrame, polygons: DataFrame, column: str, cell: float | None = None) -> DataFrame:
    """The points (pix, x, y and others) with ``column`` of the polygon (fid, rings, column) that holds them, of several that with the largest fid; else null.

    Points meet polygons through square cells; cell: their side, by default a hundredth of the polygons' whole extent. While the polygons have few vertices, the lists of
    those of each cell are broadcast, and points are not shuffled.
    """
    boxes, cell = _in_cells(polygons, cell, column)
    vertices = boxes.agg(F.sum(F.size(F.flatten("rings")))).first()[0] or 0
    at = lambda v: F.floor(v / F.lit(cell)).cast("long")
    rows = points.withColumns({"cx": at(F.col("x")), "cy": at(F.col("y"))})
    if vertices <= BROADCAST_VERTICES:
        lists = boxes.groupBy("cx", "cy").agg(F.collect_list(F.struct("fid", "rings", column)).alias("polygons__"))
        rows = rows.join(F.broadcast(lists), ["cx", "cy"], "left")
        inside = F.filter("polygons__", lambda p: geometry.in_polygon(F.col("x"), F.col("y"), p["rings"]))
        last = F.array_max(F.transform(inside, lambda p: F.struct(p["fid"].alias("fid"), p[column].alias("v"))))
        return rows.select(*points.columns, last["v"].alias(column))
    found = rows.select("pix", "x", "y", "cx", "cy").join(boxes, ["cx", "cy"]).where(geometry.in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    return points.join(found.groupBy("pix").agg(F.max_by(column, "fid").alias(column)), "pix", "left").select(*points.columns, column)


def without_pixels(rows: DataFrame, plots: DataFrame) -> DataFrame:
    """The rows whose pix is none of the plots'; a counted number of plots is broadcast, so that the raster is not shuffled."""
    plots = plots.select("pix")
    return rows.join(F.broadcast(plots) if plots.count() <= BROADCAST_PLOTS else plots, "pix", "left_anti")
