"""Sample networks: simple random, stratified, systematic and conditioned Latin hypercube.

All are seeded: the same seed gives the same samples on any partitioning. Each returns a table of samples with row, col, x and y,
``existing`` (0 or 1) if existing plots are given, and strata for stratified samples; ``filename`` also stores it as a vector. ``plot`` is taken
and ignored: nothing is drawn.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.rng import priority, uniform
from ..session import checkpointed, scanned_again
from ..sources.raster import Raster, quoted, strata_column
from ..sources.vector import Vector
from . import constraints, kernels
from .allocate import METHODS, allocate, optimal_weights
from .calculate import correlation_matrix, moments
from .stratify import binned, cutpoints

SEED = 42
#: Candidates that a quota fill with a minimum distance looks at for each sample, and at least.
POOL_FACTOR, POOL_LEAST = 64, 20_000


def _done(df: DataFrame, rast: Raster, filename: str) -> DataFrame:
    if filename:
        Vector.samples(df, rast.meta.crs).write(filename, "samples")
    return df


def _candidates(rast: Raster, rows: DataFrame, existing: DataFrame | None, access: Vector | None, layer_name, buff_inner, buff_outer, access_mode: str) -> DataFrame:
    if access is not None:
        rows = constraints.accessible(rows, rast.meta, access, layer_name, buff_inner, buff_outer, access_mode)
    if existing is not None:
        rows = constraints.without_pixels(rows, existing)
    return rows


def _check_samples(num_samples: int, mindist: float | None) -> float:
    if num_samples < 1:
        raise ValueError("num_samples is 1 or more")
    if mindist is not None and mindist < 0:
        raise ValueError("mindist is 0 or more")
    return float(mindist or 0)


def srs(
    rast: Raster, num_samples: int, mindist: float = 0, existing: Vector | None = None, access: Vector | None = None, layer_name: str | None = None,
    buff_inner: float | None = None, buff_outer: float | None = None, plot: bool = False, filename: str = "", seed: int = SEED, access_mode: str = "centre",
) -> DataFrame:
    """Simple random samples among the pixels with data in the first band, accessible and without an existing plot.

    Existing plots count towards num_samples and are all returned; mindist holds among the new samples. Fewer samples than asked
    for are no error.
    """
    mindist = _check_samples(num_samples, mindist)
    first = rast.meta.bands[0]
    plots = None if existing is None else checkpointed(constraints.existing_pixels(rast, existing))
    rows = constraints.placed(rast, first).where(quoted(first).isNotNull()).select("row", "col", "pix", "x", "y")
    rows = _candidates(rast, rows, plots, access, layer_name, buff_inner, buff_outer, access_mode)
    rows = rows.withColumn("priority", priority(seed, F.col("pix")))
    n = num_samples - (0 if plots is None else plots.count())
    out = constraints.first_thinned(rows, mindist, n).select("row", "col", "x", "y")
    if plots is not None:
        old = plots.select("row", "col", "x", "y", F.lit(1).alias("existing"))
        out = old.unionByName(out.withColumn("existing", F.lit(0)))
    return _done(out, rast, filename)


def strata_counts(rows: DataFrame, num_strata: int, mrast: Column | None = None) -> list[tuple[int, float]]:
    """Pixels of each stratum, and the population standard deviation of a column in it; strata without pixels included."""
    spread = F.stddev_pop(mrast) if mrast is not None else F.lit(None).cast("double")
    got = {r[0]: (r[1], r[2] or 0.0) for r in rows.groupBy("strat").agg(F.count("*"), spread).collect()}
    bad = [s for s in got if s is not None and not 0 <= s < num_strata]
    if bad:
        raise ValueError(f"the strata {sorted(bad)[:5]} are not from 0 to {num_strata - 1}")
    return [got.get(s, (0, 0.0)) for s in range(num_strata)]


def strat(
    strat_rast: Raster, num_samples: int, num_strata: int | None = None, wrow: int = 3, wcol: int = 3, band: int | str | None = None, allocation: str = "prop",
    weights: Sequence[float] | None = None, mrast: Raster | None = None, mrast_band: int | str | None = None, method: str = "Queinnec", mindist: float | None = None,
    existing: Vector | None = None, force: bool = False, access: Vector | None = None, layer_name: str | None = None, buff_inner: float | None = None,
    buff_outer: float | None = None, plot: bool = False, filename: str = "", seed: int = SEED, access_mode: str = "centre",
) -> DataFrame:
    """Stratified samples; quotas by ``allocation`` over all data pixels (whether or not accessible).

    random takes pixels of a stratum in random order; Queinnec first those in the middle of a window of their own stratum. With
    mindist, strata take turns and all samples keep their distance. Existing plots count towards the quotas of their strata, as far
    as these go; with ``force`` all of them are taken, and keep no distance.
    """
    mindist = _check_samples(num_samples, mindist)
    if method not in ("random", "Queinnec"):
        raise ValueError("method is random or Queinnec")
    if allocation not in METHODS:
        raise ValueError(f"allocation is one of {', '.join(METHODS)}")
    name = strat_rast.band_name(band)
    if name in strat_rast.strata:
        num_strata = strat_rast.strata[name].strata_count
    if num_strata is None or num_strata < 1:
        raise ValueError("num_strata must be given for a raster that isn't a strat raster")
    if allocation == "manual":
        if weights is None or len(weights) != num_strata:
            raise ValueError("there must be a weight for each stratum")
        if abs(sum(weights) - 1) > 1e-9:
            raise ValueError("the weights must sum to 1")
    if method == "Queinnec" and (wrow not in (3, 5, 7) or wcol not in (3, 5, 7)):
        raise ValueError("wrow and wcol are 3, 5 or 7")
    gt = strat_rast.meta.geotransform
    rows = strat_rast.pixels(name).withColumn("strat", strata_column(strat_rast, name)).where(F.col("strat").isNotNull()).select("row", "col", "pix", "strat")
    population, spread = rows, None
    if allocation == "optim":
        if mrast is None:
            raise ValueError("optim needs mrast")
        if not strat_rast.meta.same_grid(mrast.meta):
            raise ValueError("the rasters have different grids")
        covariate = mrast.band_name(mrast_band)
        population = rows.join(mrast.df.select("row", "col", quoted(covariate).cast("double").alias("m__")), ["row", "col"], "left")
        spread = F.col("m__")
    got = strata_counts(population, num_strata, spread)
    counts = [n for n, _ in got]
    if allocation == "optim":
        weights = optimal_weights(counts, [s for _, s in got])
        allocation = "prop" if weights is None else "optim"
    quotas = allocate(num_samples, allocation, counts, weights)
    rows = rows.withColumns({"x": geometry.pixel_x(gt, F.col("col"), F.col("row")), "y": geometry.pixel_y(gt, F.col("col"), F.col("row"))})
    rows = rows.withColumn("priority", priority(seed, F.col("pix")))
    plots, left = None, quotas
    if existing is not None:
        at = constraints.existing_pixels(strat_rast, existing)
        plots = at.join(rows.select("pix", "strat", "priority"), "pix").select("row", "col", "pix", "x", "y", "strat", "priority")
        if not force:
            plots = _within_quotas(plots, quotas)
            if mindist:
                # existing plots keep their distance from each other, in random order
                plots = constraints.quota_fill(plots.withColumn("stage", F.lit(0)), quotas, mindist, sum(quotas)).drop("stage")
        plots = checkpointed(plots)
        have = [n for n, _ in strata_counts(plots, num_strata)]
        left = [max(0, q - h) for q, h in zip(quotas, have, strict=True)]
    stage = F.lit(1)
    if method == "Queinnec":
        # the windows are those of all data pixels, accessible or not; what candidates need goes through them along
        rows = constraints.focal(rows, wrow, wcol, others=("pix", "x", "y", "priority"))
        stage = F.when(F.col("eligible"), 0).otherwise(1)
    rows = rows.withColumn("stage", stage)
    candidates = _candidates(strat_rast, rows, None if existing is None else constraints.existing_pixels(strat_rast, existing), access, layer_name, buff_inner, buff_outer, access_mode)
    picked = ["row", "col", "pix", "x", "y", "strat", "priority", "stage"]
    if mindist:
        out = _spaced(candidates.select(picked), left, mindist, sum(left), None if plots is None or force else plots)
    else:
        out = _within_quotas(candidates.select(picked), left, "stage", "priority")
    fields = strat_rast.strata[name].decode(F.col("strat")) if name in strat_rast.strata and strat_rast.strata[name].mapped else {name: F.col("strat")}
    keep = ["row", "col", "x", "y", *[c.alias(n) for n, c in fields.items()]]
    if plots is not None:
        keep.append("existing")
        out = out.withColumn("existing", F.lit(0)).unionByName(plots.withColumn("existing", F.lit(1)), allowMissingColumns=True)
    return _done(out.select(*keep), strat_rast, filename)


def _within_quotas(rows: DataFrame, quotas: list[int], *order: str) -> DataFrame:
    """The first rows of each stratum, as many as its quota.

    The constant bound on the rank lets each task keep only that many rows of a stratum before the shuffle, so that a stratum with most
    of the pixels is no hot group.
    """
    if not any(quotas):
        return rows.where(F.lit(False))
    rank = F.row_number().over(Window.partitionBy("strat").orderBy(*(order or ("priority",)), "pix"))
    quota = F.get(F.array(*map(F.lit, quotas)), F.col("strat"))
    return rows.withColumn("rank__", rank).where(F.col("rank__") <= max(quotas)).where(F.col("rank__") <= quota).drop("rank__")


def _spaced(candidates: DataFrame, quotas: list[int], mindist: float, total: int, taken: DataFrame | None) -> DataFrame:
    """Quota fill with distances: over the first candidates of each stratum, and over more of them as long as quotas stay open."""
    depth, kind = max(POOL_LEAST, POOL_FACTOR * max(quotas, default=0)), candidates.columns
    if not total:
        return candidates.where(F.lit(False))
    rank = F.row_number().over(Window.partitionBy("strat", "stage").orderBy("priority", "pix"))
    while True:
        pool = candidates.withColumn("rank__", rank).where(F.col("rank__") <= depth).drop("rank__").select(*kind)
        before = None if taken is None else taken.withColumn("stage", F.lit(-1)).select(*kind)
        out = checkpointed(constraints.quota_fill(pool, quotas, mindist, total, before))
        if out.count() >= total or candidates.groupBy("strat", "stage").count().where(F.col("count") > depth).isEmpty():
            return out
        depth *= 8


# ---------------------------------------------------------------------- systematic


def lattice(rast: Raster, cellsize: float, shape: str, rotation: float) -> DataFrame:
    """i, j, cx, cy: the cells, in the turned frame, that can touch the raster's extent.

    square: cells with sides of cellsize; hexagon: cells with edges of cellsize, a corner to the left and right.
    """
    m = rast.meta
    c, s = math.cos(math.radians(-rotation)), math.sin(math.radians(-rotation))
    corners = [(x * c - y * s, x * s + y * c) for x in (m.xmin, m.xmax) for y in (m.ymin, m.ymax)]
    x1, x2 = min(p[0] for p in corners), max(p[0] for p in corners)
    y1, y2 = min(p[1] for p in corners), max(p[1] for p in corners)
    dx, dy = (cellsize, cellsize) if shape == "square" else (1.5 * cellsize, math.sqrt(3) * cellsize)
    i1, i2, j1, j2 = math.floor(x1 / dx) - 1, math.ceil(x2 / dx) + 1, math.floor(y1 / dy) - 1, math.ceil(y2 / dy) + 1
    cells = rast.df.sparkSession.range(i1, i2 + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(j1).cast("long"), F.lit(j2).cast("long"))).alias("j"))
    if shape == "square":
        return cells.withColumns({"cx": (F.col("i") + 0.5) * F.lit(cellsize), "cy": (F.col("j") + 0.5) * F.lit(cellsize)})
    return cells.withColumns({"cx": F.col("i") * F.lit(dx), "cy": (F.col("j") + F.pmod(F.col("i"), F.lit(2)) * F.lit(0.5)) * F.lit(dy)})


def _in_hexagon(x: Column, y: Column, edge: float) -> Column:
    """About the origin, with corners to the left and right."""
    h = edge * math.sqrt(3) / 2
    return (F.abs(y) <= F.lit(h)) & (F.lit(math.sqrt(3)) * F.abs(x) + F.abs(y) <= F.lit(2 * h))


def systematic(
    rast: Raster, cellsize: float, shape: str = "square", location: str = "centers", existing: Vector | None = None, access: Vector | None = None,
    layer_name: str | None = None, buff_inner: float | None = None, buff_outer: float | None = None, force: bool = False, plot: bool = False, filename: str = "",
    seed: int = SEED, rotation: float | None = None, tries: int = 10,
) -> DataFrame:
    """Samples on a lattice turned by ``rotation`` degrees, random by default: cell centers, two corners of each cell, or random
    points in the cells (the first of ``tries`` that is valid).

    Points must lie in the extent, be accessible and not share a pixel with an existing plot; with ``force`` their pixel must have data
    in all bands. Existing plots are all returned.
    """
    if cellsize <= 0:
        raise ValueError("cellsize is above 0")
    if shape not in ("square", "hexagon"):
        raise ValueError("shape is square or hexagon")
    if location not in ("centers", "corners", "random"):
        raise ValueError("location is centers, corners or random")
    m = rast.meta
    if rotation is None:
        rotation = 180 * float(np.random.default_rng(seed).random())
    cells = lattice(rast, cellsize, shape, rotation)
    half = cellsize / 2 if shape == "square" else cellsize * math.sqrt(3) / 2
    wide = cellsize / 2 if shape == "square" else cellsize
    if location == "centers":
        points = cells.select("i", "j", F.lit(0).alias("k"), F.col("cx").alias("u"), F.col("cy").alias("v"))
    elif location == "corners":
        two = [(-half, -half), (half, -half)] if shape == "square" else [(-cellsize, 0.0), (-cellsize / 2, -half)]
        corner = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(two)])
        points = cells.select("i", "j", "cx", "cy", F.explode(corner).alias("c"))
        points = points.select("i", "j", "c.k", (F.col("cx") + F.col("c.a")).alias("u"), (F.col("cy") + F.col("c.b")).alias("v"))
    else:
        points = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
        key = (F.col("i"), F.col("j"), F.col("k"))
        a = (2 * uniform(seed, F.lit("x"), *key) - 1) * F.lit(float(wide))
        b = (2 * uniform(seed, F.lit("y"), *key) - 1) * F.lit(float(half))
        points = points.withColumns({"a": a, "b": b})
        if shape == "hexagon":
            points = points.where(_in_hexagon(F.col("a"), F.col("b"), cellsize))
        points = points.select("i", "j", "k", (F.col("cx") + F.col("a")).alias("u"), (F.col("cy") + F.col("b")).alias("v"))
    x, y = geometry.rotated(F.col("u"), F.col("v"), rotation)
    points = points.select("i", "j", "k", x.alias("x"), y.alias("y")).where(F.col("x").between(m.xmin, m.xmax) & F.col("y").between(m.ymin, m.ymax))
    gt = m.geotransform
    points = points.withColumns({"row": geometry.point_row(gt, F.col("x"), F.col("y")), "col": geometry.point_col(gt, F.col("x"), F.col("y"))})
    points = points.withColumns({"row": F.least("row", F.lit(m.height - 1)), "col": F.least("col", F.lit(m.width - 1))})
    points = points.withColumn("pix", F.col("row").cast("long") * m.width + F.col("col"))
    if access is not None:
        points = constraints.accessible(points, m, access, layer_name, buff_inner, buff_outer)
    plots = None if existing is None else constraints.existing_pixels(rast, existing)
    if plots is not None:
        points = constraints.without_pixels(points, plots)
    if force:
        points = points.join(rast.pixels(*m.bands).dropna(subset=list(m.bands)).select("pix"), "pix", "left_semi")
    if location == "random":
        points = points.groupBy("i", "j").agg(F.min_by(F.struct("row", "col", "x", "y"), "k").alias("p")).select("p.*")
    out = points.select("row", "col", "x", "y")
    if plots is not None:
        out = plots.select("row", "col", "x", "y", F.lit(1).alias("existing")).unionByName(out.withColumn("existing", F.lit(0)))
    return _done(out, rast, filename)


# ---------------------------------------------------------------------- conditioned Latin hypercube


def clhs(
    rast: Raster, num_samples: int, iterations: int = 10_000, access: Vector | None = None, layer_name: str | None = None, buff_inner: float | None = None,
    buff_outer: float | None = None, existing: Vector | None = None, replace: int | None = None, plot: bool = False, filename: str = "", seed: int = SEED,
    pool_size: int = 100_000, eps: float = 0.001, exact: bool = True, access_mode: str = "centre",
) -> DataFrame:
    """Samples that have each of the num_samples quantile bins of every band once, and the bands' correlations.

    Bins and correlations are those of all pixels with data in every band. The samples are annealed from a random pool of pool_size
    accessible pixels. Existing plots stay, but for up to ``replace`` redundant ones.
    """
    _check_samples(num_samples, None)
    if replace is not None and replace < 0:
        raise ValueError("replace is 0 or more")
    if replace and existing is None:
        warnings.warn("replace has no effect without existing plots", stacklevel=2)
    bands, n = list(rast.meta.bands), num_samples
    complete = scanned_again(rast.df).dropna(how="any", subset=bands)
    whole = Raster(complete, rast.meta)
    cuts = cutpoints(whole, {b: [j / n for j in range(1, n)] for b in bands}, eps, exact)
    target = correlation_matrix(moments(whole, bands).first(), len(bands))
    rows = constraints.placed(whole, *bands)
    rows = rows.select("row", "col", "pix", "x", "y", *[quoted(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands)])
    plots = None if existing is None else constraints.existing_pixels(rast, existing)
    pool = _candidates(rast, rows, plots, access, layer_name, buff_inner, buff_outer, access_mode)
    pool = pool.withColumn("priority", priority(seed, F.col("pix"))).orderBy("priority", "pix").limit(pool_size).drop("priority").withColumn("old", F.lit(0))
    if plots is not None:
        at = plots.select("pix", F.col("x").alias("ex"), F.col("y").alias("ey"))
        old = rows.join(at, "pix").withColumns({"x": F.col("ex"), "y": F.col("ey"), "old": F.lit(1)}).select(*pool.columns)
        pool = pool.unionByName(old)
    edges = [np.asarray(cuts[b]) for b in bands]

    def run(batches):
        got = list(batches)
        table = pd.concat(got, ignore_index=True).sort_values(["old", "pix"], ascending=[False, True], kind="stable") if got else None
        values = np.empty((0, len(bands))) if table is None else table[[f"v{k}" for k in range(len(bands))]].to_numpy(float)
        bins = np.stack([np.searchsorted(edges[k], values[:, k], "left") for k in range(len(bands))], axis=1) if len(values) else np.empty((0, len(bands)), int)
        fixed = 0 if table is None else int(table["old"].sum())
        if fixed:
            keep = np.concatenate([kernels.prune(bins[:fixed], n, replace or 0), np.ones(len(bins) - fixed, bool)])
            table, values, bins = table[keep], values[keep], bins[keep]
            fixed = int(table["old"].sum())
        if fixed >= n:
            yield table.iloc[:fixed]
            return
        if len(bins) < n:
            raise ValueError(f"there are {len(bins)} pixels to choose {n} samples from")
        yield table.iloc[kernels.anneal(bins, values, fixed, n, target, iterations, seed)]

    out = pool.repartition(1).mapInPandas(run, pool.schema)
    out = out.select("row", "col", "x", "y", *([] if plots is None else [F.col("old").alias("existing")]))
    return _done(out, rast, filename)


def clhs_bins(rast: Raster, samples: DataFrame, num_samples: int, eps: float = 0.001, exact: bool = True) -> DataFrame:
    """(feature, bin, n): how many samples (row, col) lie in each of the population's quantile bins; empty bins are left out."""
    bands = list(rast.meta.bands)
    whole = Raster(scanned_again(rast.df).dropna(how="any", subset=bands), rast.meta)
    cuts = cutpoints(whole, {b: [j / num_samples for j in range(1, num_samples)] for b in bands}, eps, exact)
    at = scanned_again(samples.select("row", "col"))
    rows = whole.df.join(F.broadcast(at) if at.count() <= constraints.BROADCAST_PLOTS else at, ["row", "col"])
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("feature"), binned(quoted(b), cuts[b]).alias("bin")) for b in bands]))
    return rows.select(each.alias("b")).groupBy("b.feature", "b.bin").agg(F.count("*").alias("n"))


def nc(*args, **kwargs):
    raise NotImplementedError("nc")


def ahels(*args, **kwargs):
    raise NotImplementedError("ahels")
