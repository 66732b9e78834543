"""Population statistics: histograms and principal components."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..sources.raster import GridMeta, Raster, quoted
from ..sources.vector import Vector


def _bin(value: Column, low: float, step: float, bins: int) -> Column:
    """The last bin takes its upper edge, and what lies above."""
    if step <= 0:
        return F.lit(0)
    return F.least(F.floor((value - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("int")


def distribution(rast: Raster, band: int | str | None = None, samples: Vector | None = None, layer: str | None = None, bins: int = 50, plot: bool = True) -> DataFrame:
    """(source, bin, lo, hi, n): equal-width bins over the band's data, with the counts of all pixels and, if given, of the samples.

    Samples on nodata, outside of the grid or below the population's minimum are left out. A band without data gives no rows. plot is taken and
    ignored: the rows are what would be drawn.
    """
    if bins < 1:
        raise ValueError("bins is 1 or more")
    name, spark = rast.band_name(band), rast.df.sparkSession
    value = quoted(name).cast("double")
    low, high = rast.df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return spark.createDataFrame([], "source string, bin int, lo double, hi double, n long")
    step = (high - low) / bins
    counts = rast.df.where(value.isNotNull()).groupBy(_bin(value, low, step, bins).alias("bin")).agg(F.count("*").alias("n"))
    counts = counts.select(F.lit("population").alias("source"), "bin", "n")
    sources = ["population"]
    if samples is not None:
        sources.append("sample")
        gt = rast.meta.geotransform
        points = samples.points(layer).select(geometry.point_row(gt, F.col("x"), F.col("y")).alias("row"), geometry.point_col(gt, F.col("x"), F.col("y")).alias("col"))
        at = rast.df.select("row", "col", value.alias("v")).where("v IS NOT NULL").join(points, ["row", "col"]).where(F.col("v") >= low)
        counts = counts.unionByName(at.groupBy(_bin(F.col("v"), low, step, bins).alias("bin")).agg(F.count("*").alias("n")).select(F.lit("sample").alias("source"), "bin", "n"))
    frame = spark.range(bins).select(F.explode(F.array(*map(F.lit, sources))).alias("source"), F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(low) + k * F.lit(step)
    out = frame.join(counts, ["source", "bin"], "left")
    return out.select("source", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def moments(rast: Raster, bands: list[str]) -> DataFrame:
    """One row over the pixels that have data in all bands: n, mean_<i>, std_<i> (population) and corr_<i>_<j>."""
    rows = rast.df.select(*[quoted(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands)]).dropna(how="any")
    aggs = [F.count("*").alias("n")]
    for k in range(len(bands)):
        aggs += [F.avg(f"v{k}").alias(f"mean_{k}"), F.stddev_pop(f"v{k}").alias(f"std_{k}")]
    aggs += [F.corr(f"v{i}", f"v{j}").alias(f"corr_{i}_{j}") for i, j in combinations(range(len(bands)), 2)]
    return rows.agg(*aggs)


@dataclass(frozen=True)
class Components:
    """Rows of ``vectors`` are the components; ``values`` their variances; means and deviations standardise the bands."""

    vectors: np.ndarray
    values: np.ndarray
    means: np.ndarray
    deviations: np.ndarray


def correlation_matrix(row, count: int) -> np.ndarray:
    out = np.eye(count)
    for i, j in combinations(range(count), 2):
        v = row[f"corr_{i}_{j}"]
        out[i, j] = out[j, i] = 0.0 if v is None or np.isnan(v) else v
    return out


def components(rast: Raster, num_comp: int) -> Components:
    """Eigenvectors of the correlation matrix by falling eigenvalue; the largest element of each is positive."""
    bands = list(rast.meta.bands)
    if not 1 <= num_comp <= len(bands):
        raise ValueError(f"num_comp is from 1 to {len(bands)}")
    row = moments(rast, bands).first()
    if not row["n"]:
        raise ValueError("no pixel has data in all bands")
    values, vectors = np.linalg.eigh(correlation_matrix(row, len(bands)))
    order = np.argsort(-values, kind="stable")[:num_comp]
    vectors = vectors[:, order].T
    lead = np.abs(np.round(vectors, 9)).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), lead])[:, None]
    means = np.array([row[f"mean_{k}"] for k in range(len(bands))])
    return Components(vectors, values[order], means, np.array([row[f"std_{k}"] for k in range(len(bands))]))


def pca(rast: Raster, num_comp: int, filename: str = "", return_metadata: bool = False, driver_options: dict | None = None):
    """Bands comp_1 ... comp_k: the standardised bands projected on the components; null where any band is.

    A band that does not vary has weight 0. Float unless a band is double. With return_metadata also the Components. driver_options
    are taken and ignored.
    """
    rast.check_open()
    found = components(rast, num_comp)
    kinds = dict(rast.df.dtypes)
    kind = "double" if any(kinds[b] == "double" for b in rast.meta.bands) else "float"
    scaled = []
    for b, mean, std in zip(rast.meta.bands, found.means, found.deviations, strict=True):
        c = quoted(b).cast("double")
        scaled.append((c - F.lit(float(mean))) / F.lit(float(std)) if std > 0 else c * F.lit(0.0))
    columns, names = [], []
    for k, vector in enumerate(found.vectors):
        total = None
        for weight, c in zip(vector, scaled, strict=True):
            total = c * F.lit(float(weight)) if total is None else total + c * F.lit(float(weight))
        names.append(f"comp_{k + 1}")
        columns.append(total.cast(kind).alias(names[-1]))
    meta = GridMeta(rast.meta.width, rast.meta.height, rast.meta.geotransform, tuple(names), rast.meta.crs, tuple(float("nan") for _ in names))
    out = Raster(rast.df.select("row", "col", *columns), meta)
    out = out.write(filename) if filename else out
    return (out, found) if return_metadata else out


def representation(*args, **kwargs):
    raise NotImplementedError("representation")
