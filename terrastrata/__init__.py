"""Structurally guided sampling over gridded covariates, as DataFrame transformations."""

from .api import clhs, srs, strat, systematic
from .operators import calculate, sample, stratify
from .operators.calculate import distribution, pca, representation
from .operators.sample import ahels, nc
from .operators.stratify import breaks, kmeans, map, poly, quantiles
from .sources.raster import GridMeta, Raster, StratMeta
from .sources.vector import Samples, Vector

SpatialRaster, SpatialVector, StratRasterBandMetadata = Raster, Vector, StratMeta

__all__ = [
    "GridMeta", "Raster", "Samples", "SpatialRaster", "SpatialVector", "StratMeta", "StratRasterBandMetadata", "Vector", "ahels", "breaks", "calculate", "clhs",
    "distribution", "kmeans", "map", "nc", "pca", "poly", "quantiles", "representation", "sample", "srs", "strat", "stratify", "systematic",
]
