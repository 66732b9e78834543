"""A raster is a pixel table (row, col, one column for each band, null for nodata) and a small description of its grid."""

from __future__ import annotations

import json
import math
import os
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from . import geotiff

#: Pixels that band() and to_numpy() bring to the driver at most.
COLLECT_LIMIT = 1 << 27
#: Pixel types: those of numpy arrays, and what holds them.
PIXEL_TYPES = {
    "int8": "tinyint",
    "uint16": "int",
    "int16": "smallint",
    "uint32": "bigint",
    "int32": "int",
    "float32": "float",
    "float64": "double",
}


@dataclass(frozen=True)
class StratMeta:
    """What the strata of a band mean: a description for each, or, for a mapped band, the (name, count) of its parts."""

    strata_count: int
    descriptions: tuple[str, ...] = ()
    parts: tuple[tuple[str, int], ...] = ()

    @property
    def mapped(self) -> bool:
        return bool(self.parts)

    def decode(self, value: Column) -> dict[str, Column]:
        """The strata of the parts; the first part varies fastest."""
        out, step = {}, 1
        for name, count in self.parts:
            out[name] = ((value - value % F.lit(step)) / F.lit(step)).cast("int") % F.lit(count)
            step *= count
        return out

    def equation(self, band: str) -> str:
        """How the mapped value comes from its parts."""
        terms, step = [], 1
        for name, count in self.parts:
            terms.append(name if step == 1 else f"{name} * {step}")
            step *= count
        return f"{band} = " + " + ".join(terms) if terms else band


@dataclass(frozen=True)
class GridMeta:
    """Width, height, geotransform, coordinate system and bands."""

    width: int
    height: int
    geotransform: tuple[float, float, float, float, float, float]
    bands: tuple[str, ...]
    crs: str = ""
    nodata: tuple[float | None, ...] = ()
    driver: str = "MEM"

    def _x(self, c: float, r: float) -> float:
        return self.geotransform[0] + c * self.geotransform[1] + r * self.geotransform[2]

    def _y(self, c: float, r: float) -> float:
        return self.geotransform[3] + c * self.geotransform[4] + r * self.geotransform[5]

    def _corners(self) -> list[tuple[int, int]]:
        return [(0, 0), (self.width, 0), (0, self.height), (self.width, self.height)]

    @property
    def xmin(self) -> float:
        return min(self._x(*c) for c in self._corners())

    @property
    def xmax(self) -> float:
        return max(self._x(*c) for c in self._corners())

    @property
    def ymin(self) -> float:
        return min(self._y(*c) for c in self._corners())

    @property
    def ymax(self) -> float:
        return max(self._y(*c) for c in self._corners())

    @property
    def pixel_width(self) -> float:
        return math.hypot(self.geotransform[1], self.geotransform[4])

    @property
    def pixel_height(self) -> float:
        return math.hypot(self.geotransform[2], self.geotransform[5])

    def same_grid(self, other: GridMeta) -> bool:
        near = all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(self.geotransform, other.geotransform, strict=True))
        return (self.width, self.height) == (other.width, other.height) and near and same_crs(self.crs, other.crs)


def same_crs(a: str, b: str) -> bool:
    return "".join(a.split()).lower() == "".join(b.split()).lower()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Raster:
    """A pixel table with its grid. Nothing is computed before a result is asked for."""

    df: DataFrame
    meta: GridMeta
    strata: dict[str, StratMeta] = field(default_factory=dict)
    closed: bool = False

    # ------------------------------------------------------------------ sources

    @classmethod
    def from_dataframe(
        cls, df: DataFrame, width: int, height: int, geotransform: Sequence[float], crs: str = "", bands: Sequence[str] | None = None, nodata: Mapping[str, float] | float | None = None
    ) -> Raster:
        """Columns row and col (0-based) and the bands. Nodata values and NaN become null."""
        bands = tuple(bands if bands is not None else [c for c in df.columns if c not in ("row", "col")])
        missing = [b for b in (*bands, "row", "col") if b not in df.columns]
        if missing:
            raise ValueError(f"the table has no column {missing[0]!r}")
        kinds = dict(df.dtypes)
        bad = [b for b in bands if kinds[b] not in PIXEL_TYPES.values()]
        if bad:
            raise ValueError(f"band {bad[0]!r} has the unsupported pixel type {kinds[bad[0]]}")
        values = nodata if isinstance(nodata, Mapping) else dict.fromkeys(bands, nodata)
        cols = [F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")]
        for b in bands:
            c = quoted(b)
            if kinds[b] in ("float", "double"):
                c = F.when(~F.isnan(c), c)
            if values.get(b) is not None and not math.isnan(values[b]):
                c = F.when(c != F.lit(values[b]).cast(kinds[b]), c)
            cols.append(c.alias(b))
        meta = GridMeta(int(width), int(height), tuple(map(float, geotransform)), bands, crs, tuple(values.get(b) for b in bands))
        return cls(df.select(*cols), meta)

    @classmethod
    def from_numpy(
        cls, spark: SparkSession, array: np.ndarray, geotransform: Sequence[float], names: Sequence[str], crs: str = "", nodata: Sequence[float | None] | None = None
    ) -> Raster:
        """From an array (rows, columns) or (bands, rows, columns)."""
        array = np.asarray(array)
        array = array[None] if array.ndim == 2 else array
        if array.ndim != 3:
            raise ValueError("the array must have two or three dimensions")
        if len(names) != len(array):
            raise ValueError(f"{len(names)} names for {len(array)} bands")
        if array.dtype.name not in PIXEL_TYPES:
            raise ValueError(f"unsupported pixel type {array.dtype.name}")
        import pyarrow as pa

        height, width = array.shape[1:]
        rows, cols = np.divmod(np.arange(height * width, dtype=np.int64), width)
        kind = {"uint16": np.int32, "uint32": np.int64}.get(array.dtype.name, array.dtype)
        table = pa.table({"row": rows.astype(np.int32), "col": cols.astype(np.int32)} | {n: band.ravel().astype(kind) for n, band in zip(names, array, strict=True)})
        return cls.from_dataframe(spark.createDataFrame(table), width, height, geotransform, crs, names, dict(zip(names, nodata or [None] * len(names), strict=True)))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Raster:
        """A raster that write() has stored, or GeoTIFF files: a .tif, or a pattern that ends so for a mosaic of several."""
        if path.lower().endswith((".tif", ".tiff")):
            out = geotiff.read(spark, path)
            return Raster(out.df, replace(out.meta, driver="GTiff"))
        text = "".join(r[0] for r in spark.read.text(f"{path}/grid", wholetext=True).collect())
        got = json.loads(text)
        strata = {b: StratMeta(s["strata_count"], tuple(s["descriptions"]), tuple(map(tuple, s["parts"]))) for b, s in got.pop("strata").items()}
        meta = GridMeta(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})
        return cls(spark.read.parquet(f"{path}/pixels"), replace(meta, driver="Parquet"), strata)

    @classmethod
    def from_rasterio(cls, spark: SparkSession, dataset, array: np.ndarray | None = None) -> Raster:
        """From an open dataset of that library; ``array`` (bands, rows, columns) spares the reading."""
        array = dataset.read() if array is None else _shaped(array, dataset.count, dataset.height, dataset.width)
        t = dataset.transform
        names = [n or f"band_{k + 1}" for k, n in enumerate(dataset.descriptions)]
        return cls.from_numpy(spark, array, (t.c, t.a, t.b, t.f, t.d, t.e), names, dataset.crs.to_wkt() if dataset.crs else "", list(dataset.nodatavals))

    @classmethod
    def from_gdal(cls, spark: SparkSession, dataset, array: np.ndarray | None = None) -> Raster:
        """From an open dataset of that library's Python binding."""
        count, height, width = dataset.RasterCount, dataset.RasterYSize, dataset.RasterXSize
        own = [dataset.GetRasterBand(k + 1) for k in range(count)]
        array = np.stack([b.ReadAsArray() for b in own]) if array is None else _shaped(array, count, height, width)
        names = [b.GetDescription() or f"band_{k + 1}" for k, b in enumerate(own)]
        return cls.from_numpy(spark, array, dataset.GetGeoTransform(), names, dataset.GetProjection(), [b.GetNoDataValue() for b in own])

    # ------------------------------------------------------------------ sinks

    def write(self, path: str, mode: str = "errorifexists") -> Raster:
        """Stores pixels as Parquet and the grid as JSON beneath ``path``; returns the stored raster.

        A path that ends in .tif gets one GeoTIFF file, put together on the driver; strata metadata stay with the returned raster.
        """
        self.check_open()
        spark, kind = self.df.sparkSession, os.path.splitext(path)[1]
        if kind == ".tif":
            nodata = self.meta.nodata[0] if self.meta.nodata and len(set(map(str, self.meta.nodata))) == 1 else None
            if nodata is None and self.dtype in ("float", "double"):
                nodata = float("nan")
            put_file(spark, path, geotiff.encode(self.to_numpy(), self.meta.geotransform, list(self.meta.bands), nodata, self.meta.crs), mode == "overwrite")
            return replace(Raster.read(spark, path), strata=self.strata)
        if kind not in ("", ".parquet"):
            raise ValueError("a raster is stored as a folder of Parquet files (no extension, or .parquet) or as a .tif")
        self.df.write.mode(mode).parquet(f"{path}/pixels")
        meta = {k: getattr(self.meta, k) for k in ("width", "height", "geotransform", "bands", "crs", "nodata", "driver")}
        strata = {b: {"strata_count": s.strata_count, "descriptions": s.descriptions, "parts": s.parts} for b, s in self.strata.items()}
        spark.createDataFrame([(json.dumps(meta | {"strata": strata}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/grid")
        return Raster.read(spark, path)

    def to_numpy(self, bands: Iterable[int | str] | None = None) -> np.ndarray:
        """(bands, rows, columns); nodata is NaN, or the band's nodata value in integer bands."""
        return np.stack([self.band(b) for b in (self.meta.bands if bands is None else bands)])

    def to_rasterio(self, with_arr: bool = False):
        """An in-memory dataset of that library, where it is installed; closes this raster."""
        try:
            import rasterio
        except ImportError as e:
            raise RuntimeError("rasterio is not installed") from e
        array, g = self.to_numpy(), self.meta.geotransform
        profile = {"driver": "GTiff", "width": self.meta.width, "height": self.meta.height, "count": len(array), "dtype": array.dtype, "crs": self.meta.crs or None}
        with rasterio.MemoryFile() as file:
            with file.open(**profile, transform=rasterio.Affine(g[1], g[2], g[0], g[4], g[5], g[3])) as out:
                out.write(array)
                out.descriptions = self.meta.bands
            dataset = file.open()
        self.close()
        return (dataset, array) if with_arr else dataset

    def to_gdal(self, with_arr: bool = False):
        try:
            from osgeo import gdal, gdal_array
        except ImportError as e:
            raise RuntimeError("the GDAL binding is not installed") from e
        array = self.to_numpy()
        dataset = gdal.GetDriverByName("MEM").Create("", self.meta.width, self.meta.height, len(array), gdal_array.NumericTypeCodeToGDALTypeCode(array.dtype))
        dataset.SetGeoTransform(self.meta.geotransform)
        dataset.SetProjection(self.meta.crs)
        for k, (name, values) in enumerate(zip(self.meta.bands, array, strict=True)):
            dataset.GetRasterBand(k + 1).WriteArray(values)
            dataset.GetRasterBand(k + 1).SetDescription(name)
        self.close()
        return (dataset, array) if with_arr else dataset

    # ------------------------------------------------------------------ access

    def close(self) -> None:
        self.closed = True

    def check_open(self) -> None:
        if self.closed:
            raise RuntimeError("this raster has been closed")

    def band_name(self, band: int | str | None = None) -> str:
        """The name of a band given by name or 0-based number; None stands for the only band."""
        self.check_open()
        if band is None:
            if len(self.meta.bands) > 1:
                raise ValueError("name a band: the raster has more than one")
            return self.meta.bands[0]
        if isinstance(band, str):
            if band not in self.meta.bands:
                raise ValueError(f"no band {band!r}")
            return band
        if isinstance(band, bool) or not isinstance(band, (int, np.integer)):
            raise TypeError("a band is a name or a number")
        if not 0 <= band < len(self.meta.bands):
            raise ValueError(f"no band {band}: there are {len(self.meta.bands)}")
        return self.meta.bands[band]

    def band_index(self, band: int | str) -> int:
        return self.meta.bands.index(self.band_name(band))

    def band(self, band: int | str | None = None) -> np.ndarray:
        """One band on the driver, as (rows, columns)."""
        name, m = self.band_name(band), self.meta
        if m.width * m.height > COLLECT_LIMIT:
            raise MemoryError(f"the band has more than {COLLECT_LIMIT} pixels; use the DataFrame")
        got = self.df.select("row", "col", quoted(name).alias("v")).toArrow()
        kind = dict(self.df.dtypes)[name]
        fill = m.nodata[m.bands.index(name)] if m.nodata else None
        if kind in ("float", "double"):
            out = np.full((m.height, m.width), np.nan, np.float32 if kind == "float" else np.float64)
        else:
            out = np.full((m.height, m.width), -1 if fill is None else int(fill), {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64}[kind])
        v = got.filter(got["v"].is_valid())
        out[v["row"].to_numpy(), v["col"].to_numpy()] = v["v"].to_numpy()
        return out

    def pixels(self, *bands: str) -> DataFrame:
        """row, col, pix (row * width + col) and the named bands."""
        self.check_open()
        pix = F.col("row").cast("long") * F.lit(self.meta.width) + F.col("col")
        return self.df.select("row", "col", pix.alias("pix"), *[quoted(b).alias(b) for b in bands])

    def select(self, *bands: int | str) -> Raster:
        names = [self.band_name(b) for b in bands]
        at = [self.meta.bands.index(n) for n in names]
        nodata = tuple(self.meta.nodata[k] for k in at) if self.meta.nodata else ()
        strata = {n: self.strata[n] for n in names if n in self.strata}
        return Raster(self.df.select("row", "col", *map(quoted, names)), replace(self.meta, bands=tuple(names), nodata=nodata), strata)

    def downsampled(self, target_width: int, target_height: int) -> DataFrame:
        """Every k-th pixel of every k-th row, for display: k is 1, 2, 4 or 8, as far as the target stays filled."""
        ratio = min(self.meta.width / target_width, self.meta.height / target_height)
        k = max([1, *(n for n in (2, 4, 8) if ratio >= n / 1.2)])
        kept = self.df.where((F.col("row") % k == 0) & (F.col("col") % k == 0))
        return kept.withColumns({"row": (F.col("row") / k).cast("int"), "col": (F.col("col") / k).cast("int")})

    # ------------------------------------------------------------------ metadata

    @property
    def dtype(self) -> str:
        """The pixel type that all bands have, or an empty string."""
        kinds = {k for c, k in self.df.dtypes if c in self.meta.bands}
        return kinds.pop() if len(kinds) == 1 else ""

    def info(self) -> DataFrame:
        """One row of metadata."""
        self.check_open()
        m = self.meta
        row = (m.driver, m.width, m.height, len(m.bands), list(m.bands), m.pixel_width, m.pixel_height, m.xmin, m.xmax, m.ymin, m.ymax, m.crs)
        schema = "driver string, width int, height int, band_count int, bands array<string>, pixel_width double, pixel_height double, xmin double, xmax double, ymin double, ymax double, crs string"
        return self.df.sparkSession.createDataFrame([row], schema)

    def _strat_band(self, band: int | str | None) -> str:
        if not self.strata:
            raise ValueError("this is no strat raster")
        if isinstance(band, str) and band not in self.meta.bands and "strat_" + band in self.meta.bands:
            band = "strat_" + band
        return self.band_name(band)

    def srast_info(self, band: int | str | None = None) -> DataFrame:
        """(strata, description) of a band, named with or without ``strat_``; for a mapped band the strata of its parts."""
        name = self._strat_band(band)
        meta, spark = self.strata[name], self.df.sparkSession
        values = spark.range(meta.strata_count).select(F.col("id").cast("int").alias("strata"))
        if meta.mapped:
            return values.select("strata", *[c.alias(n) for n, c in meta.decode(F.col("strata")).items()])
        named = F.array(*map(F.lit, meta.descriptions)) if meta.descriptions else F.array().cast("array<string>")
        return values.select("strata", F.get(named, F.col("strata")).alias("description"))

    def equation(self, band: int | str | None = None) -> str:
        name = self._strat_band(band)
        return self.strata[name].equation(name)


def put_file(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """Writes a file from the driver to any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, overwrite)
    try:
        for k in range(0, len(data), 1 << 24):
            out.write(bytearray(data[k : k + (1 << 24)]))
    finally:
        out.close()


def _shaped(array: np.ndarray, count: int, height: int, width: int) -> np.ndarray:
    array = np.asarray(array)
    array = array[None] if array.ndim == 2 else array
    if array.shape != (count, height, width):
        raise ValueError(f"the array has the shape {array.shape}, the dataset {(count, height, width)}")
    return array


def strata_column(raster: Raster, band: str) -> Column:
    """The band as int strata; float and wide bands are cast, with a warning."""
    kind = dict(raster.df.dtypes)[band]
    if kind in ("bigint", "float", "double"):
        warnings.warn(f"band {band!r} of type {kind} is cast to int strata", stacklevel=3)
    return quoted(band).cast("int")
