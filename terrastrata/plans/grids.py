"""Rasters over the test tables: a dense key is the pixel's number in row-major order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.raster import GridMeta, Raster, StratMeta
from ..sources.vector import Vector

GEOTRANSFORM = (431100.0, 20.0, 0.0, 5343240.0, 0.0, -20.0)
CRS = "EPSG:26917"
SEED = 42
LINES = [[[431150, 5343230], [434050, 5342900]], [[432600, 5343240], [432600, 5323240]]]
TRIANGLE = [[431111.5, 5343233.5], [432411.5, 5343111.5], [431555.5, 5342511.5], [431111.5, 5343233.5]]
FRAME = [[431901.5, 5343201.5], [433301.5, 5343201.5], [433301.5, 5342601.5], [431901.5, 5342601.5], [431901.5, 5343201.5]]
HOLE = [[432201.5, 5343001.5], [432801.5, 5343001.5], [432801.5, 5342801.5], [432201.5, 5342801.5], [432201.5, 5343001.5]]
BOX = [[432501.5, 5342901.5], [434201.5, 5342901.5], [434201.5, 5342301.5], [432501.5, 5342301.5], [432501.5, 5342901.5]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(df: DataFrame, key: str, width: int, bands: list[str]) -> Raster:
    last = df.agg(F.max(key)).first()[0]
    pix = F.col(key)
    col = (pix % width).cast("int")
    row = ((pix - pix % width) / width).cast("int")
    df = df.select(row.alias("row"), col.alias("col"), *bands)
    return Raster.from_dataframe(df, width, -1 if last is None else last // width + 1, GEOTRANSFORM, CRS, bands)


def orders_grid(spark: SparkSession, sf_dir: str) -> Raster:
    """b1: price of the order; b2 and b3: largest price and quantity of its items, nodata without items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("b2"), F.max("l_quantity").alias("b3"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("b1"))
    return grid(rows.join(items, rows.o_orderkey == items.l_orderkey, "left"), "o_orderkey", 150, ["b1", "b2", "b3"])


def prices_grid(spark: SparkSession, sf_dir: str) -> Raster:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("b1"), F.col("o_custkey").cast("double").alias("c1"))
    return grid(rows, "o_orderkey", 150, ["b1", "c1"])


def events_grid(spark: SparkSession, sf_dir: str) -> Raster:
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    return grid(rows, "event_id", 100, ["value", "user_id"])


def part_grid(spark: SparkSession, sf_dir: str) -> Raster:
    return grid(table(spark, sf_dir, "part"), "p_partkey", 50, ["p_size", "p_retailprice"])


def block_strata(spark: SparkSession, sf_dir: str) -> Raster:
    """Four strata in blocks of six by six pixels, on the pixels of orders_grid that have b2."""
    base = orders_grid(spark, sf_dir)
    block = lambda c: F.floor(F.col(c) / 6)
    st = ((block("row") * 5 + block("col") * 3) % 4).cast("int")
    m = base.meta
    meta = GridMeta(m.width, m.height, m.geotransform, ("st",), m.crs, (-1.0,))
    return Raster(base.df.select("row", "col", F.when(F.col("b2").isNotNull(), st).alias("st")), meta, {"st": StratMeta(4)})


def access_lines(spark: SparkSession) -> Vector:
    return Vector.from_rows(spark, "LineString", LINES, "access", CRS)


def polygons(spark: SparkSession) -> Vector:
    return Vector.from_rows(spark, "Polygon", [[TRIANGLE], [FRAME, HOLE], [BOX]], "inventory", CRS, {"kind_of": ["poor", "rich", "medium"]})


def existing_plots(spark: SparkSession, width: int = 150, count: int = 20) -> Vector:
    """Centres of the pixels 5, 102, 199, ..."""
    pix = [5 + 97 * k for k in range(count)]
    return Vector.from_rows(spark, "Point", [[431100 + (p % width + 0.5) * 20, 5343240 - (p // width + 0.5) * 20] for p in pix], "existing", CRS)
