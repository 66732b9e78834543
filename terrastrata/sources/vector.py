"""Vectors as tables of features: points (fid, x, y), lines (fid, part, coords) and polygons (fid, rings), with their fields."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shapefile
from .raster import put_file

_XY = "struct<x:double,y:double>"
KINDS = {"Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}

OWN_COLUMNS = {"fid", "kind", "geometry", "part", "coords", "rings", "x", "y", "row", "col", "pix", "c"}


def field_column(name: str) -> str:
    """The column of a field: its name, with ``_field`` after it where a column of ours has that name in any case."""
    return f"{name}_field" if name.lower() in OWN_COLUMNS else name


@dataclass
class Vector:
    """Named layers. A layer has fid, kind (geometry type), geometry (GeoJSON coordinates as text) and its fields."""

    layers: dict[str, DataFrame]
    crs: str = ""
    driver: str = "MEM"
    fields: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str, layer: str | None = None, crs: str = "") -> Vector:
        """GeoJSON (a feature collection in one document, or a feature on each line) or a shapefile."""
        if path.lower().endswith(".shp"):
            return shapefile.read(spark, path, layer or os.path.splitext(os.path.basename(path))[0], crs)
        if os.path.splitext(path)[1].lower() not in (".geojson", ".json", ".geojsonl"):
            raise ValueError("vectors are read from .geojson, .json, .geojsonl or .shp")
        name = layer or os.path.splitext(os.path.basename(path))[0]
        text = spark.read.text(path, wholetext=not path.endswith("l"))
        feature = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
        top = F.from_json("value", f"struct<type:string,features:array<{feature}>,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>")
        top = text.select(top.alias("t"))
        single = F.array(F.struct(F.col("t.type").alias("type"), F.col("t.properties").alias("properties"), F.col("t.geometry").alias("geometry")))
        rows = top.select(F.posexplode(F.coalesce("t.features", single)).alias("n", "f"))
        if path.endswith("l"):
            rows = rows.withColumn("n", F.monotonically_increasing_id())
        rows = rows.select(F.col("n").cast("long").alias("fid"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("geometry"), F.col("f.properties").alias("p"))
        names = [r[0] for r in rows.select(F.explode(F.map_keys("p"))).distinct().orderBy(F.col("col")).collect()]
        rows = rows.select("fid", "kind", "geometry", *[F.col("p")[n].alias(field_column(n)) for n in names])
        return cls({name: rows}, crs, "GeoJSON", {name: [field_column(n) for n in names]})

    @classmethod
    def from_rows(cls, spark: SparkSession, kind: str, geometries: Sequence, layer: str = "layer", crs: str = "", fields: Mapping[str, Sequence] | None = None) -> Vector:
        """From nested coordinates of one kind on the driver, with a sequence of values for each field."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        fields = {field_column(f): v for f, v in (fields or {}).items()}
        rows = [(k, kind, json.dumps(g), *(fields[f][k] for f in fields)) for k, g in enumerate(geometries)]
        kinds = [T.StructField(f, _kind_of(fields[f])) for f in fields]
        schema = T.StructType([T.StructField("fid", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("geometry", T.StringType()), *kinds])
        return cls({layer: spark.createDataFrame(rows, schema)}, crs, "MEM", {layer: list(fields)})

    @classmethod
    def from_wkt(cls, spark: SparkSession, texts: Iterable[str], layer: str = "layer", crs: str = "") -> Vector:
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "fid long, wkt string")
        return cls({layer: parse_wkt(rows, "wkt")}, crs, "WKT", {layer: []})

    @classmethod
    def from_geopandas(cls, spark: SparkSession, frame, layer: str = "geopandas_geodataframe") -> Vector:
        """From a GeoDataFrame or GeoSeries, over its GeoJSON text."""
        got = json.loads(frame.to_json())["features"]
        names = sorted({k for f in got for k in f.get("properties") or {}})
        rows = [(k, f["geometry"]["type"], json.dumps(f["geometry"]["coordinates"]), *(None if (v := (f.get("properties") or {}).get(n)) is None else str(v) for n in names)) for k, f in enumerate(got)]
        names = [field_column(n) for n in names]
        schema = ", ".join(["fid long", "kind string", "geometry string", *(f"`{n}` string" for n in names)])
        return cls({layer: spark.createDataFrame(rows, schema)}, frame.crs.to_wkt() if frame.crs is not None else "", "MEM", {layer: names})

    @classmethod
    def samples(cls, df: DataFrame, crs: str = "") -> Vector:
        """A sample network: a table with x and y as the layer ``samples``."""
        fields = [c for c in df.columns if c not in ("x", "y")]
        fid = F.monotonically_increasing_id()  # points may repeat
        geometry = F.to_json(F.array("x", "y"))
        return cls({"samples": df.select(fid.alias("fid"), F.lit("Point").alias("kind"), geometry.alias("geometry"), *fields)}, crs, "MEM", {"samples": fields})

    def to_geopandas(self, layer: str | None = None):
        try:
            import geopandas
        except ImportError as e:
            raise RuntimeError("geopandas is not installed") from e
        features = [json.loads(r[0]) for r in self._features(layer).toLocalIterator()]
        return geopandas.GeoDataFrame.from_features(features, crs=self.crs or None)

    def layer_name(self, layer: str | None = None) -> str:
        if layer is None:
            if len(self.layers) > 1:
                raise ValueError("name a layer: the vector has more than one")
            return next(iter(self.layers))
        if layer not in self.layers:
            raise ValueError(f"no layer {layer!r}")
        return layer

    def layer(self, layer: str | None = None) -> DataFrame:
        return self.layers[self.layer_name(layer)]

    def info(self, layer: str | None = None) -> DataFrame:
        """layer, feature_count, field_count, geometry_type, extent and crs, one row."""
        name = self.layer_name(layer)
        rows = self.layers[name]
        points = rows.select("fid", "kind", F.explode_outer(_vertices(F.col("geometry"))).alias("p"))
        out = points.agg(
            F.count_distinct("fid").alias("feature_count"), F.min("kind").alias("geometry_type"),
            F.min("p.x").alias("xmin"), F.max("p.x").alias("xmax"), F.min("p.y").alias("ymin"), F.max("p.y").alias("ymax"),
        )
        fields = len(self.fields.get(name, []))
        return out.select(F.lit(name).alias("layer"), "feature_count", F.lit(fields).alias("field_count"), "geometry_type", "xmin", "xmax", "ymin", "ymax", F.lit(self.crs).alias("crs"))

    def points(self, layer: str | None = None) -> DataFrame:
        """fid, x, y and fields of Point and MultiPoint features; other kinds are an error."""
        rows, rest = self._of(layer, ("Point", "MultiPoint"))
        one = F.array(F.from_json("geometry", KINDS["Point"]))
        many = F.from_json("geometry", KINDS["MultiPoint"])
        rows = rows.select("fid", *rest, F.explode(F.when(F.col("kind") == "Point", one).otherwise(many)).alias("c"))
        return rows.select("fid", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), *rest)

    def lines(self, layer: str | None = None) -> DataFrame:
        """fid, part, coords (array of x, y) and fields of LineString and MultiLineString features."""
        rows, rest = self._of(layer, ("LineString", "MultiLineString"))
        one = F.array(F.from_json("geometry", KINDS["LineString"]))
        many = F.from_json("geometry", KINDS["MultiLineString"])
        rows = rows.select("fid", *rest, F.posexplode(F.when(F.col("kind") == "LineString", one).otherwise(many)).alias("part", "c"))
        return rows.select("fid", "part", F.transform("c", _xy).alias("coords"), *rest)

    def segments(self, layer: str | None = None) -> DataFrame:
        """fid, x1, y1, x2, y2 of each stretch of the lines."""
        rows = self.lines(layer)
        n = F.size("coords")
        pairs = F.zip_with(F.slice("coords", F.lit(1), n - 1), F.slice("coords", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        rows = rows.where(n > 1).select("fid", F.explode(pairs).alias("s"))
        return rows.select("fid", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))

    def polygons(self, layer: str | None = None) -> DataFrame:
        """fid, rings (array of arrays of x, y) and fields of Polygon and MultiPolygon features, a row for each part."""
        rows, rest = self._of(layer, ("Polygon", "MultiPolygon"))
        one = F.array(F.from_json("geometry", KINDS["Polygon"]))
        many = F.from_json("geometry", KINDS["MultiPolygon"])
        rows = rows.select("fid", *rest, F.explode(F.when(F.col("kind") == "Polygon", one).otherwise(many)).alias("c"))
        return rows.select("fid", F.transform("c", lambda r: F.transform(r, _xy)).alias("rings"), *rest)

    def samples_as_wkt(self) -> DataFrame:
        """(wkt) of the layer ``samples``."""
        if "samples" not in self.layers:
            raise ValueError("only a sample network has samples")
        return self.points("samples").select(F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string")).alias("wkt"))

    def write(self, path: str, layer: str | None = None, mode: str = "errorifexists") -> None:
        """A folder of GeoJSON features, one on each line (.geojson), or of Parquet files (.parquet); points also as a shapefile, put together on the driver."""
        kind = os.path.splitext(path)[1]
        if kind == ".parquet":
            self.layer(layer).write.mode(mode).parquet(path)
        elif kind == ".geojson":
            self._features(layer).write.mode(mode).text(path)
        elif kind == ".shp":
            spark, rows = self.layer(layer).sparkSession, self.points(layer).drop("fid").collect()
            fields = {n: [r[n] for r in rows] for n in self.fields.get(self.layer_name(layer), [])}
            for end, data in zip((".shp", ".shx", ".dbf"), shapefile.encode_points([(r["x"], r["y"]) for r in rows], fields), strict=True):
                put_file(spark, path[:-4] + end, data, mode == "overwrite")
            if self.crs:
                put_file(spark, path[:-4] + ".prj", self.crs.encode(), mode == "overwrite")
        else:
            raise ValueError("vectors are written as .geojson, .shp or .parquet")

    def _features(self, layer: str | None) -> DataFrame:
        name = self.layer_name(layer)
        rows = self.layers[name]
        names = self.fields.get(name, [])
        properties = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])) if names else F.lit("{}")
        return rows.select(F.format_string('{"type":"Feature","properties":%s,"geometry":{"type":"%s","coordinates":%s}}', properties, "kind", "geometry").alias("value"))

    def _of(self, layer: str | None, kinds: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
        name = self.layer_name(layer)
        rows = self.layers[name]
        message = F.concat(F.lit(f"a geometry of {' or '.join(kinds)} is wanted, not "), F.coalesce("kind", F.lit("null")))
        checked = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.raise_error(message))
        return rows.withColumn("kind", checked), [f"`{n}`" for n in self.fields.get(name, [])]


class Samples(Vector):
    """A sample network as a vector with the layer ``samples``; its table ``df``, and so all of a DataFrame's methods, is at hand too."""

    def __init__(self, df: DataFrame, crs: str = ""):
        own = Vector.samples(df, crs)
        super().__init__(own.layers, own.crs, own.driver, own.fields)
        self.df = df

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "df":
            raise AttributeError(name)
        return getattr(self.df, name)

    def samples_as_wkt(self) -> list[str]:
        """A WKT point for each sample, on the driver."""
        return [r[0] for r in super().samples_as_wkt().toLocalIterator()]


def _xy(c: Column) -> Column:
    return F.struct(c[0].alias("x"), c[1].alias("y"))


def _kind_of(values: Sequence) -> T.DataType:
    known = [v for v in values if v is not None]
    return T.LongType() if known and all(isinstance(v, int) for v in known) else T.DoubleType() if known and all(isinstance(v, float) for v in known) else T.StringType()


def _vertices(geometry: Column) -> Column:
    """All vertices of a geometry of any kind: its numbers in pairs."""
    numbers = F.transform(F.regexp_extract_all(geometry, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(1)), lambda s: s.cast("double"))
    n = (F.size(numbers) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.element_at(numbers, 2 * k - 1).alias("x"), F.element_at(numbers, 2 * k).alias("y")))
    return F.when(n > 0, pairs)


def parse_wkt(rows: DataFrame, wkt: str) -> DataFrame:
    """fid, kind and geometry from WKT of points, lines and polygons and their multiples."""
    text = F.col(wkt)
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    body = F.regexp_extract(text, r"^\s*[A-Za-z]+\s*(\(.*\))\s*$", 1)
    pairs = F.regexp_replace(body, r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)", "[$1,$2]")
    flat = F.translate(pairs, "() ", "[]")
    inner = F.regexp_replace(flat, r"^\[(.*)\]$", "$1")
    name = F.create_map(*[F.lit(x) for k in KINDS for x in (k.upper(), k)])[kind]
    points = F.regexp_replace(flat, r"\[(\[-?[\d.eE+-]+,-?[\d.eE+-]+\])\]", "$1")
    geometry = F.when(kind == "POINT", inner).when(kind == "MULTIPOINT", points).otherwise(flat)
    return rows.select("fid", name.alias("kind"), geometry.alias("geometry"))
