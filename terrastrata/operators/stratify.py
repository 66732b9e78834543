"""Strata from covariates: by breaks, by quantiles, by polygons, and by combination of strata."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.raster import GridMeta, Raster, StratMeta, quoted, same_crs, strata_column
from ..sources.vector import Vector, field_column
from .constraints import placed, with_polygon

MAX_STRATA = 2**31 - 1
#: Rank error, as one over it, of the sketches that bracket exact quantiles, and how many values between brackets are brought to the driver at most.
SKETCH, BROUGHT = 10_000, 1_000_000


def binned(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts lie below the value: stratum i is (cut i-1, cut i]. Null stays null."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for k, cut in enumerate(cuts):
        out = out.when(value <= F.lit(float(cut)), F.lit(k))
    return out.otherwise(F.lit(len(cuts)))


def _product(counts: Sequence[int]) -> int:
    total = 1
    for n in counts:
        total *= n
        if total > MAX_STRATA:
            raise ValueError(f"the map would have more than {MAX_STRATA} strata")
    return total


def combined(parts: Sequence[tuple[Column, int]]) -> Column:
    """Mixed radix, the first part fastest; null if any part is."""
    out, step = None, 1
    for column, count in parts:
        term = column if step == 1 else column * F.lit(step)
        out = term if out is None else out + term
        step *= count
    return out.cast("int")


def _finish(raster: Raster, strata: dict[str, tuple[Column, StratMeta]], filename: str, mapped: bool) -> Raster:
    columns = {n: c for n, (c, _) in strata.items()}
    metas = {n: m for n, (_, m) in strata.items()}
    df = raster.df.select("row", "col", *[c.alias(n) for n, c in columns.items()])
    if mapped:
        parts = [(n, m.strata_count) for n, m in metas.items()]
        metas["strat_map"] = StratMeta(_product([c for _, c in parts]), (), tuple(parts))
        df = df.withColumn("strat_map", combined([(quoted(n), c) for n, c in parts]))
    meta = GridMeta(raster.meta.width, raster.meta.height, raster.meta.geotransform, tuple(metas), raster.meta.crs, tuple(-1.0 for _ in metas))
    out = Raster(df, meta, metas)
    return out.write(filename) if filename else out


def _by_band(raster: Raster, given) -> dict[str, object]:
    """From a list for the only band, a list of lists or a dict by band; in the order of the bands."""
    raster.check_open()
    if isinstance(given, Mapping):
        named = {raster.band_name(b): v for b, v in given.items()}
    elif not isinstance(given, (list, tuple)):
        raise TypeError("a list, a list of lists or a dict by band is wanted")
    elif not any(isinstance(v, (list, tuple)) for v in given):
        named = {raster.band_name(None): given}
    elif len(given) == len(raster.meta.bands):
        named = dict(zip(raster.meta.bands, given, strict=True))
    else:
        raise ValueError("there must be one list for each band")
    return {b: named[b] for b in raster.meta.bands if b in named}


def breaks(
    rast: Raster, breaks: list | Mapping, map: bool = False, filename: str = "", thread_count: int = 8, driver_options: Mapping | None = None,  # noqa: A002
    plot: bool = False, histogram_bins: int | None = None,
) -> Raster:
    """Bands strat_<band>: the number of breaks below the value; with ``map`` also strat_map, which combines them.

    thread_count, driver_options, plot and histogram_bins are taken and ignored: Spark deals out the work, and nothing is drawn.
    """
    strata = {}
    for band, cuts in _by_band(rast, breaks).items():
        cuts = sorted(float(c) for c in cuts)
        names = [f"x <= {cuts[0]}", *(f"{a} < x <= {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f"x > {cuts[-1]}"] if cuts else ["all"]
        strata[f"strat_{band}"] = (binned(quoted(band), cuts), StratMeta(len(cuts) + 1, tuple(names)))
    if map:
        _product([m.strata_count for _, m in strata.values()])
    return _finish(rast, strata, filename, map)


def probabilities(given: int | Sequence[float]) -> list[float]:
    """k: i/k for i from 1 to k-1; a list: its values within (0, 1), ascending."""
    if isinstance(given, int) and not isinstance(given, bool):
        if given < 1:
            raise ValueError("the number of quantiles is 1 or more")
        return [i / given for i in range(1, given)]
    values = [float(p) for p in given]
    if any(not 0 <= p <= 1 for p in values):
        raise ValueError("probabilities lie from 0 to 1")
    return sorted({p for p in values if 0 < p < 1})


def _slot(value: Column, edges: list[float], low: int = 0, high: int | None = None) -> Column:
    """2 i + 1 for edge i itself, 2 i for what lies between the edges before it and it; by bisection."""
    high = len(edges) if high is None else high
    if low == high:
        return F.lit(2 * low)
    mid = (low + high) // 2
    at = F.lit(float(edges[mid]))
    return F.when(value < at, _slot(value, edges, low, mid)).when(value == at, F.lit(2 * mid + 1)).otherwise(_slot(value, edges, mid + 1, high))


def _slots(df: DataFrame, edges: Mapping[str, list[float]], whole: Mapping[str, set[int]]) -> DataFrame:
    """(k, slot, v, n): how many values of band k are in each slot, apart for each value v in the slots of ``whole``."""
    parts = []
    for k, (band, some) in enumerate(edges.items()):
        value = quoted(band).cast("double")
        slot = _slot(value, some)
        parts.append(F.when(value.isNotNull(), F.struct(F.lit(k).alias("k"), slot.alias("slot"), F.when(slot.isin(*whole[band]), value).alias("v"))))
    rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("s"))
    return rows.groupBy("s.k", "s.slot", "s.v").agg(F.count("*").alias("n"))


def _exact(df: DataFrame, wanted: Mapping[str, list[float]]) -> dict[str, list[float]]:
    """Quantiles by linear interpolation between order statistics, in bounded memory whatever the number of pixels.

    A scan counts the values, and one for a sketch brackets each order statistic by two values a few ranks apart. One more counts the values below and between them, and brings
    those between, which are a few for each million pixels; where they would be too many, the brackets are narrowed by further
    sketches of what lies between them.
    """
    value = {b: quoted(b).cast("double") for b in wanted}
    counts = dict(zip(wanted, df.agg(*[F.count(c) for c in value.values()]).first(), strict=True))
    wanted = {b: ps for b, ps in wanted.items() if counts[b]}
    if not wanted:
        return {b: [] for b in counts}

    def sketched(some: Mapping[str, list[float]]) -> list[Column]:
        """Values on either side of each quantile, by more than the sketch's error and by more than two ranks."""
        return [F.percentile_approx(value[b], F.array(*[F.lit(min(1.0, max(0.0, p + d * max(2 / SKETCH, 3 / counts[b])))) for p in ps for d in (-1, 1)]), SKETCH) for b, ps in some.items()]

    brackets = {b: list(zip(q[::2], q[1::2], strict=True)) for b, q in zip(wanted, df.agg(*sketched(wanted)).first(), strict=True)}
    between = sum(counts[b] * len(ps) for b, ps in wanted.items()) * 6 / SKETCH
    while between > BROUGHT:
        edges, inner = _edges(brackets)
        table = _table(_slots(df, edges, {b: set() for b in edges}).collect(), edges)
        aggs, steps = [], {}
        for b, ps in wanted.items():
            for j, (p, (low, high)) in enumerate(zip(ps, brackets[b], strict=True)):
                below = sum(n for v, _, n in table[b] if v <= low)
                inside = sum(n for v, _, n in table[b] if low < v < high)
                first, last = int(p * (counts[b] - 1)) - below, -int(-p * (counts[b] - 1) // 1) - below
                if inside and last >= 0 and first < inside:
                    margin = max(2 / SKETCH, 3 / inside)
                    ends = F.array(F.lit(max(0.0, first / inside - margin)), F.lit(min(1.0, (last + 1) / inside + margin)))
                    aggs.append(F.percentile_approx(F.when((value[b] > F.lit(low)) & (value[b] < F.lit(high)), value[b]), ends, SKETCH).alias(f"x{len(aggs)}"))
                    steps[b, j] = first, last, inside
        if not aggs:
            break
        got = df.agg(*aggs).first()
        for new, (b, j) in zip(got, steps, strict=True):
            first, last, inside = steps[b, j]
            low, high = brackets[b][j]
            brackets[b][j] = (new[0] if first >= 0 else low, new[1] if last < inside else high)
        between *= 6 / SKETCH
    edges, inner = _edges(brackets)
    table = _table(_slots(df, edges, inner).toArrow().to_pylist(), edges)
    out = {b: [] for b in counts}
    for b, ps in wanted.items():
        values, ends = [], []
        for v, _, n in table[b]:
            values.append(v)
            ends.append(n + (ends[-1] if ends else 0))
        at = lambda rank, values=values, ends=ends: values[bisect_right(ends, rank)]
        for p in ps:
            place = p * (counts[b] - 1)
            first = int(place)
            low, high = at(first), at(min(first + 1, counts[b] - 1))
            out[b].append(low if low == high else low + (place - first) * (high - low))
    return out


def _edges(brackets: Mapping[str, list[tuple[float, float]]]) -> tuple[dict[str, list[float]], dict[str, set[int]]]:
    """The distinct ends of a band's brackets in order, and the slots between them that lie in a bracket."""
    edges = {b: sorted({v for pair in some for v in pair}) for b, some in brackets.items()}
    inner = {b: {2 * k + 2 for low, high in brackets[b] for k, v in enumerate(some[:-1]) if low <= v < high} for b, some in edges.items()}
    return edges, inner


def _table(rows: list, edges: Mapping[str, list[float]]) -> dict[str, list[tuple[float, int, int]]]:
    """(value, slot, count) of each band in order; what is between edges without its own values stands just below the next edge."""
    out: dict[str, list] = {b: [] for b in edges}
    names = list(edges)
    for r in rows:
        some = edges[names[r["k"]]]
        slot, value = r["slot"], r["v"]
        if value is None:
            value = some[slot // 2] if slot % 2 else (math.nextafter(some[slot // 2], -math.inf) if slot // 2 < len(some) else math.inf)
        out[names[r["k"]]].append((value, slot, r["n"]))
    return {b: sorted(v, key=lambda x: (x[1], x[0])) for b, v in out.items()}


def cutpoints(rast: Raster, quantiles: Mapping[str, list[float]], eps: float = 0.001, exact: bool = True, digits: int = 6) -> dict[str, list[float]]:
    """The quantiles of each band over its data pixels, rounded; a band without data has none.

    exact: linear interpolation between order statistics, in a few scans and bounded memory at any size; otherwise, in one scan, ranks are off by ``eps`` of
    the pixels at most.
    """
    wanted = {b: p for b, p in quantiles.items() if p}
    out: dict[str, list[float]] = {b: [] for b in quantiles}
    if not wanted:
        return out
    if exact:
        got = _exact(rast.df, wanted)
    else:
        aggs = [F.percentile_approx(quoted(b).cast("double"), F.array(*[F.lit(q) for q in ps]), round(1 / eps)) for b, ps in wanted.items()]
        got = dict(zip(wanted, rast.df.agg(*aggs).first(), strict=True))
    return out | {b: [round(float(v), digits) for v in some or []] for b, some in got.items()}


def quantiles(
    rast: Raster, quantiles: int | list | Mapping, map: bool = False, filename: str = "", thread_count: int = 8, driver_options: Mapping | None = None,  # noqa: A002
    eps: float = 0.001, plot: bool | None = None, histogram_bins: int | None = None, info: bool | None = None, exact: bool = True,
) -> Raster:
    """Like breaks(), with the bands' own quantiles as breaks; eps is the rank error where they are not ``exact``.

    thread_count, driver_options, plot, histogram_bins and info are taken and ignored.
    """
    if isinstance(quantiles, int):
        given = {rast.band_name(None): quantiles}
    elif isinstance(quantiles, (list, tuple)) and len(rast.meta.bands) > 1:
        # one entry for each band: a number of quantiles or a list of probabilities
        if len(quantiles) != len(rast.meta.bands):
            raise ValueError("there must be an entry for each band")
        given = dict(zip(rast.meta.bands, quantiles, strict=True))
    else:
        given = _by_band(rast, quantiles)
    cuts = cutpoints(rast, {b: probabilities(q) for b, q in given.items()}, eps, exact)
    return breaks(rast, cuts, map, filename)


def map(*args, filename: str = "", thread_count: int = 8, driver_options: Mapping | None = None) -> Raster:  # noqa: A001
    """strat_map over all bands of the arguments, in their order: rasters, (raster, bands) or (raster, bands, numbers of strata).

    A number of strata is taken from a strat raster's own metadata, and must be given for other rasters. A value outside
    of its range is an error. thread_count and driver_options are taken and ignored.
    """
    if not args:
        raise ValueError("no raster is given")
    base, parts, df = None, [], None
    for n, arg in enumerate(args):
        raster, bands, counts = (*arg, None, None)[:3] if isinstance(arg, tuple) else (arg, None, None)
        raster.check_open()
        if isinstance(bands, (list, tuple)) != isinstance(counts, (list, tuple)) and counts is not None and bands is not None:
            raise ValueError("bands and numbers of strata are both lists or both single")
        bands = list(raster.meta.bands) if bands is None else list(bands) if isinstance(bands, (list, tuple)) else [bands]
        counts = None if counts is None else list(counts) if isinstance(counts, (list, tuple)) else [counts]
        if len(bands) > len(raster.meta.bands):
            raise ValueError("more bands are named than the raster has")
        if counts is not None and len(counts) != len(bands):
            raise ValueError("there must be a number of strata for each band")
        if base is None:
            base = raster
        elif not base.meta.same_grid(raster.meta):
            raise ValueError("the rasters have different grids")
        own = []
        for k, band in enumerate(bands):
            name = raster.band_name(band)
            if name in raster.strata:
                count = raster.strata[name].strata_count
            elif counts is None:
                raise ValueError(f"the number of strata of band {name!r} must be given")
            else:
                count = int(counts[k])
            value = strata_column(raster, name)
            message = F.concat(F.lit(f"band {name}: the stratum "), value.cast("string"), F.lit(f" is not from 0 to {count - 1}"))
            value = F.when(value.isNull(), value).when((value >= 0) & (value < count), value).otherwise(F.raise_error(message))
            label = f"p{n}_{k}"
            own.append(value.alias(label))
            parts.append((label, name, count))
        table = raster.df.select("row", "col", *own)
        df = table if df is None else df.join(table, ["row", "col"])
    total = _product([c for *_, c in parts])
    df = df.select("row", "col", combined([(F.col(label), c) for label, _, c in parts]).alias("strat_map"))
    meta = GridMeta(base.meta.width, base.meta.height, base.meta.geotransform, ("strat_map",), base.meta.crs, (-1.0,))
    out = Raster(df, meta, {"strat_map": StratMeta(total, (), tuple((name, c) for _, name, c in parts))})
    return out.write(filename) if filename else out


def poly(rast: Raster, vect: Vector, layer_name: str, attribute: str, features: list, filename: str = "", driver_options: Mapping | None = None, cell: float | None = None) -> Raster:
    """Band strat_<layer>: number i where the pixel's centre lies in a polygon whose attribute is features[i] or in that list.

    Of several polygons the one with the largest fid counts; pixels in none are null. driver_options are taken and ignored.
    """
    rast.check_open()
    if not same_crs(rast.meta.crs, vect.crs):
        raise ValueError("the raster and the polygons have different coordinate systems")
    attribute = field_column(attribute)
    if attribute not in vect.fields.get(vect.layer_name(layer_name), []):
        raise ValueError(f"no attribute {attribute!r}")
    if not features:
        raise ValueError("no features are given")
    value, names = F.lit(None).cast("int"), []
    for k, group in reversed(list(enumerate(features))):
        members = group if isinstance(group, (list, tuple)) else [group]
        value = F.when(F.col(f"`{attribute}`").isin(*members), F.lit(k)).otherwise(value)
        names.insert(0, ", ".join(str(m) for m in members))
    polygons = vect.polygons(layer_name).withColumn("strata__", value).where(F.col("strata__").isNotNull()).select("fid", "rings", "strata__")
    band = f"strat_{layer_name}"
    df = with_polygon(placed(rast), polygons, "strata__", cell).select("row", "col", F.col("strata__").cast("int").alias(band))
    meta = GridMeta(rast.meta.width, rast.meta.height, rast.meta.geotransform, (band,), rast.meta.crs, (-1.0,))
    out = Raster(df, meta, {band: StratMeta(len(features), tuple(names))})
    return out.write(filename) if filename else out


def kmeans(*args, **kwargs):
    raise NotImplementedError("kmeans")
