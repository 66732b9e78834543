import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import terrastrata as ts
from terrastrata.operators import allocate, calculate, constraints, kernels
from terrastrata.operators.sample import clhs_bins

GT = (0.0, 10.0, 0.0, 600.0, 0.0, -10.0)


@pytest.fixture(scope="module")
def raster(spark):
    r = np.random.default_rng(2)
    a = np.stack([r.normal(0, 1, (60, 50)), r.uniform(0, 9, (60, 50)), r.normal(5, 2, (60, 50))])
    a[2] += a[0]
    a[0, :3, :7] = np.nan
    return ts.SpatialRaster.from_numpy(spark, a, GT, ["a", "b", "c"])


@pytest.fixture(scope="module")
def strata(raster):
    return ts.breaks(raster, {"b": [2, 5, 7]})


@pytest.fixture(scope="module")
def lines(spark):
    return ts.SpatialVector.from_rows(spark, "MultiLineString", [[[[0, 300], [500, 310]], [[250, 0], [250, 600]]]], "roads")


@pytest.fixture(scope="module")
def plots(spark):
    return ts.SpatialVector.from_rows(spark, "Point", [[x * 37.0 % 500, x * 53.0 % 600] for x in range(1, 31)] + [[5, 595]], "old")


def xy(df):
    return np.array([(r["x"], r["y"]) for r in df.collect()])


def nearest(points):
    d = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    return d.min()


def distance(p, a, b):
    a, b, p = map(np.asarray, (a, b, p))
    t = np.clip(np.dot(p - a, b - a) / np.dot(b - a, b - a), 0, 1)
    return np.hypot(*(p - a - t * (b - a)))


@pytest.mark.parametrize("n", [1, 50, 2000])
def test_srs_counts_and_data(raster, n):
    rows = ts.srs(raster, n).collect()
    band = raster.band("a")
    assert len({(r["row"], r["col"]) for r in rows}) == n and not any(np.isnan(band[r["row"], r["col"]]) for r in rows)


def test_srs_is_the_same_on_any_partitioning(raster):
    other = ts.SpatialRaster(raster.df.repartition(9), raster.meta)
    assert sorted(map(tuple, ts.srs(raster, 40).collect())) == sorted(map(tuple, ts.srs(other, 40).collect()))
    assert sorted(map(tuple, ts.srs(raster, 40, seed=1).collect())) != sorted(map(tuple, ts.srs(raster, 40).collect()))


@pytest.mark.parametrize("mindist", [1, 50, 200.5, 6000])
def test_srs_mindist(raster, mindist):
    got = xy(ts.srs(raster, 100, mindist=mindist))
    assert len(got) == 1 or nearest(got) >= mindist
    assert len(got) == (1 if mindist == 6000 else len(got)) and (mindist > 50 or len(got) > 50)


def test_thinning_by_rounds_equals_the_pass_in_order(raster):
    from pyspark.sql import functions as F

    from terrastrata.functions.rng import priority

    pool = constraints.placed(raster).select("pix", "x", "y").withColumn("priority", priority(7, F.col("pix"))).orderBy("priority").limit(900)
    a = {r["pix"] for r in constraints.thinned(pool, 45).collect()}
    b = {r["pix"] for r in constraints.thinned(pool, 45, kernel_limit=0).collect()}
    assert a == b and len(a) > 20


def test_access(raster, lines):
    got = xy(ts.srs(raster, 50_000, access=lines, buff_inner=20, buff_outer=60))
    segments = [((0, 300), (500, 310)), ((250, 0), (250, 600))]
    d = np.array([min(distance(p, *s) for s in segments) for p in got])
    assert len(got) and (d > 20).all() and (d <= 60).all()
    whole = constraints.placed(raster, "a").where("a is not null").collect()
    assert len(got) == sum(20 < min(distance((r["x"], r["y"]), *s) for s in segments) <= 60 for r in whole)
    touched = xy(ts.srs(raster, 50_000, access=lines, buff_inner=20, buff_outer=60, access_mode="all_touched"))
    assert {tuple(p) for p in touched} < {tuple(p) for p in got}
    for inner, outer in ((None, None), (50, 40), (5, -1)):
        with pytest.raises(ValueError):
            ts.srs(raster, 5, access=lines, buff_inner=inner, buff_outer=outer)


def test_existing_plots_are_kept(raster, plots):
    rows = ts.srs(raster, 100, existing=plots).collect()
    assert len(rows) == 100 and sum(r["existing"] for r in rows) == 31
    assert len({(r["row"], r["col"]) for r in rows}) == 100


def test_allocation():
    assert allocate.allocate(10, "equal", [50, 50, 50]) == [4, 3, 3]
    assert sum(allocate.allocate(123, "prop", [1000, 300, 17, 5])) == 123
    assert allocate.allocate(100, "manual", [500, 500], [0.25, 0.75]) == [25, 75]
    assert allocate.allocate(5, "prop", [0, 0]) == [0, 0]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert allocate.allocate(40, "equal", [3, 100]) == [3, 20] and seen
    assert allocate.optimal_weights([10, 10], [0, 0]) is None


@pytest.mark.parametrize("method", ["random", "Queinnec"])
@pytest.mark.parametrize("mindist", [None, 30])
def test_strat(raster, strata, plots, method, mindist):
    for allocation in ("prop", "equal", "optim", "manual"):
        extra = {"weights": [0.1, 0.2, 0.3, 0.4]} if allocation == "manual" else {"mrast": raster, "mrast_band": "c"} if allocation == "optim" else {}
        rows = ts.strat(strata, 60, allocation=allocation, method=method, mindist=mindist, **extra).collect()
        band = strata.band("strat_b")
        assert all(band[r["row"], r["col"]] == r["strat_b"] for r in rows) and len({(r["row"], r["col"]) for r in rows}) == len(rows) == 60
        if mindist:
            assert nearest(np.array([(r["x"], r["y"]) for r in rows])) >= mindist
        if allocation == "equal":
            assert np.bincount([r["strat_b"] for r in rows]).tolist() == [15] * 4
    forced = ts.strat(strata, 60, method=method, mindist=mindist, existing=plots, force=True).collect()
    assert sum(r["existing"] for r in forced) == 31
    some = ts.strat(strata, 20, method=method, mindist=mindist, existing=plots).collect()
    assert len(some) == 20 and 0 < sum(r["existing"] for r in some) <= 20


def test_focal_window_against_brute_force(spark):
    r = np.random.default_rng(5)
    a = np.repeat(np.repeat(r.integers(0, 2, (6, 6)), 5, 0), 5, 1).astype(np.int32)
    raster = ts.SpatialRaster.from_numpy(spark, np.where(r.random(a.shape) < 0.02, -1, a).astype(np.int32), GT, ["s"], nodata=[-1])
    v = raster.band("s")
    for wrow, wcol in ((3, 3), (3, 5), (7, 3)):
        got = {(x["row"], x["col"]) for x in constraints.focal(raster.df, wrow, wcol, "s").where("eligible").collect()}
        h, w = wrow // 2, wcol // 2
        want = {(i, j) for i in range(h, 30 - h) for j in range(w, 30 - w) if v[i, j] >= 0 and (v[i - h : i + h + 1, j - w : j + w + 1] == v[i, j]).all()}
        assert got == want


def test_strat_inputs(strata, raster):
    bad = [{"method": "queinnec"}, {"allocation": "x"}, {"allocation": "manual"}, {"allocation": "manual", "weights": [0.5] * 4}, {"wrow": 4}, {"allocation": "optim"}, {"num_samples": 0}, {"mindist": -1}]
    for extra in bad:
        with pytest.raises(ValueError):
            ts.strat(strata, **({"num_samples": 10} | extra))
    with pytest.raises(ValueError):
        ts.strat(raster.select("b"), 10)


@pytest.mark.parametrize("shape", ["square", "hexagon"])
@pytest.mark.parametrize("location", ["centers", "corners", "random"])
def test_systematic(raster, lines, plots, shape, location):
    for cellsize in (30, 500, 3000):
        got = xy(ts.systematic(raster, cellsize, shape, location))
        assert not len(got) or (got.min() >= 0 and got[:, 0].max() <= 500 and got[:, 1].max() <= 600)
    cell = 1600.0 if shape == "square" else 1600 * 1.5 * math.sqrt(3)
    if location != "corners":
        assert abs(len(xy(ts.systematic(raster, 40, shape, location))) - 300_000 / cell) < 0.15 * 300_000 / cell + 20
    rows = ts.systematic(raster, 30, shape, location, existing=plots, access=lines, buff_outer=50, force=True).collect()
    assert sum(r["existing"] for r in rows) == 31
    new = [r for r in rows if not r["existing"]]
    assert new and all(min(distance((r["x"], r["y"]), *s) for s in (((0, 300), (500, 310)), ((250, 0), (250, 600)))) <= 50 + 1e-9 for r in new)
    for bad in ({"cellsize": 0}, {"cellsize": -1}, {"shape": ""}, {"location": ""}):
        with pytest.raises(ValueError):
            ts.systematic(raster, **({"cellsize": 100} | bad))


def test_clhs(raster, plots, lines):
    rows = ts.clhs(raster, 20, iterations=3000)
    got = rows.collect()
    assert len({(r["row"], r["col"]) for r in got}) == 20
    spread = sum(abs(r["n"] - 1) for r in clhs_bins(raster, rows, 20).collect()) + 60 - clhs_bins(raster, rows, 20).count()
    random = ts.srs(raster, 20)
    before = sum(abs(r["n"] - 1) for r in clhs_bins(raster, random, 20).collect()) + 60 - clhs_bins(raster, random, 20).count()
    assert spread < before / 2
    kept = ts.clhs(raster, 40, iterations=200, existing=plots).collect()
    assert len(kept) == 40 and sum(r["existing"] for r in kept) == 30
    pruned = ts.clhs(raster, 40, iterations=200, existing=plots, replace=10).collect()
    assert len(pruned) == 40 and 20 <= sum(r["existing"] for r in pruned) < 30
    near = xy(ts.clhs(raster, 10, iterations=50, access=lines, buff_outer=30))
    assert all(min(distance(p, *s) for s in (((0, 300), (500, 310)), ((250, 0), (250, 600)))) <= 30 for p in near)
    with pytest.raises(ValueError):
        ts.clhs(raster, 5, replace=-1)


def test_clhs_prune_keeps_lonely_samples():
    bins = np.array([[0, 0], [0, 0], [0, 0], [1, 1], [2, 2]])
    assert kernels.prune(bins, 5, 10).tolist().count(True) == 3


@pytest.mark.parametrize("bins", [1, 10, 50, 100])
def test_distribution(spark, raster, bins, plots):
    got = calculate.distribution(raster, "b", plots, bins=bins).orderBy("bin").collect()
    values = raster.band("b").ravel()
    counts, edges = np.histogram(values, bins)
    mine = [r for r in got if r["source"] == "population"]
    assert [r["n"] for r in mine] == counts.tolist() and np.allclose([r["lo"] for r in mine], edges[:-1])
    assert sum(r["n"] for r in got if r["source"] == "sample") == 31
    with pytest.raises(ValueError):
        calculate.distribution(raster, "b", bins=0)
    with pytest.raises(ValueError):
        calculate.distribution(raster)


def test_pca(raster):
    out, found = ts.pca(raster, 3, return_metadata=True)
    a = np.stack([raster.band(b) for b in "abc"])
    ok = ~np.isnan(a).any(axis=0)
    z = a[:, ok]
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, keepdims=True)
    values = np.linalg.eigvalsh(np.corrcoef(z))[::-1]
    assert np.allclose(found.values, values)
    comp = np.stack([out.band(f"comp_{k}") for k in (1, 2, 3)])
    assert np.isnan(comp[:, ~ok]).all() and np.allclose(comp[:, ok], found.vectors @ z, atol=1e-6)
    assert np.allclose(comp[:, ok].var(axis=1), values)
    for bad in (0, 4):
        with pytest.raises(ValueError):
            ts.pca(raster, bad)


def test_clhs_makes_a_raster_that_takes_a_shuffle_only_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    pixels = spark.range(400).groupBy("id").agg(F.count("*").alias("n"))
    at = pixels.select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), counted((F.col("id") * 7 % 101).cast("double")).alias("b"))
    grid = ts.Raster.from_dataframe(at, 20, 20, (0.0, 1.0, 0.0, 20.0, 0.0, -1.0), bands=["b"])
    rows = ts.clhs(grid, 5, iterations=20)
    assert rows.count() == 5 and seen.value == 400
