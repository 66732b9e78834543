import numpy as np
import pytest

from pyspark.sql import functions as F

import terrastrata as ts
from terrastrata.operators import constraints, stratify

GT = (0.0, 10.0, 0.0, 100.0, 0.0, -10.0)


@pytest.fixture(scope="module")
def raster(spark):
    r = np.random.default_rng(1)
    a = np.stack([r.normal(10, 4, (10, 12)), r.uniform(0, 100, (10, 12)), r.uniform(0, 5, (10, 12))])
    a[0, 2, 3] = np.nan
    a[1, 4, 5] = np.nan
    return ts.SpatialRaster.from_numpy(spark, a, GT, ["zq90", "pz2", "zsd"], "EPSG:1")


def bins(values, cuts):
    out = np.searchsorted(np.sort(cuts), values, "left")
    return np.where(np.isnan(values), -1, out)


def test_breaks_take_the_upper_edge(spark):
    r = ts.SpatialRaster.from_numpy(spark, np.array([[3.0, 3.1, 5.0, np.nan, 18.0, 19.0]]), GT, ["z"])
    got = ts.breaks(r, [11, 3, 18, 5])
    assert got.band("strat_z").tolist() == [[0, 1, 1, -1, 3, 4]]
    assert got.srast_info("z").count() == 5


def test_breaks_of_lists_and_dicts(raster):
    cuts = [[3, 5, 11, 18], [20, 40, 60, 80], [1, 2]]
    by_list = ts.breaks(raster, cuts, map=True)
    by_dict = ts.breaks(raster, {"zsd": cuts[2], 0: cuts[0], "pz2": cuts[1]}, map=True)
    for k, b in enumerate(raster.meta.bands):
        want = bins(raster.band(b), cuts[k])
        assert (by_list.band(f"strat_{b}") == want).all() and (by_dict.band(f"strat_{b}") == want).all()
    pairs = {(x["strat_map"], x["strat_zq90"], x["strat_pz2"], x["strat_zsd"]) for x in by_list.df.dropna().collect()}
    assert len({p[0] for p in pairs}) == len(pairs) == len({p[1:] for p in pairs})
    decoded = {x["strata"]: (x["strat_zq90"], x["strat_pz2"], x["strat_zsd"]) for x in by_list.srast_info("strat_map").collect()}
    assert all(decoded[m] == tuple(rest) for m, *rest in pairs)
    assert by_list.equation("strat_map") == "strat_map = strat_zq90 + strat_pz2 * 5 + strat_zsd * 25"


def test_wrong_breaks(raster):
    for given, error in (([1, 2], ValueError), ({"no": [1]}, ValueError), ({9: [1]}, ValueError), ([[1], [2]], ValueError), (5, TypeError)):
        with pytest.raises(error):
            ts.breaks(raster, given)
    with pytest.raises(ValueError):
        ts.breaks(raster, {b: list(range(2000)) for b in raster.meta.bands}, map=True)


@pytest.mark.parametrize("given", [4, [0.2, 0.4, 0.8], [0.8, 0.0, 0.2, 0.4, 1.0]])
def test_quantiles(raster, given):
    got = ts.quantiles(raster.select("pz2"), given).band("strat_pz2")
    values = raster.band("pz2")
    ps = [k / 4 for k in (1, 2, 3)] if given == 4 else [0.2, 0.4, 0.8]
    assert (got == bins(values, np.round(np.quantile(values[~np.isnan(values)], ps), 6))).all()


def test_quantiles_of_several_bands(raster):
    for given in ({"zq90": 4, "pz2": [0.5]}, [4, 2, 1], [[0.25], [0.5], [0.75]]):
        got = ts.quantiles(raster, given, map=True)
        assert "strat_map" in got.meta.bands
    near = stratify.cutpoints(raster, {"pz2": [0.25, 0.5]}, eps=0.01, exact=False)["pz2"]
    v = raster.band("pz2")
    assert all(abs((v < c).sum() / (~np.isnan(v)).sum() - p) < 0.03 for c, p in zip(near, (0.25, 0.5)))
    with pytest.raises(ValueError):
        ts.quantiles(raster, {"pz2": [1.5]})


def test_map_of_rasters(raster):
    a, b = ts.breaks(raster, {"zq90": [5, 10]}), ts.breaks(raster, {"pz2": [50]})
    got = ts.map(a, (b, "strat_pz2")).band(0)
    x, y = a.band(0), b.band(0)
    assert (got == np.where((x < 0) | (y < 0), -1, x + 3 * y)).all()
    with pytest.raises(ValueError):
        ts.map((raster, "zq90"))
    with pytest.raises(Exception, match="is not from 0 to"):
        ts.map((raster.select("pz2"), "pz2", 3)).df.collect()


def test_poly(spark, raster):
    square = [[[20, 20], [80, 20], [80, 80], [20, 80], [20, 20]], [[40, 40], [60, 40], [60, 60], [40, 60], [40, 40]]]
    vect = ts.SpatialVector.from_rows(spark, "Polygon", [square, [[[76, 7], [119, 7], [119, 93], [76, 93], [76, 7]]]], "inv", "EPSG:1", {"kind": ["poor", "rich"]})
    got = ts.poly(raster, vect, "inv", "kind", [["poor"], "rich"]).band("strat_inv")
    want = np.full((10, 12), -1)
    for row in range(10):
        for col in range(12):
            x, y = 10 * col + 5, 100 - 10 * row - 5
            if 20 < x < 80 and 20 < y < 80 and not (40 < x < 60 and 40 < y < 60):
                want[row, col] = 0
            if 76 < x < 119 and 7 < y < 93:
                want[row, col] = 1
    assert (got == want).all()
    with pytest.raises(ValueError):
        ts.poly(raster, vect, "inv", "nothing", ["poor"])


def test_stubs():
    for f in (ts.kmeans, ts.nc, ts.ahels, ts.representation):
        with pytest.raises(NotImplementedError):
            f()


def test_write_and_read_back(spark, raster, tmp_path):
    out = ts.breaks(raster, {"zq90": [5, 10]}, filename=f"{tmp_path}/strata.parquet")
    again = ts.SpatialRaster.read(spark, f"{tmp_path}/strata.parquet")
    assert (again.band(0) == out.band(0)).all() and again.strata == out.strata and again.meta.same_grid(raster.meta)
    with pytest.raises(ValueError):
        ts.breaks(raster, {"zq90": [5]}, filename="x.png")


@pytest.mark.parametrize(("sketch", "brought"), [(10_000, 1_000_000), (40, 30), (12, 4)])
def test_exact_quantiles_at_any_size(spark, monkeypatch, sketch, brought):
    """Over normal, heavily tied, constant and empty bands; with coarse sketches and few values on the driver brackets are narrowed in rounds."""
    monkeypatch.setattr(stratify, "SKETCH", sketch)
    monkeypatch.setattr(stratify, "BROUGHT", brought)
    r = np.random.default_rng(7)
    bands = [r.normal(0, 5, (40, 50)), r.integers(0, 4, (40, 50)).astype(float), np.full((40, 50), 2.5), np.where(r.random((40, 50)) < 0.97, 1.0, r.normal(0, 1e9, (40, 50))), np.full((40, 50), np.nan)]
    bands[0][r.random((40, 50)) < 0.1] = np.nan
    rast = ts.SpatialRaster.from_numpy(spark, np.stack(bands), GT, ["a", "b", "c", "d", "e"], "EPSG:1")
    ps = [0.001, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999]
    got = stratify.cutpoints(rast, {b: ps for b in rast.meta.bands})
    for name, values in zip(rast.meta.bands, bands):
        values = values[~np.isnan(values)]
        want = np.quantile(values, ps).tolist() if len(values) else []
        assert np.allclose(got[name], want, rtol=1e-12, atol=1e-6), name


def test_exact_quantiles_of_more_distinct_values_than_a_map_would_hold(spark, monkeypatch):
    """Two million distinct values: what reaches one task or the driver are sketches and some thousand values."""
    n = 2_000_000
    df = spark.range(n).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    rast = ts.SpatialRaster(df, ts.GridMeta(n, 1, GT, ("v",), "", (None,)))
    brought = []
    slots = stratify._slots
    monkeypatch.setattr(stratify, "_slots", lambda *args: brought.append(slots(*args)) or brought[-1])
    got = stratify.cutpoints(rast, {"v": [0.1, 0.5, 0.77]})["v"]
    assert np.allclose(got, [(n - 1) * p for p in (0.1, 0.5, 0.77)])
    assert brought[0].count() < 10_000
    assert "percentile(" not in brought[0]._jdf.queryExecution().toString()


def test_polygons_meet_pixels_without_a_shuffle(spark, raster, monkeypatch):
    squares = [[[[k * 30 - 5.0, 0.0], [k * 30 + 45.0, 0.0], [k * 30 + 45.0, 95.0], [k * 30 - 5.0, 95.0], [k * 30 - 5.0, 0.0]]] for k in range(4)]
    vect = ts.SpatialVector.from_rows(spark, "Polygon", squares, "p", "EPSG:1", {"kind": ["x", "y", "x", "z"]})
    out = ts.poly(raster, vect, "p", "kind", ["x", ["y", "z"]])
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    near = out.band("strat_p")
    monkeypatch.setattr(constraints, "BROADCAST_VERTICES", 0)
    assert (near == ts.poly(raster, vect, "p", "kind", ["x", ["y", "z"]]).band("strat_p")).all()
    # the largest fid counts where polygons overlap
    assert near[5, 3] == 1 and near[5, 1] == 0 and near[5, 6] == 0 and near[0, 0] == -1


def test_arguments_that_are_ignored(raster):
    a = ts.quantiles(raster.select("pz2"), 4, False, "", 8, None, 0.001, False, 20, False)
    b = ts.breaks(raster.select("pz2"), [20, 40], True, "", 4, {"COMPRESS": "LZW"}, False, 10)
    assert a.band("strat_pz2").max() == 3 and b.band("strat_map").max() == 2
    assert ts.map(b, thread_count=2, driver_options={}).band("strat_map").max() > 0
    assert ts.pca(raster, 1, driver_options={}).meta.bands == ("comp_1",)
