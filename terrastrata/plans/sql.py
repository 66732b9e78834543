"""DuckDB SQL of the registered queries."""

from __future__ import annotations

import math

from .grids import BOX, FRAME, HOLE, LINES, SEED, TRIANGLE

ORD = """ord AS (
  SELECT o_orderkey AS pix, CAST(o_orderkey % 150 AS INTEGER) AS col, CAST(o_orderkey // 150 AS INTEGER) AS row, o_totalprice AS b1, m2 AS b2, m3 AS b3,
    CAST(o_custkey AS DOUBLE) AS c1, 431100.0::DOUBLE + (o_orderkey % 150 + 0.5::DOUBLE) * 20.0::DOUBLE AS x, 5343240.0::DOUBLE + (o_orderkey // 150 + 0.5::DOUBLE) * -20.0::DOUBLE AS y
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m2, max(l_quantity) AS m3 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
)"""
EVT = """evt AS (
  SELECT event_id AS pix, CAST(event_id % 100 AS INTEGER) AS col, CAST(event_id // 100 AS INTEGER) AS row, value, CAST(user_id AS DOUBLE) AS user_id,
    431100.0::DOUBLE + (event_id % 100 + 0.5::DOUBLE) * 20.0::DOUBLE AS x, 5343240.0::DOUBLE + (event_id // 100 + 0.5::DOUBLE) * -20.0::DOUBLE AS y
  FROM events
)"""
BLK = "blk AS (SELECT pix, row, col, x, y, b1, b2, CAST(((row // 6) * 5 + (col // 6) * 3) % 4 AS INTEGER) AS st FROM ord WHERE b2 IS NOT NULL)"
PRI = f"md5('{SEED}|' || pix)"
EXISTING = "ex AS (SELECT 5 + 97 * range AS pix FROM range(20))"


def grid_info() -> str:
    return """SELECT 150 AS width, CAST(max(o_orderkey) // 150 + 1 AS INTEGER) AS height, 3 AS band_count, 20.0::DOUBLE AS pixel_width, 20.0::DOUBLE AS pixel_height,
    431100.0::DOUBLE AS xmin, 434100.0::DOUBLE AS xmax, 5343240.0::DOUBLE - 20.0 * (max(o_orderkey) // 150 + 1) AS ymin, 5343240.0::DOUBLE AS ymax FROM orders"""


def band_stats() -> str:
    one = "SELECT '{b}' AS band, count({b}) AS n, round(avg({b}), 4) AS mean, round(stddev_pop({b}), 4) AS std, min({b}) AS low, max({b}) AS high FROM ord"
    return f"WITH {ORD} " + " UNION ALL ".join(one.format(b=b) for b in ("b1", "b2", "b3"))


def pixel_to_point() -> str:
    return f"WITH {ORD} SELECT pix, x, y FROM ord"


def point_to_pixel() -> str:
    return f"WITH {EVT} SELECT pix, CAST(floor((x + 3.7 - 431100) / 20) AS INTEGER) AS col, CAST(floor((5343240 - (y - 2.1)) / 20) AS INTEGER) AS row FROM evt"


def histogram(sample: bool) -> str:
    bin_ = "CAST(least(floor((value - low) / step), 19) AS INTEGER)"
    counts = f"SELECT 'population' AS source, {bin_} AS bin, count(*) AS n FROM evt, s WHERE value IS NOT NULL GROUP BY 2"
    sources = "SELECT 'population' AS source"
    if sample:
        counts += f" UNION ALL SELECT 'sample', {bin_}, count(*) FROM evt, s WHERE pix IN (SELECT pix FROM ex) AND value IS NOT NULL GROUP BY 2"
        sources += " UNION ALL SELECT 'sample'"
    return f"""WITH {EVT}, {EXISTING}, s AS (SELECT min(value) AS low, (max(value) - min(value)) / 20 AS step FROM evt), c AS ({counts}), src AS ({sources})
    SELECT src.source, CAST(r.range AS INTEGER) AS bin, round(low + r.range * step, 6) AS lo, round(low + (r.range + 1) * step, 6) AS hi, coalesce(n, 0) AS n
    FROM range(20) r CROSS JOIN src CROSS JOIN s LEFT JOIN c ON c.source = src.source AND c.bin = r.range"""


def binned(column: str, cuts: list) -> str:
    whens = " ".join(f"WHEN {column} <= {c} THEN {k}" for k, c in enumerate(cuts))
    return f"CAST(CASE WHEN {column} IS NULL THEN NULL {whens} ELSE {len(cuts)} END AS INTEGER)"


def filled(*columns: str) -> str:
    return ", ".join(f"coalesce({c}, -1) AS {c}" for c in columns)


B1, B2, B3 = [100000.0, 200000.0, 300000.0], [30000.0, 50000.0, 70000.0, 90000.0], [20.0, 40.0]


def breaks_single() -> str:
    return f"WITH {ORD} SELECT pix, coalesce({binned('b2', B2)}, -1) AS strat_b2 FROM ord"


def breaks_multi_map() -> str:
    return f"""WITH {ORD}, s AS (SELECT pix, {binned('b1', B1)} AS strat_b1, {binned('b2', B2)} AS strat_b2, {binned('b3', B3)} AS strat_b3 FROM ord)
    SELECT pix, {filled('strat_b1', 'strat_b2', 'strat_b3')}, coalesce(CAST(s.strat_b1 + s.strat_b2 * 4 + s.strat_b3 * 20 AS INTEGER), -1) AS strat_map FROM s"""


def breaks_strata_counts() -> str:
    return f"WITH {ORD} SELECT coalesce({binned('b2', B2)}, -1) AS strat_b2, count(*) AS n FROM ord GROUP BY 1"


def _cut(column: str, p: float) -> str:
    return f"round(quantile_cont({column}, {p}), 6)"


def quantile_cutpoints() -> str:
    rows = [f"SELECT '{b}' AS band, {k} AS k, {_cut(b, p)} AS cut FROM ord" for b, ps in (("b1", [0.25, 0.5, 0.75]), ("b2", [0.2, 0.4, 0.8])) for k, p in enumerate(ps)]
    return f"WITH {ORD} " + " UNION ALL ".join(rows)


def _quantiled() -> str:
    return f"""{ORD}, q AS (SELECT {', '.join(f'{_cut("b1", p)} AS p{k}' for k, p in enumerate([0.25, 0.5, 0.75]))}, {', '.join(f'{_cut("b2", p)} AS r{k}' for k, p in enumerate([0.2, 0.4, 0.8]))} FROM ord),
    s AS (SELECT pix, row, col, {binned('b1', ['p0', 'p1', 'p2'])} AS strat_b1, {binned('b2', ['r0', 'r1', 'r2'])} AS strat_b2 FROM ord, q)"""


def quantiles_strata() -> str:
    return f"WITH {_quantiled()} SELECT pix, {filled('strat_b1', 'strat_b2')} FROM s"


def quantiles_map() -> str:
    return f"WITH {_quantiled()} SELECT coalesce(CAST(strat_b1 + strat_b2 * 4 AS INTEGER), -1) AS strat_map, count(*) AS n FROM s GROUP BY 1"


def map_two_rasters() -> str:
    return f"WITH {ORD}, {BLK}, s AS (SELECT pix, {binned('b1', B1)} AS a FROM ord) SELECT s.pix, coalesce(CAST(a + st * 4 AS INTEGER), -1) AS strat_map FROM s LEFT JOIN blk USING (pix)"


def map_decode() -> str:
    return "SELECT CAST(range AS INTEGER) AS strata, CAST(range % 4 AS INTEGER) AS strat_b1, CAST(range // 4 % 5 AS INTEGER) AS strat_b2 FROM range(20)"


def _in_ring(ring: list) -> str:
    terms = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if ay != by:
            terms.append(f"CAST(({ay} > y) <> ({by} > y) AND x < {ax} + (y - {ay}) / ({by} - {ay}) * ({bx} - {ax}) AS INTEGER)")
    return "(" + " + ".join(terms) + ")"


def poly_strata() -> str:
    inside = {0: f"{_in_ring(TRIANGLE)} % 2 = 1", 1: f"({_in_ring(FRAME)} + {_in_ring(HOLE)}) % 2 = 1", 2: f"{_in_ring(BOX)} % 2 = 1"}
    # poor is stratum 0, medium and rich are stratum 1; of several polygons the last one counts
    return f"WITH {ORD} SELECT pix, CAST(CASE WHEN {inside[2]} THEN 1 WHEN {inside[1]} THEN 1 WHEN {inside[0]} THEN 0 ELSE -1 END AS INTEGER) AS strat_inventory FROM ord"


def _distance2(line: list) -> str:
    (ax, ay), (bx, by) = line
    dx, dy = float(bx - ax), float(by - ay)
    t = f"greatest(0.0, least(1.0, ((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {dx * dx + dy * dy}))"
    return f"((x - ({ax} + {t} * {dx})) ** 2 + (y - ({ay} + {t} * {dy})) ** 2)"


NEAR = f"least({', '.join(_distance2(line) for line in LINES)})"


def access_mask() -> str:
    return f"WITH {ORD} SELECT pix FROM ord WHERE {NEAR} <= 40000 AND NOT {NEAR} <= 3600"


def access_all_touched() -> str:
    """Whole pixels: both distances are narrowed by half a diagonal."""
    half = "200.0::DOUBLE ** 0.5"
    return f"WITH {ORD} SELECT pix FROM ord WHERE {NEAR} <= (200.0::DOUBLE - {half}) ** 2 AND NOT {NEAR} <= (60.0::DOUBLE + {half}) ** 2"


def access_area() -> str:
    return f"WITH {ORD} SELECT count(*) AS pixels, count(*) * 400.0::DOUBLE AS area FROM ord WHERE {NEAR} <= 40000 AND NOT {NEAR} <= 3600"


def _top(source: str, n: str) -> str:
    return f"SELECT row, col, x, y FROM {source} ORDER BY {PRI}, pix LIMIT {n}"


def srs_basic() -> str:
    return f"WITH {EVT} " + _top("evt", "200")


def srs_access() -> str:
    return f"WITH {ORD}, a AS (SELECT * FROM ord WHERE b1 IS NOT NULL AND {NEAR} <= 40000 AND NOT {NEAR} <= 3600) " + _top("a", "150")


def srs_existing() -> str:
    return f"""WITH {ORD}, {EXISTING}, p AS (SELECT ord.* FROM ord JOIN ex USING (pix)), a AS (SELECT * FROM ord WHERE pix NOT IN (SELECT pix FROM ex)),
    t AS (SELECT * FROM a ORDER BY {PRI}, pix LIMIT greatest(0, 100 - (SELECT count(*) FROM p)))
    SELECT row, col, x, y, 1 AS existing FROM p UNION ALL SELECT row, col, x, y, 0 FROM t"""


def srs_mindist() -> str:
    return f"""WITH RECURSIVE {EVT}, c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {PRI}, pix) AS k, row, col, x, y FROM evt),
    r(k, kept) AS (
      SELECT 0::BIGINT, []::STRUCT(row INTEGER, col INTEGER, x DOUBLE, y DOUBLE)[]
      UNION ALL
      SELECT c.k, CASE WHEN len(list_filter(kept, lambda p: (p.x - c.x) ** 2 + (p.y - c.y) ** 2 < 14400.0)) = 0
        THEN list_append(kept, {{'row': c.row, 'col': c.col, 'x': c.x, 'y': c.y}}) ELSE kept END
      FROM r JOIN c ON c.k = r.k + 1 WHERE len(kept) < 40
    )
    SELECT p.row AS row, p.col AS col, p.x AS x, p.y AS y FROM (SELECT unnest(arg_max(kept, k)) AS p FROM r)"""


WEIGHTS = [0.1, 0.2, 0.3, 0.4]


def _alloc(method: str, n: int) -> str:
    """CTEs up to quota(st, pixels, q)."""
    first = {
        "prop": f"pixels // CAST(ceil(total / {n}::DOUBLE) AS BIGINT)",
        "equal": f"{n} // 4",
        "manual": f"CAST(floor({n} * w + 1e-9) AS BIGINT)",
        "optim": f"CAST(floor({n} * (pixels * sd / sum(pixels * sd) OVER ()) + 1e-9) AS BIGINT)",
    }[method]
    weights = ", ".join(f"({k}, {w}::DOUBLE)" for k, w in enumerate(WEIGHTS))
    return f"""{ORD}, {BLK}, h AS (SELECT st, count(*) AS pixels, stddev_pop(b1) AS sd, sum(count(*)) OVER () AS total FROM blk GROUP BY st),
    w(st, w) AS (VALUES {weights}), f AS (SELECT h.st, pixels, {first} AS q0 FROM h JOIN w USING (st)), l AS (SELECT CAST({n} - sum(q0) AS BIGINT) AS rest FROM f),
    quota AS (SELECT st, pixels, CAST(least(q0 + rest // 4 + CASE WHEN st < rest % 4 THEN 1 ELSE 0 END, pixels) AS BIGINT) AS q FROM f, l)"""


def alloc(method: str) -> str:
    return f"WITH {_alloc(method, 123)} SELECT st AS stratum, pixels, q AS quota FROM quota"


def _ranked(source: str, order: str = "") -> str:
    return f"SELECT s.*, row_number() OVER (PARTITION BY st ORDER BY {order}{PRI}, pix) AS rank FROM {source} s"


def strat_random(method: str, n: int = 123) -> str:
    return f"WITH {_alloc(method, n)}, r AS ({_ranked('blk')}) SELECT row, col, x, y, r.st FROM r JOIN quota USING (st) WHERE rank <= q"


def strat_existing_force() -> str:
    return f"""WITH {_alloc('equal', 80)}, {EXISTING}, p AS (SELECT blk.* FROM blk JOIN ex USING (pix)), a AS (SELECT * FROM blk WHERE pix NOT IN (SELECT pix FROM ex)),
    r AS ({_ranked('a')}), have AS (SELECT st, count(*) AS n FROM p GROUP BY st)
    SELECT row, col, x, y, r.st, 0 AS existing FROM r JOIN quota USING (st) LEFT JOIN have USING (st) WHERE rank <= greatest(0, q - coalesce(n, 0))
    UNION ALL SELECT row, col, x, y, st, 1 FROM p"""


FOCAL = """fh AS (SELECT pix, row, col, st, count(*) OVER w = 3 AND min(st) OVER w = max(st) OVER w AS hok FROM blk WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
fv AS (SELECT pix, row, col, st, count(*) OVER w = 3 AND bool_and(hok) OVER w AND min(st) OVER w = max(st) OVER w AS eligible FROM fh WINDOW w AS (PARTITION BY col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def focal_eligible() -> str:
    return f"WITH {ORD}, {BLK}, {FOCAL} SELECT row, col, st AS strat, eligible FROM fv"


def strat_queinnec() -> str:
    return f"""WITH {_alloc('prop', 123)}, {FOCAL}, b AS (SELECT blk.*, CASE WHEN eligible THEN 0 ELSE 1 END AS stage FROM blk JOIN fv USING (pix)), r AS ({_ranked('b', 'stage, ')})
    SELECT row, col, x, y, r.st FROM r JOIN quota USING (st) WHERE rank <= q"""


def strat_mapped_fields() -> str:
    return f"""WITH {ORD}, s AS (SELECT pix, row, col, x, y, {binned('b1', [200000.0])} AS a, {binned('b2', [60000.0])} AS b FROM ord), m AS (SELECT *, a + b * 2 AS st FROM s WHERE b IS NOT NULL),
    r AS ({_ranked('m')}), n AS (SELECT st, count(*) AS pixels FROM m GROUP BY st)
    SELECT row, col, x, y, a AS strat_b1, b AS strat_b2 FROM r JOIN n USING (st) WHERE rank <= least(10, pixels)"""


def systematic(shape: str, location: str, cell: float = 300.0, rotation: float = 30.0) -> str:
    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    dx, dy = (cell, cell) if shape == "square" else (1.5 * cell, math.sqrt(3) * cell)
    half = cell / 2 if shape == "square" else cell * math.sqrt(3) / 2
    wide = cell / 2 if shape == "square" else cell
    cx = f"(i + 0.5) * {cell!r}::DOUBLE" if shape == "square" else f"i * {dx!r}::DOUBLE"
    cy = f"(j + 0.5) * {cell!r}::DOUBLE" if shape == "square" else f"(j + ((i % 2 + 2) % 2) * 0.5) * {dy!r}::DOUBLE"
    uniform = lambda axis: f"(2 * (('0x' || substr(md5('{SEED}|{axis}|' || i || '|' || j || '|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1)"
    if location == "centers":
        points = "SELECT i, j, 0 AS k, cx AS u, cy AS v FROM cells"
    elif location == "corners":
        two = [(-half, -half), (half, -half)] if shape == "square" else [(-cell, 0.0), (-cell / 2, -half)]
        points = " UNION ALL ".join(f"SELECT i, j, {k} AS k, cx + {a!r}::DOUBLE AS u, cy + {b!r}::DOUBLE AS v FROM cells" for k, (a, b) in enumerate(two))
    else:
        inside = f"WHERE abs(b) <= {half!r} AND {math.sqrt(3)!r} * abs(a) + abs(b) <= {2 * half!r}" if shape == "hexagon" else ""
        points = f"SELECT i, j, k, cx + a AS u, cy + b AS v FROM (SELECT *, {uniform('x')} * {wide!r} AS a, {uniform('y')} * {half!r} AS b FROM cells CROSS JOIN (SELECT range AS k FROM range(10))) {inside}"
    pick = "SELECT arg_min(x, k) AS x, arg_min(y, k) AS y FROM o GROUP BY i, j" if location == "random" else "SELECT x, y FROM o"
    return f"""WITH e AS (SELECT 431100.0::DOUBLE AS x1, 434100.0::DOUBLE AS x2, 5343240.0::DOUBLE - 20.0 * (max(o_orderkey) // 150 + 1) AS y1, 5343240.0::DOUBLE AS y2 FROM orders),
    t AS (SELECT unnest([x1, x1, x2, x2]) AS x, unnest([y1, y2, y1, y2]) AS y FROM e), u AS (SELECT x * {c!r} + y * {s!r} AS x, y * {c!r} - x * {s!r} AS y FROM t),
    b AS (SELECT CAST(floor(min(x) / {dx!r}) AS BIGINT) - 1 AS i1, CAST(ceil(max(x) / {dx!r}) AS BIGINT) + 1 AS i2, CAST(floor(min(y) / {dy!r}) AS BIGINT) - 1 AS j1, CAST(ceil(max(y) / {dy!r}) AS BIGINT) + 1 AS j2 FROM u),
    ii AS (SELECT unnest(range(i1, i2 + 1)) AS i FROM b), jj AS (SELECT unnest(range(j1, j2 + 1)) AS j FROM b),
    cells AS (SELECT i, j, {cx} AS cx, {cy} AS cy FROM ii CROSS JOIN jj), p AS ({points}),
    r AS (SELECT i, j, k, u * {c!r} - v * {s!r} AS x, u * {s!r} + v * {c!r} AS y FROM p), o AS (SELECT r.* FROM r, e WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)
    SELECT round(x, 3) AS x, round(y, 3) AS y FROM ({pick})"""


def pca_moments() -> str:
    return f"""WITH {ORD}, c AS (SELECT b1, b2, b3 FROM ord WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL)
    SELECT count(*) AS n, round(avg(b1), 4) AS mean_0, round(stddev_pop(b1), 4) AS std_0, round(avg(b2), 4) AS mean_1, round(stddev_pop(b2), 4) AS std_1, round(avg(b3), 4) AS mean_2,
      round(stddev_pop(b3), 4) AS std_2, round(corr(b1, b2), 6) AS corr_0_1, round(corr(b1, b3), 6) AS corr_0_2, round(corr(b2, b3), 6) AS corr_1_2 FROM c"""


def pca_two_band() -> str:
    return f"""WITH {ORD}, m AS (SELECT avg(b2) AS m2, stddev_pop(b2) AS s2, avg(b3) AS m3, stddev_pop(b3) AS s3 FROM ord WHERE b2 IS NOT NULL AND b3 IS NOT NULL)
    SELECT pix, round(((b2 - m2) / s2 + (b3 - m3) / s3) / sqrt(2.0::DOUBLE), 4) + 0.0 AS comp_1 FROM ord, m"""


def pca_three_band() -> str:
    """Eigenvectors by power iteration, of the correlations and then of what the first leaves; the third is at right angles to both."""

    def iterated(name: str, less: str) -> str:
        times = [f"{row} - {less.format(e=e)}" if less else row for row, e in (("x + a * y + b * z", "vx"), ("a * x + y + c * z", "vy"), ("b * x + c * y + z", "vz"))]
        return f"""{name}(k, x, y, z) AS (SELECT 0, 1.0::DOUBLE, 0.7::DOUBLE, 0.4::DOUBLE UNION ALL
          SELECT k + 1, nx / sqrt(nx * nx + ny * ny + nz * nz), ny / sqrt(nx * nx + ny * ny + nz * nz), nz / sqrt(nx * nx + ny * ny + nz * nz)
          FROM (SELECT k, {times[0]} AS nx, {times[1]} AS ny, {times[2]} AS nz FROM {name}, m{", v1" if less else ""} WHERE k < 400))"""

    def signed(x: str, y: str, z: str) -> str:
        return f"CASE WHEN round(abs({x}), 9) >= greatest(round(abs({y}), 9), round(abs({z}), 9)) THEN sign({x}) WHEN round(abs({y}), 9) >= round(abs({z}), 9) THEN sign({y}) ELSE sign({z}) END"

    comps = ", ".join(
        f"round(((b1 - m1) / s1 * {n}.x + (b2 - m2) / s2 * {n}.y + (b3 - m3) / s3 * {n}.z) * {signed(f'{n}.x', f'{n}.y', f'{n}.z')}, 4) + 0.0 AS comp_{k}"
        for k, n in ((1, "e1"), (2, "e2"), (3, "e3"))
    )
    return f"""WITH RECURSIVE {ORD}, f AS (SELECT * FROM ord WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL),
    m AS (SELECT avg(b1) AS m1, stddev_pop(b1) AS s1, avg(b2) AS m2, stddev_pop(b2) AS s2, avg(b3) AS m3, stddev_pop(b3) AS s3, corr(b1, b2) AS a, corr(b1, b3) AS b, corr(b2, b3) AS c FROM f),
    {iterated("p", "")}, e1 AS (SELECT x, y, z FROM p WHERE k = 400),
    v1 AS (SELECT x AS vx, y AS vy, z AS vz, x * x + y * y + z * z + 2 * (a * x * y + b * x * z + c * y * z) AS l FROM e1, m),
    {iterated("q", "l * {e} * (vx * x + vy * y + vz * z)")}, e2 AS (SELECT x, y, z FROM q WHERE k = 400),
    e3 AS (SELECT e1.y * e2.z - e1.z * e2.y AS x, e1.z * e2.x - e1.x * e2.z AS y, e1.x * e2.y - e1.y * e2.x AS z FROM e1, e2)
    SELECT pix, {comps} FROM ord, m, e1, e2, e3"""


def clhs_checks() -> str:
    return "SELECT 50::BIGINT AS samples, 50::BIGINT AS pixels, 50::BIGINT AS with_data, true AS better"


def vector_wkt() -> str:
    return """SELECT * FROM (VALUES (0::BIGINT, 1.5::DOUBLE, -2.0::DOUBLE, 30.0::DOUBLE, 4.0::DOUBLE), (0, 30.0, 4.0, 30.0, 5.5), (1, 0.0, 0.0, 1.0, 1.0), (1, 5.0, 5.0, 6.0, 7.0))
    AS s(fid, x1, y1, x2, y2)"""


def clhs_quantile_counts() -> str:
    rows = []
    for b in ("value", "user_id"):
        cuts = ", ".join(_cut(b, k / 10) for k in range(1, 10))
        rows.append(f"SELECT '{b}' AS feature, CAST(len(list_filter((SELECT [{cuts}] FROM evt), lambda q: q < {b})) AS INTEGER) AS bin FROM t")
    return f"WITH {EVT}, t AS (SELECT * FROM evt ORDER BY {PRI}, pix LIMIT 50), u AS ({' UNION ALL '.join(rows)}) SELECT feature, bin, count(*) AS n FROM u GROUP BY 1, 2"


def clhs_corr() -> str:
    return f"WITH {EVT} SELECT count(*) AS n, round(corr(value, user_id), 6) AS corr_0_1 FROM evt"


def clhs_objective() -> str:
    return f"WITH c AS ({clhs_quantile_counts()}) SELECT CAST(sum(abs(n - 1)) + 20 - count(*) AS BIGINT) AS spread FROM c"


def downsampled() -> str:
    return f"WITH {ORD} SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, b1 FROM ord WHERE row % 2 = 0 AND col % 2 = 0"


def vector_info() -> str:
    return "SELECT 'access' AS layer, 2::BIGINT AS feature_count, 0 AS field_count, 'LineString' AS geometry_type, 431150.0::DOUBLE AS xmin, 434050.0::DOUBLE AS xmax, 5323240.0::DOUBLE AS ymin, 5343240.0::DOUBLE AS ymax"


def existing_lookup() -> str:
    return f"WITH {ORD}, {BLK}, {EXISTING} SELECT pix, st FROM blk JOIN ex USING (pix)"


def samples_wkt() -> str:
    return f"WITH {EVT}, s AS ({_top('evt', '20')}) SELECT 'POINT (' || x || ' ' || y || ')' AS wkt FROM s"


def srast_info() -> str:
    return "SELECT * FROM (VALUES (0, 'x <= 30000.0'), (1, '30000.0 < x <= 50000.0'), (2, '50000.0 < x <= 70000.0'), (3, '70000.0 < x <= 90000.0'), (4, 'x > 90000.0')) t(strata, description)"
