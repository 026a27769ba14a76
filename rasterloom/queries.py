"""Queries over raster views of relational tables, each with the SQL that says the same.

Views: `fine` (events: 100 columns of 0.01 degrees, a class 0 to 4 and a value a cell), `coarse` (part: 20 columns of 0.05 degrees over the same
extent, classes 0 to 5), `annual` (lineitem: classes 0 to 7 on the coarse grid, a year each), `zones` (nation: 5 x 5 boxes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.projection import A, E1, E2, K0
from .grid import Grid, Raster
from .operators.align import align, resample
from .operators.area import cell_area, cell_bounds
from .operators.clip import clip_bbox, clip_geometry, proportion_mask
from .operators.geometry import box, box_column, dissolve_zones, geometry_area, geometry_bounds
from .operators.zonal import category_stats, class_area, combine_classes, combined_class_area, legend_of, weighted_class_area
from .plans.catalog import DatasetConfig, manifest, time_axis

FINE_LEGEND = {0: "error", 1: "click", 2: "purchase", 3: "signup", 4: "view"}
COARSE_LEGEND = {0: "none"} | {k: f"size_{k}" for k in range(1, 6)}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- views -------------------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, key: str, columns: int) -> int:
    """Grid rows of a dense key, from the table's row count."""
    return -(-df.select(key).count() // columns)


def fine(spark: SparkSession, sf_dir: str, what: str = "class") -> Raster:
    e = _table(spark, sf_dir, "events")
    code = F.lit(None).cast("int")
    for k, name in FINE_LEGEND.items():
        code = F.when(F.col("event_type") == name, F.lit(k)).otherwise(code)
    own = {"class": code.alias("value"), "value": F.col("value"), "both": code.alias("class")}[what]
    p = e.select(F.floor(F.col("event_id") / 100).cast("int").alias("yi"), (F.col("event_id") % 100).cast("int").alias("xi"), own, *[F.col("value")] * (what == "both"))
    return Raster.of(p, Grid(-60, 0, 0.01, -0.01, 100, _rows(e, "event_id", 100)), legends={"value": FINE_LEGEND} if what == "class" else {})


def coarse(spark: SparkSession, sf_dir: str, what: str = "class") -> Raster:
    d = _table(spark, sf_dir, "part")
    own = (F.col("p_size") % 6).alias("value") if what == "class" else F.col("p_retailprice").alias("value")
    p = d.select(F.floor(F.col("p_partkey") / 20).cast("int").alias("yi"), (F.col("p_partkey") % 20).cast("int").alias("xi"), own)
    return Raster.of(p, Grid(-60, 0, 0.05, -0.01, 20, _rows(d, "p_partkey", 20)), legends={"value": COARSE_LEGEND} if what == "class" else {})


def annual(spark: SparkSession, sf_dir: str) -> Raster:
    li = _table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("cell"), "l_linenumber")
    best = li.groupBy("year", "cell").agg(F.max("l_linenumber").alias("value"))
    n = _rows(_table(spark, sf_dir, "part"), "p_partkey", 20)
    years = li.select("year").distinct()  # seven, of one narrow column
    cells = spark.range(20 * n).select(F.col("id").alias("cell")).crossJoin(F.broadcast(years))
    d = cells.join(best, ["year", "cell"], "left")
    p = d.select(F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("time"), F.floor(F.col("cell") / 20).cast("int").alias("yi"), (F.col("cell") % 20).cast("int").alias("xi"), F.coalesce("value", F.lit(0)).alias("value"))
    return Raster.of(p, Grid(-60, 0, 0.05, -0.01, 20, n))


def zones(spark: SparkSession, sf_dir: str, offset: float = 0.0) -> DataFrame:
    """(zone_id, region, geom): boxes 0.2 degrees wide and a fifth of the grid high."""
    h = 0.01 * _rows(_table(spark, sf_dir, "events"), "event_id", 100) / 5
    x, y = F.lit(-60 + offset) + F.lit(0.2) * (F.col("n_nationkey") % 5), F.lit(-offset) - F.lit(h) * F.floor(F.col("n_nationkey") / 5)
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("region"), box_column(x, y - F.lit(h), x + F.lit(0.2), y).alias("geom"))


def _zone_box(spark: SparkSession, sf_dir: str, k: int = 7, offset: float = 0.003) -> dict:
    h = 0.01 * _rows(_table(spark, sf_dir, "events"), "event_id", 100) / 5
    x, y = -60 + offset + 0.2 * (k % 5), -offset - h * (k // 5)
    return box(x, y - h, x + 0.2, y)


_CASE = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in FINE_LEGEND.items()) + " END"
_FINE = f"fine AS (SELECT CAST(event_id // 100 AS INTEGER) AS yi, CAST(event_id % 100 AS INTEGER) AS xi, {_CASE} AS value, value AS v FROM events)"
_COARSE = "coarse AS (SELECT CAST(p_partkey // 20 AS INTEGER) AS yi, CAST(p_partkey % 20 AS INTEGER) AS xi, p_size % 6 AS value, p_retailprice AS v FROM part)"
_ANNUAL = """best AS (SELECT year(l_shipdate) AS y, l_partkey AS c, max(l_linenumber) AS value FROM lineitem GROUP BY ALL),
cells AS (SELECT c, y FROM (SELECT unnest(range(20 * CAST(ceil(count(*) / 20) AS BIGINT))) AS c FROM part), (SELECT DISTINCT y FROM best)),
annual AS (SELECT make_timestamp(cells.y, 1, 1, 0, 0, 0) AS time, CAST(cells.c // 20 AS INTEGER) AS yi, CAST(cells.c % 20 AS INTEGER) AS xi, coalesce(value, 0) AS value
  FROM cells LEFT JOIN best ON cells.c = best.c AND cells.y = best.y)"""
_H = "(SELECT 0.01 * ceil(count(*) / 100) / 5 FROM events)"


def _zones_sql(offset: float) -> str:
    return f"""zones AS (SELECT n_nationkey AS zone_id, n_regionkey AS region, -60 + {offset} + 0.2 * (n_nationkey % 5) AS minx, -60 + {offset} + 0.2 * (n_nationkey % 5) + 0.2 AS maxx,
  -{offset} - {_H} * (n_nationkey // 5) - {_H} AS miny, -{offset} - {_H} * (n_nationkey // 5) AS maxy FROM nation)"""


def _y(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"({A / (2 * K0)!r} * {1 - E2!r} * ({s} / (1 - {E2!r} * {s} * {s}) - ln((1 - {E1!r} * {s}) / (1 + {E1!r} * {s})) / {2 * E1!r}))"


def _row_area(dx: float, unit: str = "1e-4") -> str:
    """Area of a cell of row yi."""
    return f"({A * K0!r} * radians({dx}) * abs({_y('-0.01 * yi')} - {_y('-0.01 * (yi + 1)')}) * {unit})"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


# --- areas by class -----------------------------------------------------------------------------------------------------


@query(f"WITH {_FINE} SELECT value AS classification, CAST(count(*) AS DOUBLE) AS cells FROM fine WHERE value <> 0 GROUP BY ALL")
def zonal_pixel_count(spark: SparkSession, d: str) -> DataFrame:
    return class_area(fine(spark, d), count_name="cells", wide=False)


@query(f"WITH {_FINE} SELECT value AS classification, round(sum(0.09), 6) AS area_hectares FROM fine GROUP BY ALL")
def zonal_const_area(spark: SparkSession, d: str) -> DataFrame:
    return _round(class_area(fine(spark, d), 0.09, wide=False, drop_zero=False), "area_hectares")


@query(f"WITH {_FINE} SELECT value AS classification, round(sum({_row_area(0.01)}), 4) AS area_hectares FROM fine WHERE value <> 0 GROUP BY ALL")
def zonal_area_6933_long(spark: SparkSession, d: str) -> DataFrame:
    return _round(class_area(fine(spark, d), True, wide=False), "area_hectares", to=4)


@query(f"WITH {_FINE}, a AS (SELECT value, {_row_area(0.01)} AS a FROM fine) SELECT " + ", ".join(f'round(sum(a) FILTER (WHERE value = {k}), 4) AS "{k}"' for k in range(1, 5)) + ", round(sum(a) FILTER (WHERE value > 0), 4) AS total_area FROM a")
def zonal_area_wide(spark: SparkSession, d: str) -> DataFrame:
    r = fine(spark, d)
    return _round(class_area(Raster(r.pixels, r.grid), True, classes=[1, 2, 3, 4]), "1", "2", "3", "4", "total_area", to=4)


@query(f"WITH {_FINE}, a AS (SELECT value, {_row_area(0.01)} AS a FROM fine) SELECT " + ", ".join(f"round(sum(a) FILTER (WHERE value = {k}), 4) AS {n}" for k, n in FINE_LEGEND.items()) + ", round(sum(a), 4) AS total_area FROM a")
def zonal_wide_legend_total(spark: SparkSession, d: str) -> DataFrame:
    return _round(class_area(fine(spark, d), True, drop_zero=False), *FINE_LEGEND.values(), "total_area", to=4)


@query(f"WITH {_ANNUAL} SELECT time, value AS classification, round(sum({_row_area(0.05)}), 4) AS area_hectares FROM annual WHERE value <> 0 GROUP BY ALL")
def zonal_time_long(spark: SparkSession, d: str) -> DataFrame:
    return _round(class_area(annual(spark, d), True, wide=False), "area_hectares", to=4)


@query(f"WITH {_ANNUAL} SELECT time, " + ", ".join(f'CAST(count(*) FILTER (WHERE value = {k}) AS DOUBLE) AS "{k}"' for k in range(8)) + ", CAST(count(*) AS DOUBLE) AS total_area FROM annual GROUP BY time")
def zonal_time_wide(spark: SparkSession, d: str) -> DataFrame:
    return class_area(annual(spark, d), drop_zero=False, classes=list(range(8))).na.fill(0.0)


@query(f"WITH {_FINE} SELECT value AS classification, round(sum(v), 4) AS area_hectares FROM fine WHERE value <> 0 GROUP BY ALL")
def zonal_area_raster(spark: SparkSession, d: str) -> DataFrame:
    """A raster of areas, here the continuous one."""
    return _round(class_area(fine(spark, d), fine(spark, d, "value"), wide=False), "area_hectares", to=4)


# --- grids --------------------------------------------------------------------------------------------------------------


@query(f"SELECT CAST(yi AS INTEGER) AS yi, round({_row_area(0.01)}, 6) AS area FROM (SELECT unnest(range(CAST(ceil(count(*) / 100) AS BIGINT))) AS yi FROM events)")
def area_grid_rows_ha(spark: SparkSession, d: str) -> DataFrame:
    return _round(cell_area(fine(spark, d)), "area")


@query(f"SELECT CAST(yi AS INTEGER) AS yi, round({_row_area(0.01, '1.0')}, 3) AS area FROM (SELECT unnest(range(CAST(ceil(count(*) / 100) AS BIGINT))) AS yi FROM events)")
def area_grid_rows_m2(spark: SparkSession, d: str) -> DataFrame:
    return _round(cell_area(fine(spark, d), hectares=False), "area", to=3)


@query("""WITH y AS (SELECT unnest(range(CAST(ceil(count(*) / 100) AS BIGINT))) AS k FROM events), c AS (SELECT k, -0.01 * (k + 0.5) * (1 + k / 1000) AS lat FROM y)
SELECT CAST(k AS INTEGER) AS yi, round(lat, 9) AS lat, round(coalesce((lag(lat) OVER w + lat) / 2, lat - (lead(lat) OVER w - lat) / 2), 9) AS lo, round(coalesce((lat + lead(lat) OVER w) / 2, lat + (lat - lag(lat) OVER w) / 2), 9) AS hi FROM c WINDOW w AS (ORDER BY k)""")
def cell_bounds_irregular(spark: SparkSession, d: str) -> DataFrame:
    """Bounds from irregular centres."""
    n = fine(spark, d).grid.ny
    axis = spark.range(n).select(F.col("id").cast("int").alias("yi"), (F.lit(-0.01) * (F.col("id") + 0.5) * (1 + F.col("id") / 1000)).alias("lat"))
    return _round(cell_bounds(axis, "yi", "lat", latitude=True), "lat", "lo", "hi", to=9)


def _geodesic_sql(passes: int = 8) -> str:
    """Vincenty's formula with its passes as nested selects; the meridian as a geodesic of no longitude."""
    f, b = "(1 / 298.257223563)", "(6378137.0 * (1 - 1 / 298.257223563))"

    def inverse(source: str, name: str, lat1: str, lat2: str, span: str) -> str:
        out = [f"{name}0 AS (SELECT *, atan((1 - {f}) * tan(radians({lat1}))) AS u1, atan((1 - {f}) * tan(radians({lat2}))) AS u2, radians({span}) AS sp, radians({span}) AS lam FROM {source})"]
        for k in range(passes):
            out.append(f"""{name}{k}a AS (SELECT * EXCLUDE (lam), sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs, lam FROM {name}{k}),
{name}{k}b AS (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM {name}{k}a),
{name}{k}c AS (SELECT *, 1 - sa * sa AS c2, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS cm FROM {name}{k}b),
{name}{k}d AS (SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS c FROM {name}{k}c)""")
            if k < passes - 1:
                out.append(f"{name}{k + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sg, sa, c2, cm, c), sp + (1 - c) * {f} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS lam FROM {name}{k}d)")
        last = f"{name}{passes - 1}d"
        out.append(f"""{name}u AS (SELECT *, c2 * (pow(6378137.0, 2) - pow({b}, 2)) / pow({b}, 2) AS uu FROM {last}),
{name}v AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ba, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM {name}u),
{name} AS (SELECT yi, {b} * ba * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS m FROM {name}v)""")
        return ",\n".join(out)

    return f"""WITH r AS (SELECT yi, -0.01 * yi AS lo, -0.01 * (yi + 1) AS hi FROM (SELECT unnest(range(CAST(ceil(count(*) / 100) AS BIGINT))) AS yi FROM events)),
{inverse("r", "h", "lo", "hi", "0.0")},
{inverse("r", "w", "((lo + hi) / 2)", "((lo + hi) / 2)", "0.01")}
SELECT CAST(h.yi AS INTEGER) AS yi, round(h.m * w.m * 1e-4, 3) AS area FROM h JOIN w ON h.yi = w.yi"""


@query(_geodesic_sql())
def area_grid_geodesic(spark: SparkSession, d: str) -> DataFrame:
    return _round(cell_area(fine(spark, d), high_accuracy=True), "area", to=3)


@query("SELECT make_timestamp(unnest(range(2000, 2025)), 1, 1, 0, 0, 0) AS time")
def time_axis_annual(spark: SparkSession, d: str) -> DataFrame:
    return time_axis(spark, "2000-01-01", "2024-01-01")


# --- clipping -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_FINE} SELECT yi - 1 AS yi, xi - 20 AS xi, value FROM fine WHERE xi BETWEEN 20 AND 50 AND yi BETWEEN 1 AND 6")
def bbox_clip(spark: SparkSession, d: str) -> DataFrame:
    return clip_bbox(fine(spark, d), (-59.795, -0.065, -59.495, -0.015)).pixels


@query(f"WITH {_ANNUAL} SELECT yi, xi - 4 AS xi, value FROM annual WHERE time = (SELECT min(time) FROM annual) AND xi BETWEEN 4 AND 10 AND yi <= 6")
def bbox_clip_first_time(spark: SparkSession, d: str) -> DataFrame:
    return clip_bbox(annual(spark, d), (-59.795, -0.065, -59.495, 0.5), first_time=True).pixels


#: Zone 7 by cells, as the box of the queries below.
_ZONE7 = f"z AS (SELECT * FROM zones WHERE zone_id = 7), w AS (SELECT CAST(floor(round((minx + 60) / 0.01, 6)) AS INTEGER) AS x1, CAST(ceil(round((maxx + 60) / 0.01, 6)) AS INTEGER) - 1 AS x2, CAST(floor(round(-maxy / 0.01, 6)) AS INTEGER) AS y1, CAST(ceil(round(-miny / 0.01, 6)) AS INTEGER) - 1 AS y2, z.* FROM z)"


@query(f"WITH {_FINE}, {_zones_sql(0.003)}, {_ZONE7} SELECT yi - y1 AS yi, xi - x1 AS xi, CASE WHEN -60 + 0.01 * (xi + 0.5) > minx AND -60 + 0.01 * (xi + 0.5) < maxx AND -0.01 * (yi + 0.5) > miny AND -0.01 * (yi + 0.5) < maxy THEN value END AS value FROM fine, w WHERE xi BETWEEN x1 AND x2 AND yi BETWEEN y1 AND y2")
def clip_zone_center(spark: SparkSession, d: str) -> DataFrame:
    return clip_geometry(fine(spark, d), _zone_box(spark, d)).pixels


@query(f"WITH {_FINE}, {_zones_sql(0.003)}, {_ZONE7} SELECT yi - y1 AS yi, xi - x1 AS xi, value FROM fine, w WHERE xi BETWEEN x1 AND x2 AND yi BETWEEN y1 AND y2")
def clip_zone_all_touch(spark: SparkSession, d: str) -> DataFrame:
    return clip_geometry(fine(spark, d), _zone_box(spark, d), all_touched=True).pixels


_SHARE = "greatest(0, least(maxx, -60 + 0.01 * (xi + 1)) - greatest(minx, -60 + 0.01 * xi)) * greatest(0, least(maxy, -0.01 * yi) - greatest(miny, -0.01 * (yi + 1))) / 0.0001"


@query(f"WITH {_FINE}, {_zones_sql(0.003)} SELECT yi, xi, round({_SHARE}, 6) AS proportion FROM fine, (SELECT * FROM zones WHERE zone_id = 7)")
def proportion_mask_zone(spark: SparkSession, d: str) -> DataFrame:
    return _round(proportion_mask(fine(spark, d), _zone_box(spark, d), overwrite=True), "proportion")


@query(f"WITH {_FINE}, {_zones_sql(0.003)} SELECT value AS classification, round(sum({_SHARE} * {_row_area(0.01)}), 4) AS area_hectares FROM fine, (SELECT * FROM zones WHERE zone_id = 7) WHERE value <> 0 AND {_SHARE} > 1e-12 GROUP BY ALL")
def weighted_zone_area(spark: SparkSession, d: str) -> DataFrame:
    r = fine(spark, d)
    return _round(weighted_class_area(r, proportion_mask(r, _zone_box(spark, d), overwrite=True)), "area_hectares", to=4)


@query(f"WITH {_FINE} SELECT yi, xi, CASE WHEN value > 2 THEN 1 ELSE 0 END AS value FROM fine")
def binary_mask(spark: SparkSession, d: str) -> DataFrame:
    return fine(spark, d).where(F.col("value") > 2).binary_mask().pixels


# --- two rasters --------------------------------------------------------------------------------------------------------


@query(f"WITH {_FINE}, {_COARSE} SELECT f.yi, f.xi, c.value FROM fine f JOIN coarse c ON c.yi = f.yi AND c.xi = f.xi // 5")
def align_nearest(spark: SparkSession, d: str) -> DataFrame:
    return align(fine(spark, d), coarse(spark, d), area=False)[0].pixels


_OVER = f"WITH {_FINE}, o AS (SELECT yi, xi // 5 AS xi, value, v FROM fine)"


def _resampled(method: str, what: str = "value", to: int = 8) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = resample(fine(spark, d, what), coarse(spark, d).grid, method).pixels
        return out if what == "class" else _round(out, "value", to=to)

    run.__name__ = f"resample_{method}"
    return run


for _m, _expr in {"average": "avg(v)", "max": "max(v)", "min": "min(v)", "med": "quantile_cont(v, 0.5)", "q1": "quantile_cont(v, 0.25)", "q3": "quantile_cont(v, 0.75)", "sum": "sum(v)", "rms": "sqrt(avg(v * v))"}.items():
    query(f"{_OVER} SELECT yi, xi, round({_expr}, 8) AS value FROM o GROUP BY yi, xi")(_resampled(_m))
query(f"{_OVER}, n AS (SELECT yi, xi, value, count(*) AS n FROM o GROUP BY ALL) SELECT yi, xi, arg_max(value, n * 100 - value) AS value FROM n GROUP BY yi, xi")(_resampled("mode", "class"))
# in y both grids are alike; in x a cell of the coarse grid has its centre in the middle of its third fine one
query(f"WITH {_FINE} SELECT a.yi, CAST((a.xi - 2) // 5 AS INTEGER) AS xi, round(sum(b.v * (1 - abs(b.xi - a.xi) / 5.0)) / sum(1 - abs(b.xi - a.xi) / 5.0), 8) AS value FROM fine a JOIN fine b ON b.yi = a.yi AND abs(b.xi - a.xi) < 5 WHERE a.xi % 5 = 2 GROUP BY a.yi, a.xi")(_resampled("bilinear"))


def _cubic_sql(x: str) -> str:
    return f"(CASE WHEN abs({x}) <= 1 THEN 1.5 * pow(abs({x}), 3) - 2.5 * pow({x}, 2) + 1 ELSE -0.5 * pow(abs({x}), 3) + 2.5 * pow({x}, 2) - 4 * abs({x}) + 2 END)"


_X = "((b.xi - a.xi) / 5.0)"
query(f"WITH {_FINE} SELECT a.yi, CAST((a.xi - 2) // 5 AS INTEGER) AS xi, round(sum(b.v * {_cubic_sql(_X)}) / sum({_cubic_sql(_X)}), 8) AS value FROM fine a JOIN fine b ON b.yi = a.yi AND abs(b.xi - a.xi) < 10 WHERE a.xi % 5 = 2 GROUP BY a.yi, a.xi")(_resampled("cubic"))


_BOTH = f"WITH {_FINE}, {_COARSE}, m AS (SELECT f.yi, f.xi, f.value AS p, c.value AS s, f.v FROM fine f JOIN coarse c ON c.yi = f.yi AND c.xi = f.xi // 5)"


@query(f"{_BOTH} SELECT yi, xi, p, s, CASE WHEN p = 0 OR s = 0 THEN 0.0::DOUBLE ELSE round(p + s / 10, 6) END AS code FROM m")
def combined_classification(spark: SparkSession, d: str) -> DataFrame:
    a = fine(spark, d)
    return _round(combine_classes(a, align(a, coarse(spark, d), area=False)[0]), "code")


@query(f"{_BOTH} SELECT p AS \"primary\", s AS secondary, p || '.' || s AS classification, round(sum({_row_area(0.01)}), 4) AS area_hectares FROM m WHERE p <> 0 AND s <> 0 GROUP BY p, s")
def combined_stats_long(spark: SparkSession, d: str) -> DataFrame:
    return _round(combined_class_area(fine(spark, d), coarse(spark, d), True, wide=False), "area_hectares", to=4)


@query(f"{_BOTH} SELECT p AS \"primary\", s AS secondary, p || '.' || s AS classification, CAST(count(*) AS DOUBLE) AS cells FROM m GROUP BY p, s")
def combined_stats_with_zero(spark: SparkSession, d: str) -> DataFrame:
    return combined_class_area(fine(spark, d), coarse(spark, d), count_name="cells", wide=False, drop_zero=False)


_PAIRS = [(p, s) for p in range(1, 5) for s in range(1, 6)]


@query(f"{_BOTH} SELECT " + ", ".join(f'CAST(count(*) FILTER (WHERE p = {p} AND s = {s}) AS DOUBLE) AS "{FINE_LEGEND[p]} - {COARSE_LEGEND[s]}"' for p, s in _PAIRS) + ", CAST(count(*) FILTER (WHERE p > 0 AND s > 0) AS DOUBLE) AS total_area FROM m")
def combined_stats_labelled(spark: SparkSession, d: str) -> DataFrame:
    return combined_class_area(fine(spark, d), coarse(spark, d), classes=_PAIRS).na.fill(0.0)


@query(f"WITH {_FINE} SELECT value AS category, round(avg(v) FILTER (WHERE v > 0), 6) AS mean_value, round(stddev_pop(v) FILTER (WHERE v > 0), 6) AS std_value FROM fine WHERE value > 0 GROUP BY value")
def category_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return _round(category_stats(fine(spark, d), fine(spark, d, "value")), "mean_value", "std_value")


@query(f"WITH {_ANNUAL}, {_COARSE} SELECT a.time, a.value AS category, round(avg(v), 6) AS mean_value, round(stddev_pop(v), 6) AS std_value FROM annual a LEFT JOIN (SELECT yi, xi, v FROM coarse WHERE v > 0) c ON a.yi = c.yi AND a.xi = c.xi WHERE a.value > 0 GROUP BY a.time, a.value")
def category_mean_std_time(spark: SparkSession, d: str) -> DataFrame:
    return _round(category_stats(annual(spark, d), coarse(spark, d, "price")), "mean_value", "std_value")


# --- zones --------------------------------------------------------------------------------------------------------------

_BOX_AREA = f"{A * K0!r} * radians(maxx - minx) * ({_y('maxy')} - {_y('miny')}) * 1e-4"


@query(f"WITH {_zones_sql(0.0)} SELECT zone_id, round({_BOX_AREA}, 4) AS area FROM zones")
def zone_area(spark: SparkSession, d: str) -> DataFrame:
    return zones(spark, d).select("zone_id", F.round(geometry_area("geom"), 4).alias("area"))


@query(f"WITH {_zones_sql(0.0)} SELECT zone_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("minx", "miny", "maxx", "maxy")) + " FROM zones")
def zone_bounds(spark: SparkSession, d: str) -> DataFrame:
    return zones(spark, d).select("zone_id", *[F.round(v, 9).alias(k) for k, v in geometry_bounds(F.col("geom")).items()])


@query(f"WITH {_zones_sql(0.0)} SELECT region, round(sum({_BOX_AREA}), 3) AS area, round(min(minx), 9) AS minx, round(min(miny), 9) AS miny, round(max(maxx), 9) AS maxx, round(max(maxy), 9) AS maxy FROM zones GROUP BY region")
def zone_dissolve_by_region(spark: SparkSession, d: str) -> DataFrame:
    out = dissolve_zones(zones(spark, d), ["region"]).drop("geom")
    return _round(_round(out, "area", to=3), "minx", "miny", "maxx", "maxy", to=9)


# --- catalog ------------------------------------------------------------------------------------------------------------

CONFIG = {
    "dataset_name": "sample", "organization": "org", "crs": "EPSG:4326", "dim": ["x", "y", "time"],
    "groups": {
        "yearly": {"time": {"start": "2000-01-01", "end": "2024-01-01", "freq": "YS"}, "classification": {"s3_path_prefix": "s3://b/cover_", "s3_path_suffix": ".tif", "unit_type": "int", "values": {"0": "no data", "1": "tall forest", "2": "shrub"}}},
        "root": {"height": {"s3_path": "s3://b/height.tif", "unit_type": "float", "unit_name": "m"}},
    },
}


@query("SELECT * FROM (VALUES ('yearly', 'classification', 0, 'no_data'), ('yearly', 'classification', 1, 'tall_forest'), ('yearly', 'classification', 2, 'shrub')) t(\"group\", var, code, meaning)")
def legend_from_config(spark: SparkSession, d: str) -> DataFrame:
    return DatasetConfig(CONFIG).legend_table(spark)


@query("""SELECT 'yearly' AS "group", 'classification' AS var, make_timestamp(y, 1, 1, 0, 0, 0) AS time, 's3://b/cover_' || y || '.tif' AS path FROM (SELECT unnest(range(2000, 2025)) AS y)
UNION ALL SELECT 'root', 'height', NULL, 's3://b/height.tif'""")
def manifest_paths(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, DatasetConfig(CONFIG)).select("group", "var", "time", "path")


@query("SELECT * FROM (VALUES (0, 'error'), (1, 'click'), (2, 'purchase'), (3, 'signup'), (4, 'view')) t(place, meaning)")
def flag_meanings(spark: SparkSession, d: str) -> DataFrame:
    names = legend_of(fine(spark, d))
    return spark.createDataFrame(list(enumerate(names)), "place int, meaning string")


from . import ingest_queries  # noqa: E402, F401  (its queries are registered here)
