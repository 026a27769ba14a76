"""Queries of reading, writing and cataloguing rasters, and of geometries that aren't boxes, each with the SQL that says the same.

Files are made from the shared tables in the folder that the cluster shares, and read again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.projection import A, K0, transform
from .grid import Grid, Raster
from .operators.align import align
from .operators.area import uses_geodesic
from .operators.clip import clip_geometry, proportion_mask
from .operators.geometry import box, box_column, dissolve_zones, first_feature_bbox, geojson_crs, geojson_zones, geometry_area, geometry_bounds, process_geometry, read_geojson
from .operators.zonal import class_area, combine_classes
from .plans.catalog import Catalog, DatasetConfig, grid_of_bbox, list_datasets, reprojected, time_axis
from .queries import _ANNUAL, _BOX_AREA, _FINE, _H, _SHARE, CONFIG, _resampled, _round, _row_area, _table, _y, _zone_box, _zones_sql, annual, coarse, fine, query, zones
from .session import Files, shared_dir
from .sources.geotiff import open_header, read_geotiffs, tiff_grid, write_geotiffs


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


# --- GeoJSON ------------------------------------------------------------------------------------------------------------


def _written_zones(spark: SparkSession, d: str, crs: str = "EPSG:4326", offset: float = 0.0) -> str:
    """The path of a GeoJSON document of the zones, a feature each."""
    rows = zones(spark, d, offset).orderBy("zone_id").collect()  # 25
    features = [{"type": "Feature", "properties": {"zone_id": r["zone_id"]}, "geometry": {"type": "Polygon", "coordinates": [[[p["x"], p["y"]] for p in r["geom"][0][0]]]}} for r in rows]
    path = f"{_folder(spark)}/zones.json"
    Files(spark).create(path, json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}, "features": features}).encode())
    return path


@query(f"WITH {_zones_sql(0.0)} SELECT CAST(row_number() OVER (ORDER BY zone_id) - 1 AS INTEGER) AS feature, 'EPSG:4326' AS crs, round({_BOX_AREA}, 4) AS area, round(minx, 9) AS minx, round(maxy, 9) AS maxy FROM zones")
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    z = geojson_zones(spark, _written_zones(spark, d))
    b = geometry_bounds(F.col("geom"))
    return z.select("feature", "crs", F.round(geometry_area("geom"), 4).alias("area"), F.round(b["minx"], 9).alias("minx"), F.round(b["maxy"], 9).alias("maxy"))


@query(f"WITH {_zones_sql(0.0)} SELECT 'EPSG:4326' AS crs, round({A * K0!r} * radians(minx), 3) AS minx, round({_y('miny')}, 3) AS miny, round({A * K0!r} * radians(maxx), 3) AS maxx, round({_y('maxy')}, 3) AS maxy FROM zones WHERE zone_id = 0")
def geojson_first_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the first feature, brought to another system."""
    document = read_geojson(_written_zones(spark, d), spark)
    return spark.createDataFrame([(geojson_crs(document), *(round(v, 3) for v in first_feature_bbox(document, "EPSG:6933")))], "crs string, minx double, miny double, maxx double, maxy double")


# --- GeoTIFF ------------------------------------------------------------------------------------------------------------

_STRIP = 64


def _written_tiffs(spark: SparkSession, raster: Raster, rows: int = _STRIP) -> dict[int, str]:
    """Paths by the first row that each holds."""
    return {r["y_lo"]: r["path"] for r in write_geotiffs(raster, _folder(spark), rows).collect()}  # a row a file


@query(f"WITH {_FINE} SELECT yi, xi, CAST(CASE WHEN value <> 0 THEN value END AS DOUBLE) AS value FROM fine")
def geotiff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Classes written as files and read again, window by window; class 0 as no data."""
    r = fine(spark, d)
    paths = _written_tiffs(spark, r.where(F.col("value") != 0))
    pixels = read_geotiffs(spark, list(paths.values()), window=32).where("band = 0")
    first = F.regexp_extract("path", r"strip_(\d+)\.tif", 1).cast("int") * _STRIP
    return pixels.select((F.col("yi") + first).alias("yi"), "xi", "value")


@query(f"SELECT CAST({_STRIP} * k AS INTEGER) AS y_lo, 'EPSG:4326' AS crs, -60.0 AS x0, round(-0.01 * {_STRIP} * k, 9) AS y0, 0.01 AS dx, -0.01 AS dy, 100 AS nx, CAST(least({_STRIP}, n - {_STRIP} * k) AS INTEGER) AS ny FROM (SELECT n, unnest(range(CAST(ceil(n / {_STRIP}) AS BIGINT))) AS k FROM (SELECT CAST(ceil(count(*) / 100) AS BIGINT) AS n FROM events))")
def geotiff_headers(spark: SparkSession, d: str) -> DataFrame:
    """Grids of files, from their headers alone."""
    rows = []
    for y_lo, path in _written_tiffs(spark, fine(spark, d)).items():
        g = open_header(spark, path).grid()
        rows.append((y_lo, g.crs, *(round(v, 9) for v in (g.x0, g.y0, g.dx, g.dy)), g.nx, g.ny))
    return spark.createDataFrame(rows, "y_lo int, crs string, x0 double, y0 double, dx double, dy double, nx int, ny int")


_WIDE_ = f"(SELECT {A * K0!r} * radians(1.0) AS w, {_y('0.0')} - {_y(f'-0.01 * least({_STRIP}, n)')} AS h, sqrt(100 * 100 + pow(least({_STRIP}, n), 2)) AS cells FROM (SELECT CAST(ceil(count(*) / 100) AS BIGINT) AS n FROM events))"


@query(f"SELECT 'EPSG:6933' AS crs, round({A * K0!r} * radians(-60.0), 3) AS x0, round({_y('0.0')}, 3) + 0.0 AS y0, round(sqrt(w * w + h * h) / cells, 6) AS dx, CAST(round(w / (sqrt(w * w + h * h) / cells)) AS INTEGER) AS nx, CAST(round(h / (sqrt(w * w + h * h) / cells)) AS INTEGER) AS ny FROM {_WIDE_}")
def template_reprojected(spark: SparkSession, d: str) -> DataFrame:
    """A template's grid in the configuration's system."""
    g = reprojected(tiff_grid(spark, _written_tiffs(spark, fine(spark, d))[0]), "EPSG:6933")
    return spark.createDataFrame([(g.crs, round(g.x0, 3), round(g.y0, 3) + 0.0, round(g.dx, 6), g.nx, g.ny)], "crs string, x0 double, y0 double, dx double, nx int, ny int")


@query("WITH n AS (SELECT CAST(ceil(count(*) / 100) AS BIGINT) AS n FROM events) SELECT 'x' AS axis, k AS cell, round(-60 + 0.05 * k, 9) AS centre FROM (SELECT unnest(range(20)) AS k) UNION ALL SELECT 'y', k, round(-0.01 * n + 0.05 * k, 9) FROM (SELECT n, unnest(range(CAST(ceil(round(n * 0.01 / 0.05, 9)) AS BIGINT))) AS k FROM n)")
def bbox_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Axes that a bounding box and a cell size give, from the lower left corner up."""
    r = fine(spark, d)
    g = grid_of_bbox(r.grid.bounds, 0.05)
    axes = [g.axis(spark, a).select(F.lit(a).alias("axis"), F.col(k).cast("long").alias("cell"), F.round(c, 9).alias("centre")) for a, k, c in (("x", "xi", "lon"), ("y", "yi", "lat"))]
    return axes[0].unionByName(axes[1])


# --- catalog ------------------------------------------------------------------------------------------------------------


def _configs(spark: SparkSession, d: str) -> str:
    """A folder with a configuration for each region, one that can't be read and a note."""
    files, folder = Files(spark), _folder(spark)
    for r in _table(spark, d, "region").collect():  # five
        files.create(f"{folder}/region_{r['r_regionkey']}.json", json.dumps({"dataset_name": f"region_{r['r_regionkey']}", "long_name": r["r_name"], "organization": "org"}).encode())
    files.create(f"{folder}/broken.json", b"{")
    files.create(f"{folder}/note.txt", b"x")
    return folder


@query("SELECT 'region_' || r_regionkey AS name, r_name AS long_name, 'org/region_' || r_regionkey AS repo FROM region")
def configs_listed(spark: SparkSession, d: str) -> DataFrame:
    folder = _configs(spark, d)
    names = [r["name"] for r in list_datasets(spark, folder).collect() if r["name"] != "broken"]
    loaded = [(n, DatasetConfig.load(spark, f"{folder}/{n}.json")) for n in names]
    return spark.createDataFrame([(n, c.long_name, c.repo_name) for n, c in loaded], "name string, long_name string, repo string")


@query("SELECT 'region_' || r_regionkey AS name, true AS created FROM region UNION ALL SELECT 'broken', false")
def repos_created(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalog(spark, _folder(spark))
    got = cat.create_from_configs(_configs(spark, d))
    rows = [(p.rsplit("/", 1)[-1].removesuffix(".json"), isinstance(v, str) and cat.exists(v)) for p, v in got.items()]
    return spark.createDataFrame(rows, "name string, created boolean")


_CONFIG = {"dataset_name": "cover", "organization": "org", "crs": "EPSG:4326", "dim": ["x", "y", "time"], "groups": {"yearly": {"time": {"start": "1992-01-01", "end": "1993-01-01", "freq": "YS"}, "line": {"unit_type": "int", "classification_type": "line number", "values": {"0": "none", "1": "line one"}}}, "root": {"value": {"unit_type": "float", "unit_name": "m"}}}}


@query(f"WITH {_FINE} SELECT yi, xi, -1.0::FLOAT AS value FROM fine")
def schema_filled(spark: SparkSession, d: str) -> DataFrame:
    """A group that was initialised and never written: the fill value in every cell."""
    cat, config = Catalog(spark, _folder(spark)), DatasetConfig(_CONFIG)
    cat.initialize(config, "root", fine(spark, d).grid)
    return cat.read(config, "root", "value", fill=-1).pixels


@query(f"WITH {_ANNUAL}, two AS (SELECT min(time) AS a, min(time) + INTERVAL 1 YEAR AS b FROM annual) SELECT time, yi, xi, CAST(CASE WHEN time = b AND xi BETWEEN 5 AND 9 AND yi BETWEEN 2 AND 4 THEN value + 10 ELSE value END AS SMALLINT) AS value FROM annual, two WHERE time IN (a, b)")
def catalog_populated(spark: SparkSession, d: str) -> DataFrame:
    """Two years from files, then a region of the second from another file; the rest of both stays."""
    r = annual(spark, d)
    times = [x["time"] for x in r.pixels.select("time").distinct().orderBy("time").limit(2).collect()]
    config = json.loads(json.dumps(_CONFIG))
    folder = _folder(spark)
    rows = []
    for t in times:
        path = write_geotiffs(r.at_time(t).cast("smallint"), f"{folder}/{t.year}", r.grid.ny).first()["path"]
        rows.append(("line", t, path, "smallint"))
    config["groups"]["yearly"]["time"] = {"start": str(times[0].date()), "end": str(times[1].date())}
    cat, config = Catalog(spark, folder), DatasetConfig(config)
    cat.initialize(config, "yearly", r.grid)
    schema = "var string, time timestamp, path string, kind string"
    cat.populate(config, "yearly", spark.createDataFrame(rows, schema))
    part = r.at_time(times[1])
    region = Raster(part.pixels.where("xi BETWEEN 5 AND 9 AND yi BETWEEN 2 AND 4").select((F.col("yi") - 2).alias("yi"), (F.col("xi") - 5).alias("xi"), (F.col("value") + 10).cast("smallint").alias("value")), r.grid.window(5, 9, 2, 4))
    path = write_geotiffs(region, f"{folder}/region", 3).first()["path"]
    cat.populate(config, "yearly", spark.createDataFrame([("line", times[1], path, "smallint")], schema))
    return cat.read(config, "yearly", "line").pixels.withColumnRenamed("line", "value")


@query("SELECT * FROM (VALUES ('root', 1, 'initialize root'), ('root', 2, 'write'), ('yearly', 1, 'initialize yearly')) t(\"group\", version, message)")
def catalog_commits(spark: SparkSession, d: str) -> DataFrame:
    cat, config, r = Catalog(spark, _folder(spark)), DatasetConfig(_CONFIG), fine(spark, d, "value")
    cat.initialize_all(config, grid=r.grid)
    cat.write(config, "root", {"value": r})
    return cat.commits(config).select("group", F.col("version").cast("int").alias("version"), "message")


@query("SELECT * FROM (VALUES ('x', 'standard_name', 'longitude'), ('x', 'long_name', 'longitude'), ('x', 'units', 'degrees_east'), ('y', 'standard_name', 'latitude'), ('y', 'long_name', 'latitude'), ('y', 'units', 'degrees_north'), ('time', 'standard_name', 'time'), ('time', 'long_name', 'time'), ('line', 'Conventions', 'CF-1.8'), ('line', 'standard_name', 'classification'), ('line', 'long_name', 'line number'), ('line', 'classification_type', 'line number'), ('line', 'units', 'class'), ('line', 'flag_values', '0 1'), ('line', 'flag_meanings', 'none line_one')) t(name, attribute, value)")
def catalog_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as it is stored with a group."""
    cat, config = Catalog(spark, _folder(spark)), DatasetConfig(_CONFIG)
    cat.initialize(config, "yearly", fine(spark, d).grid)
    return cat.attributes(config, "yearly")


@query(f"WITH {_FINE} SELECT value AS classification, round(sum({_row_area(0.01)}), 4) AS area_hectares FROM fine WHERE value <> 0 GROUP BY ALL")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/areas"
    areas = _round(class_area(fine(spark, d), True, wide=False), "area_hectares", to=4)
    areas.write.csv(path, header=True)
    return spark.read.schema(areas.schema).csv(path, header=True)


# --- selection and time -------------------------------------------------------------------------------------------------


@query(f"WITH {_FINE} SELECT yi, xi, value AS class FROM fine")
def variable_selected(spark: SparkSession, d: str) -> DataFrame:
    return fine(spark, d, "both").select("class").pixels


@query(f"WITH {_ANNUAL} SELECT make_timestamp(2030, 1, 1, 0, 0, 0) AS time, yi, xi, CAST(CASE WHEN value > 3 THEN value ELSE -1 END AS SMALLINT) AS value FROM annual WHERE time = make_timestamp(1993, 1, 1, 0, 0, 0)")
def slice_moved_and_cast(spark: SparkSession, d: str) -> DataFrame:
    """One year's slice with missing cells filled, at another time."""
    r = annual(spark, d).at_time("1993-01-01").where(F.col("value") > 3)
    return r.cast("smallint", fill=-1).with_time("2030-01-01").pixels


@query("SELECT 'MS' AS freq, unnest(generate_series(TIMESTAMP '2020-02-01', TIMESTAMP '2020-12-01', INTERVAL 1 MONTH)) AS time UNION ALL SELECT 'YE', make_timestamp(unnest(range(2020, 2023)), 12, 31, 0, 0, 0) UNION ALL SELECT 'QS', unnest(generate_series(TIMESTAMP '2020-04-01', TIMESTAMP '2020-12-31', INTERVAL 3 MONTH)) UNION ALL SELECT 'D', unnest(generate_series(TIMESTAMP '2020-01-15', TIMESTAMP '2020-02-03', INTERVAL 1 DAY))")
def time_axis_frequencies(spark: SparkSession, d: str) -> DataFrame:
    axes = [time_axis(spark, *span, freq).select(F.lit(freq).alias("freq"), "time") for freq, span in {"MS": ("2020-01-15", "2020-12-31"), "YE": ("2020-01-15", "2022-12-31"), "QS": ("2020-01-15", "2020-12-31"), "D": ("2020-01-15", "2020-02-03")}.items()]
    return reduce(DataFrame.unionByName, axes)


# --- areas and resampling -----------------------------------------------------------------------------------------------


@query("SELECT lat, lat NOT BETWEEN -70 AND 70 AS geodesic FROM (SELECT unnest([-89.5, -70.1, -70.0, -0.5, 69.9, 70.0, 70.1]) AS lat)")
def area_method(spark: SparkSession, d: str) -> DataFrame:
    """Which method a first latitude calls for."""
    rows = [(lat, uses_geodesic(Grid.of_centres([0, 1], [lat, lat + 0.1]), None)) for lat in (-89.5, -70.1, -70.0, -0.5, 69.9, 70.0, 70.1)]
    return spark.createDataFrame(rows, "lat double, geodesic boolean")


@query(f"SELECT CAST(yi AS INTEGER) AS yi, round({_row_area(0.01)}, 6) AS area FROM (SELECT unnest(range(CAST(ceil(count(*) / 100) AS BIGINT))) AS yi FROM events)")
def aligned_area_grid(spark: SparkSession, d: str) -> DataFrame:
    """The area grid that comes with an aligned raster."""
    return _round(align(fine(spark, d), coarse(spark, d))[1], "area")


def _kernel_sql(reach: float, x: str, y: str) -> str:
    """A coarse cell has its centre in the middle of its third fine column; rows are alike, so a kernel has its own width there."""
    return f"WITH {_FINE} SELECT a.yi, CAST((a.xi - 2) // 5 AS INTEGER) AS xi, round(sum(b.v * {x} * {y}) / sum({x} * {y}), 5) AS value FROM fine a JOIN fine b ON abs(b.yi - a.yi) <= 1 AND abs(b.xi - a.xi) <= {reach} WHERE a.xi % 5 = 2 GROUP BY a.yi, a.xi"


def _spline_sql(t: str) -> str:
    return f"(CASE WHEN abs({t}) <= 1 THEN (4 - 6 * pow({t}, 2) + 3 * pow(abs({t}), 3)) / 6 WHEN abs({t}) < 2 THEN pow(2 - abs({t}), 3) / 6 ELSE 0 END)"


_TX, _TY = "((b.xi - a.xi) / 5.0)", "CAST(b.yi - a.yi AS DOUBLE)"
_sinc = lambda t: f"(CASE WHEN {t} = 0 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) END)"
query(_kernel_sql(9, _spline_sql(_TX), _spline_sql(_TY)))(_resampled("cubic_spline", to=5))
query(_kernel_sql(14, f"({_sinc(_TX)} * {_sinc(f'({_TX} / 3)')})", "(CASE WHEN b.yi = a.yi THEN 1 ELSE 0 END)"))(_resampled("lanczos", to=5))
query(_kernel_sql(7, f"exp(-2 * pow({_TX}, 2))", f"exp(-2 * pow({_TY}, 2))"))(_resampled("gauss", to=5))


# --- polygons -----------------------------------------------------------------------------------------------------------

#: A right triangle under a rising edge, with a box as hole: corners as shares of the grid's height H; none falls on a cell's bound or centre.
_XA, _XB, _YA, _YB = -59.9037, -59.1013, 0.10131, 0.90437
_HX1, _HX2, _HY1, _HY2 = -59.4021, -59.2017, 0.7019, 0.8011


def _triangle(spark: SparkSession, d: str) -> dict:
    h = 0.01 * fine(spark, d).grid.ny
    shell = [[_XA, -_YB * h], [_XB, -_YB * h], [_XB, -_YA * h], [_XA, -_YB * h]]
    hole = [[_HX1, -_HY2 * h], [_HX1, -_HY1 * h], [_HX2, -_HY1 * h], [_HX2, -_HY2 * h], [_HX1, -_HY2 * h]]
    return {"type": "Polygon", "coordinates": [shell, hole]}


_T = f"t AS (SELECT {_XA} AS xa, {_XB} AS xb, -{_YB} * h AS yb, -{_YA} * h AS ya, ({_YB} - {_YA}) * h / ({_XB} - {_XA}) AS m, {_HX1} AS hx1, {_HX2} AS hx2, -{_HY2} * h AS hy1, -{_HY1} * h AS hy2 FROM (SELECT 5 * {_H} AS h))"
_CELL = "-60 + 0.01 * xi AS x1, -60 + 0.01 * (xi + 1) AS x2, -0.01 * (yi + 1) AS y1, -0.01 * yi AS y2"
_UNDER = lambda x: f"(yb + ({x} - xa) * m - v)"
_G = lambda t: f"(pow(greatest({t}, 0), 2) - pow(greatest({t} - greatest(y2 - v, 0), 0), 2)) / 2"
_COVER = f"""{_T}, c AS (SELECT yi, xi, value, {_CELL} FROM fine), u AS (SELECT c.*, t.*, greatest(x1, xa) AS a, greatest(least(x2, xb), greatest(x1, xa)) AS b, greatest(y1, yb) AS v FROM c, t),
s AS (SELECT yi, xi, value, (({_G(_UNDER("b"))} - {_G(_UNDER("a"))}) / m - greatest(0, least(x2, hx2) - greatest(x1, hx1)) * greatest(0, least(y2, hy2) - greatest(y1, hy1))) / 0.0001 AS share FROM u)"""


@query(f"WITH {_FINE}, {_COVER} SELECT yi, xi, round(share, 6) + 0.0 AS proportion FROM s")
def proportion_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a triangle with a hole."""
    return _round(proportion_mask(fine(spark, d), _triangle(spark, d), overwrite=True), "proportion")


_IN = "cx > xa AND cx < xb AND cy > yb AND cy < yb + (cx - xa) * m AND NOT (cx > hx1 AND cx < hx2 AND cy > hy1 AND cy < hy2)"
_CENTRES = f"{_T}, c AS (SELECT yi, xi, value, -60 + 0.01 * (xi + 0.5) AS cx, -0.01 * (yi + 0.5) AS cy FROM fine)"


@query(f"WITH {_FINE}, {_CENTRES} SELECT yi - CAST(floor(round(-ya / 0.01, 6)) AS INTEGER) AS yi, xi - CAST(floor(round((xa + 60) / 0.01, 6)) AS INTEGER) AS xi, CASE WHEN {_IN} THEN value END AS value FROM c, t WHERE xi BETWEEN floor(round((xa + 60) / 0.01, 6)) AND ceil(round((xb + 60) / 0.01, 6)) - 1 AND yi BETWEEN floor(round(-ya / 0.01, 6)) AND ceil(round(-yb / 0.01, 6)) - 1")
def clip_polygon_center(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose centres are in a triangle with a hole."""
    return clip_geometry(fine(spark, d), _triangle(spark, d)).pixels


@query(f"WITH {_FINE}, {_CENTRES} SELECT yi, xi, CASE WHEN {_IN} THEN 1.0 ELSE 0.0 END AS proportion FROM c, t")
def proportion_mask_binary(spark: SparkSession, d: str) -> DataFrame:
    """Below the threshold of cell to geometry the mask goes by centres."""
    return proportion_mask(fine(spark, d), _triangle(spark, d), pixel_ratio=1e9)


@query(f"WITH {_T} SELECT round({A * K0!r} * (radians(xb - xa) * ({_y('ya')} - {_y('yb')}) / 2 - radians(hx2 - hx1) * ({_y('hy2')} - {_y('hy1')})) * 1e-4, 4) AS area, round(xa, 9) AS minx, round(yb, 9) AS miny, round(xb, 9) AS maxx, round(ya, 9) AS maxy FROM t")
def polygon_processed(spark: SparkSession, d: str) -> DataFrame:
    """Area and bounds of a triangle with a hole."""
    g = process_geometry(_triangle(spark, d))
    return spark.createDataFrame([(round(g.geom_area, 4), *(round(v, 9) for v in g.geom_bbox))], "area double, minx double, miny double, maxx double, maxy double")


_TWO = f"{_zones_sql(0.003)}, z AS (SELECT minx, maxx, miny, maxy FROM zones WHERE zone_id = 7), two AS (SELECT * FROM z UNION ALL SELECT minx + 0.0537, maxx + 0.0537, miny + 0.017, maxy + 0.017 FROM z), cut AS (SELECT max(minx) AS minx, min(maxx) AS maxx, max(miny) AS miny, min(maxy) AS maxy FROM two)"


@query(f"WITH {_FINE}, {_TWO}, o AS (SELECT yi, xi, {_SHARE} AS s FROM fine, two UNION ALL SELECT yi, xi, -({_SHARE}) FROM fine, cut WHERE maxx > minx AND maxy > miny) SELECT yi, xi, round(sum(s), 6) + 0.0 AS proportion FROM o GROUP BY yi, xi")
def proportion_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Two boxes that overlap: what both cover counts once."""
    a = _zone_box(spark, d)
    ring = np.array(a["coordinates"][0])
    b = {"type": "Polygon", "coordinates": [(ring + [0.0537, 0.017]).tolist()]}
    return _round(proportion_mask(fine(spark, d), [a, b], overwrite=True), "proportion")


_WIDER = 0.0021
_UNION = f"{A * K0!r} * radians(max(maxx) - min(minx) + {2 * _WIDER}) * ({_y(f'(max(maxy) + {_WIDER})')} - {_y(f'(min(miny) - {_WIDER})')}) * 1e-4"


@query(f"WITH {_zones_sql(0.003)} SELECT region, round({_UNION}, 3) AS area, round(min(minx) - {_WIDER}, 9) AS minx, round(min(miny) - {_WIDER}, 9) AS miny, round(max(maxx) + {_WIDER}, 9) AS maxx, round(max(maxy) + {_WIDER}, 9) AS maxy FROM zones GROUP BY region")
def dissolve_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Zones widened until those of a region overlap, dissolved."""
    z = zones(spark, d, 0.003)
    b = geometry_bounds(F.col("geom"))
    wider = z.select("region", box_column(b["minx"] - _WIDER, b["miny"] - _WIDER, b["maxx"] + _WIDER, b["maxy"] + _WIDER).alias("geom"))
    out = dissolve_zones(wider, ["region"]).drop("geom")
    return _round(_round(out, "area", to=3), "minx", "miny", "maxx", "maxy", to=9)


@query(f"WITH {_zones_sql(0.003)} SELECT region, 5 AS parts, round({_UNION}, 3) AS area FROM zones GROUP BY region")
def geometry_list_processed(spark: SparkSession, d: str) -> DataFrame:
    """Lists of overlapping geometries that stay lists; the area is that of their union."""
    by: dict[int, list] = {}
    for r in zones(spark, d, 0.003).collect():  # 25
        x, y = zip(*((p["x"], p["y"]) for p in r["geom"][0][0]), strict=True)
        by.setdefault(r["region"], []).append(box(min(x) - _WIDER, min(y) - _WIDER, max(x) + _WIDER, max(y) + _WIDER))
    rows = [(k, len((g := process_geometry(v, dissolve=False)).geom), round(g.geom_area, 3)) for k, v in by.items()]
    return spark.createDataFrame(rows, "region long, parts int, area double").select(F.col("region").cast(dict(zones(spark, d).dtypes)["region"]).alias("region"), "parts", "area")


@query(f"WITH {_zones_sql(0.003)} SELECT zone_id, round({A!r} * radians(minx), 3) AS x_3857, round({A!r} * ln(tan(pi() / 4 + radians(miny) / 2)), 3) AS y_3857, round({A * K0!r} * radians(minx), 3) AS x_6933, round({_y('miny')}, 3) AS y_6933, round(minx, 9) AS lon, round(miny, 9) AS lat FROM zones")
def zone_corners_projected(spark: SparkSession, d: str) -> DataFrame:
    """A corner of each zone in the systems that are known, and back."""
    b = geometry_bounds(F.col("geom"))
    rows = zones(spark, d, 0.003).select("zone_id", b["minx"].alias("x"), b["miny"].alias("y")).collect()  # 25
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    m, e = transform(x, y, "EPSG:4326", "EPSG:3857"), transform(x, y, "EPSG:4326", "EPSG:6933")
    lon, lat = transform(*transform(*e, "EPSG:6933", "EPSG:3857"), "EPSG:3857", "EPSG:4326")
    values = np.stack([*(np.round(v, 3) for v in (*m, *e)), np.round(lon, 9), np.round(lat, 9)], axis=1).tolist()
    kind = dict(zones(spark, d).dtypes)["zone_id"]
    return spark.createDataFrame([(r["zone_id"], *v) for r, v in zip(rows, values, strict=True)], f"zone_id {kind}, x_3857 double, y_3857 double, x_6933 double, y_6933 double, lon double, lat double")


# --- classes ------------------------------------------------------------------------------------------------------------


@query(f"WITH {_FINE}, p AS (SELECT yi, xi, value FROM fine WHERE xi % 7 <> 0), s AS (SELECT yi, xi, CAST(floor(v) AS BIGINT) % 3 AS value FROM fine WHERE xi % 5 <> 0) SELECT coalesce(p.yi, s.yi) AS yi, coalesce(p.xi, s.xi) AS xi, p.value AS p, s.value AS s, CASE WHEN p.value = 0 OR s.value = 0 THEN 0.0::DOUBLE ELSE round(p.value + s.value / 10, 6) END AS code FROM p FULL JOIN s ON p.yi = s.yi AND p.xi = s.xi")
def combined_with_missing(spark: SparkSession, d: str) -> DataFrame:
    """Where one raster is 0 and the other has no cell, the code is 0."""
    a, b = fine(spark, d), fine(spark, d, "value")
    p = replace(a, pixels=a.pixels.where("xi % 7 <> 0"))
    s = Raster(b.pixels.where("xi % 5 <> 0").select("yi", "xi", (F.floor("value") % 3).alias("value")), b.grid)
    return _round(combine_classes(p, s), "code")


@query(f"WITH {_FINE} SELECT CAST(count(*) FILTER (WHERE value IN (1, 2)) AS DOUBLE) AS active, CAST(count(*) FILTER (WHERE value IN (3, 4)) AS DOUBLE) AS passive, CAST(count(*) FILTER (WHERE value > 0) AS DOUBLE) AS total_area FROM fine")
def wide_shared_names(spark: SparkSession, d: str) -> DataFrame:
    """Codes of one meaning share its column."""
    return class_area(fine(spark, d), legend={0: "none", 1: "active", 2: "active", 3: "passive", 4: "passive"})


@query("SELECT \"group\", name, attribute, value FROM (VALUES ('yearly', 'classification', 'units', 'class'), ('root', 'height', 'units', 'm')) t(\"group\", name, attribute, value)")
def config_units(spark: SparkSession, d: str) -> DataFrame:
    return DatasetConfig(CONFIG).metadata_table(spark).where("attribute = 'units' AND name NOT IN ('x', 'y')")
