"""Grids with more rows than there are latitudes: the views of the queries at large sizes go on beyond 90 degrees, as their SQL does."""

import glob
import os
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import queries
from rasterloom.functions import geodesic
from rasterloom.grid import Grid, Raster, places
from rasterloom.operators.area import cell_area, cell_bounds
from rasterloom.operators.clip import clip_geometry
from rasterloom.operators.geometry import box

#: 40 rows of 15 degrees, to 600 degrees below the equator.
TALL = Grid(-60, 0, 1.0, -15.0, 5, 40)


def tall(spark, v="id"):
    return Raster(spark.range(TALL.nx * TALL.ny).select(F.floor(F.col("id") / TALL.nx).cast("int").alias("yi"), (F.col("id") % TALL.nx).cast("int").alias("xi"), F.expr(v).alias("value")), TALL)


def test_latitudes_are_held_on_the_globe_alone():
    assert TALL.edges("y").tolist() == [-15.0 * k for k in range(41)] and TALL.bounds == (-60, -600, -55, 0)
    assert Grid.of_centres([0, 1], np.linspace(-90, 90, 37)).bounds[1::2] == (-90, 90)
    assert Grid(0, 90, 1, -1, 1, 180).edges("y")[-1] == -90


@pytest.mark.parametrize("all_touched", [True, False])
def test_clip_beyond_the_pole(spark, all_touched):
    """clip_zone_all_touch and clip_zone_center raised an error where the zone lay beyond 90 degrees."""
    got = clip_geometry(tall(spark), box(-58.7, -240.1, -56.7, -122.0), all_touched=all_touched)
    own = {(r["yi"] + 8, r["xi"] + 1): r["value"] for r in got.pixels.collect()}
    inside = lambda y, x: all_touched or -58.7 < -59.5 + x < -56.7 and -240.1 < -15 * y - 7.5 < -122.0
    assert own == {(y, x): y * 5 + x if inside(y, x) else None for y in range(8, 17) for x in range(1, 4)}


def test_clip_polygon_beyond_the_pole(spark):
    """clip_polygon_center kept the rows between the pole and the triangle's end as one, and lost others."""
    shell = [[-59.9, -562.0], [-55.1, -562.0], [-55.1, -41.0], [-59.9, -562.0]]
    hole = [[-56.9, -502.0], [-56.9, -400.0], [-56.1, -400.0], [-56.1, -502.0], [-56.9, -502.0]]
    got = clip_geometry(tall(spark), {"type": "Polygon", "coordinates": [shell, hole]}).pixels.collect()
    inside = lambda x, y: -562 < y < -562 + (x + 59.9) * 521 / 4.8 and x < -55.1 and not (-56.9 < x < -56.1 and -502 < y < -400)
    assert {(r["yi"] + 2, r["xi"]): r["value"] for r in got} == {(y, x): y * 5 + x if inside(x - 59.5, -15 * y - 7.5) else None for y in range(2, 38) for x in range(5)}


def test_regular_bounds_are_the_decimals(spark):
    g = Grid(-60, 0, 0.05, -0.01, 20, 60_000)
    assert g.edges("y").tolist() == [float(f"-{k // 100}.{k % 100:02}") for k in range(60_001)]
    assert [r[1] for r in g.axis(spark, "x").sort("xi").collect()] == g.centres("x").tolist() == [float(f"{-60 + (k * 5 + 2.5) / 100:.3f}") for k in range(20)]
    assert g.window(3, 5, 30_007, 30_009).edges("y").tolist() == [-300.07, -300.08, -300.09, -300.1]
    assert places(0.3, 0.1, 1) == 0.4 and places(1 / 3, 0.1, 1) == 1 / 3 + 0.1 and places(2, -15.0, 3) == -43


def test_bounds_of_an_irregular_axis(spark):
    """Held to the pole on the globe; cell_bounds_irregular flattened all rows beyond it."""
    bounds = lambda *lat: [(r["lo"], r["hi"]) for r in cell_bounds(spark.createDataFrame(list(enumerate(lat)), "yi int, lat double"), "yi", "lat", latitude=True).sort("yi").collect()]
    assert bounds(-90.0, -80.0, -65.0) == [(-90, -85), (-85, -72.5), (-72.5, -57.5)]
    assert bounds(-80.0, -90.0, -110.0, -140.0) == [(-75, -85), (-85, -100), (-100, -125), (-125, -155)]


def test_geodesic_areas_on_both_sides_of_the_pole(spark):
    """Heights are the meridian's arcs up to the pole, where some rows of the query had another height than its SQL's beyond it."""
    e = np.linspace(-90, 90, 721)
    assert np.allclose(geodesic.distance(e[:-1], 0, e[1:], 0), geodesic.meridian(e[:-1], e[1:]), rtol=1e-9)
    own = [r["area"] for r in cell_area(Raster(tall(spark).pixels, TALL), high_accuracy=True).sort("yi").collect()]
    assert own[:5] == pytest.approx(own[12:17], rel=1e-9) and min(own) > 0  # 180 degrees on


# --- queries on tables of 9,200 grid rows, 200 of them beyond the pole ----------------------------------------------------

ROWS = 9_200
QUERIES = ["align_nearest", "aligned_area_grid", "area_grid_geodesic", "area_grid_rows_ha", "area_grid_rows_m2", "bbox_coordinates", "category_mean_std", "category_mean_std_time", "cell_bounds_irregular", "combined_classification", "combined_stats_labelled", "combined_stats_long", "combined_stats_with_zero"]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("large"))
    for f in ("nation", "region"):
        shutil.copy(f"/root/testdata/sf0.001/{f}.parquet", d)
    some = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    kind = F.element_at(F.array(*map(F.lit, queries.FINE_LEGEND.values())), (some(5, 1) + 1).cast("int"))
    row = F.floor(F.col("id") / 100)
    # values grow with the row, so that rows that are lost change the means
    spark.range(100 * ROWS).select(F.col("id").alias("event_id"), kind.alias("event_type"), (some(1000, 2) / 8 + row).alias("value")).write.parquet(f"{d}/events.parquet")
    cell = F.floor(F.col("id") / 20)
    spark.range(20 * ROWS).select(F.col("id").alias("p_partkey"), (some(50, 3) + 1).cast("int").alias("p_size"), (some(1000, 4) / 8 + cell).alias("p_retailprice")).write.parquet(f"{d}/part.parquet")
    spark.range(60 * ROWS).select((F.col("id") % (20 * ROWS)).alias("l_partkey"), F.make_date(1992 + some(7, 5).cast("int"), F.lit(6), F.lit(1)).alias("l_shipdate"), (some(7, 6) + 1).cast("int").alias("l_linenumber")).write.parquet(f"{d}/lineitem.parquet")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    return d, con


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql_beyond_the_pole(spark, large, name):
    d, con = large
    got, want = queries.QUERIES[name](spark, d).toPandas(), con.sql(queries.SQL[name]).df()
    assert len(got) == len(want) and sorted(got.columns) == sorted(want.columns)
    keys = [c for c in ("time", "yi", "xi", "axis", "cell", "classification", "category") if c in want.columns]
    got, want = ((x.sort_values(keys) if keys else x).reset_index(drop=True) for x in (got, want))
    for c in want.columns:
        if want[c].dtype.kind in "if" or "centre" in c:
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
