import json
import math
import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import geodesic
from rasterloom.functions import polygons as P
from rasterloom.functions.projection import UnsupportedCRS, forward, inverse, transform
from rasterloom.grid import Grid, Raster
from rasterloom.operators.align import METHODS, align, axis_weights, resample
from rasterloom.operators.area import cell_area, cell_bounds, describe_area
from rasterloom.operators.clip import clip_bbox, clip_geometry, proportion_mask
from rasterloom.operators.geometry import GEOMETRY, box, box_column, dissolve_zones, first_feature_bbox, geojson_zones, geometry_area, process_geometry
from rasterloom.operators.zonal import category_stats, class_area, combine_classes, combined_class_area, legend_of, positional_legend, weighted_class_area


def raster(spark, values, grid=None, **how):
    a = np.asarray(values, dtype=object)
    g = grid or Grid(0, 0, 1.0, -1.0, a.shape[-1], a.shape[-2])
    if a.ndim == 3:
        rows = [(f"{2000 + t}-01-01", y, x, None if v is None else float(v)) for t, p in enumerate(a) for y, r in enumerate(p) for x, v in enumerate(r)]
        p = spark.createDataFrame(rows, "time string, yi int, xi int, value double").withColumn("time", F.col("time").cast("timestamp"))
    else:
        p = spark.createDataFrame([(y, x, None if v is None else float(v)) for y, r in enumerate(a) for x, v in enumerate(r)], "yi int, xi int, value double")
    return Raster.of(p, g, **how)


def cells(df, *cols):
    return {(r["yi"], r["xi"]): r[cols[0] if cols else "value"] for r in df.collect()}


# --- formulas ---------------------------------------------------------------------------------------------------------------


def test_known_lengths_and_projections():
    assert geodesic.distance(0, 0, 1, 0) == pytest.approx(110_574.389, abs=1e-3)
    assert geodesic.meridian(0, 1) == pytest.approx(110_574.389, abs=1e-3)
    assert geodesic.distance(0, 0, 0, 1) == pytest.approx(111_319.491, abs=1e-3)
    assert geodesic.distance(60, 0, 60, 1) == pytest.approx(55_799.470, abs=1e-3)
    x, y = forward(180, 90, "EPSG:6933")
    assert (float(x), float(y)) == pytest.approx((17_367_530.445, 7_342_230.136), abs=1e-3)
    for crs in ("EPSG:6933", "EPSG:3857"):
        lon, lat = np.array([-170.0, 0, 12.5]), np.array([-80.0, 0, 66.6])
        back = inverse(*forward(lon, lat, crs), crs)
        assert np.allclose(back, (lon, lat), atol=1e-10)
    with pytest.raises(UnsupportedCRS):
        transform([0], [0], "EPSG:4326", "EPSG:32633")


@settings(max_examples=30, deadline=None)
@given(st.integers(3, 14), st.integers(0, 10_000))
def test_coverage_of_a_polygon_adds_up_to_its_area(n, seed):
    r = np.random.default_rng(seed)
    angle = np.sort(r.random(n)) * 2 * np.pi
    radius = 1 + 8 * r.random(n)
    poly = P.oriented([np.stack([10 + radius * np.cos(angle), 10 + radius * np.sin(angle)], axis=1)])
    # around its middle, else edges may cross
    if not poly or np.diff(angle, append=angle[0] + 2 * np.pi).max() >= np.pi:
        return
    x = np.linspace(0, 20, 21)
    e = P.edges([poly])
    total = sum(P.row_coverage(e, y, y + 1, x).sum() for y in range(20))
    assert total == pytest.approx(P.area([poly]), abs=1e-9)
    twice = P.union([poly, [poly[0].copy()]])
    assert P.area(twice) == pytest.approx(P.area([poly]), rel=1e-9)


# --- areas ------------------------------------------------------------------------------------------------------------------


def test_area_grid(spark):
    r = raster(spark, [[1]], Grid(0, 1, 1.0, -1.0, 1, 1))
    assert cell_area(r).first()["area"] == pytest.approx(1_230_846.389, abs=1e-3)
    assert cell_area(r, hectares=False).first()["area"] == pytest.approx(12_308_463_893.97, rel=1e-9)
    high = cell_area(r, high_accuracy=True).first()["area"]
    assert high == pytest.approx(1_230_846.389, rel=1e-4)
    assert describe_area(r, True)["units"] == "ha" and "geodesic" in describe_area(r, True)["description"]
    assert describe_area(r, False, hectares=False)["units"] == "m²"


@pytest.mark.parametrize(("first", "geodesic_"), [(-90, True), (-70, False), (70, False), (70.5, True), (-70.5, True)])
def test_method_by_first_latitude(spark, first, geodesic_):
    step = -0.5 if first > 0 else 0.5
    r = raster(spark, [[1], [1]], Grid(0, first - step / 2, 1.0, step, 1, 2))
    assert ("geodesic" in describe_area(r)["description"]) == geodesic_


def test_whole_earth_and_poles(spark):
    xs, ys = np.linspace(-180, 180, 73), np.linspace(-90, 90, 37)
    g = Grid.of_centres(xs, ys)
    r = Raster(spark.createDataFrame([], "yi int, xi int, value double"), g)
    low = cell_area(r, high_accuracy=False).agg(F.sum("area")).first()[0] * 72
    assert low == pytest.approx(51_006_562_172, rel=1e-4)  # bounds are held to the poles
    assert g.edges("y")[0] == -90 and g.edges("y")[-1] == 90


def test_irregular_axes(spark):
    g = Grid.of_centres([0.0, 1.0, 3.0], [2.0, 1.0, -1.0])
    assert g.edges("x").tolist() == [-0.5, 0.5, 2.0, 4.0] and g.edges("y").tolist() == [2.5, 1.5, 0.0, -2.0]
    r = raster(spark, np.ones((3, 3)), g)
    got = cells(cell_area(r, False), "area")
    assert len(got) == 9 and got[0, 2] == pytest.approx(2 * got[0, 0], rel=1e-9)
    high = cells(cell_area(r, True), "area")
    assert high[1, 1] == pytest.approx(got[1, 1], rel=1e-3)
    b = cell_bounds(g.axis(spark, "y"), "yi", "lat").orderBy("yi").collect()
    assert [(x["lo"], x["hi"]) for x in b] == [(2.5, 1.5), (1.5, 0.0), (0.0, -2.0)]
    with pytest.raises(ValueError):
        Grid.of_centres([1.0], [1.0, 2.0])


# --- selection and clipping -------------------------------------------------------------------------------------------------


def test_select(spark):
    p = spark.createDataFrame([(0, 0, 1, 2.0)], "yi int, xi int, a int, b double")
    r = Raster.of(p, Grid(0, 0, 1, -1, 1, 1), legends={"a": {0: "x", 1: "y"}})
    with pytest.raises(ValueError, match="'a', 'b'"):
        r.select()
    with pytest.raises(ValueError):
        r.select("c")
    assert r.select("b").variables == ["b"] and legend_of(r, "a") == ["x", "y"] and legend_of(r, "b") is None


def test_nan_and_nodata_are_null(spark):
    r = raster(spark, [[1, float("nan"), -1]], nodata=-1)
    assert cells(r.pixels) == {(0, 0): 1.0, (0, 1): None, (0, 2): None}
    assert cells(r.cast("smallint", -1).pixels) == {(0, 0): 1, (0, 1): -1, (0, 2): -1}
    assert cells(r.binary_mask().pixels) == {(0, 0): 1, (0, 1): 0, (0, 2): 0}


@pytest.mark.parametrize("bbox", [[0, 0, 1, 1], (0, 0, 1), (0, 0, 1, "1"), (0, 0, 1, np.float32(1)), (0, 0, 1, float("nan")), (50, 50, 60, 60)])
def test_bad_boxes(spark, bbox):
    with pytest.raises(ValueError):
        clip_bbox(raster(spark, np.ones((3, 3))), bbox)


@pytest.mark.parametrize("dy", [-1.0, 1.0])
def test_clip_box_keeps_every_cell_that_overlaps(spark, dy):
    g = Grid(0, 4 if dy < 0 else 0, 1.0, dy, 4, 4)
    r = raster(spark, np.arange(16).reshape(4, 4), g)
    out = clip_bbox(r, (0.5, 1.0, 2.0, 2.5))
    assert out.grid.bounds == (0, 1, 2, 3) and out.pixels.count() == 4
    assert clip_bbox(r, (-9.0, -9.0, 9.0, 9.0)).pixels.count() == 16
    assert clip_bbox(r, (1.2, 1.2, 1.3, 1.3)).pixels.count() == 1


def test_clip_reaches_the_scan(spark, tmp_path):
    r = raster(spark, np.arange(100).reshape(10, 10))
    r.pixels.write.parquet(str(tmp_path / "p"))
    out = clip_bbox(Raster(spark.read.parquet(str(tmp_path / "p")), r.grid), (2.0, -5.0, 4.0, -3.0))
    plan = out.pixels._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(yi,3)" in plan and "LessThanOrEqual(xi,3)" in plan


def test_first_time(spark):
    r = raster(spark, np.arange(8).reshape(2, 2, 2))
    out = clip_bbox(r, (0.0, -2.0, 2.0, 0.0), first_time=True)
    assert not out.has_time and cells(out.pixels) == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3}
    assert cells(r.at_time("2001-01-01").pixels)[1, 1] == 7


def test_clip_polygon(spark):
    r = raster(spark, np.ones((6, 6)), Grid(0, 6, 1.0, -1.0, 6, 6))
    tri = {"type": "Polygon", "coordinates": [[[0, 0], [6, 0], [0, 6]], [[1, 1], [2, 1], [2, 2], [1, 2]]]}
    inside = {k for k, v in cells(clip_geometry(r, tri).pixels).items() if v}
    want = {(y, x) for y in range(6) for x in range(6) if (x + 0.5) + (5.5 - y) < 6 and not (1 < x + 0.5 < 2 and 1 < 5.5 - y < 2)}
    assert inside == want
    touched = {k for k, v in cells(clip_geometry(r, tri, all_touched=True).pixels).items() if v}
    assert touched >= want and (4, 1) in touched and (0, 5) not in touched
    with pytest.raises(ValueError):
        clip_geometry(r, box(50, 50, 60, 60))


def test_proportions(spark):
    r = raster(spark, np.ones((4, 4)), Grid(0, 4, 1.0, -1.0, 4, 4))
    got = cells(proportion_mask(r, [box(0.5, 0.5, 2.25, 3), box(1, 1, 2, 2)], overwrite=True), "proportion")
    for (y, x), v in got.items():
        want = max(0, min(2.25, x + 1) - max(0.5, x)) * max(0, min(3, 4 - y) - max(0.5, 3 - y))
        assert v == pytest.approx(want, abs=1e-12)
    assert len(got) == 16
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        binary = cells(proportion_mask(r, box(0.2, 0.2, 2.2, 2.2), pixel_ratio=10.0), "proportion")
    assert w and set(binary.values()) == {0.0, 1.0} and sum(binary.values()) == 4
    out = weighted_class_area(r, proportion_mask(r, box(0, 0, 0.5, 1), overwrite=True), area=2.0).collect()
    assert [(x["classification"], x["area_hectares"]) for x in out] == [(1.0, 1.0)]


def test_mask_outside_the_grid_is_zero(spark):
    got = cells(proportion_mask(raster(spark, np.ones((2, 2))), box(50, 50, 60, 60), overwrite=True), "proportion")
    assert set(got.values()) == {0.0} and len(got) == 4


# --- geometry ---------------------------------------------------------------------------------------------------------------


def geojson(crs="EPSG:4326", features=None):
    d = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": box(0, 0, 1, 1), "properties": {}}] if features is None else features}
    return d | ({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})


def test_process_geometry(tmp_path):
    one = process_geometry(box(0, 0, 1, 1))
    assert (one.geom_crs, one.geom_bbox) == ("EPSG:4326", (0, 0, 1, 1)) and one.geom_area == pytest.approx(1_230_846.389, abs=1e-3)
    assert process_geometry(box(0, 0, 1, 1), hectares=False).geom_area == pytest.approx(one.geom_area * 1e4)
    two = [box(0, 0, 1, 1), box(1, 0, 2, 1)]
    assert len(process_geometry(two).geom) == 1 and len(process_geometry(two, dissolve=False).geom) == 2
    over = [box(0, 0, 1, 1), box(0.5, 0, 1.5, 1)]
    for d in (True, False):  # overlap counts once either way
        assert process_geometry(over, dissolve=d).geom_area == pytest.approx(1.5 * one.geom_area)
    hole = process_geometry("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 1 0, 1 1, 0 1, 0 0))")
    assert hole.geom_area == pytest.approx(process_geometry(box(0, 0, 4, 4)).geom_area - one.geom_area)
    (tmp_path / "a.json").write_text(json.dumps(geojson()))
    assert process_geometry(str(tmp_path / "a.json")).geom_area == pytest.approx(one.geom_area)
    for bad in (123, [], None, [1], {"type": "Point", "coordinates": [0, 0]}):
        with pytest.raises(ValueError):
            process_geometry(bad)
    for name, crs in (("b", None), ("c", "")):
        (tmp_path / f"{name}.json").write_text(json.dumps(geojson(crs)))
        with pytest.raises(ValueError):
            process_geometry(str(tmp_path / f"{name}.json"))
    (tmp_path / "d.json").write_text(json.dumps({**geojson(None), "crs": None}))
    with pytest.raises(ValueError):
        process_geometry(str(tmp_path / "d.json"))


def test_dissolving_twice_changes_nothing():
    g = process_geometry([box(0, 0, 2, 2), box(1, 1, 3, 3), box(5, 5, 6, 6)])
    again = P.union(g.polygons)
    assert P.area(again) == pytest.approx(P.area(g.polygons)) == pytest.approx(8)


def test_first_feature_bbox():
    assert first_feature_bbox(geojson(None)) == (0, 0, 1, 1)
    x, y = forward(np.array([1.0]), np.array([1.0]), "EPSG:6933")
    assert first_feature_bbox(geojson("urn:ogc:def:crs:EPSG::4326"), "EPSG:6933") == pytest.approx((0, 0, float(x[0]), float(y[0])))


def test_zone_columns(spark, tmp_path):
    (tmp_path / "z.json").write_text(json.dumps(geojson()))
    z = geojson_zones(spark, str(tmp_path / "z.json"))
    assert z.first()["crs"] == "EPSG:4326" and z.schema["geom"].dataType.simpleString() == GEOMETRY
    assert z.select(geometry_area("geom")).first()[0] == pytest.approx(1_230_846.389, abs=1e-3)
    f = lambda *v: box_column(*map(F.lit, map(float, v)))
    d = spark.range(3).select(F.floor(F.col("id") / 2).alias("g"), F.when(F.col("id") == 0, f(0, 0, 1, 1)).when(F.col("id") == 1, f(0.5, 0, 1.5, 1)).otherwise(f(0, 0, 1, 1)).alias("geom"))
    got = {r["g"]: r for r in dissolve_zones(d, ["g"]).collect()}
    assert got[0]["area"] == pytest.approx(1.5 * got[1]["area"]) and (got[0]["minx"], got[0]["maxx"]) == (0, 1.5)


# --- alignment --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("method", METHODS)
def test_own_grid_is_the_identity(spark, method):
    r = raster(spark, [[1, 2, 3], [4, 5, 6]])
    got = cells(resample(r, r.grid, method).pixels)
    if method not in ("cubic_spline", "gauss"):  # they smooth
        assert got == pytest.approx(cells(r.pixels))
    assert len(got) == 6


def test_nearest_by_brute_force(spark):
    source = Grid(0, 3, 0.7, -0.45, 5, 6)
    template = Grid.of_centres(np.linspace(0.11, 3.3, 9), np.linspace(0.4, 2.87, 7))
    t, s, w = axis_weights(template, source, "y", "nearest")
    for a, b in zip(t, s, strict=True):
        assert abs(source.centres("y")[b] - template.centres("y")[a]) <= 0.45 / 2 + 1e-9
    assert (w == 1).all()
    r = raster(spark, np.arange(30).reshape(6, 5), source)
    got = cells(resample(r, template, "nearest").pixels)
    for (y, x), v in got.items():
        near = [(abs(source.centres("y")[k // 5] - template.centres("y")[y]), abs(source.centres("x")[k % 5] - template.centres("x")[x]), k) for k in range(30)]
        assert v == min(near, key=lambda n: n[0] + n[1])[2]


def test_align_cuts_first_and_keeps_times(spark):
    fine = raster(spark, np.ones((2, 4)), Grid(0, 0, 0.5, -1.0, 4, 2))
    coarse = raster(spark, np.arange(2 * 3 * 3).reshape(2, 3, 3))
    out, area = align(fine, coarse)
    assert out.pixels.where("time = '2001-01-01'").count() == 8 and area.count() == 2
    assert align(fine, coarse, area=False)[1] is None
    first = align(fine, coarse, first_time=True)[0]
    assert not first.has_time and cells(first.pixels)[1, 3] == 4
    with pytest.raises(ValueError):
        resample(fine, coarse.grid, "fancy")


def test_overlap_methods(spark):
    r = raster(spark, [[1, 2, 2, None], [3, 2, 4, None]], Grid(0, 0, 1, -1, 4, 2))
    g = Grid(0, 0, 2, -2, 2, 1)
    got = {m: cells(resample(r, g, m).pixels) for m in ("average", "mode", "max", "min", "med", "sum", "rms")}
    assert {m: v[0, 0] for m, v in got.items()} == pytest.approx({"average": 2, "mode": 2, "max": 3, "min": 1, "med": 2, "sum": 8, "rms": math.sqrt(18 / 4)})
    assert got["average"][0, 1] == 3
    # a cell and a half: weights by overlap
    half = cells(resample(r, Grid(0, 0, 1.5, -1, 1, 1), "average").pixels)
    assert half[0, 0] == pytest.approx((1 + 2 * 0.5) / 1.5)


# --- zonal ------------------------------------------------------------------------------------------------------------------


def test_class_area(spark):
    r = raster(spark, [[0, 1, 1], [2, None, float("nan")]], legends={"value": {0: "none", 1: "a", 2: "b"}})
    long = {x["classification"]: x["area_hectares"] for x in class_area(r, wide=False).collect()}
    assert long == {1: 2, 2: 1}
    wide = class_area(r, 0.5)
    assert wide.columns == ["a", "b", "total_area"] and tuple(wide.first()) == (1.0, 0.5, 1.5)
    assert class_area(r, drop_zero=False).columns == ["none", "a", "b", "total_area"]
    for none in (None, False, 0, 0.0):
        assert class_area(r, none).first()["total_area"] == 3
    plain = Raster(r.pixels, r.grid)
    assert class_area(plain).columns == ["1", "2", "total_area"]
    assert class_area(plain, legend=positional_legend("x y")).columns == ["x", "y", "total_area"]
    assert positional_legend(["p", "q"]) == {1: "p", 2: "q"}
    assert class_area(raster(spark, [[0, 0]]), wide=False).count() == 0
    assert class_area(raster(spark, [[0, 0]])).first()["total_area"] == 0
    half = class_area(raster(spark, [[1.5, 2]]))
    assert half.columns == ["1.5", "2", "total_area"]


def test_class_areas_add_up_to_the_grid(spark):
    r = raster(spark, np.arange(12).reshape(3, 4) % 3 + 1, Grid(10, 50, 0.25, -0.25, 4, 3))
    total = class_area(r, True).first()["total_area"]
    assert total == pytest.approx(cell_area(r).agg(F.sum("area")).first()[0] * 4)
    areas = raster(spark, [[1, 2, None, 4]] * 3)
    got = {x[0]: x[1] for x in class_area(raster(spark, [[1, 1, 1, 2]] * 3), areas, wide=False).collect()}
    assert got == {1: 9, 2: 12}


def test_class_area_in_time(spark):
    r = raster(spark, [[[1, 2]], [[1, 1]]])
    got = class_area(r).orderBy("time").collect()
    assert [(x["1"], x["2"], x["total_area"]) for x in got] == [(1, 1, 2), (2, None, 2)]
    assert class_area(r, wide=False).columns == ["time", "classification", "area_hectares"]


def test_combined(spark):
    p, s = raster(spark, [[0, 1, 1, None, 2]]), raster(spark, [[None, 0, 11, 1, 1]])
    code = cells(combine_classes(p, s), "code")
    assert code == pytest.approx({(0, 0): 0.0, (0, 1): 0.0, (0, 2): 2.1, (0, 3): None, (0, 4): 2.1}, nan_ok=True)
    long = {x["classification"]: x["area_hectares"] for x in combined_class_area(p, s, wide=False).collect()}
    assert long == {"1.11": 1, "2.1": 1}  # equal codes, two pairs
    with_zero = {x["classification"] for x in combined_class_area(p, s, wide=False, drop_zero=False).collect()}
    assert with_zero == {"1.0", "1.11", "2.1"}
    wide = combined_class_area(p, s, legends=({1: "a", 2: "b"}, {1: "x"}))
    assert wide.columns == ["a - 11", "b - x", "total_area"] and tuple(wide.first()) == (1, 1, 2)


def test_combined_in_time(spark):
    p, s = raster(spark, [[[1, 2]], [[2, 2]]]), raster(spark, [[1, 1]])
    got = {(x["time"].year, x["classification"]): x["area_hectares"] for x in combined_class_area(p, s, wide=False).collect()}
    assert got == {(2000, "1.1"): 1, (2000, "2.1"): 1, (2001, "2.1"): 2}


@pytest.mark.parametrize("large_at", [0, 499, 999])
def test_combined_sums_areas_in_any_order(spark, large_at):
    """combined_stats_long: a running sum lost what is less than half of its last bit, so the sum hung on the order of the cells."""
    one, areas = raster(spark, [[1] * 1000]), [2.0**-24] * 1000
    areas[large_at] = 2.0**30
    total = lambda row: combined_class_area(one, one, raster(spark, [row]), wide=False).first()["area_hectares"]
    assert total(areas) == math.fsum(areas) != 2.0**30
    assert total([None, *areas[1:]]) == math.fsum(areas[1:])
    assert total([math.inf, *areas[1:]]) == math.inf and total([None] * 1000) is None


def test_category_stats(spark):
    c, v = raster(spark, [[0, 1, 1, 2, 3]]), raster(spark, [[9, 2, 4, -1, None]])
    got = {x["category"]: (x["mean_value"], x["std_value"]) for x in category_stats(c, v).collect()}
    assert got == {1: (3, 1), 2: (None, None), 3: (None, None)}
    t = raster(spark, [[[1, 1]], [[1, 2]]])
    out = category_stats(t, raster(spark, [[2, 4]]))
    assert {(x["time"].year, x["category"]): x["mean_value"] for x in out.collect()} == {(2000, 1): 3, (2001, 1): 2, (2001, 2): 4}


def test_shared_and_taken_names(spark):
    p = spark.createDataFrame([(0, k, k) for k in range(5)], "yi int, xi int, v int")
    r = Raster(p, Grid(0.0, 0.0, 1.0, -1.0, 5, 1))
    one = class_area(r, legend={1: "a`b", 2: "a`b", 3: "c"}).first().asDict()
    assert one == {"a`b": 2.0, "c": 1.0, "total_area": 3.0}
    with pytest.raises(ValueError):
        class_area(r, legend={1: "total_area"})


def test_combined_where_cells_have_no_row(spark):
    grid = Grid(0.0, 0.0, 1.0, -1.0, 4, 1)
    p = Raster(spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 3, 2)], "yi int, xi int, v int"), grid)
    s = Raster(spark.createDataFrame([(0, 1, 3), (0, 2, 0)], "yi int, xi int, w int"), grid)
    assert {r["xi"]: r["code"] for r in combine_classes(p, s).collect()} == {0: 0.0, 1: 1.3, 2: 0.0, 3: None}
    assert {r["xi"]: r["code"] for r in combine_classes(p, s, drop_zero=False).collect()} == {0: None, 1: 1.3, 2: None, 3: None}
    t = s.with_time("2020-01-01")
    got = combine_classes(p, t).collect()
    assert {(r["time"].year, r["xi"]): r["code"] for r in got} == {(2020, 0): 0.0, (2020, 1): 1.3, (2020, 2): 0.0, (2020, 3): None}
