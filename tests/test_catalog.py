import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.grid import Grid, Raster
from rasterloom.plans.catalog import Catalog, DatasetConfig, grid_of_bbox, list_datasets, manifest, time_axis
from rasterloom.queries import CONFIG
from rasterloom.session import Files
from rasterloom.sources.geotiff import Tiff, _lzw, _packbits, read_geotiffs, read_local, tiff_grid, write_geotiffs, write_tiff

GRID = Grid(10.0, 50.0, 0.5, -0.5, 7, 70)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize(("tile", "compress", "predictor"), [(None, "none", 1), (None, "deflate", 1), (16, "deflate", 1), (16, "none", 1), (16, "deflate", 2)])
def test_tiff_round_trip(tmp_path, dtype, tile, compress, predictor):
    if predictor == 2 and dtype.startswith("float"):
        pytest.skip("horizontal differences are for integers")
    a = (np.arange(2 * 70 * 7).reshape(2, 70, 7) % 120).astype(dtype)
    path = str(tmp_path / "a.tif")
    write_tiff(path, a, GRID, nodata=7, tile=tile, compress=compress, predictor=predictor)
    with open(path, "rb") as f:
        t = Tiff.open(f)
        assert t.grid() == GRID and t.nodata == 7 and t.bands == 2
        assert (t.read(f, 0, 70, 0, 7) == a).all()
        assert (t.read(f, 11, 67, 2, 5) == a[:, 11:67, 2:5]).all()


def test_codecs():
    assert _packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    # clear, 7, 258 (7 7), 8, end: nine bits each
    codes, bits = (256, 7, 258, 8, 257), 0
    for c in codes:
        bits = bits << 9 | c
    assert _lzw((bits << 3).to_bytes(6, "big")) == bytes([7, 7, 7, 8])


def test_tiff_refusals(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no tiff at all, really")
    with pytest.raises(ValueError), open(tmp_path / "x.tif", "rb") as f:
        Tiff.open(f)


def test_tiff_sources(spark, tmp_path):
    a = np.arange(70 * 7, dtype="int16").reshape(1, 70, 7)
    path = str(tmp_path / "a.tif")
    write_tiff(path, a, GRID, nodata=5, tile=16)
    d = read_local(spark, path, window=32)
    assert d.rdd.getNumPartitions() == 3
    want = {(y, x): None if a[0, y, x] == 5 else float(a[0, y, x]) for y in range(70) for x in range(7)}
    for source in (d, read_geotiffs(spark, [path])):
        assert {(r["yi"], r["xi"]): r["value"] for r in source.collect()} == want
        assert {r["path"] for r in source.select("path").distinct().collect()} == {path}
    assert tiff_grid(spark, path) == GRID


def test_ascending_grid(tmp_path):
    g = Grid(0.0, 0.0, 1.0, 1.0, 2, 2)
    write_tiff(str(tmp_path / "a.tif"), np.zeros((1, 2, 2), "uint8"), g)
    with open(tmp_path / "a.tif", "rb") as f:
        assert Tiff.open(f).grid() == g


# --- configuration ------------------------------------------------------------------------------------------------------


def test_config():
    c = DatasetConfig(CONFIG)
    assert (c.dataset_name, c.repo_name, c.crs, c.dimensions, c.has_time) == ("sample", "org/sample", "EPSG:4326", ["x", "y", "time"], True)
    d = DatasetConfig({"dataset_name": "n"}, "o")
    assert (d.repo_name, d.crs, d.dimensions, d.has_time) == ("o/n", "EPSG:4326", ["x", "y"], False)
    with pytest.raises(ValueError):
        c.group("none")
    with pytest.raises(ValueError):
        DatasetConfig({"groups": {"g": {"time": {}}}}).variables("g")
    assert c.legend("yearly", "classification") == {0: "no_data", 1: "tall_forest", 2: "shrub"}
    assert c.attributes("yearly", "classification")["flag_meanings"] == "no_data tall_forest shrub"
    assert c.attributes("root", "height")["units"] == "m"


def test_legends_belong_to_their_group():
    c = DatasetConfig({"groups": {"a": {"v": {"values": {"1": "x"}}}, "b": {"v": {"values": {"1": "y"}}}}})
    assert (c.legend("a", "v"), c.legend("b", "v")) == ({1: "x"}, {1: "y"})


def test_listing_and_loading(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"dataset_name": n, "organization": "o"}))
    (tmp_path / "note.txt").write_text("x")
    assert [r[0] for r in list_datasets(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert DatasetConfig.load(spark, str(tmp_path / "a.json")).dataset_name == "a"
    for bad in ("none.json", "note.txt"):
        with pytest.raises(ValueError):
            DatasetConfig.load(spark, str(tmp_path / bad))
    cat = Catalog(spark, str(tmp_path / "cat"))
    (tmp_path / "c.json").write_text("{")
    got = cat.create_from_configs(str(tmp_path))
    assert sum(isinstance(v, ValueError) for v in got.values()) == 1 and cat.exists(str(tmp_path / "cat/o/a"))
    with pytest.raises(ValueError):
        cat.create("", "o")


def test_time_axis(spark):
    years = lambda *a: [r[0].year for r in time_axis(spark, *a).collect()]
    assert years() == list(range(2000, 2025))
    assert years("2001-03-01", "2003-12-31") == [2002, 2003]
    assert years("2005-01-01", "2004-01-01") == []


def test_manifest(spark):
    m = manifest(spark, DatasetConfig(CONFIG))
    assert m.count() == 26
    r = m.where("year(time) = 2003").first()
    assert (r["path"], r["kind"]) == ("s3://b/cover_2003.tif", "smallint")
    assert m.where("var = 'height'").first()["time"] is None
    assert manifest(spark, DatasetConfig(CONFIG), "root", "int").first()["kind"] == "smallint"
    with pytest.raises(ValueError):
        manifest(spark, DatasetConfig({}))


def test_grid_of_bbox():
    g = grid_of_bbox((0.0, 10.0, 1.0, 10.5), 0.25)
    assert g.centres("x").tolist() == [0, 0.25, 0.5, 0.75] and g.centres("y").tolist() == [10, 10.25]


def test_initialize_and_populate(spark, tmp_path):
    grid = Grid(0.0, 2.0, 1.0, -1.0, 3, 2)
    config = DatasetConfig({"dataset_name": "d", "organization": "o", "dim": ["x", "y", "time"], "groups": {"g": {"time": {"start": "2000-01-01", "end": "2001-01-01"}, "c": {"s3_path_prefix": f"{tmp_path}/c_", "s3_path_suffix": ".tif", "unit_type": "int", "values": {"0": "no", "1": "yes"}}}, "root": {"h": {"s3_path": f"{tmp_path}/h.tif", "unit_type": "float"}}}})
    for year in (2000, 2001):
        write_tiff(f"{tmp_path}/c_{year}.tif", np.array([[[0, 1, 1], [year - 1999, -9, 2]]], "int16"), grid, nodata=-9)
    write_tiff(f"{tmp_path}/h.tif", np.array([[[0.5, np.nan, 1.5], [2.5, 3.5, 4.5]]], "float32"), grid)
    cat = Catalog(spark, str(tmp_path / "cat"))
    with pytest.raises(ValueError):
        cat.read(config, "g", "c")
    cat.initialize_all(config, grid=grid)
    assert cat.read(config, "g", "c").pixels.count() == 0
    empty = cat.read(config, "root", "h", fill=-1)
    assert {r["h"] for r in empty.pixels.collect()} == {-1.0} and empty.pixels.count() == 6
    assert cat.populate_all(config) == {"g": 2, "root": 2}
    r = cat.read(config, "g", "c")
    assert r.grid == grid and r.legends == {"c": {0: "no", 1: "yes"}}
    got = {(x["time"].year, x["yi"], x["xi"]): x["c"] for x in r.pixels.collect()}
    assert got == {(y, 0, 0): 0 for y in (2000, 2001)} | {(y, 0, 1): 1 for y in (2000, 2001)} | {(y, 0, 2): 1 for y in (2000, 2001)} | {(2000, 1, 0): 1, (2001, 1, 0): 2} | {(y, 1, 2): 2 for y in (2000, 2001)}
    assert dict(r.pixels.dtypes)["c"] == "smallint"
    h = cat.read(config, "root", "h")
    assert not h.has_time and h.pixels.count() == 5
    filled = cat.read(config, "g", "c", fill=-1).pixels
    assert filled.count() == 12 and filled.where("c = -1").count() == 2
    # an earlier version stays readable
    assert cat.read(config, "g", "c", version=1).pixels.count() == 0
    assert [x["message"] for x in cat.commits(config).where("group = 'g'").orderBy("version").collect()] == ["initialize g", "populate g"]
    plan = r.pixels.where(F.col("yi") == 0)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(yi,0)" in plan
    with pytest.raises(ValueError):
        cat.initialize_all(DatasetConfig({}), grid=grid)
    with pytest.raises(ValueError):
        cat.initialize(config, "g")
    with pytest.raises(ValueError):
        cat.populate(config, "none")


def test_initialize_from_geojson_and_write(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}}]}))
    config = DatasetConfig({"dataset_name": "d", "organization": "o", "groups": {"root": {"v": {"unit_type": "float"}}}})
    cat = Catalog(spark, str(tmp_path / "cat"))
    g = cat.initialize(config, "root", geojson=str(tmp_path / "a.json"), step=0.5)
    assert (g.nx, g.ny) == (2, 2)
    p = spark.createDataFrame([(0, 0, 1.5), (1, 1, None)], "yi int, xi int, v double")
    assert cat.write(config, "root", {"v": Raster(p, g)}) == 2
    assert [tuple(r) for r in cat.read(config, "root", "v").pixels.collect()] == [(0, 0, 1.5)]


def annual_config(tmp_path, start="2000-01-01", end="2001-01-01"):
    return DatasetConfig({"dataset_name": "d", "organization": "o", "dim": ["x", "y", "time"], "groups": {"g": {"time": {"start": start, "end": end}, "c": {"s3_path_prefix": f"{tmp_path}/c_", "s3_path_suffix": ".tif", "unit_type": "int"}}}})


def cells(raster, name="c"):
    return {(x["time"].year, x["yi"], x["xi"]): x[name] for x in raster.pixels.collect()}


def files_of(spark, rows):
    return spark.createDataFrame([("c", dt.datetime(y, 1, 1), str(p), "smallint") for y, p in rows], "var string, time timestamp, path string, kind string")


def test_populating_one_year_keeps_the_others(spark, tmp_path):
    grid, config = Grid(0.0, 2.0, 1.0, -1.0, 3, 2), annual_config(tmp_path)
    for year in (2000, 2001):
        write_tiff(f"{tmp_path}/c_{year}.tif", np.full((1, 2, 3), year - 1999, "int16"), grid, nodata=-9)
    cat = Catalog(spark, str(tmp_path / "cat"))
    cat.initialize(config, "g", grid)
    cat.populate(config, "g")
    write_tiff(f"{tmp_path}/new.tif", np.array([[[7, -9, 7], [7, 7, 7]]], "int16"), grid, nodata=-9)
    assert cat.populate(config, "g", files_of(spark, [(2001, tmp_path / "new.tif")])) == 3
    want = {(2000, y, x): 1 for y in range(2) for x in range(3)} | {(2001, y, x): 7 for y in range(2) for x in range(3) if (y, x) != (0, 1)}
    assert cells(cat.read(config, "g", "c")) == want
    assert cells(cat.read(config, "g", "c", version=2)) == want | {(2001, y, x): 2 for y in range(2) for x in range(3)}


def test_every_file_stands_where_its_header_says(spark, tmp_path):
    grid, config = Grid(0.0, 2.0, 1.0, -1.0, 6, 2), annual_config(tmp_path)
    write_tiff(f"{tmp_path}/c_2000.tif", np.array([[[1, 2]]], "int16"), Grid(0.0, 2.0, 1.0, -1.0, 2, 1))
    write_tiff(f"{tmp_path}/c_2001.tif", np.array([[[3, 4]]], "int16"), Grid(2.0, 1.0, 1.0, -1.0, 2, 1))
    cat = Catalog(spark, str(tmp_path / "cat"))
    cat.initialize(config, "g", grid)
    cat.populate(config, "g")
    want = {(2000, 0, 0): 1, (2000, 0, 1): 2, (2001, 1, 2): 3, (2001, 1, 3): 4}
    assert cells(cat.read(config, "g", "c")) == want
    # a region of one year, from two files that overlap; the later one counts
    write_tiff(f"{tmp_path}/a.tif", np.array([[[5, 5, 5]]], "int16"), Grid(1.0, 2.0, 1.0, -1.0, 3, 1))
    write_tiff(f"{tmp_path}/b.tif", np.array([[[6, -9]]], "int16"), Grid(2.0, 2.0, 1.0, -1.0, 2, 1), nodata=-9)
    cat.populate(config, "g", files_of(spark, [(2000, tmp_path / "a.tif"), (2000, tmp_path / "b.tif")]))
    assert cells(cat.read(config, "g", "c")) == {(2000, 0, 0): 1, (2000, 0, 1): 5, (2000, 0, 2): 6, (2001, 1, 2): 3, (2001, 1, 3): 4}


@pytest.mark.parametrize("own", [Grid(0.5, 2.0, 1.0, -1.0, 2, 1), Grid(0.0, 2.0, 0.5, -1.0, 2, 1), Grid(0.0, 2.0, 1.0, -1.0, 2, 1, "EPSG:3857"), Grid(50.0, 2.0, 1.0, -1.0, 2, 1)])
def test_files_that_dont_fit_the_grid_are_refused(spark, tmp_path, own):
    config = annual_config(tmp_path, end="2000-01-01")
    write_tiff(f"{tmp_path}/c_2000.tif", np.zeros((1, 1, 2), "int16"), own)
    cat = Catalog(spark, str(tmp_path / "cat"))
    cat.initialize(config, "g", Grid(0.0, 2.0, 1.0, -1.0, 6, 2))
    with pytest.raises(ValueError):
        cat.populate(config, "g")
    assert cat.read(config, "g", "c").pixels.count() == 0


def test_two_writers_both_stay(spark, tmp_path):
    grid, config = Grid(0.0, 2.0, 1.0, -1.0, 3, 2), annual_config(tmp_path)
    a, b = Catalog(spark, str(tmp_path / "cat")), Catalog(spark, str(tmp_path / "cat"))
    a.initialize(config, "g", grid)
    raster = lambda year, v: Raster(spark.createDataFrame([(dt.datetime(year, 1, 1), 0, 0, v)], "time timestamp, yi int, xi int, c int"), grid)
    state = b._state
    stale = [state(config, "g")]  # what b sees before a publishes
    b._state = lambda *x: stale.pop() if stale else state(*x)
    assert a.write(config, "g", {"c": raster(2000, 1)}) == 2
    assert b.write(config, "g", {"c": raster(2001, 2)}) == 3
    assert cells(a.read(config, "g", "c")) == {(2000, 0, 0): 1, (2001, 0, 0): 2}


def test_grid_from_a_template(spark, tmp_path):
    write_tiff(f"{tmp_path}/t.tif", np.zeros((1, 4, 8), "uint8"), Grid(10.0, 4.0, 1.0, -1.0, 8, 4))
    (tmp_path / "a.json").write_text(json.dumps({"features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [3, 0], [3, 2], [0, 2], [0, 0]]]}}]}))
    cat = Catalog(spark, str(tmp_path / "cat"))
    one = {"dataset_name": "d", "organization": "o", "groups": {"root": {"v": {"unit_type": "float"}}}}
    assert cat.initialize(DatasetConfig(one), "root", template=f"{tmp_path}/t.tif") == Grid(10.0, 4.0, 1.0, -1.0, 8, 4)
    g = cat.initialize(DatasetConfig(one), "root", template=f"{tmp_path}/t.tif", geojson=str(tmp_path / "a.json"))
    assert (g.nx, g.ny, g.dx) == (3, 2, 1.0)
    one["groups"]["root"]["v"]["is_mosaiced"] = True
    assert cat.initialize(DatasetConfig(one), "root", template=f"{tmp_path}/t.tif", geojson=str(tmp_path / "a.json")).nx == 8
    moved = cat.initialize(DatasetConfig(one | {"crs": "EPSG:3857"}), "root", template=f"{tmp_path}/t.tif")
    assert moved.crs == "EPSG:3857" and moved.nx in (8, 9) and moved.dx == -moved.dy


def test_configuration_or_name(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"dataset_name": "n", "organization": "o"}))
    cat = Catalog(spark, str(tmp_path))
    assert cat.config(name="n").dataset_name == cat.config({"dataset_name": "n"}).dataset_name == "n"
    for how in ({}, {"config": {}, "name": "n"}):
        with pytest.raises(ValueError):
            cat.config(**how)


def test_attributes_are_stored_and_carried(spark, tmp_path):
    config = DatasetConfig(CONFIG)
    cat = Catalog(spark, str(tmp_path))
    cat.initialize_all(config, grid=GRID)
    own = cat.read(config, "yearly", "classification").pixels.schema["classification"].metadata
    assert own["units"] == "class" and own["standard_name"] == "classification" and own["flag_values"] == [0, 1, 2]
    assert cat.read(config, "root", "height").pixels.schema["height"].metadata["units"] == "m"
    assert {tuple(r) for r in cat.attributes(config, "root").where("name = 'x'").collect()} == {("x", "standard_name", "longitude"), ("x", "long_name", "longitude"), ("x", "units", "degrees_east")}


def test_frequencies(spark):
    times = lambda *a: [str(r[0].date()) for r in time_axis(spark, *a).orderBy("time").collect()]
    assert times("2020-01-31", "2020-04-30", "ME") == ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30"]
    assert times("2020-02-01", "2020-07-01", "QS") == ["2020-04-01", "2020-07-01"]
    with pytest.raises(ValueError):
        time_axis(spark, None, None, "fortnight")


def test_tiff_sink(spark, tmp_path):
    p = spark.createDataFrame([(y, x, None if (y, x) == (1, 1) else y * 10 + x) for y in range(5) for x in range(3)], "yi int, xi int, v int")
    got = write_geotiffs(Raster(p, Grid(0.0, 5.0, 1.0, -1.0, 3, 5)), f"file://{tmp_path}/out", rows=2).collect()
    assert sorted((r["y_lo"], r["ny"]) for r in got) == [(0, 2), (2, 2), (4, 1)]
    back = {}
    for r in got:
        for x in read_geotiffs(spark, [r["path"]], window=1).collect():
            back[x["yi"] + r["y_lo"], x["xi"]] = x["value"]
    assert back == {(y, x): None if (y, x) == (1, 1) else float(y * 10 + x) for y in range(5) for x in range(3)}
    assert tiff_grid(spark, got[0]["path"]).ny in (1, 2)


def test_headers_fetch_no_pixels(spark, tmp_path):
    path = str(tmp_path / "big.tif")
    write_tiff(path, np.zeros((1, 2000, 1000), "float64"), Grid(0.0, 1.0, 0.1, -0.1, 1000, 2000))
    files, fetched = Files(spark), []
    from rasterloom.sources.geotiff import _Ranges

    t = Tiff.open(_Ranges(lambda start, size: fetched.append(size) or files.read(path, start, size)))
    assert (t.width, t.height) == (1000, 2000) and sum(fetched) < 1_000_000
