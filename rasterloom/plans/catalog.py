"""Datasets by configuration: groups of variables with legends and annual times, kept as versioned Parquet tables.

A catalog is a folder. <root>/<org>/<dataset>/<group>/data/<unique> holds the pixels that one commit wrote, partitioned by var and year, and
<group>/_versions/<n>.json what version n consists of: grid, attributes, and for each variable and year the layers of data with the window of cells that each
covers. A later layer replaces an earlier one inside its window, so a commit writes its own years, variables and
regions alone and everything else stays. A version exists once its file does, and that is created only if it is absent: of two writers of one number the
second takes the next, on top of the first. Hadoop's file systems are used throughout, so a root can be in any store (where
creating a file isn't atomic, as in plain object stores, writers of one group must take turns).
"""

from __future__ import annotations

import datetime as dt
import json
import math
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import normal_crs, transform
from ..grid import Grid, Raster, not_nan
from ..operators.geometry import first_feature_bbox, read_geojson
from ..session import Files
from ..sources.geotiff import read_geotiffs, tiff_grid

START, END = "2000-01-01", "2024-01-01"
FILL = -1
TILE = 2000


class DatasetConfig:
    """A dataset's configuration, from a mapping. Missing required parts raise ValueError where they are asked for."""

    def __init__(self, config: Mapping[str, Any], organization: str | None = None) -> None:
        self.config = dict(config)
        self._organization = organization

    @staticmethod
    def load(spark: SparkSession, path: str, organization: str | None = None) -> DatasetConfig:
        try:
            return DatasetConfig(json.loads(spark.read.text(path, wholetext=True).first()[0]), organization)
        except Exception as e:
            raise ValueError(f"no configuration at {path}: {e}") from e

    @property
    def dataset_name(self) -> str:
        return self.config.get("dataset_name", "")

    @property
    def organization(self) -> str:
        return self.config.get("organization") or self._organization or ""

    @property
    def repo_name(self) -> str:
        return self.config.get("repo") or f"{self.organization}/{self.dataset_name}"

    @property
    def long_name(self) -> str:
        return self.config.get("long_name", "")

    @property
    def crs(self) -> str:
        return normal_crs(self.config.get("crs") or "EPSG:4326")

    @property
    def dimensions(self) -> list[str]:
        return list(self.config.get("dim") or ["x", "y"])

    @property
    def has_time(self) -> bool:
        return "time" in self.dimensions

    @property
    def groups(self) -> dict[str, dict]:
        return dict(self.config.get("groups") or {})

    def group(self, name: str) -> dict:
        if name not in self.groups:
            raise ValueError(f"no group {name}; there are {list(self.groups)}")
        return self.groups[name]

    def time(self, group: str) -> dict | None:
        return self.group(group).get("time")

    def variables(self, group: str) -> dict[str, dict]:
        found = {k: v for k, v in self.group(group).items() if k != "time"}
        if not found:
            raise ValueError(f"group {group} has no variables")
        return found

    def legend(self, group: str, var: str) -> dict[int, str]:
        """Meaning of each code in the order of the codes, blanks as underscores; of this group's variable alone."""
        values = self.variables(group).get(var, {}).get("values") or {}
        return {int(k): str(values[k]).replace(" ", "_") for k in sorted(values, key=int)}

    def legend_table(self, spark: SparkSession) -> DataFrame:
        rows = [(g, v, k, m) for g in self.groups for v in self.variables(g) for k, m in self.legend(g, v).items()]
        return spark.createDataFrame(rows, "group string, var string, code int, meaning string")

    def attributes(self, group: str, var: str) -> dict[str, Any]:
        """Climate and forecast metadata of a variable of classes or with a unit; stored with each version and carried by the column."""
        own = self.variables(group)[var]
        out: dict[str, Any] = {"Conventions": "CF-1.8"}
        if legend := self.legend(group, var):
            kind = own.get("classification_type", "classification")
            out |= {"standard_name": "classification", "long_name": kind, "classification_type": kind, "units": "class", "flag_values": list(legend), "flag_meanings": " ".join(legend.values())}
        elif "unit_name" in own:
            out["units"] = own["unit_name"]
        return out

    def metadata(self, group: str) -> dict[str, dict[str, Any]]:
        """Attributes of the axes and variables of a group."""
        axes = {k: v for k, v in AXIS_ATTRIBUTES.items() if k != "time" or self.time(group)}
        return axes | {v: self.attributes(group, v) for v in self.variables(group)}

    def metadata_table(self, spark: SparkSession) -> DataFrame:
        """(group, name, attribute, value) of all groups, values as text."""
        text = lambda v: " ".join(map(str, v)) if isinstance(v, list) else str(v)
        rows = [(g, n, k, text(v)) for g in self.groups for n, own in self.metadata(g).items() for k, v in own.items()]
        return spark.createDataFrame(rows, "group string, name string, attribute string, value string")

    def column(self, group: str, var: str) -> Column:
        return F.col(var).alias(var, metadata=self.attributes(group, var))


AXIS_ATTRIBUTES = {
    "x": {"standard_name": "longitude", "long_name": "longitude", "units": "degrees_east"},
    "y": {"standard_name": "latitude", "long_name": "latitude", "units": "degrees_north"},
    "time": {"standard_name": "time", "long_name": "time"},
}


def kind_of(unit_type: str | None) -> str:
    return "float" if unit_type == "float" else "smallint"


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(name): the JSON files of a folder, without their ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name")).orderBy("name")


#: Frequency: months from one time to the next, and whether the times are the periods' last days. D is a day.
FREQUENCIES = {"YS": (12, False), "AS": (12, False), "QS": (3, False), "MS": (1, False), "YE": (12, True), "Y": (12, True), "A": (12, True), "QE": (3, True), "Q": (3, True), "ME": (1, True), "M": (1, True)}


def time_axis(spark: SparkSession, start: str | None = None, end: str | None = None, freq: str | None = "YS") -> DataFrame:
    """(time): every period's first (or last) day from start to end, both included; years by default."""
    first, last = ((v or d)[:10] for v, d in ((start, START), (end, END)))
    freq = freq or "YS"
    if freq == "D":
        months, ends, step = 1, False, "interval 1 day"
    elif freq in FREQUENCIES:
        months, ends = FREQUENCIES[freq]
        step = f"interval {months} month"
    else:
        raise ValueError(f"no frequency {freq}; there are {[*FREQUENCIES, 'D']}")
    lo, hi = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    if freq == "D":
        begin = lo
    else:  # the first day of the period that holds the start
        begin = dt.date(lo.year, (lo.month - 1) // months * months + 1, 1)
    if begin > hi:
        return spark.createDataFrame([], "time timestamp")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(begin), F.lit(hi), F.expr(step))).alias("day"))
    day = F.date_sub(F.add_months("day", months), 1) if ends else F.col("day")
    return days.select(day.alias("day")).where(F.col("day").between(F.lit(lo), F.lit(hi))).select(F.col("day").cast("timestamp").alias("time"))


def manifest(spark: SparkSession, config: DatasetConfig, group: str | None = None, unit_type: str | None = None) -> DataFrame:
    """(group, var, time, path, kind): a row for each file that a group, or all, is read from. A variable with prefix and suffix in a group with time has a file a year; s3_path, where it is set, is the one file."""
    parts = []
    for g in [group] if group else config.groups:
        when = config.time(g)
        for v, own in config.variables(g).items():
            kind = kind_of(unit_type or own.get("unit_type"))
            if own.get("s3_path") or not when:
                path = own.get("s3_path") or f"{own.get('s3_path_prefix', '')}{own.get('s3_path_suffix', '')}"
                d = spark.range(1).select(F.lit(None).cast("timestamp").alias("time"), F.lit(path).alias("path"))
            else:
                axis = time_axis(spark, when.get("start"), when.get("end"), when.get("freq"))
                d = axis.select("time", F.concat(F.lit(own.get("s3_path_prefix", "")), F.year("time").cast("string"), F.lit(own.get("s3_path_suffix", ""))).alias("path"))
            parts.append(d.select(F.lit(g).alias("group"), F.lit(v).alias("var"), "time", "path", F.lit(kind).alias("kind")))
    if not parts:
        raise ValueError("the configuration has no groups")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_of_bbox(bbox: tuple[float, float, float, float], step: float, crs: str = "EPSG:4326") -> Grid:
    """Cells of one size from the lower left corner, y ascending; the last may reach beyond the box."""
    count = lambda lo, hi: max(1, math.ceil(round((hi - lo) / step, 9)))
    # the first centre is the box's corner, as for a range from the minimum by the step
    return Grid(bbox[0] - step / 2, bbox[1] - step / 2, step, step, count(bbox[0], bbox[2]), count(bbox[1], bbox[3]), crs)


def reprojected(grid: Grid, crs: str) -> Grid:
    """A regular grid's extent in another system, with square cells of the size that keeps the number of cells along the diagonal."""
    own, crs = normal_crs(grid.crs), normal_crs(crs)
    if own == crs:
        return grid
    x0, y0, x1, y1 = grid.bounds
    x, y = transform(np.array([x0, x1]), np.array([y0, y1]), own, crs)
    w, h = float(x[1] - x[0]), float(y[1] - y[0])
    step = math.hypot(w, h) / math.hypot(grid.nx, grid.ny)
    return Grid(float(x[0]), float(y[1]), step, -step, max(1, round(w / step)), max(1, round(h / step)), crs)


def offset_in(grid: Grid, own: Grid, path: str) -> tuple[int, int]:
    """Cell of grid where a file's first cell stands. A file in another system or of other cells, or between cells, raises ValueError."""
    if normal_crs(own.crs) != normal_crs(grid.crs):
        raise ValueError(f"{path} is in {own.crs}, the group in {grid.crs}")
    if abs(own.dx / grid.dx - 1) > 1e-6 or abs(own.dy / grid.dy - 1) > 1e-6:
        raise ValueError(f"cells of {path} are {own.dx} x {own.dy}, those of the group {grid.dx} x {grid.dy}")
    x, y = (own.x0 - grid.x0) / grid.dx, (own.y0 - grid.y0) / grid.dy
    if max(abs(x - round(x)), abs(y - round(y))) > 0.01:
        raise ValueError(f"{path} stands between the cells of the group")
    return round(x), round(y)


def _year(time: Any) -> str:
    return "" if time is None else str(time.year)


#: What a layer covers: first and last xi, first and last yi.
Window = list[int]


def _covered(inner: Window, outer: Window) -> bool:
    return outer[0] <= inner[0] and inner[1] <= outer[1] and outer[2] <= inner[2] and inner[3] <= outer[3]


def _inside(w: Window) -> Column:
    return F.col("xi").between(w[0], w[1]) & F.col("yi").between(w[2], w[3])


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def config(self, config: DatasetConfig | Mapping[str, Any] | None = None, name: str | None = None, folder: str | None = None, organization: str | None = None) -> DatasetConfig:
        """A configuration as it is given, or by name from a folder of configurations; exactly one of the two."""
        if (config is None) == (name is None):
            raise ValueError("give a configuration or the name of one, and not both")
        if name is not None:
            return DatasetConfig.load(self.spark, f"{(folder or self.root).rstrip('/')}/{name}.json", organization)
        return config if isinstance(config, DatasetConfig) else DatasetConfig(config, organization)

    def exists(self, path: str) -> bool:
        return self.files.exists(path)

    def path(self, repo: str) -> str:
        return f"{self.root}/{repo}"

    def create(self, name: str, organization: str) -> str:
        """The folder of a new dataset."""
        if not name:
            raise ValueError("a dataset needs a name")
        path = self.path(f"{organization}/{name}")
        self.files.make(path)
        return path

    def create_from_configs(self, configs: str | Sequence[str], organization: str | None = None) -> dict[str, str | ValueError]:
        """A dataset for each configuration file, or for every one in a folder; those that are there stay. Errors are returned beside the paths, not swallowed."""
        paths = [f"{configs.rstrip('/')}/{r[0]}.json" for r in list_datasets(self.spark, configs).collect()] if isinstance(configs, str) and not configs.endswith(".json") else [configs] if isinstance(configs, str) else list(configs)
        out: dict[str, str | ValueError] = {}
        for path in paths:
            try:
                c = DatasetConfig.load(self.spark, path, organization)
                out[path] = self.path(c.repo_name) if self.exists(self.path(c.repo_name)) else self.create(c.dataset_name, c.organization)
            except ValueError as e:
                out[path] = e
        return out

    # --- commits -------------------------------------------------------------------------------------------------------

    def _versions(self, config: DatasetConfig, group: str) -> str:
        return f"{self.path(config.repo_name)}/{group}/_versions"

    def commits(self, config: DatasetConfig) -> DataFrame:
        """(group, version, message, at, grid) of every version of every group of the configuration."""
        schema = "group string, version long, message string, at timestamp, grid string"
        paths = [f"{self._versions(config, g)}/{n}" for g in config.groups for n in self.files.names(self._versions(config, g))]
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)

    def _state(self, config: DatasetConfig, group: str, version: int | None = None) -> dict | None:
        folder = self._versions(config, group)
        names = self.files.names(folder)
        if version is not None and f"{version:08d}.json" not in names:
            raise ValueError(f"group {group} has no version {version}")
        if not names:
            return None
        state = json.loads(self.files.read(f"{folder}/{names[-1] if version is None else f'{version:08d}.json'}"))
        return state | {"grid": Grid(**_tuples(json.loads(state["grid"])))}

    def _commit(self, config: DatasetConfig, group: str, grid: Grid, message: str, layers: Mapping[str, Mapping[str, list]]) -> int:
        """A version with these layers on top of the newest one's; if another writer publishes first, on top of that."""
        while True:
            last = self._state(config, group)
            if last and last["grid"] != grid and last["layers"]:
                raise ValueError(f"group {group} stands on another grid")
            merged: dict[str, dict[str, list]] = {v: dict(years) for v, years in (last["layers"] if last else {}).items()}
            for v, years in layers.items():
                for year, new in years.items():
                    held = [x for x in merged.get(v, {}).get(year, []) if not any(_covered(x[1], y[1]) for y in new)]
                    merged.setdefault(v, {})[year] = held + new
            version = last["version"] + 1 if last else 1
            state = {"group": group, "version": version, "message": message, "at": dt.datetime.now().isoformat(), "grid": json.dumps(grid.__dict__), "attributes": config.metadata(group), "layers": merged}
            if self.files.create(f"{self._versions(config, group)}/{version:08d}.json", json.dumps(state).encode()):
                return version

    def _data(self, config: DatasetConfig, group: str, pixels: DataFrame) -> str:
        """Where pixels were written."""
        path = f"{self.path(config.repo_name)}/{group}/data/{uuid.uuid4().hex}"
        tiles = pixels.withColumns({"year": F.year("time"), "ty": F.floor(F.col("yi") / TILE), "tx": F.floor(F.col("xi") / TILE)})
        # tiles stay together and in order, so that ranges of yi and xi prune row groups
        tiles.repartition("var", "year", "ty", "tx").sortWithinPartitions("var", "year", "ty", "tx", "yi", "xi").drop("ty", "tx").write.partitionBy("var", "year").parquet(path)
        return path

    def initialize(self, config: DatasetConfig, group: str, grid: Grid | None = None, geojson: str | None = None, step: float | None = None, template: str | None = None) -> Grid:
        """An empty version of a group: on a grid; on the cells of size step (or of a template's width) in the bounds of a GeoJSON file's first feature; or on the grid of a template raster, brought to the configuration's system."""
        own = config.variables(group)
        if grid is None and template is not None:
            grid = reprojected(tiff_grid(self.spark, template), config.crs)
            step = step or abs(grid.dx)
        mosaiced = next(iter(own.values())).get("is_mosaiced", False)
        if geojson is not None and step is not None and not (template is not None and mosaiced):
            grid = grid_of_bbox(first_feature_bbox(read_geojson(geojson, self.spark), config.crs), step, config.crs)
        if grid is None:
            raise ValueError("a group needs a grid, a template, or a GeoJSON file and a cell size")
        self._commit(config, group, grid, f"initialize {group}", {})
        return grid

    def initialize_all(self, config: DatasetConfig, **how) -> None:
        if not config.groups:
            raise ValueError("the configuration has no groups")
        for g in config.groups:
            self.initialize(config, g, **how)

    def populate(self, config: DatasetConfig, group: str, files: DataFrame | None = None, unit_type: str | None = None, window: int = 4000) -> int:
        """A new version of a group with what its files hold, read by the GeoTIFF source in one job, and its number. files (var, time, path, kind) replaces the configuration's manifest; years, variables and cells that no file covers stay as they are. Each file stands where its own header says; of files that overlap, the later one counts. Values are cast to the variable's kind; missing ones have no row."""
        config.variables(group)
        rows = (files if files is not None else manifest(self.spark, config, group, unit_type)).collect()  # one row a file
        if not rows:
            raise ValueError(f"group {group} has no files")
        headers = {p: tiff_grid(self.spark, p) for p in dict.fromkeys(r["path"] for r in rows)}
        last = self._state(config, group)
        grid = last["grid"] if last else headers[rows[0]["path"]]
        places, layers = [], {}
        for n, r in enumerate(rows):
            own = headers[r["path"]]
            dx, dy = offset_in(grid, own, r["path"])
            w = [max(dx, 0), min(dx + own.nx, grid.nx) - 1, max(dy, 0), min(dy + own.ny, grid.ny) - 1]
            if w[0] > w[1] or w[2] > w[3]:
                raise ValueError(f"{r['path']} lies outside of the group's grid")
            places.append((n, r["path"], r["var"], r["time"], r["kind"], dx, dy, *w))
            layers.setdefault(r["var"], {}).setdefault(_year(r["time"]), []).append(w)
        names = "n int, path string, var string, time timestamp, kind string, dx int, dy int, x_lo int, x_hi int, y_lo int, y_hi int"
        table = self.spark.createDataFrame(places, names)
        # the windows of later files for the same cells, few and often none
        later = {n: [p[7:] for p in places[n + 1 :] if p[2:4] == places[n][2:4]] for n in range(len(places))}
        v = not_nan("value")
        value = F.when(F.col("kind") == "smallint", F.round(v).cast("smallint").cast("double")).otherwise(v.cast("float").cast("double"))
        d = read_geotiffs(self.spark, list(headers), window).where("band = 0").join(F.broadcast(table), "path")  # one row a file
        d = d.select("n", "var", "time", (F.col("yi") + F.col("dy")).alias("yi"), (F.col("xi") + F.col("dx")).alias("xi"), value.alias("value"))
        keep = F.col("yi").between(0, grid.ny - 1) & F.col("xi").between(0, grid.nx - 1) & F.col("value").isNotNull()
        for n, over in later.items():
            for w in over:
                keep &= ~((F.col("n") == n) & _inside(list(w)))
        path = self._data(config, group, d.where(keep).drop("n"))
        return self._commit(config, group, grid, f"populate {group}", {var: {y: [[path, w] for w in ws] for y, ws in years.items()} for var, years in layers.items()})

    def populate_all(self, config: DatasetConfig, **how) -> dict[str, int]:
        return {g: self.populate(config, g, **how) for g in config.groups}

    def write(self, config: DatasetConfig, group: str, rasters: Mapping[str, Raster], message: str = "write") -> int:
        """A new version with rasters by variable, all on one grid, in place of those variables' years."""
        known, out, grid = config.variables(group), None, None
        for name, r in rasters.items():
            if name not in known:
                raise ValueError(f"no variable {name} in group {group}")
            one = r.select()
            time = F.col("time") if one.has_time else F.lit(None)
            p = one.pixels.select(F.lit(name).alias("var"), time.cast("timestamp").alias("time"), "yi", "xi", F.col(one.variables[0]).cast("double").alias("value"))
            out, grid = p if out is None else out.unionByName(p), grid or one.grid
            if one.grid != grid:
                raise ValueError("rasters of one commit stand on one grid")
        if out is None:
            raise ValueError("nothing to write")
        path = self._data(config, group, out.where(F.col("value").isNotNull()))
        whole: Window = [0, grid.nx - 1, 0, grid.ny - 1]
        years = out.groupBy("var", F.year("time").alias("year")).count().collect()  # a row a year
        layers: dict[str, dict[str, list]] = {}
        for r in years:
            layers.setdefault(r["var"], {})["" if r["year"] is None else str(r["year"])] = [[path, whole]]
        return self._commit(config, group, grid, message, layers)

    def read(self, config: DatasetConfig, group: str, var: str, version: int | None = None, fill: float | None = None) -> Raster:
        """A variable of a group at its latest version, or an earlier one; the column carries its attributes. With fill, a row for every cell, fill where there is none."""
        state = self._state(config, group, version)
        if not state:
            raise ValueError(f"group {group} was never written")
        grid, own = state["grid"], config.variables(group).get(var)
        if own is None:
            raise ValueError(f"no variable {var} in group {group}")
        # by path: the years that it holds, each less what later layers cover
        shown: dict[str, Column] = {}
        for year, held in state["layers"].get(var, {}).items():
            for path, k in {p: k for k, (p, _) in enumerate(held)}.items():
                on = F.col("year").isNull() if year == "" else F.col("year") == int(year)
                for p, w in held[k + 1 :]:
                    if p != path:
                        on &= ~_inside(w)
                shown[path] = shown[path] | on if path in shown else on
        schema = "time timestamp, yi int, xi int, value double, var string, year int"
        p = self.spark.createDataFrame([], schema)
        for k, (path, on) in enumerate(shown.items()):
            part = self.spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(path).where(F.col("var") == var).where(on)
            p = part if k == 0 else p.unionByName(part)
        keys = ["time"] * bool(config.time(group)) + ["yi", "xi"]
        kind = kind_of(own.get("unit_type"))
        about = state["attributes"].get(var, {})
        legends = {var: legend} if (legend := config.legend(group, var)) else {}
        r = Raster(p.select(*keys, F.col("value").cast(kind).alias(var, metadata=about)), grid, legends)
        if fill is None:
            return r
        times = None
        if config.time(group):
            when = config.time(group)
            times = time_axis(self.spark, when.get("start"), when.get("end"), when.get("freq"))
        full = r.dense(times).select(*keys, F.coalesce(F.col(var), F.lit(fill).cast(kind)).alias(var, metadata=about))
        return Raster(full, grid, legends)

    def attributes(self, config: DatasetConfig, group: str, version: int | None = None) -> DataFrame:
        """(name, attribute, value) as they are stored with a version, values as text."""
        state = self._state(config, group, version)
        text = lambda v: " ".join(map(str, v)) if isinstance(v, list) else str(v)
        rows = [(n, k, text(v)) for n, own in (state or {"attributes": {}})["attributes"].items() for k, v in own.items()]
        return self.spark.createDataFrame(rows, "name string, attribute string, value string")


def _tuples(grid: Mapping[str, Any]) -> dict[str, Any]:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in grid.items()}
