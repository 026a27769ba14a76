"""Geometries: reading, dissolving, areas and bounds, on the driver for one geometry and as columns for many."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons as P
from ..functions.projection import normal_crs, transform, x_6933, y_6933
from ..session import ready

HECTARE = 1e-4
#: Column type of a geometry: polygons of rings of points.
GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


@dataclass
class GeometryData:
    """geom: multipolygons, each a list of polygons; dissolved or not, bounds and area are those of their union."""

    geom: list[list[P.Polygon]] | None = None
    geom_crs: str | None = None
    geom_bbox: tuple[float, float, float, float] | None = None
    geom_area: float | None = None

    @property
    def polygons(self) -> list[P.Polygon]:
        return [p for g in self.geom or [] for p in g]


def _wkt(text: str) -> list[P.Polygon]:
    kind, _, rest = text.strip().partition("(")
    kind = kind.strip().upper().removesuffix(" Z").strip()
    body = "(" + rest
    numbers = lambda ring: [[float(v) for v in p.split()[:2]] for p in ring.split(",")]
    rings = lambda s: [np.array(numbers(r.strip(" ()"))) for r in s.split("),")]
    if kind == "POLYGON":
        return [rings(body)]
    if kind == "MULTIPOLYGON":
        return [rings(p) for p in body.strip()[1:-1].split(")),")]
    raise ValueError(f"no polygon: {text[:40]}")


def as_polygons(value: Any) -> list[P.Polygon]:
    """Polygons of a GeoJSON mapping, of WKT, of an object with __geo_interface__, or of nested coordinates."""
    if hasattr(value, "__geo_interface__"):
        value = value.__geo_interface__
    if isinstance(value, str):
        return _wkt(value)
    if isinstance(value, Mapping):
        kind = value.get("type")
        if kind == "Feature":
            return as_polygons(value["geometry"])
        if kind == "FeatureCollection":
            return [p for f in value["features"] for p in as_polygons(f)]
        if kind == "GeometryCollection":
            return [p for f in value["geometries"] for p in as_polygons(f)]
        if kind == "Polygon":
            return [[np.asarray(r, float)[:, :2] for r in value["coordinates"]]]
        if kind == "MultiPolygon":
            return [[np.asarray(r, float)[:, :2] for r in p] for p in value["coordinates"]]
    raise ValueError(f"no polygon geometry: {type(value).__name__}")


def box(minx: float, miny: float, maxx: float, maxy: float) -> dict:
    return {"type": "Polygon", "coordinates": [[[minx, miny], [maxx, miny], [maxx, maxy], [minx, maxy], [minx, miny]]]}


def read_geojson(path: str, spark=None) -> dict:
    """A GeoJSON document; with a session by Spark's reader, so from any store that it reaches."""
    if spark is not None:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def geojson_crs(document: Mapping) -> str:
    crs = document.get("crs")
    name = (crs.get("properties") or {}).get("name") if isinstance(crs, Mapping) else None
    if not name:
        raise ValueError("the GeoJSON document names no reference system")
    return name


def first_feature_bbox(document: Mapping, crs: str = "EPSG:4326") -> tuple[float, float, float, float]:
    """Bounds of the first feature, in crs. A document without a reference system is in EPSG:4326."""
    try:
        own = geojson_crs(document)
    except ValueError:
        own = "EPSG:4326"
    polygons = [[np.stack(transform(r[:, 0], r[:, 1], own, crs), axis=1) for r in p] for p in as_polygons(document["features"][0])]
    return P.bounds(polygons)


def projected_area(polygons: list[P.Polygon], crs: str, hectares: bool = True) -> float:
    """Area in EPSG:6933 of the union; vertices are projected, edges between them stay straight."""
    moved = [[np.stack(transform(r[:, 0], r[:, 1], crs, "EPSG:6933"), axis=1) for r in p] for p in polygons]
    return P.area(P.union(moved)) * (HECTARE if hectares else 1.0)


def process_geometry(source: Any, dissolve: bool = True, hectares: bool = True, spark=None) -> GeometryData:
    """From a GeoJSON path, a geometry or a list of geometries (both in EPSG:4326). dissolve: one geometry, the union; else the list as it is. Area and bounds are always those of the union."""
    if isinstance(source, GeometryData):
        return source
    crs = "EPSG:4326"
    if isinstance(source, str) and not source.strip().upper().startswith(("POLYGON", "MULTIPOLYGON")):
        document = read_geojson(source, spark)
        crs = geojson_crs(document)
        source = document.get("features", [])
    elif isinstance(source, (Mapping, str)) or hasattr(source, "__geo_interface__"):
        source = [source]
    if not isinstance(source, Sequence) or not source:
        raise ValueError("a geometry source is a path, a geometry or a list of geometries that isn't empty")
    geoms = [[q for p in as_polygons(g) if (q := P.oriented(p))] for g in source]
    flat = [p for g in geoms for p in g]
    if not flat:
        raise ValueError("no polygon with an area")
    merged = P.union(flat)
    return GeometryData([merged] if dissolve else geoms, normal_crs(crs), P.bounds(flat), projected_area(flat, crs, hectares))


# --- columns -------------------------------------------------------------------------------------------------------


def _ring_shoelace(ring: Column, x, y) -> Column:
    """Absolute area of a ring column, closed or not; x and y map a point to its coordinates."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, after, lambda p, q: x(p) * y(q) - x(q) * y(p))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def geometry_area(geom: Column | str, hectares: bool = True) -> Column:
    """Area in EPSG:6933 of a geometry column in degrees whose polygons don't overlap: shells less holes."""
    geom = F.col(geom) if isinstance(geom, str) else geom
    x, y = (lambda p: x_6933(p["x"])), (lambda p: y_6933(p["y"]))
    areas = F.transform(geom, lambda poly: F.aggregate(F.transform(poly, lambda r, k: F.when(k == 0, 1.0).otherwise(-1.0) * _ring_shoelace(r, x, y)), F.lit(0.0), lambda a, t: a + t))
    return F.aggregate(areas, F.lit(0.0), lambda a, t: a + t) * F.lit(HECTARE if hectares else 1.0)


def geometry_bounds(geom: Column | str) -> dict[str, Column]:
    points = F.flatten(F.flatten(geom))
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return {"minx": of(F.array_min, "x"), "miny": of(F.array_min, "y"), "maxx": of(F.array_max, "x"), "maxy": of(F.array_max, "y")}


def box_column(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy), point(minx, miny))))


def to_polygons(value) -> list[P.Polygon]:
    """Polygons of a geometry column's value."""
    return [[np.array([(p["x"], p["y"]) for p in ring]) for ring in poly] for poly in value]


def dissolve_zones(zones: DataFrame, by: list[str], hectares: bool = True) -> DataFrame:
    """by, geom, area and bounds of the union of each group's geometries (degrees). One group's geometries meet in one task, as their union is one value."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flat = [q for g in pdf["geom"] for p in to_polygons(g) if (q := P.oriented(p))]
        if not flat:
            return pd.DataFrame()
        out = [[[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in p] for p in P.union(flat)]
        return pd.DataFrame([[*key, out, projected_area(flat, "EPSG:4326", hectares), *P.bounds(flat)]], columns=[*by, "geom", "area", "minx", "miny", "maxx", "maxy"])

    ready(zones.sparkSession)
    kinds = ", ".join(f"`{k}` {zones.schema[k].dataType.simpleString()}" for k in by)
    return zones.select(*by, "geom").groupBy(*by).applyInPandas(merge, f"{kinds}, geom {GEOMETRY}, area double, minx double, miny double, maxx double, maxy double")


def geojson_zones(spark, path: str) -> DataFrame:
    """(feature, crs, geom): polygons and multipolygons of one or more GeoJSON documents, parsed by Spark's JSON reader."""
    schema = "crs struct<properties:struct<name:string>>, features array<struct<geometry:struct<type:string,coordinates:string>>>"
    point = "array<double>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.col("crs.properties.name").alias("crs"), F.posexplode("features").alias("feature", "f"))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.array(F.transform(F.from_json("f.geometry.coordinates", f"array<array<{point}>>"), ring))
    many = F.transform(F.from_json("f.geometry.coordinates", f"array<array<array<{point}>>>"), lambda poly: F.transform(poly, ring))
    return d.select("feature", "crs", F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many).alias("geom"))
