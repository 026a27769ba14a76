"""Clipping to boxes and polygons, and the share of each cell that a geometry covers.

A box becomes integer ranges of yi and xi on the driver, so the filter reaches the Parquet scan. A polygon becomes runs of
cells, one row of (yi, xi_lo, xi_hi) for each stretch of a grid row that it covers, made on executors from a broadcast list of
edges; pixels meet them by an equi-join on yi, so no pair of a pixel and a polygon is ever formed.
"""

from __future__ import annotations

import math
import numbers
import warnings
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polygons as P
from ..functions.projection import normal_crs, transform
from ..grid import Grid, Raster, maybe_broadcast
from ..session import ready
from .area import cell_area
from .geometry import GeometryData, process_geometry

#: Slack in cells for bounds that lie on a cell bound but for rounding.
SLACK = 1e-9


def cell_range(edges: np.ndarray, lo: float, hi: float) -> tuple[int, int]:
    """First and last cell that overlap [lo, hi] with their interiors; a bound on a cell bound takes in no further cell. Empty: (n, -1) or the like."""
    ascending = edges if edges[-1] > edges[0] else edges[::-1]
    n = len(ascending) - 1
    slack = SLACK * abs(ascending[1] - ascending[0])
    first = int(np.searchsorted(ascending, lo + slack, side="right")) - 1
    last = int(np.searchsorted(ascending, hi - slack, side="left")) - 1
    if last < first and lo <= hi:
        last = first
    if hi < ascending[0] - slack or lo > ascending[-1] + slack:
        return n, -1
    first, last = max(first, 0), min(last, n - 1)
    return (first, last) if ascending is edges else (n - 1 - last, n - 1 - first)


def check_bbox(bbox: Any) -> tuple[float, float, float, float]:
    if not isinstance(bbox, tuple) or len(bbox) != 4 or not all(isinstance(v, numbers.Real) and not isinstance(v, (np.floating, np.integer)) or isinstance(v, np.float64) for v in bbox):
        raise ValueError("a bounding box is a tuple of four numbers: minx, miny, maxx, maxy")
    if any(math.isnan(v) for v in bbox):
        raise ValueError("a bounding box has no NaN")
    return tuple(float(v) for v in bbox)


def bbox_window(grid: Grid, bbox: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """xi and yi ranges of every cell that overlaps the box."""
    minx, miny, maxx, maxy = check_bbox(bbox)
    x, y = cell_range(grid.edges("x"), minx, maxx), cell_range(grid.edges("y"), miny, maxy)
    if x[0] > x[1] or y[0] > y[1]:
        raise ValueError(f"no cell of the raster lies in {bbox}")
    return *x, *y


def window_filter(raster: Raster, x_lo: int, x_hi: int, y_lo: int, y_hi: int) -> Raster:
    """The raster of these cells, numbered from 0."""
    p = raster.pixels.where(F.col("yi").between(y_lo, y_hi) & F.col("xi").between(x_lo, x_hi))
    return replace(raster, pixels=p.withColumns({"yi": F.col("yi") - F.lit(y_lo), "xi": F.col("xi") - F.lit(x_lo)}), grid=raster.grid.window(x_lo, x_hi, y_lo, y_hi))


def clip_bbox(raster: Raster, bbox: tuple[float, float, float, float], first_time: bool = False) -> Raster:
    """Every cell that overlaps the box, in a grid of just those. first_time keeps the earliest time slice and drops time."""
    out = window_filter(raster, *bbox_window(raster.grid, bbox))
    return out.first_time() if first_time else out


def _geometry(raster: Raster, geometry: Any) -> GeometryData:
    """In the raster's reference system."""
    g = geometry if isinstance(geometry, GeometryData) else process_geometry(geometry, dissolve=True, spark=raster.pixels.sparkSession)
    own, target = normal_crs(g.geom_crs or "EPSG:4326"), normal_crs(raster.grid.crs)
    polygons = [q for p in g.polygons if (q := P.oriented([np.stack(transform(r[:, 0], r[:, 1], own, target), axis=1) for r in p]))]
    merged = P.union(polygons)
    return GeometryData([merged], target, P.bounds(merged), g.geom_area)


def _cells(edges_x: np.ndarray, lo: np.ndarray, hi: np.ndarray, centres: np.ndarray | None) -> list[tuple[int, int]]:
    """Cell ranges of x stretches: of the centres in [lo, hi), or (centres None) of all cells that they meet."""
    ascending = edges_x[-1] > edges_x[0]
    n = len(edges_x) - 1
    if centres is not None:
        c = centres if ascending else centres[::-1]
        a, z = np.searchsorted(c, lo, side="left"), np.searchsorted(c, hi, side="left") - 1
    else:
        e = edges_x if ascending else edges_x[::-1]
        a, z = np.searchsorted(e, lo, side="right") - 1, np.searchsorted(e, hi, side="left") - 1
        z = np.maximum(a, z)
    keep = (z >= a) & (z >= 0) & (a < n)
    a, z = np.maximum(a[keep], 0), np.minimum(z[keep], n - 1)
    return sorted(zip(*((a, z) if ascending else (n - 1 - z, n - 1 - a)), strict=True))


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(int(a), int(z)) for a, z in out]


def geometry_runs(raster: Raster, geometry: GeometryData, all_touched: bool = False) -> DataFrame:
    """(yi, xi_lo, xi_hi): stretches of cells whose centres are inside, or with all_touched of cells that the geometry meets. Stretches of a row are disjoint. A centre on an edge counts as inside on the low side only."""
    grid, spark = raster.grid, ready(raster.pixels.sparkSession)
    ex, ey, cx, cy = grid.edges("x"), grid.edges("y"), grid.centres("x"), grid.centres("y")
    e = P.edges(geometry.polygons)
    by_row = P.EdgeIndex(e)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for yi in pdf["id"]:
                y_lo, y_hi = sorted((ey[yi], ey[yi + 1]))
                near = by_row.between(y_lo, y_hi)
                _, lo, hi = P.scan_runs(near, np.array([cy[yi]]))
                if not all_touched:
                    found = _cells(ex, lo, hi, cx)
                else:
                    # the interior along the middle of the row, and every edge within the row
                    inner = near[(np.maximum(near[:, 1], near[:, 3]) > y_lo) & (np.minimum(near[:, 1], near[:, 3]) < y_hi)]
                    dy = inner[:, 3] - inner[:, 1]
                    flat = dy == 0
                    t = np.clip((np.array([[y_lo], [y_hi]]) - inner[:, 1]) / np.where(flat, 1, dy), 0, 1)
                    x = np.where(flat, np.stack([inner[:, 0], inner[:, 2]]), inner[:, 0] + t * (inner[:, 2] - inner[:, 0]))
                    found = _merge(_cells(ex, np.concatenate([lo, x.min(0)]), np.concatenate([hi, x.max(0)]), None))
                out += [(yi, a, z) for a, z in _merge(found)]
            yield pd.DataFrame(out, columns=["yi", "xi_lo", "xi_hi"]).astype("int32")

    _, miny, _, maxy = geometry.geom_bbox
    y_lo, y_hi = cell_range(ey, miny, maxy)
    return spark.range(y_lo, max(y_hi + 1, y_lo)).mapInPandas(rows, "yi int, xi_lo int, xi_hi int")


def clip_geometry(raster: Raster, geometry: Any, all_touched: bool = False) -> Raster:
    """The cells of the geometry's bounding box, with NULL outside the geometry. The geometry is brought to the raster's reference system first."""
    g = _geometry(raster, geometry)
    boxed = clip_bbox(raster, g.geom_bbox)
    runs = geometry_runs(boxed, g, all_touched)
    in_run = F.col("xi").between(F.col("xi_lo"), F.col("xi_hi"))
    # stretches of a row don't overlap, so a pixel meets one at most
    p = boxed.pixels.join(maybe_broadcast(runs, boxed.grid.ny), (boxed.pixels.yi == runs.yi) & in_run, "left").drop(runs.yi)
    p = p.withColumns({v: F.when(F.col("xi_lo").isNotNull(), F.col(v)) for v in raster.variables}).drop("xi_lo", "xi_hi")
    return replace(boxed, pixels=p)


def proportion_mask(raster: Raster, geometry: Any, pixel_ratio: float = 0.001, overwrite: bool = False) -> DataFrame:
    """(yi, xi, proportion) of every cell of the grid: the share of its area, 0 to 1, that the geometry covers.

    Where a cell is less than pixel_ratio of the geometry's area and overwrite isn't set, weighting isn't worth its cost: a warning, and 1 or 0 by the cell's centre."""
    grid, spark = raster.grid, raster.pixels.sparkSession
    g = _geometry(raster, geometry)
    ex, ey = grid.edges("x"), grid.edges("y")
    x_lo, x_hi = cell_range(ex, g.geom_bbox[0], g.geom_bbox[2])
    y_lo, y_hi = cell_range(ey, g.geom_bbox[1], g.geom_bbox[3])
    # on the driver: the area of one row of the grid
    middle = min(max((y_lo + y_hi) // 2, 0), grid.ny - 1)
    cell = cell_area(raster).where(F.col("yi") == middle).agg(F.avg("area")).first()[0]
    area = process_geometry([{"type": "MultiPolygon", "coordinates": [[[*map(list, r), list(r[0])] for r in p] for p in g.polygons]}]).geom_area if g.geom_area is None else g.geom_area
    cells = spark.range(grid.nx * grid.ny).select(F.floor(F.col("id") / grid.nx).cast("int").alias("yi"), (F.col("id") % grid.nx).cast("int").alias("xi"))
    if x_lo > x_hi or y_lo > y_hi:
        return cells.withColumn("proportion", F.lit(0.0))
    if cell / area < pixel_ratio and not overwrite:
        warnings.warn(f"a cell is {cell / area:.2g} of the geometry, under {pixel_ratio}: the mask is binary", stacklevel=2)
        runs = geometry_runs(raster, g).withColumn("proportion", F.lit(1.0))
    else:
        runs = _coverage(raster, g, x_lo, x_hi, y_lo, y_hi)
    met = cells.join(maybe_broadcast(runs, grid.ny), (cells.yi == runs.yi) & cells.xi.between(F.col("xi_lo"), F.col("xi_hi")), "left")
    return met.select(cells.yi, cells.xi, F.coalesce("proportion", F.lit(0.0)).alias("proportion"))


def _coverage(raster: Raster, g: GeometryData, x_lo: int, x_hi: int, y_lo: int, y_hi: int) -> DataFrame:
    """(yi, xi_lo, xi_hi, proportion): stretches of cells of equal share, those of share 0 left out. Cells that are wholly inside make one stretch."""
    ex, ey, by_row = raster.grid.edges("x"), raster.grid.edges("y"), P.EdgeIndex(P.edges(g.polygons))
    x = ex[x_lo : x_hi + 2]
    up = x[-1] > x[0]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for yi in pdf["id"]:
                a, z = sorted((ey[yi], ey[yi + 1]))
                share = P.row_coverage(by_row.between(a, z), a, z, x if up else x[::-1])[:: 1 if up else -1] / (np.abs(np.diff(x)) * (z - a))
                share = np.minimum(np.where(share > 1 - 1e-12, 1.0, np.where(share < 1e-12, 0.0, share)), 1.0)
                cut = np.flatnonzero(np.diff(share, prepend=np.nan) != 0)
                for i, j in zip(cut, np.append(cut[1:], len(share)), strict=True):
                    if share[i]:
                        out.append((yi, x_lo + i, x_lo + j - 1, share[i]))
            yield pd.DataFrame(out, columns=["yi", "xi_lo", "xi_hi", "proportion"]).astype({"yi": "int32", "xi_lo": "int32", "xi_hi": "int32", "proportion": "float64"})

    return ready(raster.pixels.sparkSession).range(y_lo, y_hi + 1).mapInPandas(rows, "yi int, xi_lo int, xi_hi int, proportion double")
