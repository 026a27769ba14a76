"""Bringing one raster to the grid of another.

Resampling is separable: for each axis, a small table says which source cells a target cell takes, and with what weight. Pixels
meet those two tables by broadcast joins on integers, so nearest needs no shuffle at all and every other method one
aggregation. There is no range join and no mesh of coordinates.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import normal_crs, transform
from ..grid import Grid, Raster, maybe_broadcast, small_table
from .area import cell_area
from .clip import bbox_window, window_filter

KERNELS = {"bilinear": 1.0, "cubic": 2.0, "cubic_spline": 2.0, "lanczos": 3.0, "gauss": 1.5}
OVERLAPS = ("average", "mode", "max", "min", "med", "q1", "q3", "sum", "rms")
METHODS = ("nearest", *KERNELS, *OVERLAPS)


def _kernel(method: str, x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    if method == "bilinear":
        return np.maximum(0, 1 - a)
    if method == "cubic":  # a = -1/2
        return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0))
    if method == "cubic_spline":
        return np.where(a <= 1, (4 - 6 * a**2 + 3 * a**3) / 6, np.where(a < 2, (2 - a) ** 3 / 6, 0))
    if method == "gauss":  # half a cell wide, cut at three times that
        return np.where(a <= 1.5, np.exp(-2 * a**2), 0)
    return np.where(a < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _to_source(template: Grid, source: Grid, axis: str, values: np.ndarray) -> np.ndarray:
    """Template coordinates in the source's reference system; the systems here are separable in x and y."""
    if normal_crs(template.crs) == normal_crs(source.crs):
        return values
    zero = np.zeros(len(values))
    x, y = (values, zero) if axis == "x" else (zero, values)
    return transform(x, y, template.crs, source.crs)[0 if axis == "x" else 1]


def axis_weights(template: Grid, source: Grid, axis: str, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template cell, source cell and weight along one axis; cells without a source have no row."""
    edges = source.edges(axis)
    up = edges[-1] > edges[0]
    edges = edges if up else edges[::-1]
    n = len(edges) - 1
    flip = lambda k: k if up else n - 1 - k
    if method in OVERLAPS:
        own = _to_source(template, source, axis, template.edges(axis))
        lo, hi = np.minimum(own[:-1], own[1:]), np.maximum(own[:-1], own[1:])
        slack = 1e-9 * (edges[1] - edges[0])
        a, z = np.searchsorted(edges, lo + slack, side="right") - 1, np.searchsorted(edges, hi - slack, side="left") - 1
        a, z = np.maximum(a, 0), np.minimum(z, n - 1)
        size = np.maximum(0, z - a + 1)
        t = np.repeat(np.arange(len(lo)), size)
        s = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        weight = (np.minimum(hi[t], edges[s + 1]) - np.maximum(lo[t], edges[s])) / (edges[s + 1] - edges[s])
        return t, flip(s), weight
    at = _to_source(template, source, axis, template.centres(axis))
    s = np.searchsorted(edges, at + 1e-9 * (edges[1] - edges[0]), side="right") - 1
    inside = (s >= 0) & (s < n)
    if method == "nearest":
        t = np.flatnonzero(inside)
        return t, flip(s[inside]), np.ones(len(t))
    centres = (edges[1:] + edges[:-1]) / 2
    step = np.abs(np.diff(at)).mean() / np.diff(edges).mean() if len(at) > 1 else 1.0
    scale = max(1.0, step)  # a coarser target widens the kernel, so that no source cell is skipped
    reach = int(np.ceil(KERNELS[method] * scale)) + 1
    t = np.repeat(np.flatnonzero(inside), 2 * reach + 1)
    k = s[t] + np.tile(np.arange(-reach, reach + 1), int(inside.sum()))
    ok = (k >= 0) & (k < n)
    t, k = t[ok], k[ok]
    weight = _kernel(method, (centres[k] - at[t]) / (np.diff(edges)[k] * scale))
    keep = np.abs(weight) > 1e-12
    return t[keep], flip(k[keep]), weight[keep]


def _aggregate(method: str, v: Column, w: Column) -> Column:
    some = F.when(v.isNotNull(), w)
    if method == "sum":
        return F.sum(v * w)
    if method in ("max", "min"):
        return getattr(F, method)(v)
    if method in ("med", "q1", "q3"):
        return F.percentile(v, F.lit({"med": 0.5, "q1": 0.25, "q3": 0.75}[method]))
    if method == "rms":
        return F.sqrt(F.sum(v * v * w) / F.sum(some))
    return F.sum(v * w) / F.sum(some)


def resample(source: Raster, template: Grid, method: str = "nearest") -> Raster:
    """source on the grid of template. nearest takes the cell that holds the template cell's centre; the kernels weigh centres around it; the others are over all source cells that overlap, average, sum and rms by overlap, mode by overlapped area with ties to the least value, max, min and quantiles unweighted. NULL is left out of every weight; cells outside the source have no row."""
    if method not in METHODS:
        raise ValueError(f"unknown resampling {method}; there are {METHODS}")
    spark, p = source.pixels.sparkSession, source.pixels
    for axis, key, n in (("y", "yi", template.ny), ("x", "xi", template.nx)):
        t, s, w = axis_weights(template, source.grid, axis, method)
        m = small_table(spark, {f"s_{key}": s.astype(np.int32), f"t_{key}": t.astype(np.int32), f"w_{key}": w})
        p = p.join(maybe_broadcast(m, len(t)), p[key] == m[f"s_{key}"])
    keys = [k for k in source.keys if k == "time"]
    place = [F.col("t_yi").alias("yi"), F.col("t_xi").alias("xi")]
    if method == "nearest":
        p = p.select(*keys, *place, *source.variables)
    else:
        w = F.col("w_yi") * F.col("w_xi")
        if method == "mode":
            out = None
            for v in source.variables:
                each = p.where(F.col(v).isNotNull()).groupBy(*keys, *place, v).agg(F.round(F.sum(w), 9).alias("w"))
                one = each.groupBy(*keys, "yi", "xi").agg(F.max(F.struct("w", (-F.col(v)).alias("v"))).alias("best")).select(*keys, "yi", "xi", (-F.col("best.v")).alias(v))
                out = one if out is None else out.join(one, [*keys, "yi", "xi"], "full")
            p = out
        else:
            p = p.groupBy(*keys, *place).agg(*[_aggregate(method, F.col(v).cast("double"), w).alias(v) for v in source.variables])
    return replace(source, pixels=p, grid=template)


def align(template: Raster, target: Raster, method: str = "nearest", area: bool = True, hectares: bool = True, first_time: bool = False) -> tuple[Raster, DataFrame | None]:
    """target on template's grid, and the cell areas of that grid (None without area). target is cut to template's bounds before anything is resampled; each of its times is aligned, or only the earliest."""
    t = target
    if normal_crs(template.grid.crs) == normal_crs(target.grid.crs):
        x_lo, x_hi, y_lo, y_hi = bbox_window(target.grid, template.grid.bounds)
        # the kernels look beyond the bounds by some cells
        pad = 0 if method == "nearest" or method in OVERLAPS else 8
        t = window_filter(target, max(0, x_lo - pad), min(target.grid.nx - 1, x_hi + pad), max(0, y_lo - pad), min(target.grid.ny - 1, y_hi + pad))
    if first_time:
        t = t.first_time()
    out = resample(t, template.grid, method)
    return out, cell_area(out, hectares=hectares) if area else None
