"""Coordinates on the WGS84 ellipsoid: the equal-area cylindrical projection EPSG:6933, web Mercator, and degrees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
INVERSE_F = 298.257223563
FLAT = 1 / INVERSE_F
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)
B = A * (1 - FLAT)
_SIN30 = 0.5
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * _SIN30**2)


class UnsupportedCRS(ValueError):
    """A pair of reference systems without a closed form here."""


def normal_crs(crs: str) -> str:
    """EPSG codes as EPSG:n; the URN of plain longitude and latitude counts as EPSG:4326."""
    text = str(crs).strip().upper()
    if text.endswith("CRS84"):
        return "EPSG:4326"
    code = text.replace("URN:OGC:DEF:CRS:", "").replace("::", ":").split(":")[-1]
    return f"EPSG:{code}"


def x_6933(lon: Column) -> Column:
    return F.lit(A * K0) * F.radians(lon)


def y_6933(lat: Column) -> Column:
    """In the order of operations of the SQL of the queries: any other is off in the last place, which shows in the third digit of a row's square metres."""
    s = F.sin(F.radians(lat))
    es = F.lit(E1) * s
    return F.lit(A / (2 * K0) * (1 - E2)) * (s / (1 - F.lit(E2) * s * s) - F.log((1 - es) / (1 + es)) / F.lit(2 * E1))


def forward(x: np.ndarray, y: np.ndarray, crs: str) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to crs."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:6933":
        s = np.sin(np.radians(y))
        es = E1 * s
        return A * K0 * np.radians(x), A / (2 * K0) * (1 - E2) * (s / (1 - es * es) - np.log((1 - es) / (1 + es)) / (2 * E1))
    if crs == "EPSG:3857":
        return A * np.radians(x), A * np.log(np.tan(np.pi / 4 + np.radians(np.clip(y, -89.9999, 89.9999)) / 2))
    raise UnsupportedCRS(f"no projection to {crs}")


def inverse(x: np.ndarray, y: np.ndarray, crs: str) -> tuple[np.ndarray, np.ndarray]:
    """crs to degrees; the equal-area latitude by Newton steps."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        return np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - np.pi / 2)
    if crs == "EPSG:6933":
        pole = forward(np.zeros(1), np.full(1, 90.0), crs)[1][0]
        q = 2 * K0 * y / A
        phi = np.arcsin(np.clip(y / pole, -1, 1))
        for _ in range(12):
            s, c = np.sin(phi), np.cos(phi)
            es = E1 * s
            own = (1 - E2) * (s / (1 - es * es) - np.log((1 - es) / (1 + es)) / (2 * E1))
            step = np.where(c > 1e-12, (1 - es * es) ** 2 / np.maximum(2 * c * (1 - E2), 1e-300) * (q - own), 0)
            phi = phi + step
        return np.degrees(x / (A * K0)), np.degrees(phi)
    raise UnsupportedCRS(f"no projection from {crs}")


def transform(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    source, target = normal_crs(source), normal_crs(target)
    if source == target:
        return np.asarray(x, float), np.asarray(y, float)
    return forward(*inverse(x, y, source), target)
