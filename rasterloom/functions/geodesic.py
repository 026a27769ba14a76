"""Distances on the WGS84 ellipsoid, vectorised: Vincenty's inverse formula, and the meridian arc as a series."""

from __future__ import annotations

import numpy as np

from .projection import FLAT, A, B


def distance(lat1, lon1, lat2, lon2, passes: int = 100) -> np.ndarray:
    """Metres between points in degrees. Nearly antipodal points, where the iteration needn't converge, give NaN."""
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (lat1, lon1, lat2, lon2)))
    u1, u2 = np.arctan((1 - FLAT) * np.tan(np.radians(lat1))), np.arctan((1 - FLAT) * np.tan(np.radians(lat2)))
    span = np.radians(lon2 - lon1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, done = span.copy(), np.zeros(span.shape, bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(passes):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((cu2 * sl) ** 2 + (cu1 * su2 - su1 * cu2 * cl) ** 2)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, cu1 * cu2 * sl / np.where(ss == 0, 1, ss))
            c2 = 1 - sa**2
            cm = np.where(c2 == 0, 0, cs - 2 * su1 * su2 / np.where(c2 == 0, 1, c2))
            k = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
            new = span + (1 - k) * FLAT * sa * (sigma + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
            done = np.abs(new - lam) < 1e-13
            lam = new
            if done.all():
                break
        uu = c2 * (A**2 - B**2) / B**2
        big = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        small = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        ds = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = B * big * (sigma - ds)
    return np.where(done | (ss == 0), out, np.nan)


def meridian(lat1, lat2) -> np.ndarray:
    """Metres along a meridian between two latitudes."""
    n = FLAT / (2 - FLAT)

    def arc(lat: np.ndarray) -> np.ndarray:
        p = np.radians(np.asarray(lat, float))
        c = (1 + n**2 / 4 + n**4 / 64, -3 / 2 * (n - n**3 / 8), 15 / 16 * (n**2 - n**4 / 4), -35 / 48 * n**3, 315 / 512 * n**4)
        return A / (1 + n) * (c[0] * p + c[1] * np.sin(2 * p) + c[2] * np.sin(4 * p) + c[3] * np.sin(6 * p) + c[4] * np.sin(8 * p))

    return np.abs(arc(lat2) - arc(lat1))
