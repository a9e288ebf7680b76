"""Positions on the ellipsoid and the sphere, velocities and strain; as column expressions and in NumPy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and UTM.
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres to earth-centred metres."""
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (1 - E2) + alt) * F.sin(p)


def lla(x: Column, y: Column, z: Column, rounds: int = 5) -> tuple[Column, Column, Column]:
    """Earth-centred metres to degrees and metres, by fixed-point iteration on the latitude."""
    r = F.sqrt(x * x + y * y)
    p = F.atan2(z, r * (1 - E2))
    for _ in range(rounds):
        n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
        p = F.atan2(z + n * E2 * F.sin(p), r)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return F.degrees(p), F.degrees(F.atan2(y, x)), r * F.cos(p) + z * F.sin(p) - A * A / n


def enu(dx: Column, dy: Column, dz: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred differences to east, north, up at a position."""
    p, q = F.radians(lat), F.radians(lon)
    e = -F.sin(q) * dx + F.cos(q) * dy
    n = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    u = F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz
    return e, n, u


def enu_rotation(lat: float, lon: float) -> np.ndarray:
    p, q = math.radians(lat), math.radians(lon)
    return np.array([[-math.sin(q), math.cos(q), 0], [-math.sin(p) * math.cos(q), -math.sin(p) * math.sin(q), math.cos(p)], [math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)]])


def utm_zone(lon: float) -> int:
    return int((lon + 180) // 6) % 60 + 1


def utm(lat: np.ndarray, lon: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in metres by the Krüger series in the third flattening, to its fourth order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    p, d = np.radians(lat), np.radians(lon - (6 * zone - 183))
    ecc = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(p)) - ecc * np.arctanh(ecc * np.sin(p)))
    xi, eta = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.sqrt(1 + t * t))
    east, north = eta.copy(), xi.copy()
    for k, c in enumerate(series, 1):
        east += c * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        north += c * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
    return FALSE_EAST + K0 * radius * east, K0 * radius * north + np.where(np.asarray(lat) < 0, FALSE_NORTH, 0.0)


def strain_invariants(xx: Column, xy: Column, yy: Column, w: Column) -> tuple[Column, Column, Column, Column]:
    """(dilatation, strain, shear, rotation) of a plane strain-rate tensor and the rotation-rate entry w."""
    tr = xx + yy
    square = xx * xx + 2 * xy * xy + yy * yy
    return tr, F.sqrt(square), F.sqrt(F.greatest(square / 2 - tr * tr / 6, F.lit(0.0))), F.abs(w)


def euler_pole(rotation: np.ndarray, cov: np.ndarray | None = None, principal: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Rotation vector [rad/time] to pole (longitude, latitude in rad, rate), with covariance. `principal` takes the
    longitude from arctan of the quotient, as some published values do."""
    x, y, z = rotation
    h2 = x * x + y * y
    h, r2 = math.sqrt(h2), h2 + z * z
    pole = np.array([math.atan(y / x) if principal else math.atan2(y, x), math.atan2(z, h), math.sqrt(r2)])
    if cov is None:
        return pole, None
    j = np.array([[-y / h2, x / h2, 0], [-x * z / (h * r2), -y * z / (h * r2), h / r2], rotation / math.sqrt(r2)])
    return pole, j @ cov @ j.T


def rotation_vector(pole: np.ndarray) -> np.ndarray:
    lon, lat, rate = pole
    return rate * np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
