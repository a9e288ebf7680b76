"""Velocity fields of a network: homogeneous strain and rotation, rotation poles, and strain at field points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geodesy import A, utm, utm_zone
from tidemark.solve.dense import pinvh

#: Stations up to which a field-point task may hold the whole network (64 bytes each).
NETWORK_ROWS = 200_000


def _sums(df: DataFrame, size: int, rows) -> np.ndarray:
    """Add up rows(pdf) -> vector of `size` over all partitions; only the vector comes back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = np.zeros(size)
        for pdf in frames:
            if len(pdf):
                v += rows(pdf)
        yield pd.DataFrame({"k": np.arange(size), "v": v})

    out = np.zeros(size)
    for r in df.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def _weights(pdf: pd.DataFrame) -> np.ndarray:
    """2 x 2 inverse covariances of (ve, vn); identity where variances are missing."""
    n = len(pdf)
    m = np.tile(np.eye(2), (n, 1, 1))
    if {"ve_var", "vn_var"} <= set(pdf.columns):
        m[:, 0, 0], m[:, 1, 1] = pdf["ve_var"], pdf["vn_var"]
        if "ve_vn_cov" in pdf.columns:
            m[:, 0, 1] = m[:, 1, 0] = pdf["ve_vn_cov"]
    return np.linalg.pinv(m, hermitian=True)


def _mapping(de: np.ndarray, dn: np.ndarray) -> np.ndarray:
    """n x 2 x 6: velocity at offsets from (ve, vn) and the gradient dve/de, dve/dn, dvn/de, dvn/dn."""
    g = np.zeros((len(de), 2, 6))
    g[:, 0, 0] = g[:, 1, 1] = 1
    g[:, 0, 2], g[:, 0, 3], g[:, 1, 4], g[:, 1, 5] = de, dn, de, dn
    return g


def homogeneous_field(velocities: DataFrame, origin: tuple[float, float] | None = None) -> dict:
    """velocity (2), gradient (2 x 2), strain (2 x 2), rotation (rate in the plane), covariance (6 x 6), origin and zone
    of one field through all stations (lon, lat, ve, vn, optional ve_var, vn_var, ve_vn_cov) by weighted least squares
    in UTM. At least six stations. Rows with NULL in position or velocity are left out."""
    v = velocities.dropna(subset=["lon", "lat", "ve", "vn"])
    c = v.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.degrees(F.atan2(F.sum(F.sin(F.radians("lon"))), F.sum(F.cos(F.radians("lon"))))).alias("lon")).first()
    if c["n"] < 6:
        raise ValueError(f"at least six stations, not {c['n']}")
    lon0, lat0 = origin or (c["lon"], c["lat"])
    zone = utm_zone(c["lon"])
    e0, n0 = utm(np.array([lat0]), np.array([lon0]), zone)

    def rows(pdf: pd.DataFrame) -> np.ndarray:
        e, n = utm(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), zone)
        g, w = _mapping((e - e0[0]) / 1e6, (n - n0[0]) / 1e6), _weights(pdf)
        y = pdf[["ve", "vn"]].to_numpy()
        gw = np.einsum("nap,nab->npb", g, w)
        return np.concatenate([np.einsum("npb,nbq->pq", gw, g).ravel(), np.einsum("npb,nb->p", gw, y)])

    s = _sums(v, 42, rows)
    q, b = s[:36].reshape(6, 6), s[36:]
    m = np.linalg.lstsq(q, b, rcond=None)[0]
    cov = pinvh(q)
    scale = np.array([1, 1, 1e-6, 1e-6, 1e-6, 1e-6])
    m, cov = m * scale, cov * np.outer(scale, scale)
    grad = m[2:].reshape(2, 2)
    return {"velocity": m[:2], "gradient": grad, "strain": (grad + grad.T) / 2, "rotation": (grad[1, 0] - grad[0, 1]) / 2, "covariance": cov, "origin": (lon0, lat0), "zone": zone}


def predict_homogeneous(stations: DataFrame, field: dict) -> DataFrame:
    """station, ve, vn: the homogeneous field (see homogeneous_field) at stations (station, lon, lat)."""
    e0, n0 = utm(np.array([field["origin"][1]]), np.array([field["origin"][0]]), field["zone"])
    gradient, velocity, zone = field["gradient"], field["velocity"], field["zone"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            e, n = utm(pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float), zone)
            v = np.column_stack([e - e0[0], n - n0[0]]) @ gradient.T + velocity
            yield pd.DataFrame({"station": pdf["station"], "ve": v[:, 0], "vn": v[:, 1]})

    return stations.select("station", "lat", "lon").dropna().mapInPandas(run, "station string, ve double, vn double")


def _rotated(lat: str, lon: str) -> tuple[list, list]:
    """East and north velocity at a position as sums over the components of the rotation vector, in metres."""
    p, q = F.radians(lat), F.radians(lon)
    east = [-F.sin(p) * F.cos(q), -F.sin(p) * F.sin(q), F.cos(p)]
    north = [F.sin(q), -F.cos(q), F.lit(0.0)]
    return [A * c for c in east], [A * c for c in north]


def predict_rotation(stations: DataFrame, rotation: np.ndarray) -> DataFrame:
    """station, ve, vn: velocities of a sphere of the equatorial radius that turns by the rotation vector."""
    east, north = _rotated("lat", "lon")
    along = lambda g: sum((c * float(w) for c, w in zip(g, rotation)), F.lit(0.0))
    return stations.select("station", "lat", "lon").dropna().select("station", along(east).alias("ve"), along(north).alias("vn"))


def estimate_euler_pole(velocities: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rotation vector in rad per time, covariance) of stations on a sphere of the equatorial radius, from ve and vn in
    metres per time; columns as in homogeneous_field. Nine sums in one aggregate."""
    v = velocities.dropna(subset=["lon", "lat", "ve", "vn"])
    a, b, c = F.lit(1.0), F.lit(0.0), F.lit(1.0)
    if {"ve_var", "vn_var"} <= set(v.columns):
        cov = F.col("ve_vn_cov") if "ve_vn_cov" in v.columns else F.lit(0.0)
        det = F.col("ve_var") * F.col("vn_var") - cov * cov
        a, b, c = F.col("vn_var") / det, -cov / det, F.col("ve_var") / det
        v = v.filter(det > 0)
    east, north = _rotated("lat", "lon")
    we, wn = [a * e + b * n for e, n in zip(east, north)], [b * e + c * n for e, n in zip(east, north)]
    sums = [F.sum(we[i] * east[j] + wn[i] * north[j]).alias(f"q{i}{j}") for i in range(3) for j in range(i, 3)]
    r = v.agg(*sums, *[F.sum(we[i] * F.col("ve") + wn[i] * F.col("vn")).alias(f"b{i}") for i in range(3)]).first()
    q = np.array([[r[f"q{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)], float)
    return np.linalg.solve(q, np.array([r[f"b{i}"] for i in range(3)], float)), pinvh(q)


def _hull(points: np.ndarray) -> np.ndarray:
    """Numbers of the corners of the convex hull, counter-clockwise (a monotone chain)."""
    order = np.lexsort((points[:, 1], points[:, 0]))

    def half(seq):
        out: list = []
        for k in seq:
            q = points[k]
            while len(out) > 1:
                (ax, ay), (bx, by) = points[out[-1]] - points[out[-2]], q - points[out[-2]]
                if ax * by - ay * bx > 0:
                    break
                out.pop()
            out.append(k)
        return out[:-1]

    return np.array(half(order) + half(order[::-1]))


def _cell_area(own: np.ndarray, others: np.ndarray, box: float) -> tuple[float, bool]:
    """Area of the Voronoi cell of `own` among `others` (nearest first), and whether it is bounded: a square of half width
    `box` is cut by the bisector with one neighbour after the other, until the next is too far away to matter."""
    cell = np.array([[-box, -box], [box, -box], [box, box], [-box, box]])
    for other in others - own:
        size2 = other @ other
        if size2 > 4 * (cell**2).sum(axis=1).max():
            break
        side = cell @ other - size2 / 2  # positive beyond the bisector
        nxt, ahead = np.roll(cell, -1, axis=0), np.roll(side, -1)
        keep = []
        for p, q, s, t in zip(cell, nxt, side, ahead):
            if s <= 0:
                keep.append(p)
            if s * t < 0:
                keep.append(p + (q - p) * (s / (s - t)))
        cell = np.array(keep)
    x, y = cell.T
    area = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
    return area, bool(np.abs(cell).max() < box * (1 - 1e-9))


def voronoi_weights(points: np.ndarray, nearest: int = 6) -> np.ndarray:
    """How much of the plane each point stands for, 1 on average. The area of a point is that of a circle of the mean
    distance to its six nearest ones; inside the hull that of its Voronoi cell, unless it is unbounded or twice as large."""
    n = len(points)
    area, corners = np.empty(n), set(_hull(points).tolist())
    box = 4 * float(np.ptp(points, axis=0).max()) + 1.0
    for i in range(n):
        d = np.hypot(*(points - points[i]).T)
        order = np.argsort(d, kind="stable")
        order = order[order != i]
        area[i] = np.pi * d[order[:nearest]].mean() ** 2
        if i not in corners:
            cell, bounded = _cell_area(points[i], points[order], box)
            if bounded and cell < 2 * area[i]:
                area[i] = cell
    return n * area / area.sum()


def _azimuth_weights(de: np.ndarray, dn: np.ndarray) -> np.ndarray:
    """points x stations: the share of the horizon between the neighbours in azimuth on both sides, 1 on average."""
    azimuth = np.arctan2(dn, de)
    order = np.argsort(azimuth, axis=1)
    ranked = np.take_along_axis(azimuth, order, 1)
    gap = np.diff(np.concatenate([ranked, ranked[:, :1] + 2 * np.pi], 1), axis=1)
    out = np.empty_like(azimuth)
    np.put_along_axis(out, order, (gap + np.roll(gap, 1, axis=1)) * azimuth.shape[1] / (4 * np.pi), 1)
    return out


def strain_field(velocities: DataFrame, points: DataFrame, threshold: float = 2.0, distance: str = "quadratic", coverage: str = "voronoi", reach_m: float = 0.0) -> DataFrame:
    """Velocity, strain and rotation at each field point (point_id, lon, lat) from the stations around it: point_id, ve,
    vn, exx, exy, eyy, dilatation, strain, shear, rotation, scale. After Shen et al. (2015): stations are weighted by
    distance ('gaussian' or 'quadratic' decay) and by `coverage` ('voronoi' or 'azimuth': the area or angle they stand for;
    'none'); the distance scale of each point, in metres, is the one at which the weights of all stations add up to
    `threshold`. Points farther than reach_m outside the hull of the stations, or without such a scale, are NULL. The
    network is a bounded table: at most NETWORK_ROWS stations."""
    v = velocities.dropna(subset=["lon", "lat", "ve", "vn"])
    net = v.limit(NETWORK_ROWS + 1).toPandas()
    if len(net) > NETWORK_ROWS:
        raise ValueError(f"more than {NETWORK_ROWS} stations")
    if len(net) < 6:
        raise ValueError("at least six stations")
    zone = utm_zone(float(np.degrees(np.arctan2(np.sin(np.radians(net["lon"])).sum(), np.cos(np.radians(net["lon"])).sum()))))
    at = np.column_stack(utm(net["lat"].to_numpy(), net["lon"].to_numpy(), zone))
    w2, y = _weights(net), net[["ve", "vn"]].to_numpy()
    hull = at[_hull(at)]
    area = voronoi_weights(at) if coverage == "voronoi" else np.ones(len(at))
    names = ["point_id", "ve", "vn", "exx", "exy", "eyy", "dilatation", "strain", "shear", "rotation", "scale"]

    def outside(p: np.ndarray) -> np.ndarray:
        """Distance beyond the hull, 0 inside."""
        a, b = hull, np.roll(hull, -1, axis=0)
        to, side = p[:, None] - a, b - a
        inside = (side[:, 0] * to[:, :, 1] - side[:, 1] * to[:, :, 0] >= 0).all(axis=1)
        along = np.clip((to * side).sum(axis=2) / (side**2).sum(axis=1), 0, 1)
        far = np.hypot(*np.moveaxis(to - along[:, :, None] * side, 2, 0)).min(axis=1)
        return np.where(inside, 0.0, far)

    def some(p: np.ndarray) -> np.ndarray:
        de, dn = at[:, 0] - p[:, :1], at[:, 1] - p[:, 1:]
        d2 = de**2 + dn**2
        cover = _azimuth_weights(de, dn) if coverage == "azimuth" else area[None]
        fall = (lambda s: np.exp(-d2 / s[:, None] ** 2)) if distance == "gaussian" else (lambda s: 1 / (1 + d2 / s[:, None] ** 2))
        low, high = np.ones(len(p)), np.sqrt(d2.max(axis=1))
        found = ((fall(low) * cover).sum(axis=1) < threshold) & ((fall(high) * cover).sum(axis=1) > threshold)
        for _ in range(60):
            mid = np.sqrt(low * high)
            more = (fall(mid) * cover).sum(axis=1) > threshold
            low, high = np.where(more, low, mid), np.where(more, mid, high)
        k = fall(high) * cover
        # normal equations of velocity and gradient at each point, in megametres
        ones = np.ones_like(de)
        g = np.stack([ones, de / 1e6, dn / 1e6], 1)  # points x 3 x stations
        q, b = np.empty((len(p), 6, 6)), np.empty((len(p), 6))
        for i in range(2):
            b[:, 3 * i : 3 * i + 3] = (g * (k * (w2[:, i] * y).sum(axis=1))[:, None]).sum(axis=2)
            for j in range(2):
                q[:, 3 * i : 3 * i + 3, 3 * j : 3 * j + 3] = (g * (k * w2[:, i, j])[:, None]) @ g.transpose(0, 2, 1)
        m = np.stack([np.linalg.lstsq(x, z, rcond=None)[0] for x, z in zip(q, b)])
        xx, xn, nx, yy = m[:, 1] * 1e-6, m[:, 2] * 1e-6, m[:, 4] * 1e-6, m[:, 5] * 1e-6
        xy, rot = (xn + nx) / 2, (nx - xn) / 2
        sq = xx * xx + yy * yy + 2 * xy * xy
        out = np.column_stack([m[:, 0], m[:, 3], xx, xy, yy, xx + yy, np.sqrt(sq), np.sqrt(np.maximum(sq / 2 - (xx + yy) ** 2 / 6, 0)), np.abs(rot), high])
        out[~found | (outside(p) > reach_m)] = np.nan
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 1_000_000 // len(at))
        for pdf in frames:
            p = np.column_stack(utm(pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float), zone))
            for k in range(0, len(p), step):
                yield pd.DataFrame({"point_id": pdf["point_id"].iloc[k : k + step].to_numpy()} | dict(zip(names[1:], some(p[k : k + step]).T)))

    got = points.select("point_id", "lon", "lat").dropna().mapInPandas(run, "point_id bigint, " + ", ".join(f"{n} double" for n in names[1:]))
    return got.select("point_id", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names[1:]])
