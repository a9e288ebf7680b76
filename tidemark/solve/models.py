"""Models as data: what a series is made of, as JSON, as design columns in Spark and in NumPy.

A model maps time to one or more design columns; the parameters of a collection are ordered by model, then by column.
Times are microseconds since 1970. Outside [t_start, t_end] a model keeps its boundary value, or is zero where
zero_before / zero_after say so.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timeunits import UNIT_MICROS

#: Model types and whether they are zero before and after their period unless told otherwise.
ZEROING = {
    "Step": (True, False), "Polynomial": (False, False), "BSpline": (True, True), "ISpline": (True, False),
    "SplineSet": (True, False), "DecayingSplineSet": (True, False), "Sinusoid": (True, True), "AmpPhModulatedSinusoid": (True, True),
    "Logarithmic": (True, False), "Exponential": (True, False), "Arctangent": (False, False), "HyperbolicTangent": (False, False),
}


#: Models of the user by type, see `register`.
CUSTOM: dict[str, tuple[Callable[[dict], int], Callable[[np.ndarray, dict], np.ndarray], Callable[[Column, dict], list[Column]] | None]] = {}


def register(name: str, parameters: Callable[[dict], int], design: Callable[[np.ndarray, dict], np.ndarray], columns: Callable[[Column, dict], list[Column]] | None = None, zero_before: bool = False, zero_after: bool = False) -> None:
    """Add a model type: the number of parameters from `kw`; the design matrix (times x parameters) from the times since the
    reference in the model's unit and `kw`; the same as column expressions, or none, in which case evaluation goes through
    Arrow batches."""
    CUSTOM[name] = (parameters, design, columns)
    ZEROING[name] = (zero_before, zero_after)


def parse_time(t: str) -> int:
    return int(np.datetime64(t, "us").astype(np.int64))


@dataclass(frozen=True)
class ModelSpec:
    """One model. `kw` by type: Step steptimes; Polynomial order, min_exponent; BSpline and ISpline degree, scale,
    num_splines, spacing; SplineSet degree, t_center_start, t_center_end and list_num_knots or list_scales, splineclass;
    DecayingSplineSet degree, t_center_start, list_scales, list_num_splines; Sinusoid period; AmpPhModulatedSinusoid
    period, degree, num_bases (with t_start, t_end); Logarithmic and Exponential tau (number or list); Arctangent and
    HyperbolicTangent tau."""

    name: str
    type: str
    kw: dict = field(default_factory=dict)
    t_reference: str = "2000-01-01"
    time_unit: str = "D"
    regularize: bool = False
    t_start: str | None = None
    t_end: str | None = None
    zero_before: bool | None = None
    zero_after: bool | None = None

    def __post_init__(self) -> None:
        if self.type not in ZEROING:
            raise ValueError(f"unknown model type {self.type}")
        if self.type in ("Logarithmic", "Exponential") and self.t_start and parse_time(self.t_start) < parse_time(self.t_reference):
            raise ValueError("a decay cannot start before its reference time")

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v is not None})

    @staticmethod
    def from_json(text: str) -> ModelSpec:
        return ModelSpec(**json.loads(text))

    @property
    def zeros(self) -> tuple[bool, bool]:
        a, b = ZEROING[self.type]
        return a if self.zero_before is None else self.zero_before, b if self.zero_after is None else self.zero_after

    def splines(self) -> list[tuple[str, int, float, float, float]]:
        """(class, degree, scale, centre, internal scale) of each spline, in units from t_reference."""
        kw = self.kw
        p = kw.get("degree", 2)
        if self.type in ("BSpline", "ISpline"):
            scale = kw["scale"]
            step = kw.get("spacing") or scale
            return [(self.type, p, scale, j * step, 1.0) for j in range(kw.get("num_splines", 1))]
        unit = UNIT_MICROS[self.time_unit]
        at = lambda t: (parse_time(t) - parse_time(self.t_reference)) / unit
        kind, out = kw.get("splineclass", "ISpline"), []
        if self.type == "SplineSet":
            a, b = at(kw["t_center_start"]), at(kw["t_center_end"])
            pad = p // 2
            sets = [((b - a) / (n - 1), n + 2 * pad) for n in kw["list_num_knots"]] if "list_num_knots" in kw else [(s, int((b - a) / s + 1e-9) + 1 + 2 * pad) for s in kw["list_scales"]]
            if not kw.get("complete", True):
                pad, sets = 0, [(s, n - 2 * (p // 2)) for s, n in sets]
            least = min(s for s, _ in sets)
            for s, n in sets:
                out += [(kind, p, s, a + (j - pad) * s, math.sqrt(s / least)) for j in range(n)]
        elif self.type == "DecayingSplineSet":
            a, least = at(kw["t_center_start"]), min(kw["list_scales"])
            for s, n in zip(kw["list_scales"], kw["list_num_splines"]):
                out += [(kind, p, s, a + j * s, math.sqrt(s / least)) for j in range(n)]
        return out if kw.get("internal_scaling", True) else [(*x[:4], 1.0) for x in out]

    @property
    def num_parameters(self) -> int:
        kw = self.kw
        if self.type in CUSTOM:
            return CUSTOM[self.type][0](kw)
        if self.type == "Step":
            return len(kw["steptimes"])
        if self.type == "Polynomial":
            return kw["order"] + 1 - kw.get("min_exponent", 0)
        if self.type == "Sinusoid":
            return 2
        if self.type == "AmpPhModulatedSinusoid":
            return 2 * kw["num_bases"]
        if self.type in ("Logarithmic", "Exponential"):
            return len(kw["tau"]) if isinstance(kw["tau"], (list, tuple)) else 1
        if self.type in ("Arctangent", "HyperbolicTangent"):
            return 1
        return len(self.splines())

    def internal_scales(self) -> list[float]:
        return [x[4] for x in (self.splines() if self.type not in CUSTOM else [])] or [1.0] * self.num_parameters

    def taus(self) -> list[float]:
        tau = self.kw["tau"]
        return list(tau) if isinstance(tau, (list, tuple)) else [tau]


def spline_coefficients(degree: int) -> list[float]:
    """(-1)^k C(n, k) / p! of the cardinal B-spline of degree p, n = p + 1."""
    n = degree + 1
    return [(-1) ** k * math.comb(n, k) / math.factorial(degree) for k in range(n + 1)]


def clamped_bspline_basis(x: np.ndarray, degree: int, num: int) -> np.ndarray:
    """The `num` B-splines of a clamped uniform knot vector on [0, 1], by the recursion on the degree; the right end
    belongs to the last one, outside all are zero."""
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, num - degree + 1), np.ones(degree)])
    b = np.zeros((len(x), len(knots) - 1))
    for i in range(len(knots) - 1):
        b[:, i] = (knots[i] <= x) & (x < knots[i + 1])
    last = np.flatnonzero(knots[:-1] < knots[1:])[-1]
    b[x == 1.0, last] = 1.0
    for d in range(1, degree + 1):
        nxt = np.zeros((len(x), b.shape[1] - 1))
        for i in range(nxt.shape[1]):
            lo, hi = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            if lo > 0:
                nxt[:, i] += (x - knots[i]) / lo * b[:, i]
            if hi > 0:
                nxt[:, i] += (knots[i + d + 1] - x) / hi * b[:, i + 1]
        b = nxt
    return b


def design(spec: ModelSpec, us: np.ndarray) -> np.ndarray:
    """len(us) x num_parameters."""
    us = np.asarray(us, np.int64)
    a = parse_time(spec.t_start) if spec.t_start else None
    b = parse_time(spec.t_end) if spec.t_end else None
    at = np.clip(us, a, b) if a is not None or b is not None else us
    tau = (at - parse_time(spec.t_reference)) / UNIT_MICROS[spec.time_unit]
    kw = spec.kw
    if spec.type in CUSTOM:
        g = np.array(CUSTOM[spec.type][1](tau, kw), float).reshape(len(us), -1)
    elif spec.type == "Step":
        g = np.stack([at >= parse_time(s) for s in sorted(kw["steptimes"], key=parse_time)], 1).astype(float)
    elif spec.type == "Polynomial":
        g = np.stack([tau**k for k in range(kw.get("min_exponent", 0), kw["order"] + 1)], 1)
    elif spec.type == "Sinusoid":
        g = np.stack([np.cos(2 * np.pi * tau / kw["period"]), np.sin(2 * np.pi * tau / kw["period"])], 1)
    elif spec.type == "AmpPhModulatedSinusoid":
        h = clamped_bspline_basis((at - a) / (b - a), kw.get("degree", 2), kw["num_bases"])
        w = 2 * np.pi * tau[:, None] / kw["period"]
        g = np.concatenate([h * np.cos(w), h * np.sin(w)], 1)
    elif spec.type == "Logarithmic":
        g = np.stack([np.log1p(np.maximum(tau, 0) / x) for x in spec.taus()], 1)
    elif spec.type == "Exponential":
        g = np.stack([-np.expm1(-np.maximum(tau, 0) / x) for x in spec.taus()], 1)
    elif spec.type == "Arctangent":
        g = (np.arctan(tau / kw["tau"]) / np.pi + 0.5)[:, None]
    elif spec.type == "HyperbolicTangent":
        g = (np.tanh(tau / kw["tau"]) / 2 + 0.5)[:, None]
    else:
        cols = []
        for kind, p, scale, centre, inner in spec.splines():
            u, half = (tau - centre) / scale, (p + 1) / 2
            e = p if kind == "BSpline" else p + 1
            v = sum(c * np.maximum(u + half - k, 0) ** e for k, c in enumerate(spline_coefficients(p))) / (1 if kind == "BSpline" else e)
            v = np.where(np.abs(u) > half, 0.0, v) if kind == "BSpline" else np.where(u < -half, 0.0, np.where(u > half, 1.0, v))
            cols.append(v * inner)
        g = np.stack(cols, 1)
    before, after = spec.zeros
    if a is not None and before:
        g[us < a] = 0
    if b is not None and after:
        g[us > b] = 0
    if spec.type in ("Logarithmic", "Exponential"):
        g[us < parse_time(spec.t_reference)] = 0
    return g


def design_all(specs: Sequence[ModelSpec], us: np.ndarray) -> np.ndarray:
    return np.concatenate([design(s, us) for s in specs], 1)


def _clamped_columns(x: Column, degree: int, num: int) -> list[Column]:
    """clamped_bspline_basis as expressions: on each piece between knots every basis is one polynomial, whose coefficients
    follow from its values there."""
    pieces = num - degree
    edges = np.linspace(0, 1, pieces + 1)
    at = np.linspace(0.05, 0.95, degree + 1)
    powers = np.linalg.inv(np.vander(at, increasing=True))
    out = []
    for j in range(num):
        c = None
        for i in range(pieces):
            value = clamped_bspline_basis(edges[i] + at * (edges[i + 1] - edges[i]), degree, num)[:, j]
            u = (x - float(edges[i])) * pieces
            poly = F.lit(0.0)
            for k in reversed(powers @ value):
                poly = poly * u + float(k)
            inside = (x >= float(edges[i])) & ((x < float(edges[i + 1])) if i < pieces - 1 else (x <= 1.0))
            c = F.when(inside, poly) if c is None else c.when(inside, poly)
        out.append(c.otherwise(0.0))
    return out


def columns(spec: ModelSpec, us: str = "_us") -> list[Column]:
    """The design columns as Spark expressions of the integer column `us`."""
    raw = F.col(us)
    a = parse_time(spec.t_start) if spec.t_start else None
    b = parse_time(spec.t_end) if spec.t_end else None
    at = raw
    if a is not None:
        at = F.greatest(at, F.lit(a))
    if b is not None:
        at = F.least(at, F.lit(b))
    tau = (at - F.lit(parse_time(spec.t_reference))).cast("double") / float(UNIT_MICROS[spec.time_unit])
    kw, zero = spec.kw, F.lit(0.0)
    if spec.type in CUSTOM and CUSTOM[spec.type][2] is None:
        n, matrix = spec.num_parameters, CUSTOM[spec.type][1]

        @F.pandas_udf("array<double>")
        def rows(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.array(matrix(x.to_numpy(float), kw), float).reshape(len(x), -1)))

        found = rows(tau)
        out = [F.get(found, F.lit(k)) for k in range(n)]
    elif spec.type in CUSTOM:
        out = CUSTOM[spec.type][2](tau, kw)
    elif spec.type == "Step":
        out = [F.when(at >= parse_time(s), 1.0).otherwise(0.0) for s in sorted(kw["steptimes"], key=parse_time)]
    elif spec.type == "Polynomial":
        out = [F.lit(1.0) if k == 0 else tau if k == 1 else F.pow(tau, float(k)) for k in range(kw.get("min_exponent", 0), kw["order"] + 1)]
    elif spec.type == "Sinusoid":
        w = tau * (2 * math.pi / kw["period"])
        out = [F.cos(w), F.sin(w)]
    elif spec.type == "Logarithmic":
        out = [F.log1p(F.greatest(tau, zero) / x) for x in spec.taus()]
    elif spec.type == "Exponential":
        out = [-F.expm1(-F.greatest(tau, zero) / x) for x in spec.taus()]
    elif spec.type == "Arctangent":
        out = [F.atan(tau / kw["tau"]) / math.pi + 0.5]
    elif spec.type == "HyperbolicTangent":
        out = [F.tanh(tau / kw["tau"]) / 2 + 0.5]
    elif spec.type == "AmpPhModulatedSinusoid":
        h = _clamped_columns((at - F.lit(a)).cast("double") / float(b - a), kw.get("degree", 2), kw["num_bases"])
        w = tau * (2 * math.pi / kw["period"])
        out = [x * F.cos(w) for x in h] + [x * F.sin(w) for x in h]
    else:
        out = []
        for kind, p, scale, centre, inner in spec.splines():
            u, half = (tau - centre) / scale, (p + 1) / 2
            e = p if kind == "BSpline" else p + 1
            v = sum((F.pow(F.greatest(u + (half - k), zero), float(e)) * c for k, c in enumerate(spline_coefficients(p))), zero) / (1.0 if kind == "BSpline" else float(e))
            v = F.when(F.abs(u) > half, 0.0).otherwise(v) if kind == "BSpline" else F.when(u < -half, 0.0).when(u > half, 1.0).otherwise(v)
            out.append(v * inner)
    before, after = spec.zeros
    if a is not None and before:
        out = [F.when(raw < a, 0.0).otherwise(c) for c in out]
    if b is not None and after:
        out = [F.when(raw > b, 0.0).otherwise(c) for c in out]
    if spec.type in ("Logarithmic", "Exponential"):
        out = [F.when(raw < parse_time(spec.t_reference), 0.0).otherwise(c) for c in out]
    return out


def exponent_index(spec: ModelSpec, exponent: int) -> int:
    """par_ix of a power of a polynomial; an error if it has none."""
    low = spec.kw.get("min_exponent", 0)
    if spec.type != "Polynomial" or not low <= exponent <= spec.kw["order"]:
        raise ValueError(f"{spec.name} has no power {exponent}")
    return exponent - low


def center_times(spec: ModelSpec) -> list[int]:
    """Centre of each spline in microseconds."""
    return [parse_time(spec.t_reference) + round(x[3] * UNIT_MICROS[spec.time_unit]) for x in spec.splines()]


def transient_periods(spec: ModelSpec) -> list[tuple[int, int]]:
    """For each spline the first and last microsecond at which it counts as transient: degree + 1 times its scale to
    either side of its centre."""
    unit = UNIT_MICROS[spec.time_unit]
    return [(c - round(scale * (p + 1) * unit), c + round(scale * (p + 1) * unit)) for c, (_, p, scale, _, _) in zip(center_times(spec), spec.splines())]


def transient_mask(spec: ModelSpec, us: str = "_us") -> list[Column]:
    """One boolean column a spline: whether the time is within its transient period."""
    return [F.col(us).between(a, b) for a, b in transient_periods(spec)]


def to_arch(specs: Sequence[ModelSpec]) -> dict:
    """{name: {type, kw_args}}, the flat form of the network file."""
    skip = {"name", "type", "kw"}
    return {s.name: {"type": s.type, "kw_args": s.kw | {k: v for k, v in asdict(s).items() if k not in skip and v is not None}} for s in specs}


def from_arch(arch: dict) -> list[ModelSpec]:
    own = {"t_reference", "time_unit", "regularize", "t_start", "t_end", "zero_before", "zero_after"}
    return [ModelSpec(n, a["type"], {k: v for k, v in a["kw_args"].items() if k not in own}, **{k: v for k, v in a["kw_args"].items() if k in own}) for n, a in arch.items()]
