"""Least squares on normal equations: plain, ridge, lasso, reweighted. NumPy only."""

from __future__ import annotations

import numpy as np


def reweight(kind: str, m: np.ndarray, eps: float, scale: float = 1.0) -> np.ndarray:
    """Weights from parameter sizes: 'inv' s/(|m|+e), 'inv_sq' s/(m²+e²), 'log' s ln((sum|m| + n e)/(|m|+e)) / ln n."""
    size = np.abs(m)
    if kind == "inv":
        return scale / (size + eps)
    if kind == "inv_sq":
        return scale / (size**2 + eps**2)
    if kind == "log":
        n = m.size
        return scale * np.log((size.sum() + n * eps) / (size + eps)) / np.log(n) if n > 1 else np.full_like(size, scale)
    raise ValueError(f"unknown reweighting {kind}")


def pinvh(a: np.ndarray) -> np.ndarray:
    lam, v = np.linalg.eigh((a + a.T) / 2)
    cut = np.abs(lam).max(initial=0.0) * len(a) * np.finfo(float).eps
    inv = np.where(np.abs(lam) > cut, 1 / np.where(lam == 0, 1, lam), 0.0)
    return (v * inv) @ v.T


def plain(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(q, b, rcond=None)[0]


def bounded(q: np.ndarray, b: np.ndarray, sign: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """min mᵀQm/2 - bᵀm with m·sign >= 0 where sign is not 0: an active set on the gradient."""
    flip = np.where(sign < 0, -1.0, 1.0)
    q, b = q * flip[:, None] * flip[None, :], b * flip
    held = sign != 0
    free = ~held
    m = np.zeros(len(b))
    if free.any():
        m[free] = plain(q[np.ix_(free, free)], b[free])
    tol = 1e-10 * max(1.0, np.abs(b).max(initial=0.0))
    for _ in range(rounds):
        g = b - q @ m
        add = np.where(~free, g, -np.inf)
        if not held.any() or add.max(initial=-np.inf) <= tol:
            break
        free[int(add.argmax())] = True
        while True:
            s = np.zeros(len(b))
            s[free] = plain(q[np.ix_(free, free)], b[free])
            bad = free & held & (s <= 0)
            if not bad.any():
                m = s
                break
            step = np.min(m[bad] / np.maximum(m[bad] - s[bad], 1e-300))
            m = m + step * (s - m)
            free &= ~(held & (m <= 1e-14))
            m[~free] = 0
    return m * flip


def feature_sign(q: np.ndarray, b: np.ndarray, lam: np.ndarray, start: np.ndarray | None = None, rounds: int = 5000, sign: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """min mᵀQm - 2bᵀm + Σ lam|m| by active sets of signs, and the largest violation of the optimality conditions.
    Entries whose `sign` is not 0 may not have the other sign. Free entries with lam = 0 are eliminated exactly first."""
    n = len(b)
    sign = np.zeros(n) if sign is None else np.asarray(sign, float)
    loose = (lam <= 0) & (sign == 0)
    if loose.any():
        tight = ~loose
        m = np.zeros(n)
        ql = q[np.ix_(loose, loose)]
        if not tight.any():
            return plain(q, b), 0.0
        cross = q[np.ix_(loose, tight)]
        sol = np.linalg.lstsq(ql, np.column_stack([cross, b[loose]]), rcond=None)[0]
        qq, bb = q[np.ix_(tight, tight)] - cross.T @ sol[:, :-1], b[tight] - cross.T @ sol[:, -1]
        m[tight], kkt = feature_sign((qq + qq.T) / 2, bb, lam[tight], None if start is None else start[tight], rounds, sign[tight])
        m[loose] = sol[:, -1] - sol[:, :-1] @ m[tight]
        return m, kkt
    half = np.maximum(lam, 0) / 2  # the objective has no one half
    held = sign != 0
    m = np.zeros(n) if start is None else np.where(held & (start * sign < 0), 0.0, start)
    theta = np.sign(m)
    tol = 1e-9 * max(1.0, half.max(initial=0.0), 1e-3 * np.abs(b).max(initial=0.0) if held.any() else 0.0)
    cost = lambda v: v @ (q @ v) - 2 * b @ v + lam @ np.abs(v)
    fresh = True
    for _ in range(rounds):
        g = q @ m - b
        active = theta != 0
        if fresh or np.all(np.abs(g[active] + half[active] * theta[active]) <= tol):
            gain = np.where(held, -g * sign, np.abs(g)) - half  # an entry that is held may leave zero one way only
            over = np.where(~active, gain, -np.inf)
            j = int(over.argmax())
            if over[j] > tol:
                theta[j] = sign[j] if held[j] else -np.sign(g[j])
                active = theta != 0
            elif not fresh:
                break
        fresh = False
        k = np.flatnonzero(active)
        if not len(k):
            break
        rhs = b[k] - half[k] * theta[k]
        try:
            new = np.linalg.solve(q[np.ix_(k, k)], rhs)
        except np.linalg.LinAlgError:
            new = plain(q[np.ix_(k, k)], rhs)
        if not np.all(np.isfinite(new)):
            new = plain(q[np.ix_(k, k)], rhs)
        old = m[k]
        if np.all(np.sign(new) == theta[k]):
            m[k] = new
            continue
        # try every point between old and new where a sign changes, as far as no entry that is held does
        with np.errstate(all="ignore"):
            cuts = old / (old - new)
        stop = min(cuts[held[k] & (new * sign[k] < 0) & (cuts >= 0)], default=1.0)
        cuts = np.unique(np.append(cuts[(cuts > 0) & (cuts < stop)], stop))
        best, at = np.inf, stop
        for c in cuts:
            v = m.copy()
            v[k] = old + c * (new - old)
            v[np.abs(v) < 1e-15] = 0
            f = cost(v)
            if f < best:
                best, at = f, c
        m[k] = old + at * (new - old)
        m[np.abs(m) < 1e-14 * max(1.0, np.abs(m).max())] = 0
        m[held & (m * sign < 0)] = 0
        theta = np.sign(m)
    g = 2 * (b - q @ m)
    idle = np.maximum(np.where(held, g * sign, np.abs(g)) - lam, 0)
    kkt = np.where(m != 0, np.abs(g - lam * np.sign(m)), idle).max(initial=0.0)
    return m, float(kkt)


def lasso(q: np.ndarray, b: np.ndarray, reg: np.ndarray, penalty: float, iters: int = 1, kind: str = "inv", eps: float = 1e-4, scale: float = 1.0, inner: np.ndarray | None = None, init: np.ndarray | None = None, coupled: bool = True, tol: float = 1e-9, sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool, float]:
    """(parameters, weights after the last solve, converged, optimality violation). With iters > 1 the problem is solved
    again with weights from the parameter sizes; `coupled` lets the reweighting start from the penalty and then go on alone, else
    weights multiply the penalty. `sign`: see feature_sign."""
    inner = np.ones(len(b)) if inner is None else inner
    w = np.where(reg, (penalty if coupled else 1.0), 0.0) if init is None else np.where(reg, init, 0.0)
    m, kkt, done = np.zeros(len(b)), 0.0, iters <= 1
    for i in range(max(iters, 1)):
        lam = w if coupled else w * penalty
        new, kkt = feature_sign(q, b, lam, sign=sign)
        moved = np.linalg.norm(new - m)
        m = new
        w = np.zeros(len(b))
        if reg.any():
            w[reg] = reweight(kind, (m * inner)[reg], eps, scale)
        if i and moved < tol:
            done = True
            break
    return m, w, done, kkt
