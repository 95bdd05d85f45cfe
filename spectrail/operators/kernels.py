"""Multivariate kernels on one matrix or on its R factor; tasks and fit barriers call them.

All take centred data unless they say otherwise.  A linear kernel needs X and y
only through orthogonal invariants, so the R factor of [X, y] does as well.
Signs: the largest element of a loading or weight by size, the first of equals,
is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from spectrail.functions.arrays import Refused

EPS = np.finfo(float).eps
#: Relative rank tolerance of a stored matrix (single precision's step, a fixed value of the definitions).
STORED_EPS = float(np.finfo(np.float32).eps)


def _signed(v: np.ndarray) -> np.ndarray:
    return v if v[np.argmax(np.abs(v))] >= 0 else -v


def rank_of(s: np.ndarray, rows: int, columns: int, data_eps: float = 0.0) -> int:
    return int((s > (max(rows, columns) * EPS + data_eps) * s[0]).sum()) if len(s) and s[0] > 0 else 0


@dataclass
class Pca:
    loadings: np.ndarray
    eigenvalues: np.ndarray
    n: int

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues[: self.loadings.shape[1]] / self.eigenvalues.sum()


def pca(x: np.ndarray, components: int, n: int | None = None, data_eps: float = STORED_EPS) -> Pca:
    """x as given (or its R factor, with n rows stated); eigenvalues of all components up to the rank."""
    n = len(x) if n is None else n
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    r = rank_of(s, n, x.shape[1], data_eps)
    if components > r:
        raise Refused(f"{components} components, but the rank is {r}")
    return Pca(np.stack([_signed(v) for v in vt[:components]], 1), s[:r] ** 2 / (n - 1), n)


@dataclass
class Latent:
    """Weights, loadings, y loadings and rotations of a latent-variable regression; t_size is t't."""

    w: np.ndarray
    p: np.ndarray
    q: np.ndarray
    t_size: np.ndarray

    @property
    def rotations(self) -> np.ndarray:
        return self.w @ np.linalg.inv(self.p.T @ self.w)

    def coefficients(self, a: int | None = None) -> np.ndarray:
        a = self.w.shape[1] if a is None else min(a, self.w.shape[1])
        return self.w[:, :a] @ np.linalg.solve(self.p[:, :a].T @ self.w[:, :a], self.q[:a])

    def vip(self) -> np.ndarray:
        ss = (self.q**2 if self.q.ndim == 1 else (self.q**2).sum(1)) * self.t_size
        return np.sqrt(len(self.w) * (self.w**2 @ ss) / ss.sum())


def pls(x: np.ndarray, y: np.ndarray, components: int, n: int | None = None) -> Latent:
    """NIPALS with deflation of both blocks; y of one column or many.  Ends early when no covariance is left."""
    n = len(x) if n is None else n
    if components > min(n - 1, x.shape[1]):
        raise Refused(f"{components} components, but at most {min(n - 1, x.shape[1])} can be fitted")
    e, f = x.copy(), y.copy()
    first, parts = np.linalg.norm(x.T @ y), []
    for _ in range(components):
        c = e.T @ f
        if np.linalg.norm(c) <= np.sqrt(EPS) * first or first == 0:
            break
        w = _signed(c / np.linalg.norm(c) if y.ndim == 1 else np.linalg.svd(c, full_matrices=False)[0][:, 0])
        t = e @ w
        tt = t @ t
        p, q = e.T @ t / tt, f.T @ t / tt
        e -= np.outer(t, p)
        f = f - (t * q if y.ndim == 1 else np.outer(t, q))
        parts.append((w, p, q, tt))
    if not parts:
        raise Refused("no covariance between the variables and the response")
    w, p, q, tt = zip(*parts, strict=True)
    return Latent(np.stack(w, 1), np.stack(p, 1), np.stack(q), np.array(tt))


def pcr(x: np.ndarray, y: np.ndarray, components: int, n: int | None = None) -> tuple[Pca, np.ndarray]:
    front = pca(x, components, n, 0.0)
    t = x @ front.loadings
    return front, (t.T @ y) / (t * t).sum(0)


def opls(x: np.ndarray, y: np.ndarray, orthogonal: int, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and orthogonal weights; predicts as PLS of 1 + orthogonal components does."""
    e, w_all = x.copy(), []
    w = x.T @ y
    if np.linalg.norm(w) == 0:
        raise Refused("no covariance between the variables and the response")
    w = w / np.linalg.norm(w)
    for _ in range(orthogonal):
        t = e @ w
        p = e.T @ t / (t @ t)
        wo = p - (w @ p) * w
        if np.linalg.norm(wo) <= np.sqrt(EPS) * np.linalg.norm(p):
            break
        wo /= np.linalg.norm(wo)
        to = e @ wo
        e -= np.outer(to, e.T @ to / (to @ to))
        w_all.append(wo)
    return pls(x, y, 1 + len(w_all), n).coefficients(), np.stack(w_all, 1) if w_all else np.zeros((x.shape[1], 0))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and effective degrees of freedom."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    return vt.T @ (s / (s**2 + alpha) * (u.T @ y)), float((s**2 / (s**2 + alpha)).sum())


def mlr(x: np.ndarray, y: np.ndarray, n: int | None = None, data_eps: float = STORED_EPS) -> np.ndarray:
    s = np.linalg.svd(x, compute_uv=False)
    if rank_of(s, len(x) if n is None else n, x.shape[1], data_eps) < x.shape[1]:
        raise Refused(f"the {x.shape[1]} variables are linearly dependent")
    q, r = np.linalg.qr(x)
    return np.linalg.solve(r, q.T @ y)


def elastic_net(gram: np.ndarray, xy: np.ndarray, n: int, alpha: float, l1_ratio: float, start: np.ndarray | None = None, tol: float = 1e-10, most: int = 20_000) -> np.ndarray:
    """Coordinate descent on X'X and X'y for 1/2n |y - Xb|^2 + alpha (l1 |b| + (1 - l1)/2 b^2)."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    grad, size = xy - gram @ b, np.diag(gram)
    for _ in range(most):
        largest = 0.0
        for j in np.flatnonzero(size > 0):
            z = grad[j] + size[j] * b[j]
            new = np.sign(z) * max(abs(z) - n * alpha * l1_ratio, 0.0) / (size[j] + n * alpha * (1 - l1_ratio))
            if new != b[j]:
                grad -= gram[:, j] * (new - b[j])
                largest = max(largest, abs(new - b[j]) * np.sqrt(size[j]))
                b[j] = new
        if largest <= tol * max(1.0, np.abs(xy).max()):
            return b
    raise Refused(f"the elastic net didn't converge for alpha {alpha}")


def kernel(a: np.ndarray, b: np.ndarray, kind: str, gamma: float) -> np.ndarray:
    if kind == "linear":
        return a @ b.T
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def smo(k: np.ndarray, sign: np.ndarray, linear: np.ndarray, c: float, tol: float = 1e-3, most: int = 200_000) -> tuple[np.ndarray, float]:
    """min 1/2 a'Qa + linear'a, 0 <= a <= c, sign'a = 0 with Q = sign sign' k: working pairs of second order; later index on ties."""
    a, g = np.zeros(len(sign)), linear.astype(float).copy()
    diag = np.diag(k)
    for _ in range(most):
        up = np.where(sign > 0, a < c, a > 0)
        low = np.where(sign > 0, a > 0, a < c)
        v = -sign * g
        best = np.where(up, v, -np.inf)
        i = len(best) - 1 - int(np.argmax(best[::-1]))
        gap = v[i] - v
        if not up.any() or not low.any() or (v[i] - np.where(low, v, np.inf).min()) < tol:
            break
        curve = np.maximum(diag[i] + diag - 2 * k[i], 1e-12)
        gain = np.where(low & (gap > 0), gap**2 / curve, -np.inf)
        j = len(gain) - 1 - int(np.argmax(gain[::-1]))
        step = gap[j] / curve[j]
        room_i = c - a[i] if sign[i] > 0 else a[i]
        room_j = a[j] if sign[j] > 0 else c - a[j]
        step = min(step, room_i, room_j)
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        g += sign * step * (k[i] - k[j])
    else:
        raise Refused("the support vector solver didn't converge")
    free = (a > 0) & (a < c)
    rho = -np.mean((-sign * g)[free]) if free.any() else -(np.where(up, v, -np.inf).max() + np.where(low, v, np.inf).min()) / 2
    return a, float(rho)


def concentrated(x: np.ndarray, starts: int, seed: int, best: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and covariances of least determinant among random starts of p + 1 rows and two concentration steps each, different ones only."""
    n, p = x.shape
    h = -(-(n + p + 1) // 2)
    rng, found = np.random.default_rng(seed), {}
    for _ in range(starts):
        rows = rng.permutation(n)[: p + 1]
        for _ in range(2):
            d = x - x[rows].mean(0)
            rows = np.argsort((d @ np.linalg.pinv(d[rows].T @ d[rows] / len(rows)) * d).sum(1), kind="stable")[:h]
        m = x[rows].mean(0)
        c = (x[rows] - m).T @ (x[rows] - m) / len(rows)
        found.setdefault(tuple(np.sort(rows)), (np.linalg.slogdet(c)[1], m, c))
    return [(m, c) for _, m, c in sorted(found.values(), key=lambda r: r[0])[:best]]


def robust_distances(x: np.ndarray, quantile, starts: int = 500, seed: int = 0) -> np.ndarray:
    """Squared distances by the minimum covariance determinant: random starts, two concentration steps, the best ten to the end, one reweighting."""
    n, p = x.shape
    h = -(-(n + p + 1) // 2)
    rng = np.random.default_rng(seed)

    def moved(rows: np.ndarray) -> np.ndarray:
        m = x[rows].mean(0)
        d = x - m
        return (d @ np.linalg.pinv(d[rows].T @ d[rows] / len(rows)) * d).sum(1)

    def size(rows: np.ndarray) -> float:
        return np.linalg.slogdet(np.cov(x[rows].T).reshape(p, p))[1]

    found = []
    for _ in range(starts):
        rows = rng.permutation(n)[: p + 1]
        for _ in range(2):
            rows = np.argsort(moved(rows), kind="stable")[:h]
        found.append((size(rows), rows))
    best = None
    for _, rows in sorted(found, key=lambda r: r[0])[:10]:
        while True:
            new = np.argsort(moved(rows), kind="stable")[:h]
            if set(new) == set(rows):
                break
            rows = new
        if best is None or size(rows) < best[0]:
            best = size(rows), rows
    d = moved(best[1])
    d = d * quantile(0.5, p) / np.median(d)
    good = np.flatnonzero(d <= quantile(0.975, p))
    return moved(good)
