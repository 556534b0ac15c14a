"""Numeric kernels for grouped pandas work and small driver-side systems, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths with potentials."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j_last = row, -1
        while True:
            slack = c[i] - u[i] - v
            low = 0.0 if j_last < 0 else reach[j_last]
            better = ~done & (low + slack < reach - 1e-15)
            reach[better], parent[better] = low + slack[better], j_last
            j = int(np.argmin(np.where(done, np.inf, reach)))
            done[j] = True
            if owner[j] < 0:
                break
            i, j_last = int(owner[j]), j
        short = reach[j]
        for k in np.flatnonzero(done):
            if k != j:
                v[k] += reach[k] - short
                u[owner[k]] += short - reach[k]
        u[row] += short
        while j >= 0:
            previous = int(parent[j])
            owner[j] = row if previous < 0 else owner[previous]
            j = previous
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) for a, b in pairs) if flipped else sorted(pairs)


def least_squares(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 60, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Damped Gauss-Newton (Levenberg-Marquardt) with forward differences; parameters and the sum of squares."""
    x, damping = np.array(start, float), 1e-3
    r = f(x)
    best = float(r @ r)
    for _ in range(rounds):
        step = 1e-7 * np.maximum(1.0, np.abs(x))
        jac = np.stack([(f(x + np.eye(len(x))[k] * step[k]) - r) / step[k] for k in range(len(x))], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        for _ in range(12):
            move = np.linalg.lstsq(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
            new = f(x + move)
            value = float(new @ new)
            if np.isfinite(value) and value < best:
                break
            damping *= 4
        else:
            break
        gain, x, r, best, damping = best - value, x + move, new, value, damping / 4
        if gain <= tolerance * max(best, 1e-300):
            break
    return x, best


def simplex_search(f: Callable[[np.ndarray], float], start: np.ndarray, size: float | np.ndarray = 0.1, rounds: int = 400, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Downhill simplex (Nelder-Mead)."""
    start = np.array(start, float)
    points = np.vstack([start, start + np.diag(np.broadcast_to(size, start.shape))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * (abs(values[0]) + tolerance):
            break
        middle = points[:-1].mean(axis=0)
        mirrored = middle + (middle - points[-1])
        at = f(mirrored)
        if at < values[0]:
            further = middle + 2 * (middle - points[-1])
            far = f(further)
            points[-1], values[-1] = (further, far) if far < at else (mirrored, at)
        elif at < values[-2]:
            points[-1], values[-1] = mirrored, at
        else:
            inner = middle + 0.5 * ((mirrored if at < values[-1] else points[-1]) - middle)
            near = f(inner)
            if near < min(at, values[-1]):
                points[-1], values[-1] = inner, near
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], float(values[k])


def nonnegative(a: np.ndarray | Callable[[np.ndarray], np.ndarray], b: np.ndarray, sizes: np.ndarray | None = None, tolerance: float = 1e-12) -> np.ndarray:
    """Non-negative least squares on the normal equations ``a`` x = ``b`` (a symmetric, or its product with a vector and ``sizes``, its diagonal), by conjugate gradients on the free columns, which are let go and held as their gradients say.

    It ends where the gradient of what is free, and what is negative of the rest, is ``tolerance`` of b; an error is raised if that can't be reached nearly.
    """
    product = a if callable(a) else a.__matmul__
    d = np.diag(a) if sizes is None else sizes
    scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
    b = np.asarray(b, float) * scale

    def times(v: np.ndarray) -> np.ndarray:
        return scale * product(scale * v)

    def free(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.where(x > 0, g, 0.0)

    x, g, widest, best, since, small = np.zeros(len(b)), -b, 0.0, np.inf, 0, tolerance * float(np.linalg.norm(b))
    p = free(x, g)
    while True:
        f, held = free(x, g), np.where((x <= 0) & (g < 0), g, 0.0)
        left = float(np.linalg.norm(f + held))
        if left <= small:
            # what was added up step by step is computed anew before it is believed
            g = times(x) - b
            f, held = free(x, g), np.where((x <= 0) & (g < 0), g, 0.0)
            if np.linalg.norm(f + held) <= 2 * small:
                return x * scale
            p, left = f, float(np.linalg.norm(f + held))
        best, since = (left, 0) if left < best / 2 else (best, since + 1)
        if since > 1000:
            if best <= 1e4 * small:
                return x * scale
            raise ArithmeticError(f"non-negative least squares didn't settle: {best / max(small, 1e-300) * tolerance:.1e} of the right side is left")
        if held @ held > f @ f:
            move = times(held)
            step = (g @ held) / (held @ move)
            x, g = np.maximum(x - step * held, 0.0), g - step * move
            p = free(x, g)
            continue
        move = times(p)
        bend = float(p @ move)
        if bend <= 0:
            p, g = f, times(x) - b
            continue
        step, widest = float(g @ p) / bend, max(widest, bend / float(p @ p))
        falls = p > 0
        room = float((x[falls] / p[falls]).min()) if falls.any() else np.inf
        if step <= room:
            x, g = np.maximum(x - step * p, 0.0), g - step * move
            f = free(x, g)
            p = f - (f @ move) / bend * p
            continue
        # the nearest bound stops the step; a step down the gradient from there, cut at the bounds, holds many columns at once
        x, g = np.maximum(x - room * p, 0.0), g - room * move
        x[falls & (x <= 1e-15 * room * p)] = 0.0
        value, f = x @ g - x @ b, free(x, g)
        while True:
            y = np.maximum(x - f / widest, 0.0)
            h = times(y) - b
            if y @ h - y @ b <= value + 1e-14 * abs(value):
                break
            widest *= 2
        x, g = y, h
        p = free(x, g)


def strain_of_spacings(normals: np.ndarray, strains: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Six strain parts (Voigt order, tensor shears) from relative spacing changes along unit normals, by least squares."""
    x, y, z = normals.T
    design = np.stack([x * x, y * y, z * z, 2 * y * z, 2 * x * z, 2 * x * y], axis=1)
    w = np.ones(len(x)) if weights is None else np.sqrt(weights)
    return np.linalg.lstsq(design * w[:, None], strains * w, rcond=None)[0]


def mixture_of_two(x: np.ndarray, n: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Two-Gaussian mixture of weighted values by expectation-maximisation: shares, means, deviations, its BIC and that of a single Gaussian."""
    n = np.ones(len(x)) if n is None else n
    total = n.sum()
    mean, deviation = (n @ x) / total, np.sqrt(max((n @ (x - (n @ x) / total) ** 2) / total, 1e-12))
    mu, sd, share = np.array([mean - deviation, mean + deviation]), np.full(2, deviation), np.full(2, 0.5)
    for _ in range(rounds):
        density = share / (sd * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2)
        whole = np.maximum(density.sum(axis=1, keepdims=True), 1e-300)
        part = density / whole * n[:, None]
        size = np.maximum(part.sum(axis=0), 1e-12)
        new = (part * x[:, None]).sum(axis=0) / size
        sd = np.sqrt(np.maximum((part * (x[:, None] - new) ** 2).sum(axis=0) / size, 1e-8))
        moved, mu, share = np.abs(new - mu).max(), new, size / total
        if moved < 1e-9:
            break
    two = -2 * float(n @ np.log(whole[:, 0])) + 5 * np.log(total)
    one = float(total * (np.log(2 * np.pi * deviation**2) + 1)) + 2 * np.log(total)
    return share, mu, sd, two, one


def label_blobs(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a boolean image, numbered from 1 in reading order."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(np.where(label > 0, label, mask.size + 1), 1, constant_values=mask.size + 1)
        low = np.min([padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, low, 0)
        if (new == label).all():
            break
        label = new
    kinds = np.unique(label[label > 0])
    return np.where(label > 0, np.searchsorted(kinds, label) + 1, 0)


def filtered_back_projection(sinogram: np.ndarray, angles: np.ndarray, window: str = "ramp") -> np.ndarray:
    """Slice (n, n) of a parallel-beam sinogram (angles, n), angles in radians."""
    views, n = sinogram.shape
    size = 1 << (2 * n - 1).bit_length()
    k = np.fft.fftfreq(size)
    ramp = 2 * np.abs(k) * (np.cos(np.pi * k) if window == "cosine" else 1.0)
    filtered = np.fft.ifft(np.fft.fft(sinogram, size, axis=1) * ramp, axis=1).real[:, :n]
    grid = np.arange(n) - (n - 1) / 2
    x, y = np.meshgrid(grid, grid)
    out = np.zeros((n, n))
    for row, a in zip(filtered, angles, strict=True):
        out += np.interp(x * np.cos(a) + y * np.sin(a) + (n - 1) / 2, np.arange(n), row, left=0, right=0)
    return out * np.pi / (2 * views)


def projection_matrix(n: int, angles: np.ndarray) -> np.ndarray:
    """Dense (views * n, n * n) matrix of linear-interpolated projections; for small slices."""
    grid = np.arange(n) - (n - 1) / 2
    x, y = (v.ravel() for v in np.meshgrid(grid, grid))
    out = np.zeros((len(angles) * n, n * n))
    for k, a in enumerate(angles):
        t = x * np.cos(a) + y * np.sin(a) + (n - 1) / 2
        low = np.floor(t).astype(int)
        for place, share in ((low, 1 - (t - low)), (low + 1, t - low)):
            fine = (place >= 0) & (place < n)
            np.add.at(out, (k * n + place[fine], np.flatnonzero(fine)), share[fine])
    return out


def iterate_slice(a: np.ndarray, b: np.ndarray, rounds: int, method: str = "sirt") -> np.ndarray:
    """Solution of a x = b by simultaneous reconstruction ("sirt") or expectation-maximisation ("mlem")."""
    rows, columns = np.maximum(a.sum(axis=1), 1e-12), np.maximum(a.sum(axis=0), 1e-12)
    x = np.zeros(a.shape[1]) if method == "sirt" else np.ones(a.shape[1])
    for _ in range(rounds):
        if method == "sirt":
            x = np.maximum(x + a.T @ ((b - a @ x) / rows) / columns, 0)
        else:
            x = x * (a.T @ (b / np.maximum(a @ x, 1e-12))) / columns
    return x


def prominences(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points on its two sides before a higher value."""
    out = np.empty(len(at))
    for k, i in enumerate(at):
        left = np.flatnonzero(y[:i] > y[i])
        right = np.flatnonzero(y[i + 1 :] > y[i])
        a, b = (left[-1] if len(left) else 0), (i + 1 + right[0] if len(right) else len(y) - 1)
        out[k] = y[i] - max(y[a : i + 1].min(), y[i : b + 1].min())
    return out
