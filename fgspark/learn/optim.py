"""Minimization on the driver; the function evaluates value and gradient, usually as a distributed job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Function = Callable[[np.ndarray], tuple[float, np.ndarray]]


def wolfe_step(f: Function, x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, start: float = 1.0, c1: float = 1e-4, c2: float = 0.9, tries: int = 60):
    """A step length with enough decrease and little slope left, by bracketing: (step, x, value, gradient)."""
    slope, low, high, step = float(grad @ way), 0.0, np.inf, start
    for _ in range(tries):
        new = x + step * way
        v, g = f(new)
        if not np.isfinite(v) or v > value + c1 * step * slope:
            high = step
        elif float(g @ way) < c2 * slope:
            low = step
        else:
            break
        step = (low + high) / 2 if np.isfinite(high) else 2 * step
    return step, new, v, g


def lbfgs(f: Function, x: np.ndarray, tol: float = 1e-5, max_iter: int = 0, memory: int = 50) -> tuple[np.ndarray, float]:
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(max_iter or 100_000):
        if np.linalg.norm(grad) < tol:
            break
        way, kept = -grad, []
        for s, y in reversed(pairs):
            a = float(s @ way) / float(y @ s)
            way = way - a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            way = way * float(s @ y) / float(y @ y)
        for (s, y), a in zip(pairs, reversed(kept)):
            way = way + s * (a - float(y @ way) / float(y @ s))
        if grad @ way >= 0:
            way, pairs = -grad, []
        start = 1.0 if pairs else min(1.0, 1 / max(np.linalg.norm(grad), 1e-12))
        _, new, v, g = wolfe_step(f, x, value, grad, way, start)
        if not v < value:
            break
        s, y = new - x, g - grad
        if float(s @ y) >= 1e-12 * float(y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        x, value, grad = new, v, g
    return x, value


def backtracking(f: Function, x: np.ndarray, tol: float = 1e-5, max_iter: int = 0, shrink: float = 0.5, enough: float = 1e-4) -> tuple[np.ndarray, float]:
    """Steepest descent; a step that does not bring enough is shortened, and the next starts at twice the last length."""
    value, grad = f(x)
    step = 1.0
    for _ in range(max_iter or 100_000):
        square = float(grad @ grad)
        if square < tol * tol:
            break
        for _ in range(60):
            new = x - step * grad
            v, g = f(new)
            if v <= value - enough * step * square:
                break
            step *= shrink
        else:
            break
        x, value, grad, step = new, v, g, step / shrink
    return x, value


def barzilai_borwein(f: Function, x: np.ndarray, tol: float = 1e-5, max_iter: int = 0) -> tuple[np.ndarray, float]:
    value, grad = f(x)
    if np.linalg.norm(grad) < tol:
        return x, value
    _, new, v, g = wolfe_step(f, x, value, grad, -grad, min(1.0, 1 / np.linalg.norm(grad)))
    best = min((value, x), (v, new), key=lambda p: p[0])
    for _ in range(max_iter or 100_000):
        s, y = new - x, g - grad
        x, grad = new, g
        if np.linalg.norm(grad) < tol:
            break
        sy = float(s @ y)
        new = x - grad * (float(s @ s) / sy if sy > 1e-300 else 1e-3)
        v, g = f(new)
        best = min(best, (v, new), key=lambda p: p[0])
    return best[1], best[0]


def gradient(f: Function, x: np.ndarray, tol: float = 1e-5, max_iter: int = 0, step: float = 1.0) -> tuple[np.ndarray, float]:
    """Steps along the gradient, halved whenever it turns around."""
    value, grad = f(x)
    best = value, x
    for _ in range(max_iter or 100_000):
        if np.linalg.norm(grad) < tol:
            break
        x = x - step * grad
        v, g = f(x)
        if float(g @ grad) < 0:
            step /= 2
        grad = g
        best = min(best, (v, x), key=lambda p: p[0])
    return best[1], best[0]


def subgradient(f: Function, x: np.ndarray, max_iter: int = 100) -> tuple[np.ndarray, float]:
    best = f(x)[0], x
    for k in range(max_iter):
        _, g = f(x)
        x = x - 201 / (k + 201) / max(float(g @ g), 1e-12) * g
        best = min(best, (f(x)[0], x), key=lambda p: p[0])
    return best[1], best[0]


def fista(f: Function, value_of: Callable[[np.ndarray], float], prox: Callable[[np.ndarray, float], np.ndarray], x: np.ndarray, tol: float = 1e-6, max_iter: int = 1000) -> tuple[np.ndarray, float]:
    """f smooth plus value_of with a proximal step; the smoothness is found by doubling."""
    y, t, smooth = x, 1.0, 0.25
    for _ in range(max_iter):
        v, g = f(y)
        while True:
            new = prox(y - g / smooth, smooth)
            d = new - y
            if f(new)[0] <= v + float(g @ d) + smooth / 2 * float(d @ d) + 1e-12:
                break
            smooth *= 2
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        moved, x, t = np.linalg.norm(new - x), new, after
        if moved < tol:
            break
    return x, f(x)[0] + value_of(x)


def stochastic_subgradient(parts: list[Function], x: np.ndarray, epochs: int = 50, weight: float = 1.0, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for e in range(epochs):
        for i in rng.integers(len(parts), size=len(parts)):
            x = x - 1 / (e + 1) * (weight * x / len(parts) + parts[i](x)[1]) / len(parts)
    return x


def gradient_error(f: Function, x: np.ndarray, seed: int = 0, step: float = 1e-5) -> float:
    """Difference of the gradient and a central difference in one random coordinate."""
    i = int(np.random.default_rng(seed).integers(len(x)))
    e = np.zeros_like(x)
    e[i] = step
    return float(abs((f(x + e)[0] - f(x - e)[0]) / (2 * step) - f(x)[1][i]))


def simplex_projection(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative entries that add up to 1."""
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    k = int(np.flatnonzero(u > over)[-1])
    return np.maximum(v - over[k], 0)


def simplex_quadratic(q: np.ndarray, b: np.ndarray, tol: float = 1e-10, max_iter: int = 2000, memory: int = 10) -> tuple[np.ndarray, float]:
    """The point x of the simplex that maximizes b'x - x'qx / 2, and a bound below that maximum (its value).

    Spectral projected gradients: steps of Barzilai-Borwein length are projected, and shortened until they bring enough
    over the worst of the last values.
    """
    f = lambda x: float(x @ q @ x) / 2 - float(b @ x)
    x = np.full(len(b), 1 / len(b))
    grad, step = q @ x - b, 1.0
    past = [f(x)]
    best = past[0], x
    for _ in range(max_iter):
        way = simplex_projection(x - step * grad) - x
        slope = float(grad @ way)
        if float(grad @ x) - grad.min() < tol:  # the duality gap
            break
        length, worst = 1.0, max(past[-memory:])
        while f(x + length * way) > worst + 1e-4 * length * slope and length > 1e-12:
            length /= 2
        new = x + length * way
        slopes = q @ new - b
        s, y = new - x, slopes - grad
        sy = float(s @ y)
        step = min(max(float(s @ s) / sy, 1e-8), 1e8) if sy > 1e-300 else 1.0
        x, grad = new, slopes
        past.append(f(x))
        best = min(best, (past[-1], x), key=lambda p: p[0])
    return best[1], -best[0]
