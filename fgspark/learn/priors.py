"""Priors over weight vectors: value and gradient of -log p(w), and proximal steps."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Normal:
    sigma: float

    def neg_log(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        value = float(w @ w) / (2 * self.sigma**2) + len(w) * math.log(self.sigma * math.sqrt(2 * math.pi))
        return value, w / self.sigma**2

    def prox(self, u: np.ndarray, strength: float) -> np.ndarray:
        """Minimizer of -log p(w) + strength / 2 |w - u|^2."""
        return u * strength / (strength + 1 / self.sigma**2)

    def dual(self, u: np.ndarray) -> tuple[float, np.ndarray]:
        """Fenchel dual of -log p and its gradient."""
        return self.sigma**2 * float(u @ u) / 2 - len(u) * math.log(self.sigma * math.sqrt(2 * math.pi)), self.sigma**2 * u


@dataclass(frozen=True)
class Laplace:
    """p(w) ~ exp(-|w| / (2 sigma^2)), normalised."""

    sigma: float

    def neg_log(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        b = 2 * self.sigma**2
        return float(np.abs(w).sum()) / b + len(w) * math.log(2 * b), np.sign(w) / b

    def prox(self, u: np.ndarray, strength: float) -> np.ndarray:
        return np.sign(u) * np.maximum(np.abs(u) - 1 / (2 * self.sigma**2 * strength), 0)


@dataclass(frozen=True)
class StudentT:
    """Multivariate, isotropic."""

    dof: float
    sigma: float

    def neg_log(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        d, n, s2 = len(w), self.dof, self.sigma**2
        q = float(w @ w) / (n * s2)
        const = math.lgamma(n / 2) - math.lgamma((n + d) / 2) + d / 2 * math.log(n * math.pi * s2)
        return const + (n + d) / 2 * math.log1p(q), (n + d) / (n * s2) * w / (1 + q)


def log_bessel_k(order: float, x: float) -> float:
    """ln K_order(x), by the integral of exp(-x cosh t) cosh(order t) from 0 on."""
    t = np.linspace(0, 30, 60_001)
    y = -x * np.cosh(np.minimum(t, 700)) + np.logaddexp(order * t, -order * t) - math.log(2)
    top = y.max()
    return float(top + math.log(np.trapezoid(np.exp(y - top), t)))


@dataclass(frozen=True)
class Hyperbolic:
    """p(w) ~ exp(-alpha sqrt(delta^2 + w'w)); the gradient is that of this density."""

    alpha: float = 1.0
    delta: float = 1.0

    def neg_log(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        d, r = len(w), math.sqrt(self.delta**2 + float(w @ w))
        nu = (d + 1) / 2
        const = math.log(2) + (nu - 1) * math.log(2 * math.pi) + nu * math.log(self.delta) + log_bessel_k(nu, self.alpha * self.delta) - (nu - 1) * math.log(self.alpha)
        return const + self.alpha * r, self.alpha * w / r
