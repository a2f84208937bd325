"""Spherical Bessel (radial Fourier) transforms, by direct summation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F


def quadrature_weights(x: np.ndarray, integration: str = "uniform") -> np.ndarray:
    """Trapezoid weights, or Simpson's on a uniform grid; an even number of points ends with a cubic correction."""
    x = np.asarray(x, float)
    if x.ndim != 1 or len(x) < 2 or not np.isfinite(x).all() or (np.diff(x) <= 0).any():
        raise ValueError("coordinates must be a finite, strictly increasing grid of two points or more")
    n, h = len(x), np.diff(x)
    w = np.zeros(n)
    if integration == "uniform":
        w[:-1] += h / 2
        w[1:] += h / 2
        return w
    if integration != "simpson":
        raise ValueError("integration must be 'uniform' or 'simpson'")
    if n == 2:
        return np.array([h[0] / 2, h[0] / 2])
    last = n - 1 if n % 2 else n - 2
    for k in range(0, last - 1, 2):
        a, b = h[k], h[k + 1]
        w[k] += (a + b) / 6 * (2 - b / a)
        w[k + 1] += (a + b) ** 3 / (6 * a * b)
        w[k + 2] += (a + b) / 6 * (2 - a / b)
    if n % 2 == 0:  # the last interval, from the parabola through the last three points
        a, b = h[-1], h[-2]
        w[-1] += (2 * a * a + 3 * a * b) / (6 * (b + a))
        w[-2] += (a * a + 3 * a * b) / (6 * b)
        w[-3] -= a**3 / (6 * b * (b + a))
    return w


def spherical_bessel_transform(coordinates, values, output_grid, *, backend="zoomfft", integration="uniform", chunk_size=512) -> np.ndarray:
    """Integral of x^2 f(x) sin(xy)/(xy) dx of curves on a driver-side grid.  Both back ends name the one direct sum."""
    if backend not in ("zoomfft", "direct"):
        raise ValueError("backend must be 'zoomfft' or 'direct'")
    if int(chunk_size) < 1:
        raise ValueError("chunk_size must be positive")
    x, y = np.asarray(coordinates, float), np.asarray(output_grid, float)
    f = np.asarray(values, float)
    one = f.ndim == 1
    f = f[:, None] if one else f
    w = quadrature_weights(x, integration)
    if f.ndim != 2 or len(f) != len(x) or not np.isfinite(f).all():
        raise ValueError("values must be finite with one row per coordinate")
    if y.ndim != 1 or not len(y) or not np.isfinite(y).all() or (y < 0).any():
        raise ValueError("output_grid must be finite, nonnegative and one-dimensional")
    weighted = f * (w * x * x)[:, None]
    out = np.concatenate([np.sinc(np.outer(y[k : k + chunk_size], x) / np.pi) @ weighted for k in range(0, len(y), int(chunk_size))])
    return out[:, 0] if one else out


def bessel_transform(curves: DataFrame, targets: DataFrame, source: str, target: str) -> DataFrame:
    """(target, label, value) from curves (source, label, value, weight): every target meets every point of its curves, summed in place."""
    x, y = F.col(source), F.col(target)
    kernel = F.when(x * y == 0, 1.0).otherwise(F.sin(x * y) / (x * y))
    joined = curves.crossJoin(F.broadcast(targets))  # a grid of some hundred points, made from the request
    return joined.groupBy(target, "label").agg(F.sum(F.col("weight") * x * x * F.col("value") * kernel).alias("value"))


def number_density(composition_masses: dict[str, float], amounts: dict[str, float], mass_density: float) -> float:
    """Atoms per cubic angstrom from grams per cubic centimeter."""
    from tesserspark.functions.constants import AVOGADRO

    if not math.isfinite(mass_density) or mass_density <= 0:
        raise ValueError("mass_density must be finite and positive")
    total = sum(amounts.values())
    mean = sum(composition_masses[s] * n for s, n in amounts.items()) / total
    return AVOGADRO * mass_density / mean / 1e24
