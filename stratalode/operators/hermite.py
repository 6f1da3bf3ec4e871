"""A Hermite anamorphosis: from scores to values and back, to blocks, and the recoveries above cutoffs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hermite, total, value


def _polynomials(y: np.ndarray, degree: int) -> np.ndarray:
    h = [np.ones_like(y), -y]
    for n in range(1, degree):
        h.append(-(y * h[n] / math.sqrt(n + 1)) - math.sqrt(n / (n + 1)) * h[n - 1])
    return np.array(h[: degree + 1])


@dataclass(frozen=True)
class Anamorphosis:
    """Coefficients psi of normalised Hermite polynomials, and the least and largest value that it may give."""

    psi: tuple[float, ...]
    low: float = -math.inf
    high: float = math.inf

    @property
    def mean(self) -> float:
        return self.psi[0]

    @property
    def variance(self) -> float:
        return sum(p * p for p in self.psi[1:])

    def _at(self, y: np.ndarray) -> np.ndarray:
        return np.clip(np.array(self.psi) @ _polynomials(y, len(self.psi) - 1), self.low, self.high)

    def inverse_transform(self, score) -> Column:
        """The value of a score: the sum of polynomials, held between low and high."""
        z = total([F.lit(float(p)) * h for p, h in zip(self.psi, hermite(score, len(self.psi) - 1))])
        if math.isfinite(self.low):
            z = F.when(z.isNotNull(), F.greatest(z, F.lit(self.low)))
        return z if not math.isfinite(self.high) else F.when(z.isNotNull(), F.least(z, F.lit(self.high)))

    def transform(self, values, steps: int = 1000, reach: float = 5.0) -> Column:
        """The score of a value: linear between the nodes of a fixed table of scores, found by halving.

        The table is the anamorphosis made to rise (its running maximum), `steps` steps over -reach..reach.
        """
        y = np.linspace(-reach, reach, steps + 1)
        z = np.maximum.accumulate(self._at(y))
        nodes, v = F.array(*[F.lit(float(x)) for x in z]), value(values)
        jumps = F.array(*[F.lit(1 << i) for i in range(steps.bit_length() - 1, -1, -1)])
        # the last node that is not above the value
        at = F.aggregate(jumps, F.lit(0), lambda a, jump: F.when((a + jump <= steps) & (F.get(nodes, a + jump) <= v), a + jump).otherwise(a))
        low, high = F.get(nodes, at), F.get(nodes, F.least(at + 1, F.lit(steps)))
        score = -reach + (at + F.when(high > low, F.least((v - low) / (high - low), F.lit(1.0))).otherwise(0.0)) * (2 * reach / steps)
        return F.when(v.isNotNull(), F.when(v < float(z[0]), F.lit(-reach)).otherwise(score))

    def block(self, r: float) -> Anamorphosis:
        """Of a block whose score correlates by r with the point's: each coefficient times r to its degree."""
        if not 0 <= r <= 1:
            raise ValueError("r must be between 0 and 1")
        return Anamorphosis(tuple(p * r**n for n, p in enumerate(self.psi)), self.low, self.high)

    def support(self, variance: float) -> float:
        """The r at which blocks have this variance, by halving."""
        if not 0 <= variance <= self.variance:
            raise ValueError("the variance must be between 0 and the point's")
        low, high = 0.0, 1.0
        for _ in range(80):
            r = (low + high) / 2
            low, high = (r, high) if self.block(r).variance < variance else (low, r)
        return (low + high) / 2

    def score(self, z: float) -> float:
        """The score of one value, by halving."""
        low, high = -8.0, 8.0
        for _ in range(100):
            y = (low + high) / 2
            low, high = (y, high) if self._at(np.array([y]))[0] < z else (low, y)
        return (low + high) / 2

    def grade_tonnage(self, cutoffs: Sequence[float]) -> list[tuple[float, float, float, float]]:
        """(cutoff, tonnage, metal, grade) above each cutoff, tonnage as a share of all, in closed form."""
        out = []
        for c in cutoffs:
            y = self.score(float(c))
            g = math.exp(-y * y / 2) / math.sqrt(2 * math.pi)
            t = 0.5 * math.erfc(y / math.sqrt(2))
            h = _polynomials(np.array([y]), max(len(self.psi) - 1, 1))[:, 0]
            q = self.psi[0] * t - sum(p * h[n - 1] * g / math.sqrt(n) for n, p in enumerate(self.psi) if n)
            out.append((float(c), t, q, q / t if t > 0 else math.nan))
        return out


def fit(df: DataFrame, values, degree: int = 30, weights=None) -> Anamorphosis:
    """Coefficients of the sorted weighted values, which it keeps within their range."""
    from .transforms import anamorphosis

    r = df.agg(F.min(value(values)), F.max(value(values))).first()
    return Anamorphosis(tuple(anamorphosis(df, values, degree, weights)), r[0], r[1])


def block_correlation(variogram, size: Sequence[float], discretization: Sequence[int] = (4, 4, 1)) -> float:
    """The mean correlation between the points that discretize a block: its variance as a share of a point's."""
    axes = [(np.arange(n) + 0.5) / n * s for n, s in zip(discretization, size)]
    p = np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")], axis=1)
    h = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    return float(variogram.covariance(h).mean() / variogram.sill)


def change_of_support(anamorphosis: Anamorphosis, variogram, size: Sequence[float], discretization: Sequence[int] = (4, 4, 1)) -> tuple[float, Anamorphosis]:
    """(r, block anamorphosis) of the Gaussian model: r squared is the block's mean correlation of scores."""
    r = math.sqrt(block_correlation(variogram, size, discretization))
    return r, anamorphosis.block(r)
