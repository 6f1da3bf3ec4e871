"""Kriging: a nearest-neighbour join finds each target's samples, then local systems are solved in Arrow batches.

Systems of one size are stacked and solved at once by numpy; a singular one gives null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import shape, value
from .joins import nearest, points
from .near import by_place


@dataclass(frozen=True)
class Structure:
    model: str
    sill: float
    range: float
    order: float | None = None
    exponent: float | None = None


@dataclass(frozen=True)
class Variogram:
    nugget: float
    structures: Sequence[Structure]

    @property
    def sill(self) -> float:
        return self.nugget + sum(s.sill for s in self.structures)

    def gamma(self, h):
        """Column: nugget for any lag above 0, and the structures."""
        out = F.when(h > 0, self.nugget).otherwise(0.0)
        for s in self.structures:
            out = out + s.sill * shape(s.model, h / s.range, s.order, s.exponent)
        return out

    def covariance(self, h: np.ndarray) -> np.ndarray:
        out = np.where(h > 0, 0.0, self.nugget)
        for s in self.structures:
            out = out + s.sill * (1 - _shape(s, h / s.range))
        return out


def _shape(s: Structure, t: np.ndarray) -> np.ndarray:
    if s.model == "spherical":
        return np.where(t >= 1, 1.0, 1.5 * t - 0.5 * t**3)
    if s.model == "exponential":
        return 1 - np.exp(-3 * t)
    if s.model == "gaussian":
        return 1 - np.exp(-3 * t * t)
    if s.model == "cubic":
        return np.where(t >= 1, 1.0, 7 * t**2 - 8.75 * t**3 + 3.5 * t**5 - 0.75 * t**7)
    if s.model == "pentaspherical":
        return np.where(t >= 1, 1.0, 1.875 * t - 1.25 * t**3 + 0.375 * t**5)
    if s.model == "matern":
        k = min((0.5, 1.5, 2.5), key=lambda x: abs(x - (s.order or 0.5)))
        u = t * {0.5: 3.0, 1.5: 4.744, 2.5: 5.918}[k]
        return 1 - {0.5: 1.0, 1.5: 1 + u, 2.5: 1 + u + u * u / 3}[k] * np.exp(-u)
    raise ValueError(f"unknown model {s.model!r}")


def _drift(x: np.ndarray, degree: int) -> np.ndarray:
    """Monomials of offsets, (..., 3) to (..., terms)."""
    out = [np.ones(x.shape[:-1])]
    if degree >= 1:
        out += [x[..., i] for i in range(3)]
    if degree >= 2:
        out += [x[..., i] * x[..., j] for i in range(3) for j in range(i, 3)]
    return np.stack(out, axis=-1)


@dataclass(frozen=True)
class System:
    """kind: ordinary, simple (with mean), universal (degree) or block (size and discretization of the target)."""

    variogram: Variogram
    kind: str = "ordinary"
    mean: float = 0.0
    degree: int = 1
    size: tuple[float, float, float] | None = None
    discretization: tuple[int, int, int] = (4, 4, 1)

    def solve(self, x: np.ndarray, v: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x (m, n, 3), v (m, n), t (m, 3): estimate, variance and weights (m, n)."""
        c = self.variogram.covariance
        m, n, _ = x.shape
        a = c(np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(-1)))
        c0 = np.full(m, self.variogram.sill)
        if self.kind == "block":
            axes = [(np.arange(k) + 0.5) / k * s - s / 2 for k, s in zip(self.discretization, self.size)]
            nodes = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
            b = c(np.sqrt(((x[:, :, None] - t[:, None, None] - nodes) ** 2).sum(-1))).mean(-1)
            c0[:] = c(np.sqrt(((nodes[:, None] - nodes) ** 2).sum(-1))).mean()
        else:
            b = c(np.sqrt(((x - t[:, None]) ** 2).sum(-1)))
        if self.kind == "simple":
            f = np.zeros((m, n, 0))
            g = np.zeros((m, 0))
        else:
            f = _drift(x - t[:, None], self.degree if self.kind == "universal" else 0)
            g = np.zeros((m, f.shape[-1]))
            g[:, 0] = 1.0
        k = f.shape[-1]
        left = np.zeros((m, n + k, n + k))
        left[:, :n, :n], left[:, :n, n:], left[:, n:, :n] = a, f, f.transpose(0, 2, 1)
        right = np.concatenate([b, g], axis=1)
        try:
            w = np.linalg.solve(left, right[..., None])[..., 0]
        except np.linalg.LinAlgError:
            w = np.full((m, n + k), np.nan)
            for i in range(m):
                try:
                    w[i] = np.linalg.solve(left[i], right[i])
                except np.linalg.LinAlgError:
                    pass
        weights = w[:, :n]
        estimate = (weights * v).sum(-1) + ((1 - weights.sum(-1)) * self.mean if self.kind == "simple" else 0.0)
        return estimate, np.maximum(c0 - (w * right).sum(-1), 0), weights


def krige(targets: DataFrame, data: DataFrame, coords: Sequence, values, system: System, radius: float, k: int = 16, min_samples: int = 1, target_id: str = "id", data_id: str = "id", condition=None, spare: int | None = None, weights: bool = False) -> DataFrame:
    """id, estimate, variance, n of every target (null where fewer than min_samples or singular); optionally samples and weights.

    Samples at one place count once, the first by id. Targets at one place are solved once. For condition and spare see `nearest`.
    """
    t = points(targets, coords, [], target_id)
    if condition is None:
        return by_place(t, lambda places: _solved(places, data, coords, values, system, radius, k, min_samples, data_id, None, None, weights))
    return _solved(t, data, coords, values, system, radius, k, min_samples, data_id, condition, spare, weights)


def _solved(t: DataFrame, data: DataFrame, coords, values, system: System, radius: float, k: int, min_samples: int, data_id: str, condition, spare, weights: bool, cuts: Sequence[float] | None = None) -> DataFrame:
    """See `krige`; with cuts also `shares`, the estimates of the indicators of each."""
    s = points(data, coords, [value(values).alias("v")], data_id).filter("v is not null")
    first = Window.partitionBy("x", "y", "z").orderBy("id")
    s = s.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    near = nearest(t, s, k, radius, condition, spare)
    rows = near.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"), F.array_sort(F.collect_list(F.struct("rank", "id2", "x2", "y2", "z2", "v2"))).alias("s")).filter(F.size("s") >= min_samples)
    flat = rows.select("id", F.array("x", "y", "z").alias("t"), F.flatten(F.transform("s", lambda p: F.array(p["x2"], p["y2"], p["z2"]))).alias("p"), F.transform("s", lambda p: p["v2"]).alias("v"), F.transform("s", lambda p: p["id2"]).alias("samples"))

    def solved(batches):
        import pandas as pd

        for b in batches:
            size = b["v"].map(len)
            for n, part in b.groupby(size):
                x = np.stack(part["p"].to_list()).reshape(len(part), n, 3)
                e, var, w = system.solve(x, np.stack(part["v"].to_list()), np.stack(part["t"].to_list()))
                out = pd.DataFrame({"id": part["id"].to_numpy(), "estimate": e, "variance": var, "n": n})
                if cuts is not None:
                    v = np.stack(part["v"].to_list())
                    out["shares"] = list(np.stack([(w * (v <= c)).sum(-1) for c in cuts], axis=1)) if cuts else [[]] * len(out)
                if weights:
                    out["samples"], out["weights"] = list(part["samples"]), list(w)
                yield out.where(out.notna(), None) if np.isnan(e).any() else out

    done = flat.mapInPandas(solved, "id long, estimate double, variance double, n long" + ", shares array<double>" * (cuts is not None) + ", samples array<long>, weights array<double>" * weights)
    out = t.select("id").join(done, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out


def cross_validate(data: DataFrame, coords: Sequence, values, system: System, radius: float, k: int = 16, id: str = "id", folds: int | None = None, holes=None) -> DataFrame:
    """id, truth, estimate, variance: each sample from the others, or from other folds (whole holes, dealt in order)."""
    if folds is None:
        condition = F.col("id") != F.col("id2")
        est = krige(data, data, coords, values, system, radius, k, 1, id, id, condition, 1)
    else:
        key = F.col(id) if holes is None else F.col(holes)
        fold = data.select(key.alias("_k")).distinct().withColumn("_f", (F.row_number().over(Window.orderBy("_k")) - 1) % folds)
        tagged = data.join(fold, key == F.col("_k"))
        est = None
        for f in range(folds):
            one = krige(tagged.filter(F.col("_f") == f), tagged.filter(F.col("_f") != f), coords, values, system, radius, k, 1, id, id)
            est = one if est is None else est.unionByName(one)
    truth = data.select(F.col(id).alias("id"), value(values).alias("truth"))
    return est.join(truth, "id").select("id", "truth", "estimate", "variance")


def indicator_krige(targets: DataFrame, data: DataFrame, coords: Sequence, values, thresholds: Sequence[float], variogram: Variogram, radius: float, k: int = 16, target_id: str = "id", data_id: str = "id") -> DataFrame:
    """id, threshold, cdf: ordinary kriging of each indicator, clamped, order corrected by the mean of the upward running maximum and the downward running minimum.

    The indicators share their samples and weights: one search and one solution for all thresholds.
    """
    cuts = [float(c) for c in thresholds]
    t = points(targets, coords, [], target_id)
    out = by_place(t, lambda places: _solved(places, data, coords, values, System(variogram), radius, k, 1, data_id, None, None, False, cuts))
    each = [F.struct(F.lit(c).alias("threshold"), F.get("shares", F.lit(i)).alias("estimate")) for i, c in enumerate(cuts)]
    out = out.select("id", F.inline(F.array(*each))).select("id", "threshold", F.least(F.greatest("estimate", F.lit(0.0)), F.lit(1.0)).alias("cdf"))
    w = Window.partitionBy("id").orderBy("threshold")
    up = F.max("cdf").over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.min("cdf").over(w.rowsBetween(0, Window.unboundedFollowing))
    return out.select("id", "threshold", ((up + down) / 2).alias("cdf"))


def fit_variogram(experimental: DataFrame, model: str = "spherical", ranges: Sequence[float] | None = None, weighting: str = "count") -> Variogram:
    """Weighted least squares on the few rows of an experimental variogram: a grid over ranges, nugget and sill not negative."""
    rows = [(r.lag, r.gamma, r.pairs) for r in experimental.select("lag", "gamma", "pairs").orderBy("lag").collect()]
    h, g, n = (np.array(x, float) for x in zip(*rows))
    w = n if weighting == "count" else n / h**2 if weighting == "distance" else np.ones(len(h))
    best = None
    for r in ranges or np.linspace(h.max() / 20, h.max() * 1.5, 60):
        s = _shape(Structure(model, 1.0, r), h / r)
        for use in ((0, 1), (0,), (1,)):  # the exact non-negative solution is one of these
            a = np.stack([np.ones(len(h)), s], axis=1)[:, use]
            c = np.linalg.lstsq(a * np.sqrt(w)[:, None], g * np.sqrt(w), rcond=None)[0]
            if (c < 0).any():
                continue
            full = np.zeros(2)
            full[list(use)] = c
            e = float((w * (g - full[0] - full[1] * s) ** 2).sum())
            if best is None or e < best[0] - 1e-12:
                best = (e, full[0], full[1], float(r))
    return Variogram(float(best[1]), (Structure(model, float(best[2]), best[3]),))


def simulate_bands(targets: DataFrame, variogram: Variogram, n: int, seed: int = 0, bands: int = 200, id: str = "id") -> DataFrame:
    """realization, id, value: unconditional Gaussian fields by random cosines, of spherical, exponential, gaussian or matern structures; a value depends on seed, realization and place only.

    One row of each target goes through numpy for all realizations of its batch; nothing is shared between tasks.
    """
    t = points(targets, ["x", "y", "z"], [], id).select("id", "x", "y", "z")
    structures = tuple(variogram.structures)

    def field(batches):
        import pandas as pd

        for b in batches:
            p = b[["x", "y", "z"]].to_numpy()
            for r in range(n):
                rng = np.random.Generator(np.random.Philox(key=[seed, r]))
                out = np.zeros(len(p))
                for s in structures:
                    out += math.sqrt(s.sill) * math.sqrt(2 / bands) * np.cos(p @ _frequencies(s, bands, rng).T + rng.uniform(0, 2 * math.pi, bands)).sum(-1)
                if variogram.nugget:
                    noise = np.array([np.random.Generator(np.random.Philox(key=[seed, (r << 40) ^ (int(i) & 0xFFFFFFFFFF)])).standard_normal() for i in b["id"]])
                    out += math.sqrt(variogram.nugget) * noise
                yield pd.DataFrame({"realization": r, "id": b["id"].to_numpy(), "value": out})

    return t.mapInPandas(field, "realization long, id long, value double")


def _frequencies(s: Structure, bands: int, rng) -> np.ndarray:
    """Frequencies drawn from the spectrum of the structure's covariance in three dimensions."""
    z = rng.standard_normal((bands, 3))
    if s.model == "gaussian":
        return z * math.sqrt(6) / s.range
    if s.model == "exponential":
        return z / np.sqrt(rng.gamma(0.5, 2.0, bands))[:, None] * 3 / s.range  # a Cauchy spectrum
    if s.model == "matern":  # Student's t with 2 nu degrees of freedom; nu as _shape takes it
        nu = min((0.5, 1.5, 2.5), key=lambda x: abs(x - (s.order or 0.5)))
        return z / np.sqrt(rng.gamma(nu, 2.0, bands))[:, None] * {0.5: 3.0, 1.5: 4.744, 2.5: 5.918}[nu] / s.range
    if s.model == "spherical":  # the ball's transform squared: the radius times range / 2 has density j1(x) ** 2
        x = np.zeros(0)
        while len(x) < bands:
            y = np.maximum(2.0 * np.abs(np.tan(math.pi * (rng.random(4 * bands) - 0.5))), 1e-3)  # 1.8 / (4 + y ** 2) bounds j1(y) ** 2
            x = np.append(x, y[rng.random(4 * bands) * 1.8 / (4 + y * y) < ((np.sin(y) / y - np.cos(y)) / y) ** 2])
        return z / np.sqrt((z * z).sum(-1))[:, None] * (x[:bands, None] * 2 / s.range)
    raise ValueError(f"no spectrum for model {s.model!r}")


def summarize(realizations: DataFrame, cutoffs: Sequence[float] = (), quantiles: Sequence[float] = ()) -> DataFrame:
    """id, mean, variance, P(value >= cutoff), mean above it and quantiles over the realizations of each target."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")]
    for i, c in enumerate(cutoffs):
        above = F.col("value") >= float(c)
        aggs += [F.avg(above.cast("double")).alias(f"p_above{i}"), F.avg(F.when(above, F.col("value"))).alias(f"mean_above{i}")]
    aggs += [F.percentile("value", float(q)).alias(f"q{i}") for i, q in enumerate(quantiles)]
    return realizations.groupBy("id").agg(*aggs)
