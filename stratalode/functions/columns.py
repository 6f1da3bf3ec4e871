"""Column builders: null model, geometry, compositions, distributions, variogram shapes.

Null and NaN are one thing here; every entry point reads NaN as null with `value`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value(c: Column | str) -> Column:
    """As double, NaN as null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def divided(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


# ---- geometry


def direction(azimuth: float, dip: float = 0.0) -> tuple[float, float, float]:
    """Unit (east, north, up); dip positive down."""
    a, d = math.radians(azimuth), math.radians(dip)
    return math.cos(d) * math.sin(a), math.cos(d) * math.cos(a), -math.sin(d)


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(total([(p - q) * (p - q) for p, q in zip(a, b)]))


def floor_cell(c: Column | str, size: float, origin: float = 0.0) -> Column:
    return F.floor((col(c) - F.lit(float(origin))) / F.lit(float(size))).cast("long")


# ---- compositions; parts are positive columns of one row


def _positive(parts: Sequence[Column | str]) -> list[Column]:
    parts = [value(p) for p in parts]
    ok = reduce(lambda a, b: a & b, [p > 0 for p in parts])
    return [F.when(ok, p) for p in parts]


def closure(parts: Sequence[Column | str], whole: float = 1.0) -> list[Column]:
    """Parts as shares of `whole`; null where a part is missing or not positive."""
    parts = _positive(parts)
    s = total(parts)
    return [p / s * whole for p in parts]


def clr(parts: Sequence[Column | str]) -> list[Column]:
    logs = [F.ln(p) for p in _positive(parts)]
    mean = total(logs) / len(logs)
    return [x - mean for x in logs]


def clr_inverse(coords: Sequence[Column | str]) -> list[Column]:
    coords = [value(c) for c in coords]
    top = F.greatest(*coords) if len(coords) > 1 else coords[0]
    e = [F.exp(c - top) for c in coords]
    return [x / total(e) for x in e]


def alr(parts: Sequence[Column | str], reference: int | None = None) -> list[Column]:
    parts = _positive(parts)
    r = len(parts) - 1 if reference is None else reference
    return [F.ln(p / parts[r]) for i, p in enumerate(parts) if i != r]


def alr_inverse(coords: Sequence[Column | str], reference: int | None = None) -> list[Column]:
    e = [F.exp(value(c)) for c in coords]
    r = len(e) if reference is None else reference
    e.insert(r, F.lit(1.0))
    return [x / total(e) for x in e]


def ilr(parts: Sequence[Column | str], basis: Sequence[Sequence[float]] | None = None) -> list[Column]:
    """Pivot balances, or the rows of an orthonormal basis."""
    logs = [F.ln(p) for p in _positive(parts)]
    if basis is not None:
        return [total([float(b) * x for b, x in zip(row, logs)]) for row in basis]
    return [math.sqrt(i / (i + 1)) * (total(logs[:i]) / i - logs[i]) for i in range(1, len(logs))]


def ilr_basis(n: int) -> list[list[float]]:
    return [[math.sqrt(i / (i + 1)) / i] * i + [-math.sqrt(i / (i + 1))] + [0.0] * (n - i - 1) for i in range(1, n)]


def ilr_inverse(coords: Sequence[Column | str], basis: Sequence[Sequence[float]] | None = None) -> list[Column]:
    coords = [value(c) for c in coords]
    basis = basis or ilr_basis(len(coords) + 1)
    return clr_inverse([total([float(row[k]) * c for row, c in zip(basis, coords)]) for k in range(len(basis[0]))])


def partition_basis(signs: Sequence[Sequence[int]]) -> list[list[float]]:
    """Orthonormal balances of a binary partition: +1 and -1 groups of each row."""
    out = []
    for row in signs:
        r, s = sum(x > 0 for x in row), sum(x < 0 for x in row)
        if not r or not s:
            raise ValueError("each balance needs parts on both sides")
        out.append([math.sqrt(s / (r * (r + s))) if x > 0 else -math.sqrt(r / (s * (r + s))) if x < 0 else 0.0 for x in row])
    for i, a in enumerate(out):
        for b in out[:i]:
            if abs(sum(x * y for x, y in zip(a, b))) > 1e-9:
                raise ValueError("the rows are not a binary partition")
    return out


def replace_below_detection(parts: Sequence[Column | str], limits: Sequence[float], fraction: float = 0.65) -> list[Column]:
    """Parts under their limit become fraction * limit; the others shrink so that the row's total stays."""
    parts = [value(p) for p in parts]
    low = [p < float(d) for p, d in zip(parts, limits)]
    put = [F.when(b, F.lit(fraction * d)).otherwise(0.0) for b, d in zip(low, limits)]
    was = [F.when(b, p).otherwise(0.0) for b, p in zip(low, parts)]
    seen = total([F.when(b, 0.0).otherwise(p) for b, p in zip(low, parts)])
    factor = divided(seen - (total(put) - total(was)), seen)
    return [F.when(b, F.lit(fraction * d)).otherwise(p * factor) for b, p, d in zip(low, parts, limits)]


def perturbation(a: Sequence[Column | str], b: Sequence[Column | str]) -> list[Column]:
    return closure([x * y for x, y in zip(_positive(a), _positive(b))])


def powering(parts: Sequence[Column | str], alpha: float) -> list[Column]:
    return closure([F.pow(p, F.lit(float(alpha))) for p in _positive(parts)])


def aitchison_inner_product(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    return total([x * y for x, y in zip(clr(a), clr(b))])


def aitchison_norm(parts: Sequence[Column | str]) -> Column:
    return F.sqrt(aitchison_inner_product(parts, parts))


def aitchison_distance(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    return F.sqrt(total([(x - y) * (x - y) for x, y in zip(clr(a), clr(b))]))


# ---- distributions

#: Coefficients of the rational approximation of the normal quantile (Acklam).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_LOW = 0.02425


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda s, c: s * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_ppf(p: Column | str) -> Column:
    """Quantile of the standard normal by the rational approximation (1e-9); p outside (0, 1) is moved inside."""
    p = value(p)
    p = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-300)), F.lit(1 - 1.1102230246251565e-16)))
    tail = F.sqrt(-2 * F.ln(F.when(p < PPF_LOW, p).otherwise(1 - p)))
    ends = _horner(PPF_C, tail) / _horner((*PPF_D, 1.0), tail)
    q = p - 0.5
    r = q * q
    middle = _horner(PPF_A, r) * q / _horner((*PPF_B, 1.0), r)
    return F.when(p < PPF_LOW, ends).when(p > 1 - PPF_LOW, -ends).otherwise(middle)


#: Rational approximation of the normal tail (Hart), numerator and denominator.
CDF_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column | str) -> Column:
    """Distribution of the standard normal (1e-15); a short continued fraction beyond 7.07."""
    x = value(x)
    a = F.abs(x)
    density = F.exp(-a * a / 2)
    near = density * _horner(CDF_P, a) / _horner(CDF_Q, a)
    far = density / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * 2.506628274631)
    lower = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - lower).otherwise(lower)


def box_cox(z: Column | str, lam: float) -> Column:
    z = value(z)
    z = F.when(z > 0, z)
    return F.ln(z) if abs(lam) < 1e-9 else (F.pow(z, F.lit(float(lam))) - 1) / lam


def box_cox_inverse(y: Column | str, lam: float) -> Column:
    y = value(y)
    if abs(lam) < 1e-9:
        return F.exp(y)
    base = y * lam + 1
    return F.when(base > 0, F.pow(base, F.lit(1.0 / lam)))


def hermite(y: Column | str, degree: int) -> list[Column]:
    """Normalised Hermite polynomials H_0..H_degree with H_1 = -y."""
    y = value(y)
    out = [F.lit(1.0), -y]
    for n in range(1, degree):
        out.append(-y * out[n] / math.sqrt(n + 1) - math.sqrt(n / (n + 1)) * out[n - 1])
    return out[: degree + 1]


# ---- variogram shapes, of a lag in units of the range


def shape(model: str, t: Column, order: float | None = None, exponent: float | None = None) -> Column:
    """Share of the sill reached at t = distance / range."""
    one = F.lit(1.0)
    if model == "spherical":
        return F.when(t >= 1, one).otherwise(1.5 * t - 0.5 * t * t * t)
    if model == "exponential":
        return 1 - F.exp(-3 * t)
    if model == "gaussian":
        return 1 - F.exp(-3 * t * t)
    if model == "cubic":
        t2 = t * t
        return F.when(t >= 1, one).otherwise(t2 * (7 - 8.75 * t + 3.5 * t2 * t - 0.75 * t2 * t2 * t))
    if model == "pentaspherical":
        t3 = t * t * t
        return F.when(t >= 1, one).otherwise(1.875 * t - 1.25 * t3 + 0.375 * t3 * t * t)
    if model == "circular":
        inside = F.when(t < 1, t).otherwise(one)
        return F.when(t >= 1, one).otherwise(2 / math.pi * (inside * F.sqrt(1 - inside * inside) + F.asin(inside)))
    if model == "sine_hole":
        return F.when(t <= 0, 0.0).otherwise(1 - F.sin(math.pi * t) / (math.pi * F.when(t > 0, t)))
    if model == "matern":
        k = min((0.5, 1.5, 2.5), key=lambda x: abs(x - (order or 0.5)))
        s = t * {0.5: 3.0, 1.5: 4.744, 2.5: 5.918}[k]
        poly = {0.5: F.lit(1.0), 1.5: 1 + s, 2.5: 1 + s + s * s / 3}[k]
        return 1 - poly * F.exp(-s)
    if model == "power":
        return F.pow(t, F.lit(float(exponent or 1.0)))
    raise ValueError(f"unknown model {model!r}")
