"""Distribution transforms, declustering, support corrections, trends, rotations of several variables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import box_cox, divided, normal_ppf, total, value
from .eda import _weight, valued
from .ranks import between, cumulative, joined, weighted_quantiles


def normal_score_table(df: DataFrame, values, weights=None, order: Sequence = ()) -> DataFrame:
    """value, score, p of each row: the normal quantile of the middle of its ordered weight; ties keep `order`.

    Weights up to 1e-10 of the greatest are left out.
    """
    t = df.select(value(values).alias("value"), _weight(weights).alias("w"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).filter("value is not null and w is not null")
    t = joined(t, t.agg(F.max("w").alias("_m")), []).filter("w > 1e-10 * _m").drop("_m")
    t = joined(t, cumulative(t, [], "value", "w").select("value", "_below", "_whole"), ["value"])
    ties = Window.partitionBy("value").orderBy(*[f"o{i}" for i in range(len(order))], "w").rowsBetween(Window.unboundedPreceding, 0)
    p = (F.col("_below") + F.sum("w").over(ties) - F.col("w") / 2) / F.col("_whole")
    return t.select("value", p.alias("p")).withColumn("score", normal_ppf("p"))


def normal_score_nodes(table: DataFrame) -> DataFrame:
    """One row per distinct value: the mean score and p of its ties."""
    return table.groupBy("value").agg(F.avg("score").alias("score"), F.avg("p").alias("p"))


def normal_score(df: DataFrame, x, nodes: DataFrame, out: str = "score") -> DataFrame:
    return between(df, value(x), nodes, "value", "score", out)


def normal_score_inverse(df: DataFrame, y, nodes: DataFrame, out: str = "value_") -> DataFrame:
    return between(df, value(y), nodes, "score", "value", out)


def cell_declustering(df: DataFrame, coords: Sequence, size: float, offsets: int = 25, id: str = "id") -> DataFrame:
    """id, weight: inverse of the samples in each cell, averaged over shifted origins, adding up to the number of samples."""
    cols = [value(c).alias(n) for n, c in zip("xyz", coords)] + [F.lit(0.0).alias(n) for n in "xyz"[len(coords) :]]
    t = df.select(F.col(id).alias("id"), *cols).filter("x is not null and y is not null and z is not null")
    low = t.agg(*[F.min(c).alias(f"o{c}") for c in "xyz"])
    t = t.crossJoin(F.broadcast(low)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(offsets)])))
    shift = F.col("k") * (size / offsets)
    t = t.select("id", "k", *[F.floor((F.col(c) - F.col(f"o{c}") + shift) / size).cast("long").alias(c) for c in "xyz"])
    cell = t.groupBy("k", "x", "y", "z").agg(F.count(F.lit(1)).alias("c"))
    occupied = cell.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("n"))
    w = t.join(cell, ["k", "x", "y", "z"]).join(F.broadcast(occupied), "k")
    return w.groupBy("id").agg(F.avg(F.col("n") / (F.col("m") * F.col("c"))).alias("weight"))


def cell_size_scan(df: DataFrame, coords: Sequence, values, sizes: Sequence[float], offsets: int = 25, id: str = "id") -> DataFrame:
    """size, mean: the declustered mean at each cell size."""
    out = None
    v = df.select(F.col(id).alias("id"), value(values).alias("v")).filter("v is not null")
    for s in sizes:
        one = cell_declustering(df.filter(value(values).isNotNull()), coords, s, offsets, id).join(v, "id").agg(F.lit(float(s)).alias("size"), divided(F.sum(F.col("weight") * F.col("v")), F.sum("weight")).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out


def polygon_declustering(df: DataFrame, coords: Sequence, nodes: int = 10_000, id: str = "id") -> DataFrame:
    """id, weight: share of grid nodes to which each sample is nearest (ties to the lower id), times the number of samples."""
    from .joins import points

    t = points(df, coords, [], id)
    b = t.agg(*[F.min(c).alias(f"l{c}") for c in "xyz"], *[F.max(c).alias(f"h{c}") for c in "xyz"], F.count(F.lit(1)).alias("n")).first()
    extent = [b[f"h{c}"] - b[f"l{c}"] for c in "xyz"] if b["n"] else []
    axes = [i for i, e in enumerate(extent) if e > 1e-9]
    if not axes:
        return t.select("id", F.lit(1.0).alias("weight"))
    step = (math.prod(extent[i] for i in axes) / nodes) ** (1 / len(axes))
    count = [math.ceil(extent[i] / step - 1e-9) if i in axes else 1 for i in range(3)]
    g = df.sparkSession.range(math.prod(count))
    index = [F.col("id") % count[0], F.floor(F.col("id") / count[0]) % count[1], F.floor(F.col("id") / (count[0] * count[1]))]
    for c, i, n, e in zip("xyz", index, count, extent):
        g = g.withColumn(c, F.lit(b[f"l{c}"]) + (i + 0.5) * (e / n if n > 1 or e > 1e-9 else 0.0))
    reach, found, left = step * 4, None, g
    total_ = math.prod(count)
    from .joins import nearest

    while True:  # nodes far from any sample look again with twice the reach
        near = nearest(left, t, 1, reach).select("id", F.col("id2").alias("sample"))
        found = near if found is None else found.unionByName(near)
        if reach > max(extent) * 2:
            break
        left, reach = left.join(near.select("id"), "id", "left_anti"), reach * 4
    n = found.groupBy("sample").agg(F.count(F.lit(1)).alias("c"))
    return t.select("id").join(n.withColumnRenamed("sample", "id"), "id", "left").select("id", (F.coalesce("c", F.lit(0)) * (b["n"] / total_)).alias("weight"))


def affine_correction(df: DataFrame, values, f: float, weights=None, out: str = "corrected") -> DataFrame:
    """Values pulled to their mean so that the variance is f times as large."""
    m = valued(df, values, weights).agg(divided(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("_mean"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, math.sqrt(f) * (value(values) - F.col("_mean")) + F.col("_mean")).drop("_mean")


def indirect_lognormal_correction(df: DataFrame, values, f: float, weights=None, out: str = "corrected") -> DataFrame:
    """a * z^b, rescaled to keep the mean."""
    t = valued(df, values, weights)
    m = t.agg(divided(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("m"))
    v = t.crossJoin(F.broadcast(m)).agg(F.max("m").alias("_m"), divided(F.sum(F.col("_w") * (F.col("_v") - F.col("m")) * (F.col("_v") - F.col("m"))), F.sum("_w")).alias("s"))
    cv2 = F.col("s") / (F.col("_m") * F.col("_m"))
    b = F.sqrt(F.ln(f * cv2 + 1) / F.ln(cv2 + 1))
    root = F.sqrt(cv2 + 1)
    a = F.col("_m") / F.sqrt(f * cv2 + 1) * F.pow(root / F.col("_m"), b)
    p = v.select("_m", a.alias("_a"), b.alias("_b"))
    z = t.crossJoin(F.broadcast(p))
    k = z.agg(F.max("_m").alias("_m"), F.max("_a").alias("_a"), F.max("_b").alias("_b"), divided(F.sum(F.col("_w") * F.col("_a") * F.pow("_v", "_b")), F.sum("_w")).alias("_k"))
    return df.crossJoin(F.broadcast(k)).withColumn(out, F.col("_a") * F.pow(value(values), F.col("_b")) * F.col("_m") / F.col("_k")).drop("_m", "_a", "_b", "_k")


def upscale(df: DataFrame, coords: Sequence, values, size: Sequence[float], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Block centres with the mean and number of the values in each."""
    names = "xyz"[: len(coords)]
    cells = [F.floor((value(c) - o) / s).cast("long").alias(f"i{n}") for n, c, o, s in zip(names, coords, origin, size)]
    t = df.select(*cells, value(values).alias("v")).filter("v is not null")
    g = t.groupBy(*[f"i{n}" for n in names]).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select(*[(o + (F.col(f"i{n}") + 0.5) * s).alias(n) for n, o, s in zip(names, origin, size)], "mean", "n")


def downscale(df: DataFrame, size: Sequence[float], refine: Sequence[int]) -> DataFrame:
    """Each block (x, y, z and other columns) as refine sub-cells, x fastest."""
    t = df
    for n, s, r in zip("zyx", reversed(size), reversed(refine)):
        t = t.withColumn(n, F.explode(F.array(*[F.col(n) - s / 2 + (k + 0.5) * (s / r) for k in range(r)])))
    return t


def correct_distribution(df: DataFrame, values, reference: DataFrame, ref_values, ref_weights=None, strength: float = 1.0, order: Sequence[str] = (), out: str = "corrected") -> DataFrame:
    """Each value moved, by strength, to the reference's quantile at its own rank (i + 0.5) / m."""
    v = value(values)
    known = df.filter(v.isNotNull()).withColumn("_cv", v).withColumn("_one", F.lit(1.0))
    r = joined(known, cumulative(known, [], "_cv", "_one").select("_cv", "_below", "_whole"), ["_cv"])
    ties = Window.partitionBy("_cv").orderBy(*(order or ["_cv"]))
    r = r.withColumn("_q", (F.col("_below") + F.row_number().over(ties) - 0.5) / F.col("_whole")).drop("_cv", "_one", "_below", "_whole")
    c = cumulative(valued(reference, ref_values, ref_weights).filter("_w > 0"), [], "_v", "_w")
    first, last = F.col("_below") + F.col("_least") / 2, F.col("_below") + F.col("_ties") - F.col("_most") / 2  # ties have one value from their first to their last
    nodes = c.select(F.explode(F.array_distinct(F.array(first / F.col("_whole"), last / F.col("_whole")))).alias("p"), F.col("_v").alias("value"))
    done = between(r, F.col("_q"), nodes, "p", "value", "_ref")
    return done.withColumn(out, v + strength * (F.col("_ref") - v)).drop("_ref", "_q")


def fit_box_cox(df: DataFrame, values, candidates: Sequence[float]) -> float:
    """The candidate whose transform has the least absolute skewness; the first of equals. One pass for all of them."""
    z = value(values)
    means = df.agg(*[F.avg(box_cox(z, c)).alias(f"m{i}") for i, c in enumerate(candidates)]).first()
    moments = []
    for i, c in enumerate(candidates):
        d = box_cox(z, c) - F.lit(means[i])
        moments += [F.avg(d * d), F.avg(d * d * d)]
    m = df.agg(*moments).first()
    skew = [abs(m[2 * i + 1]) / m[2 * i] ** 1.5 if m[2 * i] else math.inf for i in range(len(candidates))]
    return candidates[int(np.argmin(skew))]


def box_cox_skewness(df: DataFrame, values, candidates: Sequence[float]) -> DataFrame:
    """lam, skewness of each candidate's transform."""
    rows = F.array(*[F.struct(F.lit(float(c)).alias("lam"), box_cox(values, c).alias("y")) for c in candidates])
    t = df.select(F.explode(rows).alias("r")).select("r.*").filter("y is not null")
    return t.groupBy("lam").agg(F.skewness("y").alias("skewness"))


@dataclass(frozen=True)
class Trend:
    """A polynomial of the coordinates of degree up to 2, fitted by least squares."""

    degree: int
    center: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]

    def column(self, coords: Sequence):
        return total([c * m for c, m in zip(self.coefficients, monomials([(value(x) - o) / s for x, o, s in zip(coords, self.center, self.scale)], self.degree))])


def monomials(coords: Sequence, degree: int) -> list:
    out = [F.lit(1.0)]
    if degree >= 1:
        out += list(coords)
    if degree >= 2:
        out += [coords[i] * coords[j] for i in range(len(coords)) for j in range(i, len(coords))]
    return out


def fit_trend(df: DataFrame, coords: Sequence, values, degree: int = 1, weights=None) -> Trend:
    """Normal equations from sums over all rows, of centred and scaled coordinates; solved by pseudo-inverse on the driver."""
    v, w = value(values), _weight(weights)
    t = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(coords)], v.alias("v"), w.alias("w")).na.drop()
    s = t.agg(*[f(f"c{i}") for i in range(len(coords)) for f in (F.avg, F.stddev_pop)]).first()
    center, scale = tuple(s[2 * i] or 0.0 for i in range(len(coords))), tuple(s[2 * i + 1] or 1.0 for i in range(len(coords)))
    m = monomials([(F.col(f"c{i}") - center[i]) / scale[i] for i in range(len(coords))], degree)
    k = len(m)
    sums = t.agg(*[F.sum(F.col("w") * m[i] * m[j]) for i in range(k) for j in range(i, k)], *[F.sum(F.col("w") * x * F.col("v")) for x in m]).first()
    a, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = sums[at]
            at += 1
    return Trend(degree, center, scale, tuple(np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ np.array([sums[at + i] for i in range(k)])))


def detrend(df: DataFrame, coords: Sequence, values, degree: int = 1, weights=None) -> DataFrame:
    """All rows with `trend` and `residual`."""
    t = fit_trend(df, coords, values, degree, weights)
    return df.withColumn("trend", t.column(coords)).withColumn("residual", value(values) - F.col("trend"))


@dataclass(frozen=True)
class PCA:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    values: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]

    def columns(self, columns: Sequence, prefix: str = "pc") -> list:
        d = [(value(c) - m) / s for c, m, s in zip(columns, self.mean, self.scale)]
        return [total([a * x for a, x in zip(v, d)]).alias(f"{prefix}{i + 1}") for i, v in enumerate(self.vectors)]


def covariance_matrix(df: DataFrame, columns: Sequence, weights=None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and population covariances of complete rows, from two aggregations."""
    t = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)], _weight(weights).alias("w")).na.drop()
    n = len(columns)
    m = t.agg(*[F.sum(F.col("w") * F.col(f"c{i}")) / F.sum("w") for i in range(n)]).first()
    d = [F.col(f"c{i}") - F.lit(m[i]) for i in range(n)]
    c = t.agg(*[F.sum(F.col("w") * d[i] * d[j]) / F.sum("w") for i in range(n) for j in range(n)]).first()
    return np.array(m, float), np.array(c, float).reshape(n, n)


def fit_pca(df: DataFrame, columns: Sequence, weights=None, correlation: bool = True) -> PCA:
    """Eigenvectors by decreasing eigenvalue, each with its largest entry positive."""
    mean, cov = covariance_matrix(df, columns, weights)
    scale = np.sqrt(np.diag(cov)) if correlation else np.ones(len(mean))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values)
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    return PCA(tuple(mean), tuple(scale), tuple(values[order]), tuple(map(tuple, vectors.T)))


def kernel_density(df: DataFrame, values, at: Sequence[float], weights=None, bandwidth: float | None = None) -> DataFrame:
    """x, density: sum of weighted normal kernels; Silverman's bandwidth unless given."""
    t = valued(df, values, weights)
    if bandwidth is None:
        s = t.agg(F.sum("_w").alias("n"), F.stddev_pop("_v").alias("s")).first()
        q = weighted_quantiles(t.withColumn("_k", F.lit(0)), ["_k"], (0.25, 0.75)).first()
        n = t.agg((F.sum("_w") * F.sum("_w") / F.sum(F.col("_w") * F.col("_w"))).alias("n")).first()["n"]
        bandwidth = 0.9 * min(s["s"], (q["q1"] - q["q0"]) / 1.34) * n ** (-0.2)
    t = t.withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in at])))
    u = (F.col("x") - F.col("_v")) / bandwidth
    return t.groupBy("x").agg((F.sum(F.col("_w") * F.exp(-u * u / 2)) / (F.sum("_w") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def anamorphosis(df: DataFrame, values, degree: int, weights=None) -> list[float]:
    """Hermite coefficients psi_0..psi_degree of the sorted values, sums over the distinct ones."""
    from ..functions.columns import hermite

    t = valued(df, values, weights).filter("_w > 0")
    cum = (F.col("_below") + F.col("_ties")) / F.col("_whole")
    t = cumulative(t, [], "_v", "_w").select("_v", F.col("_next.v").alias("_n"), normal_ppf(cum).alias("_y"))
    g = F.exp(-F.col("_y") * F.col("_y") / 2) / math.sqrt(2 * math.pi)
    h = hermite("_y", degree)
    step = F.col("_v") - F.col("_n")  # by parts: what is left at each bound between classes
    inner = F.col("_n").isNotNull()
    sums = [F.avg("_v")] + [F.sum(F.when(inner, step * h[n - 1] * g / math.sqrt(n))) for n in range(1, degree + 1)]
    row = t.agg(*sums).first()
    mean = valued(df, values, weights).agg(F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).first()[0]
    return [mean, *[float(x) for x in row[1:]]]
