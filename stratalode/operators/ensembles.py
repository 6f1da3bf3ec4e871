"""What an ensemble of realizations says: recoveries, errors, categories, and a few realizations for all.

Realizations are rows (id, realization, value).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import divided
from .eda import _weight


def recoveries(realizations: DataFrame, cutoffs: Sequence[float], probabilities: Sequence[float] = (0.1, 0.5, 0.9), tonnage=None) -> DataFrame:
    """cutoff, and of tonnage, metal and grade above it the mean and the quantiles over realizations; a realization with nothing above has no grade."""
    w = _weight(tonnage)
    aggs = []
    for i, c in enumerate(cutoffs):
        above = F.col("value") >= float(c)
        aggs += [F.sum(F.when(above, w).otherwise(0.0)).alias(f"t{i}"), F.sum(F.when(above, w * F.col("value")).otherwise(0.0)).alias(f"m{i}")]
    each = realizations.groupBy("realization").agg(*aggs)
    each = each.select(F.inline(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"t{i}").alias("tonnage"), F.col(f"m{i}").alias("metal")) for i, c in enumerate(cutoffs)])))
    each = each.withColumn("grade", F.when(F.col("tonnage") > 0, F.col("metal") / F.col("tonnage")))
    out = []
    for n in ("tonnage", "metal", "grade"):
        out += [F.avg(n).alias(f"{n}_mean"), *[F.percentile(n, float(p)).alias(f"{n}_q{i}") for i, p in enumerate(probabilities)]]
    return each.groupBy("cutoff").agg(*out)


def relative_error(realizations: DataFrame, confidence: float = 0.9, center: str = "mean") -> DataFrame:
    """id, relative_error: half the width of the interval that holds `confidence` of the realizations, over their mean or median."""
    middle = F.avg("value") if center == "mean" else F.percentile("value", 0.5)
    t = realizations.groupBy("id").agg(F.percentile("value", (1 - confidence) / 2).alias("lo"), F.percentile("value", (1 + confidence) / 2).alias("hi"), middle.alias("c"))
    return t.select("id", divided(F.col("hi") - F.col("lo"), 2 * F.col("c")).alias("relative_error"))


def validate(realizations: DataFrame, truth: DataFrame, confidence: float = 0.9, cutoff: float | None = None, probability: float = 0.5) -> DataFrame:
    """id, error (mean less truth), inside (the interval holds the truth) and, with a cutoff, type1 and type2.

    type1: called above with at least `probability` and is not; type2: is above and not called so. truth: rows (id, truth).
    """
    above = F.col("value") >= float(cutoff if cutoff is not None else 0.0)
    t = realizations.groupBy("id").agg(F.avg("value").alias("mean"), F.percentile("value", (1 - confidence) / 2).alias("lo"), F.percentile("value", (1 + confidence) / 2).alias("hi"), F.avg(above.cast("double")).alias("p"))
    t = t.join(truth.select("id", "truth"), "id")
    out = t.select("id", (F.col("mean") - F.col("truth")).alias("error"), F.col("truth").between(F.col("lo"), F.col("hi")).alias("inside"), "p", "truth")
    if cutoff is None:
        return out.drop("p", "truth")
    called, true = F.col("p") >= probability, F.col("truth") >= float(cutoff)
    return out.select("id", "error", "inside", (called & ~true).alias("type1"), (~called & true).alias("type2"))


def categorical_summary(realizations: DataFrame, k: int) -> DataFrame:
    """id, p0..p(k-1), most_likely (ties: the lowest), entropy (over ln k) of categories 0..k-1 in `value`."""
    p = [F.avg((F.col("value") == i).cast("double")) for i in range(k)]
    t = realizations.groupBy("id").agg(*[x.alias(f"p{i}") for i, x in enumerate(p)])
    cols = F.array(*[f"p{i}" for i in range(k)])
    entropy = sum((F.when(F.col(f"p{i}") > 0, -F.col(f"p{i}") * F.ln(f"p{i}")).otherwise(0.0) for i in range(k)), F.lit(0.0)) / math.log(k)
    return t.select("id", *[f"p{i}" for i in range(k)], (F.array_position(cols, F.array_max(cols)) - 1).alias("most_likely"), entropy.alias("entropy"))


def category_proportions(realizations: DataFrame, k: int, weights=None) -> DataFrame:
    """realization, category, proportion: 0 where a realization has none of a category."""
    t = realizations.groupBy("realization").agg(F.sum(_weight(weights)).alias("all"), *[F.sum(F.when(F.col("value") == i, _weight(weights)).otherwise(0.0)).alias(f"w{i}") for i in range(k)])
    return t.select("realization", F.inline(F.array(*[F.struct(F.lit(i).alias("category"), divided(F.col(f"w{i}"), F.col("all")).alias("proportion")) for i in range(k)])))


def distances(realizations: DataFrame) -> tuple[list, np.ndarray]:
    """Names of the realizations and the root mean square difference of each two, from one aggregation over ids.

    One row an id holds its values, so no pairs of rows are made; the driver gets a matrix of realizations.
    """
    names = [r[0] for r in realizations.select("realization").distinct().orderBy("realization").collect()]
    wide = realizations.groupBy("id").pivot("realization", names).agg(F.first("value")).drop("id").toDF(*[f"r{i}" for i in range(len(names))])

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((len(names), len(names)))
        n = 0
        for b in batches:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns], float)
            x = x[:, ~np.isnan(x).any(0)]
            g = x @ x.T
            total += np.diag(g)[:, None] + np.diag(g)[None] - 2 * g
            n += x.shape[1]
        yield pa.RecordBatch.from_pydict({"s": [total.ravel().tolist()], "n": [n]})

    r = wide.mapInArrow(sums, "s array<double>, n long").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(len(names) ** 2)]).alias("s"), F.sum("n").alias("n")).first()
    return names, np.sqrt(np.maximum(np.array(r.s, float).reshape(len(names), -1) / max(r.n or 0, 1), 0))


def select_realizations(realizations: DataFrame, n: int, seed: int = 0) -> list[tuple]:
    """(realization, share): n medoids by swaps from a seeded start, and the share of all realizations next to each."""
    names, d = distances(realizations)
    if not 1 <= n <= len(names):
        raise ValueError("n must be between 1 and the number of realizations")
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(names)))]
    while len(chosen) < n:  # far ones first, by the square of what is left
        left = d[:, chosen].min(1) ** 2
        left[chosen] = 0
        chosen.append(int(rng.choice(len(names), p=left / left.sum())) if left.sum() > 0 else min(set(range(len(names))) - set(chosen)))
    while True:
        cost = d[:, chosen].min(1).sum()
        best = min((d[:, [*chosen[:i], j, *chosen[i + 1 :]]].min(1).sum(), i, j) for i in range(n) for j in range(len(names)) if j not in chosen) if n < len(names) else (cost, 0, 0)
        if best[0] >= cost - 1e-12:
            break
        chosen[best[1]] = best[2]
    chosen.sort()
    nearest = d[:, chosen].argmin(1)
    return [(names[c], float((nearest == i).mean())) for i, c in enumerate(chosen)]


def localize(blocks: DataFrame, realizations: DataFrame, panel: str = "panel", ranking: str = "ranking") -> DataFrame:
    """id, localized: a panel's realizations pooled in order and cut into as many equal chunks as it has blocks; the chunk means go to its blocks by rank.

    blocks: rows (id, panel, ranking); realizations: rows (panel, realization, value). Ties of ranking: the lower id first.
    """
    b = blocks.withColumn("_at", F.row_number().over(Window.partitionBy(panel).orderBy(ranking, "id")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(panel)))
    counts = blocks.groupBy(panel).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(panel).orderBy("value")
    v = realizations.join(counts, panel).withColumn("_i", F.row_number().over(order) - 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(panel)))
    # a value lies in one chunk or, where chunks do not end between values, in shares of several
    lo, hi = F.col("_i") * F.col("_n") / F.col("_all"), (F.col("_i") + 1) * F.col("_n") / F.col("_all")
    v = v.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_at", F.explode(F.sequence(F.floor("_lo").cast("int"), F.greatest(F.floor("_lo"), F.ceil(F.col("_hi") - 1e-9) - 1).cast("int"))))
    part = F.least("_hi", F.col("_at") + 1) - F.greatest("_lo", F.col("_at"))
    means = v.groupBy(panel, "_at").agg((F.sum(part * F.col("value")) / F.sum(part)).alias("localized"))
    return b.join(means, [panel, "_at"], "left").select("id", "localized")
