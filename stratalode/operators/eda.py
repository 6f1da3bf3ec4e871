"""Statistics of weighted values: summaries, grade-tonnage, capping, cross-tabs, profiles.

Every function takes DataFrames and returns one, lazily. Values that are null or NaN are skipped; a
weight column may be given, else each row weighs 1. Quantiles take the middle of each row's weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, divided, value
from .ranks import joined, mid_ranks, weighted_quantiles

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
ALL = "all"


def _weight(weights) -> Column:
    return F.lit(1.0) if weights is None else value(weights)


def valued(df: DataFrame, values, weights=None, by=None, keep: Sequence[str] = ()) -> DataFrame:
    """_v, _w and _g (as text) of the rows with a value and a weight that is not negative or missing."""
    g = F.lit(ALL) if by is None else col(by).cast("string")
    t = df.select(value(values).alias("_v"), _weight(weights).alias("_w"), g.alias("_g"), *keep)
    return t.filter("_v is not null and _w is not null and _w >= 0")


def _with_all(t: DataFrame) -> DataFrame:
    """Each row for its category, and once more for all; no category: only for all."""
    both = F.array(F.struct(F.col("_g").alias("g"), F.lit(0).alias("k")), F.struct(F.lit(ALL).alias("g"), F.lit(1).alias("k")))
    e = t.withColumn("_e", F.explode(both))
    return e.withColumn("category", F.col("_e.g")).withColumn("_all", F.col("_e.k")).drop("_e", "_g").filter("category is not null")


def _moments(t: DataFrame, by: Sequence[str]) -> DataFrame:
    """One pass of sums about the mean of all rows, which loses few digits."""
    t = joined(t, t.agg(F.avg("_v").alias("_m")), [])
    d = F.col("_v") - F.col("_m")
    s1, s2 = divided(F.sum(F.col("_w") * d), F.sum("_w")), divided(F.sum(F.col("_w") * d * d), F.sum("_w"))
    m = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.first("_m") + s1).alias("mean"), F.greatest(s2 - s1 * s1, F.lit(0.0)).alias("variance"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    return m.withColumn("std", F.sqrt("variance")).withColumn("cv", divided(F.col("std"), F.col("mean")))


def _named(quantiles) -> list[str]:
    return [f"p{round(q * 1000) / 10:g}".replace(".", "_") for q in quantiles]


def describe_by(df: DataFrame, values, categories, weights=None, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Summary of each category and of all: n, mean, variance, std, cv, min, max and quantiles."""
    t = _with_all(valued(df, values, weights, categories))
    by = ["category", "_all"]
    out = _moments(t, by).join(weighted_quantiles(t, by, quantiles), by, "left")
    names = [F.col(f"q{k}").alias(n) for k, n in enumerate(_named(quantiles))]
    return out.select("category", "n", "mean", "variance", "std", "cv", "min", "max", *names)


def describe(df: DataFrame, values, weights=None, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    return describe_by(df, values, F.lit(None).cast("string"), weights, quantiles).drop("category")


def _cutoffs(df: DataFrame, cutoffs: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))


def grade_tonnage(df: DataFrame, values, cutoffs: Sequence[float], weights=None, density=1.0, categories=None) -> DataFrame:
    """category, cutoff, tonnage, metal, mean of the values at or above each cutoff, per category and for all.

    One pass: the sums of every cutoff are conditional aggregates of the same scan, turned to rows at the end.
    """
    density = density if isinstance(density, (str, Column)) else F.lit(float(density))
    w = _weight(weights) * value(density)
    t = _with_all(valued(df, values, w, categories if categories is not None else F.lit(None).cast("string")))
    sums = []
    for k, c in enumerate(cutoffs):
        above = F.col("_v") >= float(c)
        sums += [F.coalesce(F.sum(F.when(above, F.col("_w"))), F.lit(0.0)).alias(f"t{k}"), F.coalesce(F.sum(F.when(above, F.col("_w") * F.col("_v"))), F.lit(0.0)).alias(f"m{k}")]
    g = t.groupBy("category", "_all").agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"t{k}").alias("tonnage"), F.col(f"m{k}").alias("metal")) for k, c in enumerate(cutoffs)])
    g = g.select("category", F.explode(rows).alias("r")).select("category", "r.*")
    return g.withColumn("mean", F.when(F.col("tonnage") > 0, F.try_divide("metal", "tonnage")))


def compare_models(df: DataFrame, columns: Sequence[str], cutoffs: Sequence[float], reference: str | None = None, weights=None, density=1.0) -> DataFrame:
    """Grade-tonnage of several value columns and each one's difference from the reference, as a share of it."""
    long = None
    for c in columns:
        one = grade_tonnage(df, c, cutoffs, weights, density).withColumn("model", F.lit(c)).drop("category")
        long = one if long is None else long.unionByName(one)
    ref = long.filter(F.col("model") == (reference or columns[0])).select("cutoff", *[F.col(x).alias(f"_{x}") for x in ("tonnage", "metal", "mean")])
    out = long.join(F.broadcast(ref), "cutoff")
    diff = [divided(F.col(x) - F.col(f"_{x}"), F.col(f"_{x}")).alias(f"{x}_diff") for x in ("tonnage", "metal", "mean")]
    return out.select("model", "cutoff", "tonnage", "metal", "mean", *diff)


def domain_change(df: DataFrame, before, after, grade=None, weights=None, density=1.0) -> DataFrame:
    """Tonnage, metal and mean grade of each (class before, class after), every pair of classes listed."""
    w = _weight(weights) * F.lit(float(density))
    v = value(grade) if grade is not None else F.lit(None).cast("double")
    t = df.select(col(before).cast("string").alias("from"), col(after).cast("string").alias("to"), w.alias("_w"), v.alias("_v")).filter("`from` is not null and `to` is not null")
    g = t.groupBy("from", "to").agg(F.sum("_w").alias("tonnage"), F.sum(F.col("_w") * F.col("_v")).alias("metal"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_known"))
    classes = g.select(F.col("from").alias("c")).union(g.select(F.col("to").alias("c"))).distinct()
    dense = classes.select(F.col("c").alias("from")).crossJoin(F.broadcast(classes.select(F.col("c").alias("to"))))
    out = dense.join(g, ["from", "to"], "left")
    zero = F.lit(0.0)
    return out.select("from", "to", F.coalesce("tonnage", zero).alias("tonnage"), F.coalesce("metal", zero).alias("metal"), divided(F.col("metal"), F.col("_known")).alias("mean"))


def transition_matrix(df: DataFrame, depth, categories, holes, lag: float, tolerance: float = 0.0) -> DataFrame:
    """Of each class pair, how often the second stands `lag` (within tolerance) below the first in the same hole.

    The join is on hole and a depth cell as wide as the window, so that each row meets two or three cells.
    """
    width = float(max(2 * tolerance, lag / 2, 1e-9))
    t = df.select(col(holes).alias("h"), value(depth).alias("d"), col(categories).cast("string").alias("c"), F.monotonically_increasing_id().alias("r")).filter("h is not null and d is not null and c is not null")
    low, high = F.col("d") + (lag - tolerance), F.col("d") + (lag + tolerance)
    a = t.withColumn("cell", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    b = t.select("h", F.col("d").alias("d2"), F.col("c").alias("c2"), F.col("r").alias("r2"), F.floor(F.col("d") / width).alias("cell"))
    hit = a.join(b, ["h", "cell"]).filter((F.col("d2") >= low) & (F.col("d2") <= high) & (F.col("r") != F.col("r2")))
    n = hit.groupBy(F.col("c").alias("from"), F.col("c2").alias("to")).agg(F.count(F.lit(1)).alias("count"))
    classes = t.select("c").distinct()
    dense = classes.select(F.col("c").alias("from")).crossJoin(F.broadcast(classes.select(F.col("c").alias("to")))).join(n, ["from", "to"], "left")
    dense = dense.withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return dense.withColumn("frequency", divided(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy("from")).cast("double")))


def swath(df: DataFrame, axis, values, width: float, weights=None, density: float = 1.0) -> DataFrame:
    """slice, center, n, mean, tonnage, metal of slices of equal width along a coordinate; empty ones omitted."""
    t = df.select(value(axis).alias("_x"), value(values).alias("_v"), (_weight(weights) * F.lit(float(density))).alias("_w")).filter("_x is not null and _v is not null and _w is not null")
    g = t.groupBy(F.floor(F.col("_x") / float(width)).cast("long").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("tonnage"), F.sum(F.col("_w") * F.col("_v")).alias("metal"))
    return g.select("slice", ((F.col("slice") + 0.5) * float(width)).alias("center"), "n", divided(F.col("metal"), F.col("tonnage")).alias("mean"), "tonnage", "metal")


def along(x, y, azimuth: float) -> Column:
    """Coordinate along an azimuth, for swaths."""
    import math

    a = math.radians(azimuth)
    return value(x) * math.sin(a) + value(y) * math.cos(a)


def contact(df: DataFrame, coords: Sequence, values, domains, holes, inside: str, outside: str, max_distance: float, bin: float) -> DataFrame:
    """Mean value by signed distance to the nearest sample of the other domain in the same hole (inside negative)."""
    names = ("x", "y", "z")[: len(coords)]
    t = df.select(*[value(c).alias(n) for c, n in zip(coords, names)], value(values).alias("v"), col(domains).cast("string").alias("g"), col(holes).alias("h")).filter(F.col("g").isin(inside, outside) & F.col("h").isNotNull())
    t = t.withColumn("r", F.monotonically_increasing_id())
    other = t.select("h", F.col("g").alias("g2"), *[F.col(n).alias(f"{n}2") for n in names])
    d2 = sum(((F.col(n) - F.col(f"{n}2")) * (F.col(n) - F.col(f"{n}2")) for n in names[1:]), (F.col(names[0]) - F.col(f"{names[0]}2")) * (F.col(names[0]) - F.col(f"{names[0]}2")))
    near = t.join(other, "h").filter("g <> g2").groupBy("r", "g", "v").agg(F.sqrt(F.min(d2)).alias("d")).filter((F.col("d") <= max_distance) & F.col("v").isNotNull())
    last = max(-(-max_distance // bin), 1) - 1
    k = F.least(F.floor(F.col("d") / bin), F.lit(last)).cast("long")
    signed = F.when(F.col("g") == inside, -k - 1).otherwise(k)
    g = near.groupBy(signed.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    return g.select("bin", ((F.col("bin") + 0.5) * bin).alias("distance"), "n", "mean")


DEFAULT_CAPS = (0.90, 0.95, 0.975, 0.99, 0.995, 0.999)


def _capped(t: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of rows with _cap: share above, metal removed, capped mean and cv, in two passes of sums."""
    c = F.least("_v", "_cap")
    g = t.groupBy(*by).agg(
        divided(F.sum(F.when(F.col("_v") > F.col("_cap"), F.col("_w")).otherwise(0.0)), F.sum("_w")).alias("fraction"),
        divided(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("_mean"), divided(F.sum(F.col("_w") * c), F.sum("_w")).alias("mean"),
    )
    about = t.join(F.broadcast(g.select(*by, F.col("mean").alias("_m"))), list(by))
    d = c - F.col("_m")
    var = about.groupBy(*by).agg(divided(F.sum(F.col("_w") * d * d), F.sum("_w")).alias("_var"))
    g = g.join(var, list(by))
    return g.select(*by, "fraction", (1 - divided(F.col("mean"), F.col("_mean"))).alias("metal_removed"), "mean", divided(F.sqrt("_var"), F.col("mean")).alias("cv"))


def capping(df: DataFrame, values, caps: Sequence[float] | None = None, weights=None) -> DataFrame:
    """cap, fraction (strictly above), metal_removed, mean, cv for given caps, or for high quantiles."""
    t = valued(df, values, weights)
    if caps is None:
        q = weighted_quantiles(t.withColumn("_k", F.lit(0)), ["_k"], DEFAULT_CAPS)
        each = q.select(F.explode(F.array(*[f"q{k}" for k in range(len(DEFAULT_CAPS))])).alias("_cap"))
        t = t.crossJoin(F.broadcast(each))
    else:
        t = t.withColumn("_cap", _cutoffs(t, caps))
    return _capped(t, ["_cap"]).withColumnRenamed("_cap", "cap")


def capping_report(df: DataFrame, values, caps: dict[str, float], domains, weights=None) -> DataFrame:
    """Per domain, before and after its cap: n, n_capped, mean, cv, max, and the metal above the cap."""
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(float(v)))])
    t = valued(df, values, weights, domains)
    t = t.withColumn("_cap", F.coalesce(F.element_at(cap, F.col("_g")), F.lit(float("inf"))))
    t = _with_all(t.filter("_g is not null"))
    before = _moments(t, ["category", "_all"]).select("category", "_all", "n", F.col("mean").alias("mean_before"), F.col("cv").alias("cv_before"), F.col("max").alias("max_before"))
    after = _moments(t.withColumn("_v", F.least("_v", "_cap")), ["category", "_all"]).select("category", "_all", F.col("mean").alias("mean_after"), F.col("cv").alias("cv_after"), F.col("max").alias("max_after"))
    over = F.col("_v") > F.col("_cap")
    cut = t.groupBy("category", "_all").agg(F.sum(over.cast("long")).alias("n_capped"), F.sum(F.when(over, (F.col("_v") - F.col("_cap")) * F.col("_w")).otherwise(0.0)).alias("metal_capped"))
    return before.join(after, ["category", "_all"]).join(cut, ["category", "_all"]).drop("_all")


def cap_by_quantile(df: DataFrame, values, q: float, domains=None, weights=None) -> DataFrame:
    """domain, cap: the quantile of each domain's values."""
    t = valued(df, values, weights, domains).withColumnRenamed("_g", "domain")
    return weighted_quantiles(t, ["domain"], [q]).select("domain", F.col("q0").alias("cap"))


def cap_by_rule(df: DataFrame, values, rule: str, target: float, domains=None, weights=None) -> DataFrame:
    """domain, cap: the cap at which `metal_removed` is target, or the coefficient of variation (`cv`) is.

    Both change monotonically with the cap. Prefix sums over the ordered values give, at each value, what
    capping there does; the cap lies between the two values around the target. Between them the metal is
    linear in the cap, and the squared cv is a ratio of polynomials that is solved in closed form.
    """
    t = valued(df, values, weights, domains).withColumnRenamed("_g", "domain").filter("_w > 0")
    up = Window.partitionBy("domain").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("domain")
    t = t.withColumn("_tw", F.sum("_w").over(whole)).withColumn("_tm", F.sum(F.col("_w") * F.col("_v")).over(whole))
    t = t.withColumn("_s0", F.sum("_w").over(up)).withColumn("_s1", F.sum(F.col("_w") * F.col("_v")).over(up)).withColumn("_s2", F.sum(F.col("_w") * F.col("_v") * F.col("_v")).over(up))
    steps = t.select("domain", "_v", "_tw", "_tm", "_s0", "_s1", "_s2").distinct()
    rest = F.col("_tw") - F.col("_s0")
    nxt = F.lead("_v").over(Window.partitionBy("domain").orderBy("_v"))
    if rule == "metal_removed":  # 1 - (s1 + c * rest) / M = target
        c = divided(F.col("_tm") * (1 - target) - F.col("_s1"), rest)
    elif rule == "cv":  # W (s2 + c^2 rest) = (1 + target^2) (s1 + c rest)^2
        k = 1 + target * target
        a = F.col("_tw") * rest - k * rest * rest
        b = -2 * k * F.col("_s1") * rest
        d = F.col("_tw") * F.col("_s2") - k * F.col("_s1") * F.col("_s1")
        root = F.sqrt(F.greatest(b * b - 4 * a * d, F.lit(0.0)))
        c = F.when(F.abs(a) > 1e-12, (-b + root) / (2 * a)).otherwise(divided(-d, b))
    else:
        raise ValueError(rule)
    steps = steps.withColumn("_next", nxt).withColumn("_c", c)
    hit = steps.filter("_next is not null and _c >= _v and _c <= _next")
    found = hit.groupBy("domain").agg(F.max("_c").alias("cap"))
    top = steps.groupBy("domain").agg(F.max("_v").alias("_top"))
    return top.join(found, "domain", "left").select("domain", F.coalesce("cap", "_top").alias("cap"))


def cap(df: DataFrame, values: str, caps: DataFrame, domains: str | None = None, out: str = "capped") -> DataFrame:
    """All rows with the value cut at its domain's cap; a domain without a cap keeps its values."""
    if domains is None:
        joined = df.crossJoin(F.broadcast(caps.select(F.col("cap").alias("_cap"))))
    else:
        joined = df.join(F.broadcast(caps.select(F.col("domain").alias("_d"), F.col("cap").alias("_cap"))), F.col(domains).cast("string") == F.col("_d"), "left").drop("_d")
    v = value(values)
    return joined.withColumn(out, F.when(v.isNotNull(), F.least(v, F.coalesce("_cap", v)))).drop("_cap")


def correlation(df: DataFrame, columns: Sequence[str], weights=None, method: str = "pearson") -> DataFrame:
    """a, b, n and value of each pair of columns, over rows where both are known.

    `pearson` and `covariance` are one aggregation of sums about the columns' means. `spearman` correlates ranks among the rows
    of a pair, so there each pair has rows of its own.
    """
    cols = [value(c).alias(f"c{i}") for i, c in enumerate(columns)]
    t = df.select(*cols, _weight(weights).alias("_w")).filter("_w > 0")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]

    def sums(t: DataFrame, x: str, y: str, ok: Column) -> list[Column]:
        dx, dy, w = F.col(x) - F.col(f"{x}m"), F.col(y) - F.col(f"{y}m"), F.when(ok, F.col("_w"))
        return [F.count(w), F.sum(w), *[F.sum(w * d) for d in (dx, dy, dx * dy, dx * dx, dy * dy)]]

    def measured(s: Sequence[Column]) -> Column:
        n, w, x, y, xy, xx, yy = s
        xy, xx, yy = (p / w - (q / w) * (r / w) for p, q, r in ((xy, x, y), (xx, x, x), (yy, y, y)))
        return xy if method == "covariance" else divided(xy, F.sqrt(xx * yy))

    if method == "spearman":
        rows = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i, j in pairs])
        t = t.select("_w", F.explode(rows).alias("r")).select("_w", "r.*").filter("x is not null and y is not null")
        t = mid_ranks(mid_ranks(t, ["a", "b"], "x", "_w", "_x"), ["a", "b"], "y", "_w", "_y").select("a", "b", "_w", F.col("_x").alias("x"), F.col("_y").alias("y"))
        t = joined(t, t.agg(F.avg("x").alias("xm"), F.avg("y").alias("ym")), [])
        s = sums(t, "x", "y", F.lit(True))
        return t.groupBy("a", "b").agg(*[c.alias(f"s{k}") for k, c in enumerate(s)]).select("a", "b", F.col("s0").alias("n"), measured([F.col(f"s{k}") for k in range(7)]).alias("value"))
    t = joined(t, t.agg(*[F.avg(f"c{i}").alias(f"c{i}m") for i in range(len(columns))]), [])
    aggs = [c.alias(f"p{i}_{j}_{k}") for i, j in pairs for k, c in enumerate(sums(t, f"c{i}", f"c{j}", F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()))]
    one = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"p{i}_{j}_0").alias("n"), measured([F.col(f"p{i}_{j}_{k}") for k in range(7)]).alias("value")) for i, j in pairs]
    return t.agg(*aggs).select(F.inline(F.array(*one))).filter("n > 0")


def compare(df: DataFrame, estimate, truth) -> DataFrame:
    """n, mean_error, mean_absolute_error, rmse, correlation and slope (truth on estimate), finite pairs only."""
    t = df.select(value(estimate).alias("e"), value(truth).alias("t")).filter("e is not null and t is not null")
    d = F.col("e") - F.col("t")
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_error"), F.avg(F.abs(d)).alias("mean_absolute_error"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr("e", "t").alias("correlation"), F.regr_slope("t", "e").alias("slope"))


def global_bias(model: DataFrame, estimate, data: DataFrame, values, weights=None, data_weights=None) -> DataFrame:
    """Weighted means of estimates and data and their relative difference."""
    e = valued(model, estimate, weights).agg(divided(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("estimate_mean"))
    d = valued(data, values, data_weights).agg(divided(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("data_mean"))
    return e.crossJoin(F.broadcast(d)).withColumn("relative_difference", divided(F.col("estimate_mean") - F.col("data_mean"), F.col("data_mean")))


def classify(df: DataFrame, rules: Sequence[tuple[str, Sequence[tuple[str, str, float]]]], default: str = "unclassified", out: str = "class") -> DataFrame:
    """The name of the first rule whose conditions (column, operator, threshold) all hold; a missing value never holds."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}
    result = None
    for name, conditions in rules:
        ok = F.lit(True)
        for c, op, threshold in conditions:
            ok = ok & F.coalesce(ops[op](value(c), F.lit(float(threshold))), F.lit(False))
        result = F.when(ok, name) if result is None else result.when(ok, name)
    return df.withColumn(out, F.lit(default) if result is None else result.otherwise(default))


def paired_bias(df: DataFrame, a, b, distance, edges: Sequence[float]) -> DataFrame:
    """Per bin of distance (the last one closed): n, mean_a, mean_b and mean_b / mean_a - 1; empty bins are kept."""
    t = df.select(value(a).alias("a"), value(b).alias("b"), value(distance).alias("d")).filter("a is not null and b is not null")
    k = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        top = (F.col("d") <= edges[i + 1]) if i == last else (F.col("d") < edges[i + 1])
        k = F.when((F.col("d") >= edges[i]) & top, i).otherwise(k)
    g = t.withColumn("bin", k).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    bins = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)], "bin int, lower double, upper double")
    out = bins.join(g, "bin", "left")
    return out.select("bin", "lower", "upper", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_a", "mean_b", (divided(F.col("mean_b"), F.col("mean_a")) - 1).alias("bias"))


def uncertainty_curve(df: DataFrame, spacing, uncertainty, edges: Sequence[float], quantiles: Sequence[float] = (0.5, 0.9), threshold: float = 0.15, min_count: int = 8) -> DataFrame:
    """Quantiles of uncertainty per spacing bin, made non-decreasing; bins under min_count go before that."""
    t = df.select(value(spacing).alias("s"), value(uncertainty).alias("_v"), F.lit(1.0).alias("_w")).filter("s is not null and _v is not null")
    k = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        top = (F.col("s") <= edges[i + 1]) if i == last else (F.col("s") < edges[i + 1])
        k = F.when((F.col("s") >= edges[i]) & top, i).otherwise(k)
    t = t.withColumn("bin", k).filter("bin is not null")
    g = t.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("spacing"), F.avg((F.col("_v") <= threshold).cast("double")).alias("share"))
    g = g.join(weighted_quantiles(t, ["bin"], quantiles), "bin").filter(F.col("n") >= min_count)
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    names = [F.max(f"q{i}").over(upto).alias(n) for i, n in enumerate(_named(quantiles))]
    return g.select("bin", "spacing", "n", *names, "share")


def required_spacing(curve: DataFrame, column: str = "p90", threshold: float = 0.15) -> DataFrame:
    """spacing, exceeded: where the curve first exceeds the threshold, linear from the point before; null if the first does.

    A curve that never does gives its last spacing, not exceeded.
    """
    w = Window.orderBy("bin")  # one row a bin
    t = curve.select("bin", "spacing", F.col(column).alias("v"), F.lag("spacing").over(w).alias("s0"), F.lag(column).over(w).alias("v0"))
    over = F.when(F.col("v") > threshold, F.col("bin"))
    t = t.agg(F.min_by(F.struct("spacing", "v", "s0", "v0"), over).alias("r"), F.max_by("spacing", "bin").alias("last"), F.count(over).alias("n"))
    between = F.col("r.s0") + (F.col("r.spacing") - F.col("r.s0")) * (threshold - F.col("r.v0")) / (F.col("r.v") - F.col("r.v0"))
    return t.select(F.when(F.col("n") > 0, between).otherwise(F.col("last")).alias("spacing"), (F.col("n") > 0).alias("exceeded"))


def vertical_proportions(df: DataFrame, z, categories, size: float, weights=None) -> DataFrame:
    """slice, category, share: weighted share of each category in each slice of height."""
    t = df.select(F.floor(value(z) / float(size)).cast("long").alias("slice"), col(categories).cast("string").alias("category"), _weight(weights).alias("_w")).filter("slice is not null and category is not null")
    g = t.groupBy("slice", "category").agg(F.sum("_w").alias("_w"))
    slices, cats = g.select("slice").distinct(), g.select("category").distinct()
    dense = slices.crossJoin(F.broadcast(cats)).join(g, ["slice", "category"], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    return dense.select("slice", "category", divided(F.col("_w"), F.sum("_w").over(Window.partitionBy("slice"))).alias("share"))


def validate_model(model: DataFrame, grade, data: DataFrame, values, weights=None, domains=None, density: float = 1.0) -> DataFrame:
    """Rows naive, declustered and model per domain and for all: n, mean, variance, mean_diff and variance_ratio to declustered (or naive)."""
    by = domains if domains is not None else F.lit(None).cast("string")
    kinds = [("naive", data, values, None), ("model", model, grade, F.lit(float(density)))]
    if weights is not None:
        kinds.insert(1, ("declustered", data, values, weights))
    rows = None
    for name, df, v, w in kinds:
        t = _with_all(valued(df, v, w, by))
        one = _moments(t, ["category", "_all"]).select("category", "_all", F.lit(name).alias("kind"), "n", "mean", "variance")
        rows = one if rows is None else rows.unionByName(one)
    base = rows.filter(F.col("kind") == ("naive" if weights is None else "declustered")).select("category", "_all", F.col("mean").alias("_m"), F.col("variance").alias("_v"))
    out = rows.join(base, ["category", "_all"], "left")
    return out.select("category", "kind", "n", "mean", "variance", divided(F.col("mean") - F.col("_m"), F.col("_m")).alias("mean_diff"), divided(F.col("variance"), F.col("_v")).alias("variance_ratio"))
