"""Operators on neighbourhoods of points: spacing, pairs, duplicates, simple interpolation, variogram sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, direction, divided, value
from .ranks import weighted_quantiles
from .joins import cells, components, nearest, points, second, within
from .near import by_place, counted, greedy_pairs, lag_cells, nearest_holes


def _samples(df: DataFrame, coords, values, id, **more) -> DataFrame:
    return points(df, coords, [value(values).alias("v"), *[col(c).alias(n) for n, c in more.items() if c is not None]], id).filter("v is not null")


def interpolate(targets: DataFrame, data: DataFrame, coords: Sequence, values, radius: float, k: int = 16, min_samples: int = 1, method: str = "idw", power: float = 2.0, target_id: str | None = None, data_id: str | None = None) -> DataFrame:
    """id, estimate, n of every target: `nearest`, `idw`, `average` or `median` of its k nearest samples within radius.

    Fewer than min_samples: null. Inverse distance: an exact hit (1e-12) wins.
    """
    s = _samples(data, coords, values, data_id)
    w = F.pow(F.greatest("distance", F.lit(1e-12)), F.lit(-float(power)))
    hit = F.col("distance") < 1e-12
    made = {
        "nearest": F.min_by("v2", "rank"),
        "idw": F.coalesce(F.min_by(F.when(hit, F.col("v2")), F.when(hit, F.col("rank"))), divided(F.sum(w * F.col("v2")), F.sum(w))),
        "average": F.avg("v2"),
        "median": F.median("v2"),
    }[method]
    out = by_place(points(targets, coords, [], target_id), lambda t: nearest(t, s, k, radius).groupBy("id").agg(F.count(F.lit(1)).alias("n"), made.alias("estimate")))
    return out.select("id", F.when(F.col("n") >= min_samples, F.col("estimate")).alias("estimate"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def neighborhood_stats(targets: DataFrame, data: DataFrame, coords: Sequence, values, radius: float, k: int = 8, holes=None, target_id: str | None = None, data_id: str | None = None) -> DataFrame:
    """Of each target: samples and holes within radius, nearest, mean and max distance of the k nearest, and their values."""
    t = points(targets, coords, [], target_id)
    s = _samples(data, coords, values, data_id, hole=holes if holes is not None else F.lit(0))
    w = 1 / F.pow(F.greatest("distance", F.lit(1e-12)), F.lit(2.0))
    zero = F.lit(0).cast("long")

    def made(places):
        n = counted(places, s.drop("v", "hole"), radius).withColumnRenamed("n", "n_within")
        h = nearest_holes(places, s.drop("v"), None, radius).groupBy("id").agg(F.count("hole2").alias("n_holes"))
        g = nearest(places, s, k, radius).groupBy("id").agg(F.min("distance").alias("nearest"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), F.avg("v2").alias("mean"), F.var_pop("v2").alias("variance"), F.min("v2").alias("min"), F.max("v2").alias("max"), (F.sum(w * F.col("v2")) / F.sum(w)).alias("idw"))
        return n.join(h, "id").join(g, "id")

    out = by_place(t, made)
    return out.select("id", F.coalesce("n_within", zero).alias("n_within"), F.coalesce("n_holes", zero).alias("n_holes"), *[c for c in out.columns if c not in ("id", "n_within", "n_holes")])


def hole_distance(targets: DataFrame, data: DataFrame, coords: Sequence, holes, n: int, radius: float, target_id: str | None = None, data_id: str | None = None) -> DataFrame:
    """Mean distance of each target to the n nearest holes, each at its nearest sample; null where fewer are in reach."""
    t = points(targets, coords, [], target_id)
    s = points(data, coords, [col(holes).alias("hole")], data_id)
    g = by_place(t, lambda places: nearest_holes(places, s, n, radius).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("d")))
    return g.select("id", F.when(F.col("n") >= n, F.col("d")).alias("distance"))


def data_spacing(targets: DataFrame, data: DataFrame, coords: Sequence, radius: float, composite_length: float, target_id: str | None = None, data_id: str | None = None) -> DataFrame:
    """sqrt(volume of the search ball / (composite length * samples in it)); null without samples."""
    t, s = points(targets, coords, [], target_id), points(data, coords, [], data_id)
    volume = 4 / 3 * math.pi * radius**3
    return by_place(t, lambda places: counted(places, s, radius)).select("id", F.sqrt(F.lit(volume / composite_length) / F.col("n")).alias("spacing"))


def duplicates(data: DataFrame, coords: Sequence, tolerance: float, id: str | None = None) -> DataFrame:
    """id, group of points that others lie within tolerance of, transitively; the group is its least id.

    Points of one cell are linked at once; cells by their outermost points, and by all points where that leaves them apart.
    """
    p = points(data, coords, [], id)
    if tolerance <= 0:
        same = p.groupBy("x", "y", "z").agg(F.min("id").alias("group"), F.count(F.lit(1)).alias("n")).filter("n > 1" if tolerance == 0 else "false")
        return p.join(same, ["x", "y", "z"]).select("id", "group")
    size = tolerance * 0.999 / math.sqrt(3)  # all points of a cell are linked
    at = ["cx", "cy", "cz"]
    p = p.select("*", *cells(size))
    place = F.struct("x", "y", "z")
    ends = F.array_distinct(F.array(*[f(place, a) for a in "xyz" for f in (F.min_by, F.max_by)]))
    own = p.groupBy(*at).agg(F.min("id").alias("cell"), ends.alias("ends"))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(a) for a, x in zip(at, s)]) for s in steps]))
    other = own.select(*[(F.col(a)).alias(f"{a}2") for a in at], F.col("cell").alias("cell2"), F.col("ends").alias("ends2"))
    pairs = own.withColumn("_s", step).join(other, [F.col(a) + F.col(f"_s.{a}") == F.col(f"{a}2") for a in at])

    def apart(a, b):
        return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]) + (b["z"] - a["z"]) * (b["z"] - a["z"]))

    touch = F.exists("ends", lambda a: F.exists("ends2", lambda b: apart(a, b) <= tolerance))
    pairs = pairs.select("cell", "cell2", touch.alias("touch")).persist()
    try:
        label = components(own.select(F.col("cell").alias("id")), pairs.filter("touch").select(F.col("cell").alias("a"), F.col("cell2").alias("b")))
        label = label.select(F.col("id").alias("cell"), "component")
        # cells whose ends are not near, of components that may still touch: their points are compared
        rest = pairs.filter(~F.col("touch")).join(label, "cell").join(label.select(F.col("cell").alias("cell2"), F.col("component").alias("component2")), "cell2").filter("component <> component2")
        q = p.join(own.select(*at, "cell"), at).select("cell", place.alias("p"))
        links = rest.join(q, "cell").join(q.select(F.col("cell").alias("cell2"), F.col("p").alias("p2")), "cell2").filter(apart(F.col("p"), F.col("p2")) <= tolerance)
        final = components(label.select(F.col("component").alias("id")).distinct(), links.select(F.col("component").alias("a"), F.col("component2").alias("b")).distinct())
    finally:
        pairs.unpersist()
    label = label.join(final.select(F.col("id").alias("component"), F.col("component").alias("group")), "component").select("cell", "group")
    out = p.join(own.select(*at, "cell"), at).join(label, "cell").select("id", "group")
    many = out.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    return out.join(many, "group").select("id", "group")


def merge_duplicates(data: DataFrame, coords: Sequence, values, tolerance: float, how: str = "mean", weights=None, id: str = "id") -> DataFrame:
    """Points with each group of duplicates made one: its weighted mean, first or greatest value, at the first place."""
    w = F.lit(1.0) if weights is None else value(weights)
    t = points(data, coords, [value(values).alias("v"), w.alias("w")], id).join(duplicates(data, coords, tolerance, id), "id", "left")
    g = t.groupBy(F.coalesce("group", "id").alias("id"))
    made = {"mean": divided(F.sum(F.when(F.col("v").isNotNull(), F.col("v") * F.col("w"))), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))), "first": F.min_by("v", "id"), "max": F.max("v")}[how]
    return g.agg(F.min_by("x", t["id"]).alias("x"), F.min_by("y", t["id"]).alias("y"), F.min_by("z", t["id"]).alias("z"), made.alias("v"), F.count(F.lit(1)).alias("n"))


def nearest_pairs(a: DataFrame, b: DataFrame, coords: Sequence, max_distance: float, a_id: str, b_id: str) -> DataFrame:
    """a, b, distance: the nearest b of each a within max_distance, ties by id."""
    n = nearest(points(a, coords, [], a_id), points(b, coords, [], b_id), 1, max_distance)
    return n.select(F.col("id").alias("a"), F.col("id2").alias("b"), "distance")


def unique_pairs(a: DataFrame, b: DataFrame, coords: Sequence, max_distance: float, a_id: str, b_id: str) -> DataFrame:
    """Pairs taken closest first (ties by ids) so that no point is used twice.

    Points that are each other's nearest are paired, round by round; candidates are not listed.
    """
    return greedy_pairs(points(a, coords, [], a_id).select("id", "x", "y", "z"), points(b, coords, [], b_id).select("id", "x", "y", "z"), max_distance)


def soft_boundary(data: DataFrame, coords: Sequence, values, domains, target: str, buffer: float, id: str, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Statistics of a domain alone, and with the other domains' samples that lie within buffer of it."""
    s = points(data, coords, [value(values).alias("v"), col(domains).cast("string").alias("g")], id).filter("v is not null")
    own, rest = s.filter(F.col("g") == target), s.filter(F.col("g") != target)
    near = within(rest, own.select("id", "x", "y", "z"), buffer).select("id", "v").distinct()
    t = own.select("v", F.lit("hard").alias("boundary")).union(own.select("v", F.lit("soft"))).union(near.select("v", F.lit("soft")))
    t = t.withColumn("w", F.lit(1.0))
    g = t.groupBy("boundary").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    return g.join(weighted_quantiles(t, ["boundary"], quantiles, "v", "w"), "boundary")


def pairs_by_lag(data: DataFrame, coords: Sequence, values, max_lag: float, id: str, azimuth: float | None = None, dip: float = 0.0, tolerance: float = 22.5, bandwidth: float | None = None, other=None, holes=None) -> DataFrame:
    """Each unordered pair of samples once: id < id2, v, v2 (w, w2 of the other variable), distance, offsets; in a cone if asked."""
    s = _samples(data, coords, values, id, w=value(other) if other is not None else None, hole=holes)
    if holes is not None:  # pairs of one hole: the hole is the join key
        t = s.join(second(s), F.col("hole") == F.col("hole2")).withColumn("distance", F.sqrt(sum(((F.col(f"{a}2") - F.col(a)) * (F.col(f"{a}2") - F.col(a)) for a in "yz"), (F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x"))))).filter(F.col("distance") <= max_lag)
    else:
        t = within(s, s, max_lag)
    t = t.filter((F.col("id") < F.col("id2")) & (F.col("distance") > 0))
    if azimuth is not None:
        u = direction(azimuth, dip)
        along = sum(((F.col(f"{a}2") - F.col(a)) * c for a, c in zip("yz", u[1:])), (F.col("x2") - F.col("x")) * u[0])
        t = t.withColumn("along", along).filter(F.abs("along") >= F.col("distance") * math.cos(math.radians(tolerance)) - 1e-12)
        if bandwidth is not None:
            t = t.filter(F.sqrt(F.greatest(F.col("distance") * F.col("distance") - F.col("along") * F.col("along"), F.lit(0.0))) <= bandwidth)
    return t


def experimental_variogram(data: DataFrame, coords: Sequence, values, lag: float, max_lag: float, id: str, estimator: str = "matheron", standardize: bool = False, other=None, **cone) -> DataFrame:
    """bin, lag, distance, pairs, gamma: empty bins omitted.

    One cell join and one aggregation of sums per bin; the estimators differ only in the sums.
    matheron, cressie_hawkins, covariance, correlogram, pairwise_relative, madogram; with `other` the cross-variogram.
    """
    bins = math.ceil(max_lag / lag) - 1
    t = pairs_by_lag(data, coords, values, max_lag, id, other=other, **cone)
    k = F.least(F.floor(F.col("distance") / lag), F.lit(bins)).cast("long")
    d, m = F.col("v2") - F.col("v"), (F.col("v2") + F.col("v")) / 2
    n = F.count(F.lit(1)).cast("double")
    if other is not None:
        gamma = F.sum(d * (F.col("w2") - F.col("w"))) / (2 * n)
    elif estimator == "matheron":
        gamma = F.sum(d * d) / (2 * n)
    elif estimator == "cressie_hawkins":
        gamma = 0.5 * F.pow(F.sum(F.sqrt(F.abs(d))) / n, F.lit(4.0)) / (0.457 + 0.494 / n + 0.045 / (n * n))
    elif estimator == "madogram":
        gamma = F.sum(F.abs(d)) / (2 * n)
    elif estimator == "pairwise_relative":
        ok = m > 0
        gamma = divided(F.sum(F.when(ok, d * d / (m * m))), 2 * F.sum(ok.cast("double")))
    else:
        s1 = F.sum(F.col("v") + F.col("v2")) / (2 * n)
        s2 = F.sum(F.col("v") * F.col("v") + F.col("v2") * F.col("v2")) / (2 * n)
        c = F.sum(F.col("v") * F.col("v2")) / n - s1 * s1
        gamma = c if estimator == "covariance" else 1 - divided(c, s2 - s1 * s1)
    g = t.groupBy(k.alias("bin")).agg(F.avg("distance").alias("distance"), F.count(F.lit(1)).alias("pairs"), gamma.alias("gamma"))
    if estimator == "covariance" or standardize:
        v = value(values)
        total = data.filter(v.isNotNull()).agg(F.var_pop(v).alias("_var"))
        g = g.crossJoin(F.broadcast(total))
        if estimator == "covariance":
            g = g.withColumn("gamma", F.col("_var") - F.col("gamma"))
        if standardize and estimator not in ("correlogram", "pairwise_relative"):
            g = g.withColumn("gamma", divided(F.col("gamma"), F.sqrt("_var") if estimator == "madogram" else F.col("_var")))
    return g.select("bin", ((F.col("bin") + 0.5) * lag).alias("lag"), "distance", "pairs", "gamma")


def downhole_variogram(data: DataFrame, coords: Sequence, values, lag: float, max_lag: float, holes, id: str) -> DataFrame:
    """Pairs of one hole by round(distance / lag); the lag is the mean distance of the pairs."""
    t = pairs_by_lag(data, coords, values, max_lag, id, holes=holes)
    k = F.floor(F.col("distance") / lag + 0.5).cast("long") - 1
    d = F.col("v2") - F.col("v")
    g = t.withColumn("bin", k).filter("bin >= 0").groupBy("bin").agg(F.avg("distance").alias("lag"), F.count(F.lit(1)).alias("pairs"), (F.sum(d * d) / (2 * F.count(F.lit(1)))).alias("gamma"))
    return g.select("bin", "lag", "pairs", "gamma")


def h_scatter(data: DataFrame, coords: Sequence, values, lag: float, tolerance: float, id: str, azimuth: float | None = None, dip: float = 0.0, angle_tolerance: float = 22.5) -> DataFrame:
    """n and Pearson correlation of head and tail of ordered pairs about lag apart, in a one-sided cone if asked."""
    s = _samples(data, coords, values, id)
    t = within(s, s, lag + tolerance).filter((F.col("id") != F.col("id2")) & (F.abs(F.col("distance") - lag) <= tolerance) & (F.col("distance") > 0))
    if azimuth is not None:
        u = direction(azimuth, dip)
        along = sum(((F.col(f"{a}2") - F.col(a)) * c for a, c in zip("yz", u[1:])), (F.col("x2") - F.col("x")) * u[0])
        t = t.filter(along >= F.col("distance") * math.cos(math.radians(angle_tolerance)) - 1e-12)
    return t.agg(F.count(F.lit(1)).alias("n"), F.corr("v", "v2").alias("correlation"))


def dissemination(madogram: DataFrame, variogram: DataFrame) -> DataFrame:
    """sqrt(pi) * madogram / sqrt(variogram) per bin."""
    m = madogram.select("bin", "lag", F.col("gamma").alias("_m"))
    return m.join(variogram.select("bin", F.col("gamma").alias("_g")), "bin").select("bin", "lag", divided(math.sqrt(math.pi) * F.col("_m"), F.sqrt("_g")).alias("dissemination"))


def variogram_map(data: DataFrame, coords: Sequence, values, lag: float, max_lag: float, id: str, steps: int = 36) -> DataFrame:
    """angle (sector of the half circle), bin, pairs, gamma of a plan."""
    bins = math.ceil(max_lag / lag) - 1
    t = pairs_by_lag(data, coords, values, max_lag, id)
    a = F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))), F.lit(180.0))
    d = F.col("v2") - F.col("v")
    g = t.groupBy(F.floor(a / (180.0 / steps)).cast("long").alias("sector"), F.least(F.floor(F.col("distance") / lag), F.lit(bins)).cast("long").alias("bin"))
    return g.agg(F.count(F.lit(1)).alias("pairs"), (F.sum(d * d) / (2 * F.count(F.lit(1)))).alias("gamma"))


def variogram_volume(data: DataFrame, coords: Sequence, values, lag: float, max_lag: float, id: str) -> DataFrame:
    """ix, iy, iz, pairs, gamma per cell of the lag vector, each pair once with its first non-zero offset positive."""
    t = lag_cells(_samples(data, coords, values, id).select("id", "x", "y", "z", "v"), lag, max_lag)
    return t.select("ix", "iy", "iz", "pairs", (F.col("square") / (2 * F.col("pairs"))).alias("gamma"))


def experimental_transiogram(data: DataFrame, coords: Sequence, categories, lag: float, max_lag: float, id: str) -> DataFrame:
    """bin, from, to, count, probability: both senses of each pair count; every class pair of a bin is listed."""
    bins = math.ceil(max_lag / lag) - 1
    s = points(data, coords, [col(categories).cast("string").alias("c")], id).filter("c is not null")
    t = within(s, s, max_lag).filter((F.col("id") != F.col("id2")) & (F.col("distance") > 0))
    n = t.groupBy(F.least(F.floor(F.col("distance") / lag), F.lit(bins)).cast("long").alias("bin"), F.col("c").alias("from"), F.col("c2").alias("to")).agg(F.count(F.lit(1)).alias("count"))
    classes = s.select("c").distinct()
    dense = n.select("bin").distinct().crossJoin(F.broadcast(classes.select(F.col("c").alias("from")))).crossJoin(F.broadcast(classes.select(F.col("c").alias("to"))))
    dense = dense.join(n, ["bin", "from", "to"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    p = divided(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy("bin", "from")).cast("double"))
    return dense.select("bin", "from", "to", "count", F.coalesce(p, F.lit(0.0)).alias("probability"))
