"""Tables of categories, local grids and polylines as functions over DataFrames, and compositions in aggregate."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import _positive, col, divided, total, value
from .eda import _weight


def drop_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows with a value in each of the columns (all of them by default); NaN is no value."""
    kinds = dict(df.dtypes)
    for c in columns or df.columns:
        df = df.filter(value(c).isNotNull() if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    return df


# ---- compositions


def _logs(df: DataFrame, parts: Sequence, weights) -> DataFrame:
    logs = [F.ln(p).alias(f"x{i}") for i, p in enumerate(_positive(parts))]
    return df.select(*logs, _weight(weights).alias("w")).na.drop().filter("w > 0")


def composition_center(df: DataFrame, parts: Sequence, weights=None) -> DataFrame:
    """part, share: the closed weighted geometric mean of complete positive rows."""
    n, t = len(parts), _logs(df, parts, weights)
    t = t.agg(*[(F.sum(F.col("w") * F.col(f"x{i}")) / F.sum("w")).alias(f"x{i}") for i in range(n)])
    top = F.greatest(*[f"x{i}" for i in range(n)])
    e = [F.exp(F.col(f"x{i}") - top) for i in range(n)]
    return t.select(F.posexplode(F.array(*[x / total(e) for x in e])).alias("part", "share"))


def variation_matrix(df: DataFrame, parts: Sequence, weights=None) -> DataFrame:
    """i, j, variance: the weighted population variance of the log ratio of each two parts, by one aggregation."""
    n, t = len(parts), _logs(df, parts, weights)
    at = [(i, j) for i in range(n) for j in range(i + 1, n)]
    first = t.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(n)])  # sums about a shift lose fewer digits
    d = {(i, j): (F.col(f"x{i}") - F.col(f"m{i}")) - (F.col(f"x{j}") - F.col(f"m{j}")) for i, j in at}
    w = F.col("w")
    t = t.crossJoin(F.broadcast(first)).agg(*[(F.sum(w * x * x) / F.sum(w) - (F.sum(w * x) / F.sum(w)) * (F.sum(w * x) / F.sum(w))).alias(f"v{i}_{j}") for (i, j), x in d.items()])
    rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.lit(0.0) if i == j else F.col(f"v{min(i, j)}_{max(i, j)}")).alias("variance")) for i in range(n) for j in range(n)]
    return t.select(F.inline(F.array(*rows)))


def total_variance(df: DataFrame, parts: Sequence, weights=None) -> DataFrame:
    """variance: the sum of the variation matrix over twice the number of parts."""
    return variation_matrix(df, parts, weights).agg((F.sum("variance") / (2 * len(parts))).alias("variance"))


# ---- categories


@dataclass(frozen=True)
class Categories:
    """Names with their places as codes. Names merged into `other` have its code."""

    names: tuple[str, ...]
    merged: tuple[str, ...] = ()
    other: str | None = None

    def encode(self, c: Column | str) -> Column:
        """The code of a label; an unlisted one has that of `other`, else it is an error. Null stays null."""
        code = {n: i for i, n in enumerate(self.names)}
        c = col(c).cast("string")
        rest = F.lit(code[self.other]) if self.other in code else F.raise_error(F.concat(F.lit("no category "), c)).cast("int")
        known = F.lit(None).cast("int")
        if code:
            pairs = F.create_map(*[F.lit(x) for item in code.items() for x in item])
            known = F.try_element_at(pairs, c)
        return F.when(c.isNotNull(), F.coalesce(known, rest))

    def decode(self, c: Column | str) -> Column:
        return F.get(F.array(*[F.lit(n) for n in self.names]).cast("array<string>"), col(c).cast("int"))

    def lump(self, names: Sequence[str], into: str = "other") -> Categories:
        """The same categories with some names merged into one, which stands last if it is new."""
        if gone := [n for n in names if n not in self.names]:
            raise KeyError(f"no category {gone[0]!r}")
        left = [n for n in self.names if n not in names]
        return Categories(tuple(left if into in left else [*left, into]), (*self.merged, *(n for n in names if n != into)), into)

    def shares(self, df: DataFrame, codes: Column | str, weights=None) -> DataFrame:
        """code, name, share: the weighted share of each category of the rows with a code; 0 where none has it."""
        t = df.select(col(codes).cast("int").alias("code"), _weight(weights).alias("w")).filter("code is not null").groupBy("code").agg(F.sum("w").alias("w"))
        each = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(self.names)], "code int, name string")
        t = each.join(F.broadcast(t), "code", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))  # a row a category
        return t.select("code", "name", divided(F.col("w"), F.sum("w").over(Window.partitionBy())).alias("share"))


def categories(df: DataFrame, values: Column | str, weights=None, min_share: float = 0.0, mapping: Mapping[str, str] | None = None, other: str = "other") -> Categories:
    """The names of a column in order, as numbers where all are whole numbers; names under `min_share` become `other`, which comes last.

    One row a name reaches the driver.
    """
    v = col(values).cast("string")
    if mapping:
        v = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in mapping.items() for x in item]), v), v)
    found = {r.n: r.w for r in df.select(v.alias("n"), _weight(weights).alias("w")).filter("n is not null").groupBy("n").agg(F.sum("w").alias("w")).collect()}
    whole = sum(found[n] for n in sorted(found))
    rare = [n for n in found if whole and found[n] / whole < min_share]
    kept = [n for n in found if n not in rare]
    numbers = all(n.lstrip("+-").isdecimal() for n in kept)
    kept.sort(key=lambda n: (int(n) if numbers else 0, n))
    return Categories(tuple([n for n in kept if n != other] + ([other] if rare or other in kept else [])), tuple(sorted(rare)), other if rare else None)


# ---- local grids


@dataclass(frozen=True)
class LocalGrid:
    """A similarity from a local to a projected plane: scale, clockwise rotation in degrees and shift; heights move by z_shift."""

    scale: float
    rotation: float
    shift: tuple[float, float]
    z_shift: float = 0.0

    def _turn(self) -> tuple[float, float]:
        a = math.radians(self.rotation)
        return self.scale * math.cos(a), -self.scale * math.sin(a)

    def apply(self, x, y, z=0.0) -> list[Column]:
        a, b = self._turn()
        x, y, z = (value(F.lit(c) if isinstance(c, (int, float)) else c) for c in (x, y, z))
        return [self.shift[0] + a * x - b * y, self.shift[1] + b * x + a * y, z + self.z_shift]

    def inverse(self, x, y, z=0.0) -> list[Column]:
        a, b = self._turn()
        x, y, z = (value(F.lit(c) if isinstance(c, (int, float)) else c) for c in (x, y, z))
        u, v, k = x - self.shift[0], y - self.shift[1], a * a + b * b
        return [(a * u + b * v) / k, (a * v - b * u) / k, z - self.z_shift]

    def residuals(self, local: Sequence, projected: Sequence) -> list[Column]:
        return [value(p) - q for p, q in zip(projected, self.apply(*local))]


def fit_local_grid(df: DataFrame, local: Sequence, projected: Sequence, z: bool = True) -> LocalGrid:
    """Least squares over control points: two aggregations."""
    t = df.select(*[value(c).alias(n) for n, c in zip(("lx", "ly", "lz", "px", "py", "pz"), [*local, *projected])]).na.drop()
    m = t.agg(*[F.avg(c).alias(c) for c in t.columns]).first()
    u, v, p, q = (F.col(c) - F.lit(m[c]) for c in ("lx", "ly", "px", "py"))
    s = t.agg(F.sum(u * p + v * q).alias("a"), F.sum(u * q - v * p).alias("b"), F.sum(u * u + v * v).alias("n"), F.count(F.lit(1)).alias("k")).first()
    if s.k < 2 or not s.n:
        raise ValueError("two control points at different places are needed")
    a, b = s.a / s.n, s.b / s.n
    return LocalGrid(math.hypot(a, b), math.degrees(-math.atan2(b, a)) % 360, (m.px - a * m.lx + b * m.ly, m.py - b * m.lx - a * m.ly), m.pz - m.lz if z else 0.0)


# ---- polylines: a row a vertex, in order


def polyline_points(df: DataFrame, feature, order: Sequence, coords: Sequence, part=None) -> DataFrame:
    """feature, part, vertex (from 0), x, y, z of each vertex with a place."""
    c = [value(x) for x in coords] + [F.lit(0.0)] * (3 - len(coords))
    p = F.lit(0) if part is None else col(part)
    t = df.select(col(feature).alias("feature"), p.alias("part"), *[x.alias(n) for x, n in zip(c, "xyz")], *[col(o).alias(f"_o{i}") for i, o in enumerate(order)]).na.drop(subset=["x", "y", "z"])
    w = Window.partitionBy("feature", "part").orderBy(*[f"_o{i}" for i in range(len(order))])
    return t.withColumn("vertex", F.row_number().over(w) - 1).select("feature", "part", "vertex", "x", "y", "z")


def polyline_lengths(vertices: DataFrame, closed: bool = False) -> DataFrame:
    """feature, length: the sum of its parts' lengths in space; closed parts with the way back to their first vertex."""
    w = Window.partitionBy("feature", "part").orderBy("vertex")
    step = F.sqrt(total([(F.col(c) - F.lag(c).over(w)) ** 2 for c in "xyz"]))
    t = vertices.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    if closed:
        ends = [F.struct("x", "y", "z")] * 2
        parts = t.groupBy("feature", "part").agg(F.sum("_step").alias("_step"), F.min_by(ends[0], "vertex").alias("_a"), F.max_by(ends[1], "vertex").alias("_b"))
        t = parts.withColumn("_step", F.col("_step") + F.sqrt(total([(F.col(f"_a.{c}") - F.col(f"_b.{c}")) ** 2 for c in "xyz"])))
    return t.groupBy("feature").agg(F.sum("_step").alias("length"))


def polyline_areas(vertices: DataFrame) -> DataFrame:
    """feature, area: the shoelace area of each feature's closed parts in the plane, holes wound the other way taken off; fewer than three vertices have none."""
    w = Window.partitionBy("feature", "part").orderBy("vertex")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xy")
    ox, oy = (F.first(c).over(whole) for c in "xy")
    enough = F.count(F.lit(1)).over(whole) >= 3
    t = vertices.withColumn("_a", F.when(enough, 1.0).otherwise(0.0) * ((F.col("x") - ox) * (ny - oy) - (nx - ox) * (F.col("y") - oy)))
    return t.groupBy("feature").agg((F.abs(F.sum("_a")) / 2).alias("area"))


def combine_proportions(df: DataFrame, vertical: Sequence, areal: Sequence, overall: Sequence) -> list[Column]:
    """The proportions of each category from a vertical and an areal one: their product over the overall one, closed."""
    p = [F.when(value(g) > 0, value(v) * value(a) / value(g)).otherwise(0.0) for v, a, g in zip(vertical, areal, overall)]
    return [divided(x, total(p)) for x in p]
