"""Block models: grids, regularizing, class cleaning, contacts; polygons and closed meshes as broadcast edges and faces."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col, divided, value
from .joins import nearest


@dataclass(frozen=True)
class Grid:
    """A regular grid; blocks are numbered x fastest, then y, then z. Rotation is about z, in degrees."""

    origin: tuple[float, float, float]
    size: tuple[float, float, float]
    count: tuple[int, int, int]
    rotation: float = 0.0

    def local(self, x, y, z) -> list[Column]:
        a = math.radians(self.rotation)
        dx, dy, dz = (value(c) - o for c, o in zip((x, y, z), self.origin))
        return [dx * math.cos(a) + dy * math.sin(a), -dx * math.sin(a) + dy * math.cos(a), dz]

    def cell(self, x, y, z) -> Column:
        """Block number at a place, -1 outside."""
        i, j, k = (F.floor(c / s).cast("long") for c, s in zip(self.local(x, y, z), self.size))
        inside = (i >= 0) & (i < self.count[0]) & (j >= 0) & (j < self.count[1]) & (k >= 0) & (k < self.count[2])
        return F.when(inside, i + self.count[0] * (j + self.count[1] * k)).otherwise(F.lit(-1).cast("long"))

    def index(self, cell: str = "cell") -> list[Column]:
        c, (nx, ny, _) = F.col(cell), self.count
        return [c % nx, F.floor(c / nx) % ny, F.floor(c / (nx * ny))]

    def center(self, cell: str = "cell") -> list[Column]:
        a = math.radians(self.rotation)
        u, v, w = ((i + 0.5) * s for i, s in zip(self.index(cell), self.size))
        return [self.origin[0] + u * math.cos(a) - v * math.sin(a), self.origin[1] + u * math.sin(a) + v * math.cos(a), self.origin[2] + w]

    def blocks(self, spark: SparkSession) -> DataFrame:
        t = spark.range(math.prod(self.count)).withColumnRenamed("id", "cell")
        return t.select("cell", *[c.alias(n) for n, c in zip("xyz", self.center())])


def covering(df: DataFrame, size: Sequence[float], buffer: float = 0.0, x="x", y="y", z="z") -> Grid:
    """The smallest grid of blocks of this size around all points."""
    r = df.agg(*[f(value(c)) for c in (x, y, z) for f in (F.min, F.max)]).first()
    low = [r[2 * i] - buffer for i in range(3)]
    count = [max(1, math.ceil((r[2 * i + 1] + buffer - low[i]) / size[i] + 1e-9)) for i in range(3)]
    return Grid(tuple(low), tuple(size), tuple(count))


def regularize(model: DataFrame, grid: Grid, target: Grid, values: Sequence[str] = (), classes: Sequence[str] = (), min_fraction: float = 0.0) -> DataFrame:
    """cell of target, fraction, volume-weighted means of values and classes of most volume (ties the least), by exact overlap."""
    lows, t = [], model
    for a, i, s, o, ts, to in zip("xyz", grid.index(), grid.size, grid.origin, target.size, target.origin):
        t = t.withColumn(f"_l{a}", o + i * s).withColumn(f"_h{a}", o + (i + 1) * s)
        first, last = F.floor((F.col(f"_l{a}") - to) / ts + 1e-9), F.ceil((F.col(f"_h{a}") - to) / ts - 1e-9) - 1
        t = t.withColumn(f"_k{a}", F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))))
        lows.append(F.least(F.col(f"_h{a}"), to + (F.col(f"_k{a}") + 1) * ts) - F.greatest(F.col(f"_l{a}"), to + F.col(f"_k{a}") * ts))
    nx, ny, nz = target.count
    inside = " and ".join(f"_k{a} >= 0 and _k{a} < {n}" for a, n in zip("xyz", target.count))
    whole = math.prod(target.size)
    t = t.withColumn("_v", lows[0] * lows[1] * lows[2]).filter(inside).filter(F.col("_v") > 1e-9 * whole)
    t = t.withColumn("_c", F.col("_kx") + nx * (F.col("_ky") + ny * F.col("_kz")))
    aggs = [F.sum("_v").alias("_all")]
    for v in values:
        known = value(v).isNotNull()
        aggs.append(divided(F.sum(F.when(known, value(v) * F.col("_v"))), F.sum(F.when(known, F.col("_v")))).alias(v))
    out = t.groupBy("_c").agg(*aggs)
    for c in classes:
        votes = t.filter(F.col(c).isNotNull()).groupBy("_c", c).agg(F.sum("_v").alias("_n"))
        out = out.join(votes.groupBy("_c").agg(F.min(F.struct(-F.col("_n"), F.col(c)))[c].alias(c)), "_c", "left")
    enough = F.col("_all") / whole >= min_fraction
    return out.select(F.col("_c").alias("cell"), (F.col("_all") / whole).alias("fraction"), *[F.when(enough, F.col(c)).alias(c) for c in (*values, *classes)])


def discretize(grid: Grid, blocks: DataFrame, n: Sequence[int]) -> DataFrame:
    """n nodes per axis in every block: cell, node, x, y, z."""
    t = blocks.select("cell").withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(math.prod(n) - 1))))
    sub = [F.col("node") % n[0], F.floor(F.col("node") / n[0]) % n[1], F.floor(F.col("node") / (n[0] * n[1]))]
    a = math.radians(grid.rotation)
    u, v, w = ((i + (k + 0.5) / m) * s for i, k, m, s in zip(grid.index(), sub, n, grid.size))
    return t.select("cell", "node", (grid.origin[0] + u * math.cos(a) - v * math.sin(a)).alias("x"), (grid.origin[1] + u * math.sin(a) + v * math.cos(a)).alias("y"), (grid.origin[2] + w).alias("z"))


def smooth_classes(model: DataFrame, grid: Grid, classes: str, window: Sequence[int] = (3, 3, 1), iterations: int = 1) -> DataFrame:
    """cell, class after majority votes in a window; the own class stays on a tie, else the least class wins."""
    t = model.select("cell", F.col(classes).alias("c")).filter("c is not null")
    nx, ny, nz = grid.count
    offsets = [(i, j, k) for i in range(-(window[0] // 2), window[0] // 2 + 1) for j in range(-(window[1] // 2), window[1] // 2 + 1) for k in range(-(window[2] // 2), window[2] // 2 + 1)]
    for _ in range(iterations):
        i, j, k = grid.index()
        o = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("ijk", o)]) for o in offsets]))
        v = t.select("c", i.alias("i"), j.alias("j"), k.alias("k"), o.alias("o"))
        v = v.select("c", (F.col("i") + F.col("o.i")).alias("i"), (F.col("j") + F.col("o.j")).alias("j"), (F.col("k") + F.col("o.k")).alias("k"))
        v = v.filter((F.col("i") >= 0) & (F.col("i") < nx) & (F.col("j") >= 0) & (F.col("j") < ny) & (F.col("k") >= 0) & (F.col("k") < nz))
        votes = v.groupBy((F.col("i") + nx * (F.col("j") + ny * F.col("k"))).alias("cell"), "c").agg(F.count(F.lit(1)).alias("n"))
        mine = t.select("cell", F.col("c").alias("own"))
        best = votes.join(mine, "cell").groupBy("cell").agg(F.min(F.struct(-F.col("n"), (F.col("c") != F.col("own")).cast("int"), F.col("c")))["c"].alias("c"))
        t = best
    return t.select("cell", F.col("c").alias(classes))


def contact_distance(model: DataFrame, grid: Grid, classes: str, reach: float, target=None) -> DataFrame:
    """cell, distance to the nearest centre of another class within reach; with target, signed: its own blocks negative."""
    t = model.select(F.col("cell").alias("id"), F.col(classes).alias("c"), *[c.alias(n) for n, c in zip("xyz", grid.center())]).filter("c is not null")
    if target is not None:
        t = t.withColumn("c", F.col("c") == target)
    near = nearest(t, t, 1, reach, F.col("c") != F.col("c2"))
    d = F.col("distance") if target is None else F.when(F.col("c"), -F.col("distance")).otherwise(F.col("distance"))
    return t.select("id").join(near.select("id", d.alias("distance")), "id", "left").withColumnRenamed("id", "cell")


def block_shell(model: DataFrame, grid: Grid) -> DataFrame:
    """cell, face (-x, +x, -y, +y, -z, +z) of the faces that no other block of the model covers."""
    nx, ny, nz = grid.count
    i, j, k = grid.index()
    sides = [("-x", -1, i, 0), ("+x", 1, i, nx - 1), ("-y", -nx, j, 0), ("+y", nx, j, ny - 1), ("-z", -nx * ny, k, 0), ("+z", nx * ny, k, nz - 1)]
    faces = F.array(*[F.struct(F.lit(n).alias("face"), F.when(at != edge, F.col("cell") + step).alias("next")) for n, step, at, edge in sides])
    t = model.select("cell", F.explode(faces).alias("f")).select("cell", "f.*")
    return t.join(model.select(F.col("cell").alias("next")), "next", "left_anti").select("cell", "face")


# ---- polygons: a ring is a list of (x, y)


def _edges(spark: SparkSession, rings: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    rows = [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for r in rings for a, b in zip(r, [*r[1:], r[0]])]
    return F.broadcast(spark.createDataFrame(rows, "ax double, ay double, bx double, by double"))


def in_polygon(points: DataFrame, rings: Sequence, x="x", y="y", id: str = "id") -> DataFrame:
    """id, inside: an odd number of edges is crossed. The rings are the caller's own short lists."""
    p = points.select(F.col(id).alias("id"), value(x).alias("px"), value(y).alias("py"))
    t = p.crossJoin(_edges(points.sparkSession, rings))
    crosses = ((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))) & (F.col("px") < F.try_divide((F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")), F.col("by") - F.col("ay")) + F.col("ax"))
    return t.groupBy("id").agg((F.sum(F.coalesce(crosses, F.lit(False)).cast("int")) % 2 == 1).alias("inside"))


def polygon_distance(points: DataFrame, rings: Sequence, x="x", y="y", id: str = "id") -> DataFrame:
    """id, distance to the nearest edge in plan."""
    p = points.select(F.col(id).alias("id"), value(x).alias("px"), value(y).alias("py"))
    t = p.crossJoin(_edges(points.sparkSession, rings))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = F.coalesce(F.try_divide((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
    s = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    qx, qy = F.col("px") - F.col("ax") - s * dx, F.col("py") - F.col("ay") - s * dy
    return t.groupBy("id").agg(F.sqrt(F.min(qx * qx + qy * qy)).alias("distance"))


def ring_area(ring: Sequence[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]]))) / 2


def winding_number(points: DataFrame, vertices: Sequence, triangles: Sequence, id: str = "id") -> DataFrame:
    """id, winding: the sum of signed solid angles of a mesh's triangles over 4 pi; above a half in size is inside."""
    rows = [tuple(float(c) for v in t for c in vertices[v]) for t in triangles]
    names = [f"{v}{a}" for v in "abc" for a in "xyz"]
    faces = F.broadcast(points.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names)))
    t = points.select(F.col(id).alias("id"), *[value(a).alias(f"p{a}") for a in "xyz"]).crossJoin(faces)
    a, b, c = ([F.col(f"{v}{n}") - F.col(f"p{n}") for n in "xyz"] for v in "abc")

    def dot(u, v):
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    cross = [b[1] * c[2] - b[2] * c[1], b[2] * c[0] - b[0] * c[2], b[0] * c[1] - b[1] * c[0]]
    la, lb, lc = (F.sqrt(dot(u, u)) for u in (a, b, c))
    angle = 2 * F.atan2(dot(a, cross), la * lb * lc + dot(a, b) * lc + dot(b, c) * la + dot(c, a) * lb)
    return t.groupBy("id").agg((F.sum(angle) / (4 * math.pi)).alias("winding"))


def assign_domain(targets: DataFrame, data: DataFrame, domains, n: int = 1, target_id: str = "id", data_id: str = "id") -> DataFrame:
    """id, domain, confidence: the label of the nearest sample, or the most common of the n nearest, however far (ties: that of the nearest)."""
    from .joins import points
    from .near import by_place

    t, s = points(targets, ["x", "y", "z"], [], target_id), points(data, ["x", "y", "z"], [col(domains).cast("string").alias("g")], data_id).filter("g is not null")

    def made(places):
        votes = nearest(places, s, n, math.inf).groupBy("id", "g2").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r"))
        best = votes.groupBy("id").agg(F.min(F.struct(-F.col("n"), "r", "g2", F.col("n").alias("m"))).alias("b"), F.sum("n").alias("all"))
        return best.select("id", F.col("b.g2").alias("domain"), (F.col("b.m") / F.col("all")).alias("confidence"))

    return by_place(t, made)
