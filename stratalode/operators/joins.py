"""Spatial joins as equi-joins on computed cells: within a distance, k nearest, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import value
from . import near

AXES = ("x", "y", "z")


def points(df: DataFrame, coords: Sequence, keep: Sequence = (), id: str | None = None) -> DataFrame:
    """id, x, y, z (0 where there are fewer axes) and kept columns; rows without a place are left out.

    Without an id column the rows are numbered in the order of all that is kept, so the numbers do not depend on partitions.
    """
    cols = [value(c).alias(a) for c, a in zip(coords, AXES)] + [F.lit(0.0).alias(a) for a in AXES[len(coords) :]]
    t = df.select(*([F.col(id).alias("id")] if id else []), *cols, *keep).filter("x is not null and y is not null and z is not null")
    if id:
        return t
    return t.withColumn("id", F.row_number().over(Window.orderBy(*t.columns)).cast("long"))


def cells(size: float, suffix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{a}{suffix}") / float(size)).cast("long").alias(f"c{a}") for a in AXES]


def spread(df: DataFrame, size: float, reach: float, axes: Sequence[str] = AXES) -> DataFrame:
    """Each row once for every cell that a ball of radius reach around it touches."""
    for a in AXES:
        c = F.sequence(F.floor((F.col(a) - reach) / size).cast("long"), F.floor((F.col(a) + reach) / size).cast("long")) if a in axes else F.array(F.floor(F.col(a) / size).cast("long"))
        df = df.withColumn(f"c{a}", F.explode(c))
    return df


def second(df: DataFrame) -> DataFrame:
    """All columns with a 2 at the end."""
    return df.select(*[F.col(c).alias(f"{c}2") for c in df.columns])


def d2() -> Column:
    return sum(((F.col(f"{a}2") - F.col(a)) * (F.col(f"{a}2") - F.col(a)) for a in AXES[1:]), (F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")))


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows of a and b (columns of b with a 2 at the end) at most radius apart, and their distance.

    Cells are as wide as the radius; only one side is repeated for its neighbour cells, so no pair is met
    twice. AQE splits the cells that are dense.
    """
    near = spread(a, radius, radius).join(second(b.select("*", *cells(radius))), (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2")) & (F.col("cz") == F.col("cz2")))
    near = near.withColumn("distance", F.sqrt(d2())).filter(F.col("distance") <= radius)
    return near.drop("cx", "cy", "cz", "cx2", "cy2", "cz2")


def nearest(a: DataFrame, b: DataFrame, k: int, radius: float, condition: Column | None = None, spare: int | None = None) -> DataFrame:
    """The k nearest rows of b within radius of each row of a, with distance and rank; ties by id of b.

    A condition on the pairs leaves out `spare` rows of b at most for each row of a; where that is not known, all pairs
    within radius are listed.
    """
    w = Window.partitionBy("id").orderBy("distance", "id2")
    if condition is None:
        return near.nearest(a, b, k, radius)
    t = within(a, b, radius) if spare is None else near.nearest(a, b, k + spare, radius).drop("rank")
    return t.filter(condition).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component: the least id reachable through links (a, b); labels spread and jump until nothing changes."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b"), F.col("a"))).distinct().persist()
    label = nodes.select("id", F.col("id").alias("component"))
    try:
        for _ in range(rounds):
            near = both.join(label.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
            new = label.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
            hop = new.select(F.col("id").alias("component"), F.col("component").alias("next"))
            new = new.join(hop, "component", "left").select("id", "was", F.least("component", F.coalesce("next", "component")).alias("component"))
            if new.sparkSession.sparkContext.getCheckpointDir():
                new = new.checkpoint()
            else:
                new = new.persist()
            label = new.select("id", "component")
            if new.filter("was <> component").isEmpty():
                return label
    finally:
        both.unpersist()
    raise RuntimeError("components did not settle")
