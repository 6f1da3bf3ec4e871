"""Ranks, cumulative weights and quantiles of any number of rows: ranges of values and prefix sums, so that no task sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import divided

PARTS = 256  # ranges of values that a group is dealt into


def _same(a: Sequence[str], suffix: str = "_r") -> Column:
    out = F.lit(True)
    for c in a:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}{suffix}"))
    return out


def joined(t: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """t with the columns of `right` beside it, one row a group; nulls are a group too."""
    if not by:
        return t.crossJoin(F.broadcast(right))  # one row
    return t.join(right.withColumnsRenamed({c: f"{c}_r" for c in by}), _same(by), how).drop(*[f"{c}_r" for c in by])


def bounds(t: DataFrame, by: Sequence[str], v: str, parts: int = PARTS) -> DataFrame:
    """by, _cuts: up to parts - 1 values that deal each group's rows into about equal ranges."""
    return t.groupBy(*by).agg(F.array_distinct(F.percentile_approx(v, [i / parts for i in range(1, parts)], 4 * parts)).alias("_cuts"))


def part(v: str | Column) -> Column:
    """The number of cuts below v, by halving (cuts are in order)."""
    v = F.col(v) if isinstance(v, str) else v
    jumps = F.array(*[F.lit(1 << i) for i in range(PARTS.bit_length() - 1, -1, -1)])
    return F.aggregate(jumps, F.lit(0), lambda a, j: F.when((a + j <= F.size("_cuts")) & (F.get("_cuts", a + j - 1) < v), a + j).otherwise(a))


def cumulative(t: DataFrame, by: Sequence[str], v: str, w: str) -> DataFrame:
    """by, v, _below, _ties, _whole, _least, _most, _next: of each distinct value the weight below it, its own, the group's, the least and largest
    weight of its rows, and the next value with its least weight (null at the end).

    Equal values are summed first. Values are dealt into ranges, whose sums give where each range begins; only then a
    window orders the values of one range.
    """
    each = t.groupBy(*by, v).agg(F.sum(w).alias("_ties"), F.min(w).alias("_least"), F.max(w).alias("_most"))
    each = joined(each, bounds(t, by, v), by)
    each = each.withColumn("_part", part(v)).drop("_cuts")
    sums = each.groupBy(*by, "_part").agg(F.sum("_ties").alias("_sum"), F.min(F.struct(F.col(v).alias("v"), F.col("_least").alias("w"))).alias("_first"))
    order = Window.partitionBy(*by).orderBy("_part")  # up to PARTS rows a group
    sums = sums.select(*by, "_part", (F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(*by)).alias("_whole"), F.lead("_first").over(order).alias("_after"))
    each = joined(each, sums, [*by, "_part"])
    own = Window.partitionBy(*by, "_part").orderBy(v)
    below = F.col("_before") + F.sum("_ties").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ties")
    following = F.coalesce(F.lead(F.struct(F.col(v).alias("v"), F.col("_least").alias("w"))).over(own), F.col("_after"))
    return each.select(*by, v, below.alias("_below"), "_ties", "_whole", "_least", "_most", following.alias("_next"))


def weighted_quantiles(t: DataFrame, by: Sequence[str], quantiles: Sequence[float], v: str = "_v", w: str = "_w") -> DataFrame:
    """One row per group with q0, q1, ...: linear between the middles of the ordered weights, constant outside.

    Sums by range tell in which ranges the wanted quantiles lie; only the rows of those are shuffled and ordered.
    """
    t = t.filter(F.col(w) > 0)
    t = joined(t.select(*by, v, w), bounds(t, by, v), by).withColumn("_part", part(v)).drop("_cuts")
    order = Window.partitionBy(*by).orderBy("_part")  # up to PARTS rows a group
    sums = t.groupBy(*by, "_part").agg(F.sum(w).alias("_sum"), F.min(F.struct(F.col(v).alias("v"), F.col(w).alias("w"))).alias("_first"))
    sums = sums.withColumn("_before", F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).withColumn("_whole", F.sum("_sum").over(Window.partitionBy(*by)))
    sums = sums.withColumn("_after", F.lead("_first").over(order)).withColumn("_is_first", F.row_number().over(order) == 1)
    end = F.col("_before") + F.col("_sum")
    begins = F.when(F.col("_is_first"), F.lit(float("-inf"))).otherwise((F.col("_before") + F.col("_first.w") / 2) / F.col("_whole"))
    ends = F.when(F.col("_after").isNull(), F.lit(float("inf"))).otherwise((end + F.col("_after.w") / 2) / F.col("_whole"))
    wanted = sums.filter(F.exists(F.array(*[F.lit(float(q)) for q in quantiles]), lambda q: (q >= begins) & (q < ends)))
    rows = joined(t, wanted.select(*by, "_part", "_before", "_whole", "_after", end.alias("_end")), [*by, "_part"])
    own = Window.partitionBy(*by, "_part").orderBy(v, w)
    rows = rows.withColumn("_p", (F.col("_before") + F.sum(w).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(w) / 2) / F.col("_whole"))
    rows = rows.withColumn("_p2", F.coalesce(F.lead("_p").over(own), (F.col("_end") + F.col("_after.w") / 2) / F.col("_whole"))).withColumn("_v2", F.coalesce(F.lead(v).over(own), F.col("_after.v")))
    aggs = []
    for k, q in enumerate(quantiles):
        q = F.lit(float(q))
        between = F.col(v) + (F.col("_v2") - F.col(v)) * (q - F.col("_p")) / (F.col("_p2") - F.col("_p"))
        got = F.max(F.when((F.col("_p") <= q) & (F.col("_p2") > q), between))
        aggs.append(F.coalesce(got, F.when(q < F.min("_p"), F.min(v)).otherwise(F.max(v))).alias(f"q{k}"))
    return rows.groupBy(*by).agg(*aggs)


def mid_ranks(t: DataFrame, by: Sequence[str], v: str, w: str, out: str) -> DataFrame:
    """t with `out`: the weight below each row's value plus half that of its ties."""
    c = cumulative(t, by, v, w).select(*by, v, (F.col("_below") + F.col("_ties") / 2).alias(out))
    return joined(t, c, [*by, v])


def between(df: DataFrame, x: Column, nodes: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """All rows with `value` interpolated linearly at x in `nodes` ordered by `key`; constant outside, null where x is.

    Rows and nodes are dealt into ranges of key and sorted together within one; from the ranges beside it come the
    nodes next to it.
    """
    node = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    cuts = bounds(nodes, [], key)
    rows = df.select(x.alias("_x"), F.lit(1).alias("_o"), F.lit(None).cast("struct<k:double,v:double>").alias("_n"), F.struct(*df.columns).alias("_row"))
    some = nodes.select(F.col(key).alias("_x"), F.lit(0).alias("_o"), node.alias("_n"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    t = joined(rows.filter("_x is not null").unionByName(some), cuts, [])
    t = t.withColumn("_part", part("_x")).drop("_cuts")
    ends = joined(some, cuts, []).withColumn("_part", part("_x")).groupBy("_part").agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    ends = df.sparkSession.range(PARTS).select(F.col("id").cast("int").alias("_part")).join(ends, "_part", "left")
    order = Window.orderBy("_part")  # PARTS rows
    ends = ends.select("_part", F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    t = joined(t, ends, ["_part"])
    w = Window.partitionBy("_part").orderBy("_x", "_o")
    t = t.withColumn("_p", F.coalesce(F.last("_n", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_before")).withColumn("_q", F.coalesce(F.first("_n", True).over(w.rowsBetween(1, Window.unboundedFollowing)), "_after")).filter("_o = 1")
    share = divided(F.col("_x") - F.col("_p.k"), F.col("_q.k") - F.col("_p.k"))
    v = F.when(F.col("_p").isNull(), F.col("_q.v")).when(F.col("_q").isNull(), F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * share)
    return t.select("_row.*", v.alias(out)).unionByName(df.filter(x.isNull()).withColumn(out, F.lit(None).cast("double")))
