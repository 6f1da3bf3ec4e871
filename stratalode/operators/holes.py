"""Drill holes: interval tables, desurvey, compositing, checks. A hole is always the partition; windows do the rest."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, divided, value


def _interval(df: DataFrame, hole: str, from_: str, to: str) -> DataFrame:
    return df.withColumn(from_, value(from_)).withColumn(to, value(to)).filter(F.col(hole).isNotNull() & (F.col(from_) < F.col(to)))


def overlapping(df: DataFrame, hole: str = "HOLE_ID", from_: str = "FROM", to: str = "TO") -> DataFrame:
    """Rows that begin before the end of an earlier interval of their hole."""
    w = Window.partitionBy(hole).orderBy(from_, to).rowsBetween(Window.unboundedPreceding, -1)
    return _interval(df, hole, from_, to).withColumn("_end", F.max(to).over(w)).filter(F.col(from_) < F.col("_end") - 1e-9).drop("_end")


def merge_intervals(left: DataFrame, right: DataFrame, hole: str = "HOLE_ID", from_: str = "FROM", to: str = "TO") -> DataFrame:
    """Pieces between all boundaries of two tables, each with the columns of what covers it; a clash gets `_right`.

    Cuts and intervals go through one window: intervals are spread over the numbers of the cuts they
    span, an equi-join, so no range join is made.
    """
    left, right = _interval(left, hole, from_, to), _interval(right, hole, from_, to)
    ends = None
    for t in (left, right):
        one = t.select(F.col(hole).alias("_h"), F.explode(F.array(from_, to)).alias("_d"))
        ends = one if ends is None else ends.union(one)
    w = Window.partitionBy("_h").orderBy("_d")
    cuts = ends.distinct().withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_d").over(w))
    pieces = cuts.filter("_next is not null").select("_h", "_k", F.col("_d").alias(from_), F.col("_next").alias(to))
    number = cuts.select("_h", "_d", "_k")

    def spread(t: DataFrame, names: dict[str, str]) -> DataFrame:
        a = number.select(F.col("_h").alias("_h1"), F.col("_d").alias("_d1"), F.col("_k").alias("_k1"))
        b = number.select(F.col("_h").alias("_h2"), F.col("_d").alias("_d2"), F.col("_k").alias("_k2"))
        t = t.join(a, (F.col(hole) == F.col("_h1")) & (F.col(from_) == F.col("_d1"))).join(b, (F.col(hole) == F.col("_h2")) & (F.col(to) == F.col("_d2")))
        t = t.withColumn("_k", F.explode(F.sequence("_k1", F.col("_k2") - 1)))
        return t.select(F.col(hole).alias("_h"), "_k", F.lit(True).alias("_in"), *[F.col(c).alias(n) for c, n in names.items()])

    own = [c for c in left.columns if c not in (hole, from_, to)]
    other = {c: f"{c}_right" if c in own else c for c in right.columns if c not in (hole, from_, to)}
    a = spread(left, {c: c for c in own}).withColumnRenamed("_in", "_a")
    b = spread(right, other).withColumnRenamed("_in", "_b")
    out = pieces.join(a, ["_h", "_k"], "left").join(b, ["_h", "_k"], "left").filter("_a is not null or _b is not null")
    return out.select(F.col("_h").alias(hole), from_, to, *own, *other.values())


def composite(df: DataFrame, length: float, grades: Sequence[str], hole: str = "HOLE_ID", from_: str = "FROM", to: str = "TO", domain: str | None = None, residual: str = "keep", min_fraction: float = 0.5, categories: Sequence[str] = ()) -> DataFrame:
    """Composites of equal sampled length within runs of one domain: from, to, length, grades and the length behind each.

    Along a run the sampled length is one axis; each interval is dealt to the composites it touches. A tail
    shorter than min_fraction of the length is kept, dropped or merged into the one before. Categories:
    the one with most length, ties to the least.
    """
    t = _interval(df, hole, from_, to)
    order = Window.partitionBy(hole).orderBy(from_, to)
    if domain:
        changed = ~F.col(domain).eqNullSafe(F.lag(domain).over(order)) | F.lag(to).over(order).isNull()
        t = t.withColumn("_run", F.sum(changed.cast("int")).over(order))
    else:
        t = t.withColumn("_run", F.lit(1))
    run = Window.partitionBy(hole, "_run")
    t = t.withColumn("_c1", F.sum(F.col(to) - F.col(from_)).over(run.orderBy(from_, to)))
    t = t.withColumn("_c0", F.col("_c1") - (F.col(to) - F.col(from_))).withColumn("_all", F.max("_c1").over(run))
    last = F.greatest(F.ceil(F.col("_all") / length - 1e-9) - 1, F.lit(0))
    tail = F.col("_all") - last * length
    short = tail < min_fraction * length - 1e-9
    t = t.withColumn("_last", last.cast("long")).withColumn("_short", short)
    first_k, last_k = F.floor(F.col("_c0") / length + 1e-9), F.ceil(F.col("_c1") / length - 1e-9) - 1
    t = t.withColumn("_k", F.explode(F.sequence(first_k.cast("long"), F.greatest(first_k, last_k).cast("long"))))
    a, b = F.greatest(F.col("_c0"), F.col("_k") * length), F.least(F.col("_c1"), (F.col("_k") + 1) * length)
    t = t.withColumn("_f", F.col(from_) + a - F.col("_c0")).withColumn("_t", F.col(from_) + b - F.col("_c0")).withColumn("_len", b - a).filter("_len > 1e-9")
    if residual == "drop":
        t = t.filter(~(F.col("_short") & (F.col("_k") == F.col("_last"))))
    elif residual == "merge":
        t = t.withColumn("_k", F.when(F.col("_short") & (F.col("_k") == F.col("_last")) & (F.col("_last") > 0), F.col("_k") - 1).otherwise(F.col("_k")))
    keys = [hole, "_run", "_k"]
    aggs = [F.min("_f").alias(from_), F.max("_t").alias(to), F.sum("_len").alias("length")]
    if domain:
        aggs.append(F.first(domain).alias(domain))
    for g in grades:
        v = value(g)
        aggs += [divided(F.sum(F.when(v.isNotNull(), v * F.col("_len"))), F.sum(F.when(v.isNotNull(), F.col("_len")))).alias(g), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_len"))), F.lit(0.0)).alias(f"{g}_length")]
    out = t.groupBy(*keys).agg(*aggs)
    for c in categories:
        n = t.filter(F.col(c).isNotNull()).groupBy(*keys, F.col(c).cast("string").alias("_c")).agg(F.sum("_len").alias("_n"))
        top = n.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), "_c"))["_c"].alias(c))
        out = out.join(top, keys, "left")
    any_grade = None
    for g in grades:
        any_grade = F.col(g).isNotNull() if any_grade is None else any_grade | F.col(g).isNotNull()
    return (out if any_grade is None else out.filter(any_grade)).drop("_run", "_k")


def _unit(azimuth: Column, inclination: Column) -> list[Column]:
    a, i = F.radians(azimuth), F.radians(inclination)
    return [F.sin(i) * F.sin(a), F.sin(i) * F.cos(a), -F.cos(i)]


def desurvey(collar: DataFrame, survey: DataFrame, hole: str = "HOLE_ID", x: str = "X", y: str = "Y", z: str = "Z", at: str = "DEPTH", azimuth: str = "AZIMUTH", dip: str = "DIP", method: str = "minimum_curvature") -> DataFrame:
    """hole, depth, x, y, z and the direction at each station, and at depth 0; dip positive down.

    minimum_curvature, tangential or balanced: each step's displacement from a station and the one before
    (lag), then running sums down the hole.
    """
    s = survey.select(F.col(hole).alias("hole"), value(at).alias("depth"), value(azimuth).alias("azimuth"), value(dip).alias("dip")).filter("hole is not null and depth is not null").dropDuplicates(["hole", "depth"])
    first = s.groupBy("hole").agg(F.min("depth").alias("d"), F.min_by("azimuth", "depth").alias("azimuth"), F.min_by("dip", "depth").alias("dip")).filter("d > 0")
    s = s.unionByName(first.select("hole", F.lit(0.0).alias("depth"), "azimuth", "dip"))
    for n, c in zip("uvw", _unit(F.col("azimuth"), 90 - F.col("dip"))):
        s = s.withColumn(n, c)
    w = Window.partitionBy("hole").orderBy("depth")
    before = [F.lag(c).over(w) for c in "uvw"]
    step = F.col("depth") - F.lag("depth").over(w)
    if method == "minimum_curvature":
        cos = F.least(F.greatest(sum((F.col(c) * b for c, b in zip("vw", before[1:])), F.col("u") * before[0]), F.lit(-1.0)), F.lit(1.0))
        beta = F.acos(cos)
        ratio = F.when(beta < 1e-9, 1.0).otherwise(2 / F.when(beta >= 1e-9, beta) * F.tan(beta / 2))
        moves = [(b + F.col(c)) / 2 * ratio * step for c, b in zip("uvw", before)]
    elif method == "balanced":
        moves = [(b + F.col(c)) / 2 * step for c, b in zip("uvw", before)]
    else:
        moves = [b * step for b in before]
    for n, m in zip("xyz", moves):
        s = s.withColumn(f"_{n}", F.coalesce(m, F.lit(0.0)))
    c = collar.select(F.col(hole).alias("hole"), value(x).alias("x0"), value(y).alias("y0"), value(z).alias("z0"))
    out = s.join(c, "hole")
    for n in "xyz":
        out = out.withColumn(n, F.col(f"{n}0") + F.sum(f"_{n}").over(w))
    return out.select("hole", "depth", "x", "y", "z", "u", "v", "w")


def positions(paths: DataFrame, at: DataFrame, hole: str, depth, keep: Sequence[str] = ()) -> DataFrame:
    """All rows of `at` (kept columns) with x, y, z at their depth: linear between stations, beyond the last along its direction.

    An as-of join made by one window: stations and depths are sorted together and each depth takes the
    station before and the station after.
    """
    station = F.struct("depth", "x", "y", "z", "u", "v", "w")
    kept = list(keep)
    a = paths.select(F.col("hole").alias("_h"), F.col("depth").alias("_d"), F.lit(0).alias("_o"), station.alias("_s"), *[F.lit(None).cast(at.schema[c].dataType).alias(c) for c in kept])
    b = at.select(F.col(hole).alias("_h"), value(depth).alias("_d"), F.lit(1).alias("_o"), F.lit(None).cast(a.schema["_s"].dataType).alias("_s"), *kept)
    w = Window.partitionBy("_h").orderBy("_d", "_o")
    t = a.unionByName(b)
    t = t.withColumn("_p", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("_s", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    t = t.filter("_o = 1 and (_p is not null)")
    share = divided(F.col("_d") - F.col("_p.depth"), F.col("_n.depth") - F.col("_p.depth"))
    out = [F.when(F.col("_n").isNotNull(), F.col(f"_p.{n}") + (F.col(f"_n.{n}") - F.col(f"_p.{n}")) * share).otherwise(F.col(f"_p.{n}") + F.col(f"_p.{u}") * (F.col("_d") - F.col("_p.depth"))).alias(n) for n, u in zip("xyz", "uvw")]
    return t.select(F.col("_h").alias("hole"), F.col("_d").alias("depth"), *kept, *out)


def samples(paths: DataFrame, intervals: DataFrame, hole: str = "HOLE_ID", from_: str = "FROM", to: str = "TO", keep: Sequence[str] = ()) -> DataFrame:
    """Interval midpoints in space."""
    return positions(paths, intervals, hole, (F.col(from_) + F.col(to)) / 2, keep)


def check_intervals(df: DataFrame, collar: DataFrame, hole: str = "HOLE_ID", from_: str = "FROM", to: str = "TO", max_depth: str | None = None, grades: Sequence[str] = (), nodata: Sequence[float] = (-99.0, -999.0, -9999.0, 1e21), tolerance: float = 1e-6) -> DataFrame:
    """All rows with flags: missing, no_collar, inverted, negative, duplicate, past_depth, sentinel, negative_grade, gap, overlap.

    overlap and gap compare with the end of the last interval that was not itself flagged as overlapping,
    a fold down the hole over its sorted intervals.
    """
    f, t = value(from_), value(to)
    c = collar.select(F.col(hole).alias("_hole"), (value(max_depth) if max_depth else F.lit(None).cast("double")).alias("_max")).dropDuplicates(["_hole"])
    d = df.join(c, F.col(hole) == F.col("_hole"), "left")
    d = d.withColumn("missing", F.col(hole).isNull() | f.isNull() | t.isNull()).withColumn("no_collar", F.col(hole).isNotNull() & F.col("_hole").isNull())
    d = d.withColumn("inverted", F.coalesce(f >= t, F.lit(False))).withColumn("negative", F.coalesce(f < 0, F.lit(False))).withColumn("past_depth", F.coalesce(t > F.col("_max") + tolerance, F.lit(False)))
    bad, low = F.lit(False), F.lit(False)
    for g in grades:
        v = value(g)
        s = F.coalesce(v.isin(*[float(x) for x in nodata]), F.lit(False))
        bad, low = bad | s, low | F.coalesce((v < 0) & ~s, F.lit(False))
    d = d.withColumn("sentinel", bad).withColumn("negative_grade", low)
    same = Window.partitionBy(hole, from_, to).orderBy(*[c for c in df.columns])
    d = d.withColumn("duplicate", ~F.col("missing") & (F.row_number().over(same) > 1))
    ok = ~(F.col("missing") | F.col("inverted") | F.col("duplicate"))
    d = d.withColumn("_id", F.when(ok, F.struct(f.alias("f"), t.alias("t"))))
    folded = d.filter("_id is not null").groupBy(F.col(hole).alias("_fh")).agg(F.array_sort(F.collect_list("_id")).alias("_all"))
    start = F.struct(F.lit(None).cast("double").alias("reach"), F.array().cast("array<struct<f:double,t:double,overlap:boolean,gap:boolean>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        over = F.coalesce(i["f"] < acc["reach"] - tolerance, F.lit(False))
        gap = F.coalesce(i["f"] > acc["reach"] + tolerance, F.lit(False))
        row = F.struct(i["f"].alias("f"), i["t"].alias("t"), over.alias("overlap"), gap.alias("gap"))
        return F.struct(F.when(over, acc["reach"]).otherwise(i["t"]).alias("reach"), F.concat(acc["out"], F.array(row)).alias("out"))

    flags = folded.select("_fh", F.explode(F.aggregate("_all", start, step)["out"]).alias("_r")).select("_fh", F.col("_r.f").alias("_ff"), F.col("_r.t").alias("_ft"), F.col("_r.overlap").alias("overlap"), F.col("_r.gap").alias("gap"))
    out = d.join(flags, (F.col(hole) == F.col("_fh")) & (f == F.col("_ff")) & (t == F.col("_ft")) & F.col("_id").isNotNull(), "left")
    names = ["missing", "no_collar", "inverted", "negative", "duplicate", "past_depth", "sentinel", "negative_grade"]
    return out.select(*df.columns, *names, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("overlap", "gap")])


def fix_intervals(flagged: DataFrame, grades: Sequence[str] = (), drop: Sequence[str] = ("missing", "no_collar", "inverted", "negative", "duplicate", "overlap"), nodata: Sequence[float] = (-99.0, -999.0, -9999.0, 1e21)) -> DataFrame:
    """Rows without the flags to drop, sentinels null and flag columns gone."""
    bad = F.lit(False)
    for d in drop:
        bad = bad | F.col(d)
    out = flagged.filter(~bad)
    for g in grades:
        out = out.withColumn(g, F.when(~value(g).isin(*[float(x) for x in nodata]), value(g)))
    return out.drop("missing", "no_collar", "inverted", "negative", "duplicate", "past_depth", "sentinel", "negative_grade", "overlap", "gap")


def planned_drillholes(spark, corner: tuple[float, float], count: tuple[int, int], spacing: tuple[float, float], rotation: float = 0.0) -> DataFrame:
    """hole, x, y of a rotated collar grid, named by (row, column) from P0001."""
    a = math.radians(rotation)
    nx, ny = count
    t = spark.range(nx * ny).withColumn("i", F.col("id") % nx).withColumn("j", F.floor(F.col("id") / nx))
    u, v = F.col("i") * spacing[0], F.col("j") * spacing[1]
    return t.select(F.format_string("P%04d", F.col("id") + 1).alias("hole"), (corner[0] + u * math.cos(a) + v * math.sin(a)).alias("x"), (corner[1] - u * math.sin(a) + v * math.cos(a)).alias("y"))


def runs(df: DataFrame, grade: str, cutoff: float, min_length: float = 0.0, max_dilution: float = 0.0, hole: str = "HOLE_ID", from_: str = "FROM", to: str = "TO") -> DataFrame:
    """Ore and waste runs per hole: neighbours of one kind joined, thin waste between ore made ore, then short ore made waste.

    Whether a run changes depends on it and its neighbours only, so many holes are done at once. Holes are sorted in their
    partition and stream through; a batch ends where a hole does.
    """
    t = _interval(df, hole, from_, to).select(hole, from_, to, value(grade).alias(grade))
    names = ["hole", "from", "to", "ore", "length", "mean"]

    def joined(hole, f, t, ore, *sums):
        """Neighbours of one hole and kind as one, where they touch."""
        new = np.ones(len(f), bool)
        new[1:] = (hole[1:] != hole[:-1]) | (ore[1:] != ore[:-1]) | ~(np.abs(t[:-1] - f[1:]) < 1e-9)
        at = np.flatnonzero(new)
        return hole[at], f[at], t[np.append(at[1:], len(f)) - 1], ore[at], *(np.add.reduceat(x, at) for x in sums)

    def made(rows):
        import pyarrow as pa

        label = rows[0].combine_chunks().dictionary_encode()
        code = label.indices.to_numpy()
        f, t, g = (rows[i].to_numpy().astype(float) for i in (1, 2, 3))
        known = np.where(np.isnan(g), 0.0, t - f)
        h, f, t, ore, n, metal, known = joined(code, f, t, g >= cutoff, t - f, np.where(np.isnan(g), 0.0, (t - f) * g), known)
        if len(f) > 2:
            touch = (h[1:] == h[:-1]) & (np.abs(t[:-1] - f[1:]) < 1e-9)
            thin = ~ore[1:-1] & ore[:-2] & ore[2:] & touch[1:] & touch[:-1] & (n[1:-1] <= max_dilution + 1e-9)
            ore[1:-1] |= thin
            h, f, t, ore, n, metal, known = joined(h, f, t, ore, n, metal, known)
        h, f, t, ore, n, metal, known = joined(h, f, t, ore & (n >= min_length - 1e-9), n, metal, known)
        mean = np.divide(metal, known, out=np.zeros(len(f)), where=known != 0)
        out = label.dictionary.take(pa.array(h))
        return pa.RecordBatch.from_arrays([out, pa.array(f), pa.array(t), pa.array(ore), pa.array(n), pa.array(mean, mask=known == 0)], names=names)

    def stream(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = []  # the hole that may go on
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0)
            cut = b.num_rows - pc.sum(pc.is_in(h, value_set=h.slice(b.num_rows - 1))).as_py()
            if held and (cut or not _same(held[-1].column(0)[-1], h[0])):
                whole = not _same(held[-1].column(0)[-1], h[0])
                yield made(pa.Table.from_batches(held if whole else [*held, b.slice(0, cut)]))
                if whole and cut:
                    yield made(pa.Table.from_batches([b.slice(0, cut)]))
                held = [b.slice(cut)]
            elif cut:
                yield made(pa.Table.from_batches([b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield made(pa.Table.from_batches(held))

    return t.repartition(hole).sortWithinPartitions(hole, from_, to).mapInArrow(stream, f"hole {dict(t.dtypes)[hole]}, `from` double, `to` double, ore boolean, length double, mean double")


def _same(a, b) -> bool:
    a, b = a.as_py(), b.as_py()
    return a == b or (a != a and b != b)
