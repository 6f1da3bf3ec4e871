"""Queries of containers, anamorphosis and ensembles, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import containers, eda, ensembles, hermite, kriging, spatial
from .queries import SAMPLES, XYZ, query, samples

# ---- compositions in aggregate

PARTS = ["l_quantity", "_discount", "_tax"]
_L = "select ln(l_quantity) as x0, ln(1 + 100 * l_discount) as x1, ln(1 + 100 * l_tax) as x2, l_extendedprice as w from lineitem"
_E = ", ".join(f"exp(sum(w * x{i}) / sum(w)) as e{i}" for i in range(3))
_PAIRS = "select i, j, w, list_value(x0, x1, x2)[i + 1] - list_value(x0, x1, x2)[j + 1] as d from ({}), (select unnest([0, 1, 2]) as i), (select unnest([0, 1, 2]) as j)".format(_L)
_V = f"select i, j, sum(w * (d - m) ** 2) / sum(w) as variance from (select p.*, (sum(w * d) over (partition by i, j)) / (sum(w) over (partition by i, j)) as m from ({_PAIRS}) p) group by 1, 2"


def _parts(t):
    return t("lineitem").withColumns({"_discount": 1 + 100 * F.col("l_discount"), "_tax": 1 + 100 * F.col("l_tax")})


@query("composition_center", f"select part, e / sum(e) over () as share from (select unnest([0, 1, 2]) as part, unnest([e0, e1, e2]) as e from (select {_E} from ({_L})))", "share")
def _(t):
    return containers.composition_center(_parts(t), PARTS, "l_extendedprice")


@query("variation_matrix", _V, "variance")
def _(t):
    return containers.variation_matrix(_parts(t), PARTS, "l_extendedprice").withColumn("variance", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("variance")))


@query("total_variance", f"select sum(variance) / 6 as variance from ({_V})", "variance")
def _(t):
    return containers.total_variance(_parts(t), PARTS, "l_extendedprice")


# ---- tables, categories

_NULLS = "select p_partkey, case when p_size % 7 <> 0 then p_retailprice end as a, case when p_size % 5 <> 0 then p_brand end as b from part"


def _nulls(t):
    return t("part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("a"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("b"))


@query("drop_null", f"select * from ({_NULLS}) where a is not null and b is not null", "a")
def _(t):
    return containers.drop_null(_nulls(t))


_SHARE = "select p_brand as n, sum(p_size) / (select sum(p_size) from part) as share from part group by 1"
_NAMES = f"select p_brand, case when s.share < 0.04 then 'other' else p_brand end as name, p_size from part join ({_SHARE}) s on s.n = p_brand"


def _brands(t) -> containers.Categories:
    return containers.categories(t("part"), "p_brand", "p_size", 0.04)


@query("category_shares", f"select name, sum(p_size) / (select sum(p_size) from part) as share from ({_NAMES}) group by 1", "share")
def _(t):
    c = _brands(t)
    return c.shares(t("part").withColumn("code", c.encode("p_brand")), "code", "p_size").select("name", "share")


@query("category_codes", f"with n as (select distinct name from ({_NAMES})), k as (select name, row_number() over (order by name = 'other', name) - 1 as code from n), m as (select distinct p_brand, name from ({_NAMES})) select p_partkey, code, k.name as label from part join m using (p_brand) join k on k.name = m.name")
def _(t):
    c = _brands(t)
    return t("part").select("p_partkey", c.encode("p_brand").alias("code")).withColumn("label", c.decode("code"))


@query("category_lump", "select case when p_size in (1, 2, 3) then 'small' else p_size::VARCHAR end as label, count(*) as n from part group by 1")
def _(t):
    c = containers.categories(t("part"), "p_size").lump(["1", "2", "3"], "small")
    return t("part").select(c.decode(c.encode("p_size")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- local grids

_CONTROL = f"select id, x, y, z, 1000 + 1.5 * x - 0.7 * y + v as px, 2000 + 0.7 * x + 1.5 * y - v as py, z + 12 + v as pz from ({SAMPLES})"
_MEANS = f"select *, avg(x) over () as mx, avg(y) over () as my, avg(z) over () as mz, avg(px) over () as nx, avg(py) over () as ny, avg(pz) over () as nz from ({_CONTROL})"
_FIT = f"select *, sum((x - mx) * (px - nx) + (y - my) * (py - ny)) over () / sum((x - mx) ** 2 + (y - my) ** 2) over () as a, sum((x - mx) * (py - ny) - (y - my) * (px - nx)) over () / sum((x - mx) ** 2 + (y - my) ** 2) over () as b from ({_MEANS})"


def _control(t):
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    return samples(t).withColumns({"px": 1000 + 1.5 * x - 0.7 * y + v, "py": 2000 + 0.7 * x + 1.5 * y - v, "pz": F.col("z") + 12 + v})


@query("local_grid_residuals", f"select id, px - nx - a * (x - mx) + b * (y - my) as dx, py - ny - b * (x - mx) - a * (y - my) as dy, pz - z - nz + mz as dz from ({_FIT})", "dx dy dz")
def _(t):
    d = _control(t)
    g = containers.fit_local_grid(d, XYZ, ["px", "py", "pz"])
    return d.select("id", *[c.alias(n) for c, n in zip(g.residuals(XYZ, ["px", "py", "pz"]), ("dx", "dy", "dz"))])


@query("local_grid_inverse", f"select id, mx + (a * (px - nx) + b * (py - ny)) / (a * a + b * b) as x, my + (a * (py - ny) - b * (px - nx)) / (a * a + b * b) as y from ({_FIT})", "x y")
def _(t):
    d = _control(t)
    g = containers.fit_local_grid(d, XYZ, ["px", "py", "pz"])
    x, y, _ = g.inverse("px", "py", "pz")
    return d.select("id", x.alias("x"), y.alias("y"))


# ---- polylines

_LINE = "select p_size as feature, p_partkey % 2 as part, row_number() over (partition by p_size, p_partkey % 2 order by p_partkey) - 1 as vertex, p_retailprice as x, (p_partkey * p_partkey % 41)::DOUBLE as y, (p_partkey % 17)::DOUBLE as z from part"
_NEXT = f"select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny, coalesce(lead(z) over w, first_value(z) over w) as nz, lead(x) over w is null as last from ({_LINE}) window w as (partition by feature, part order by vertex)"


def _lines(t):
    k = F.col("p_partkey")
    return containers.polyline_points(t("part"), "p_size", ["p_partkey"], ["p_retailprice", k * k % 41, k % 17], part=k % 2)


@query("polyline_points", _LINE, "x y z")
def _(t):
    return _lines(t)


@query("polyline_lengths", f"select feature, sum(case when last then 0 else sqrt((nx - x) ** 2 + (ny - y) ** 2 + (nz - z) ** 2) end) as length from ({_NEXT}) group by 1", "length")
def _(t):
    return containers.polyline_lengths(_lines(t))


@query("polyline_lengths_closed", f"select feature, sum(sqrt((nx - x) ** 2 + (ny - y) ** 2 + (nz - z) ** 2)) as length from ({_NEXT}) group by 1", "length")
def _(t):
    return containers.polyline_lengths(_lines(t), closed=True)


@query("polyline_areas", f"select feature, abs(sum(case when k >= 3 then (x - 1000) * (ny - 20) - (nx - 1000) * (y - 20) else 0 end)) / 2 as area from (select *, count(*) over (partition by feature, part) as k from ({_NEXT})) group by 1", "area")
def _(t):
    return containers.polyline_areas(_lines(t))


@query("combine_proportions", "with p as (select p_partkey, 0.1 + p_size / 100.0 as v, 0.2 + (p_partkey % 41) / 100.0 as a from part), q as (select p_partkey, v * a / 0.3 as f, (1 - v) * (1 - a) / 0.7 as g from p) select p_partkey, f / (f + g) as p0, g / (f + g) as p1 from q", "p0 p1")
def _(t):
    v, a = 0.1 + F.col("p_size") / 100.0, 0.2 + (F.col("p_partkey") % 41) / 100.0
    p = containers.combine_proportions(t("part"), [v, 1 - v], [a, 1 - a], [F.lit(0.3), F.lit(0.7)])
    return t("part").select("p_partkey", p[0].alias("p0"), p[1].alias("p1"))


# ---- anamorphosis

PSI = (10.0, -3.0, 0.8, -0.1)
_H = "select p_partkey, y, -y as h1, (y * y - 1) / sqrt(2) as h2, -(y ** 3 - 3 * y) / sqrt(6) as h3 from (select p_partkey, (p_size - 25.5) / 10 as y from part)"


@query("hermite_inverse", f"select p_partkey, greatest(4.0, 10 - 3 * h1 + 0.8 * h2 - 0.1 * h3) as value from ({_H})", "value")
def _(t):
    return t("part").select("p_partkey", hermite.Anamorphosis(PSI, low=4.0).inverse_transform((F.col("p_size") - 25.5) / 10).alias("value"))


@query("hermite_block", f"select p_partkey, 10 - 3 * 0.6 * h1 + 0.8 * 0.36 * h2 - 0.1 * 0.216 * h3 as value from ({_H})", "value")
def _(t):
    return t("part").select("p_partkey", hermite.Anamorphosis(PSI).block(0.6).inverse_transform((F.col("p_size") - 25.5) / 10).alias("value"))


# ---- ensembles: 40 places, a realization for each 40 parts

_R = "select p_partkey % 40 as id, p_partkey // 40 as realization, p_retailprice as value from part"
_RC = "select id, realization, (value::BIGINT % 3) as value from (select p_partkey % 40 as id, p_partkey // 40 as realization, p_size as value from part)"


def _realizations(t, v="p_retailprice"):
    return t("part").select((F.col("p_partkey") % 40).alias("id"), F.floor(F.col("p_partkey") / 40).alias("realization"), F.col(v).alias("value"))


def _classes(t):
    return _realizations(t, "p_size").withColumn("value", F.col("value") % 3)


_EACH = f"select cutoff, realization, sum(case when value >= cutoff then id + 1 else 0 end)::DOUBLE as tonnage, sum(case when value >= cutoff then (id + 1) * value else 0 end) as metal from ({_R}), (select unnest([1000.0, 1400.0]::DOUBLE[]) as cutoff) group by 1, 2"
_STATS = ", ".join(f"avg({n}) as {n}_mean, quantile_cont({n}, 0.1) as {n}_q0, quantile_cont({n}, 0.9) as {n}_q1" for n in ("tonnage", "metal", "grade"))


@query("ensemble_recoveries", f"select cutoff, {_STATS} from (select *, metal / nullif(tonnage, 0) as grade from ({_EACH})) group by 1", "cutoff " + " ".join(f"{n}_{s}" for n in ("tonnage", "metal", "grade") for s in ("mean", "q0", "q1")))
def _(t):
    return ensembles.recoveries(_realizations(t), [1000.0, 1400.0], (0.1, 0.9), F.col("id") + 1)


@query("ensemble_relative_error", f"select id, (quantile_cont(value, 0.9) - quantile_cont(value, 0.1)) / (2 * avg(value)) as relative_error from ({_R}) group by 1", "relative_error")
def _(t):
    return ensembles.relative_error(_realizations(t), 0.8)


@query("ensemble_validate", f"with s as (select id, avg(value) as m, quantile_cont(value, 0.2) as lo, quantile_cont(value, 0.8) as hi, avg((value >= 1300)::INT) as p, 900.0 + 25 * id as truth from ({_R}) group by 1) select id, m - truth as error, truth between lo and hi as inside, p >= 0.5 and truth < 1300 as type1, p < 0.5 and truth >= 1300 as type2 from s", "error")
def _(t):
    r = _realizations(t)
    truth = r.select("id").distinct().withColumn("truth", 900.0 + 25 * F.col("id"))
    return ensembles.validate(r, truth, 0.6, 1300.0)


_P = ", ".join(f"avg((value = {i})::INT) as p{i}" for i in range(3))


@query("categorical_summary", f"select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as most_likely, -({' + '.join(f'case when p{i} > 0 then p{i} * ln(p{i}) else 0 end' for i in range(3))}) / ln(3) as entropy from (select id, {_P} from ({_RC}) group by 1)", "p0 p1 p2 entropy")
def _(t):
    return ensembles.categorical_summary(_classes(t), 3)


@query("category_proportions", f"select realization, c as category, sum(case when value = c then id + 1 else 0 end) / sum(id + 1) as proportion from ({_RC}), (select unnest([0, 1, 2]) as c) group by 1, 2", "proportion")
def _(t):
    return ensembles.category_proportions(_classes(t), 3, F.col("id") + 1)


# ---- curves

_BINS = "select * from (values (0, 10.0, 0.05), (1, 20.0, 0.11), (2, 30.0, 0.21)) v(bin, spacing, p90)"


@query("required_spacing", "select 20.0 + 10.0 * (0.15 - 0.11) / (0.21 - 0.11) as spacing, true as exceeded union all select 30.0, false", "spacing")
def _(t):
    curve = t("region").sparkSession.createDataFrame([(0, 10.0, 0.05), (1, 20.0, 0.11), (2, 30.0, 0.21)], "bin int, spacing double, p90 double")
    return eda.required_spacing(curve).unionByName(eda.required_spacing(curve, threshold=0.5))
