"""The registered queries of the spatial and resource operators, and SQL for the same rows.

Floats are rounded to seven significant digits on both sides, as sums depend on their order. The SQL
states the definition plainly; it does not repeat how the DataFrame operator gets there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .operators import blocks, eda, holes, kriging, spatial, steps, transforms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
NUDGE = 1.0000000000123  # moves values off the middle between two rounded ones, where engines differ


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles with DIGITS digits after the first; NaN and infinities as null; counts as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.format_string(f"%.{DIGITS}e", c * F.lit(NUDGE) + F.lit(0.0)).cast("double"))
        elif kind == "int":
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, floats: str = "") -> Callable:
    """Register a function of (tables reader) as a query; `floats` names the columns that SQL must round."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(lambda t: read(spark, sf_dir, t)))
        if sql:
            r = ", ".join(f"case when isfinite({c}) then printf('%.{DIGITS}e', {c}::DOUBLE * {NUDGE}::DOUBLE + 0.0)::DOUBLE end as {c}" for c in floats.split())
            ORACLES[name] = f"select * replace ({r}) from ({sql}) q" if r else sql
        return f

    return put


# ---- statistics

W = "l_quantity"
BASE = "select l_extendedprice as v, l_quantity as w, l_returnflag as g from lineitem"
BOTH = f"select v, w, g as category from ({BASE}) union all select v, w, 'all' from ({BASE})"
CUTOFFS = (0.0, 5000.0, 20000.0, 40000.0, 80000.0)


def quantile_sql(rows: str, by: str, q: float) -> str:
    """The quantile from its definition: middles of ordered weights, linear between, constant outside."""
    return f"""(with o as (select *, (sum(w) over (partition by {by} order by v, w rows unbounded preceding) - w / 2) / sum(w) over (partition by {by}) as p from ({rows}) where w > 0),
a as (select {by}, max_by(v, (p, v)) as v0, max(p) as p0 from o where p <= {q} group by 1), b as (select {by}, min_by(v, (p, v)) as v1, min(p) as p1 from o where p > {q} group by 1)
select {by}, case when v0 is null then v1 when v1 is null then v0 else v0 + (v1 - v0) * ({q} - p0) / (p1 - p0) end as q from a full join b using ({by}))"""


_STATS = f"select category, count(*) as n, sum(w * v) / sum(w) as mean, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2 as variance, min(v) as min, max(v) as max from ({BOTH}) group by category"


@query(
    "describe_by",
    f"select s.category, n, mean, variance, sqrt(variance) as std, sqrt(variance) / mean as cv, min, max, " + ", ".join(f"q{k}.q as p{p}" for k, p in enumerate((10, 25, 50, 75, 90))) + f" from ({_STATS}) s " + " ".join(f"join {quantile_sql(BOTH, 'category', p / 100)} q{k} on q{k}.category = s.category" for k, p in enumerate((10, 25, 50, 75, 90))),
    "mean variance std cv min max p10 p25 p50 p75 p90",
)
def _(t):
    return eda.describe_by(t("lineitem"), "l_extendedprice", "l_returnflag", W)


@query("describe", f"select n, mean, variance, sqrt(variance) as std, sqrt(variance) / mean as cv, min, max, a.q as p10, b.q as p50 from ({_STATS}) s join {quantile_sql(BOTH, 'category', 0.1)} a using (category) join {quantile_sql(BOTH, 'category', 0.5)} b using (category) where category = 'all'", "mean variance std cv min max p10 p50")
def _(t):
    return eda.describe(t("lineitem"), "l_extendedprice", W, (0.1, 0.5))


_GT = f"select category, cutoff, sum(case when v >= cutoff then w else 0 end) as tonnage, sum(case when v >= cutoff then w * v else 0 end) as metal from ({BOTH}), (select unnest([{', '.join(map(str, CUTOFFS))}]::DOUBLE[]) as cutoff) group by 1, 2"


@query("grade_tonnage", f"select *, case when tonnage > 0 then metal / tonnage end as mean from ({_GT})", "tonnage metal mean cutoff")
def _(t):
    return eda.grade_tonnage(t("lineitem"), "l_extendedprice", CUTOFFS, W, categories="l_returnflag")


_CM = "select m, v, w from (select l_extendedprice as a, l_extendedprice * (1 - l_discount) as b, l_quantity as w from lineitem) unpivot (v for m in (a, b))"


@query(
    "compare_models",
    f"with g as (select m as model, cutoff, sum(case when v >= cutoff then w else 0 end) as tonnage, sum(case when v >= cutoff then w * v else 0 end) as metal from ({_CM}), (select unnest([0, 30000.0, 60000.0]::DOUBLE[]) as cutoff) group by 1, 2) select g.model, g.cutoff, g.tonnage, g.metal, g.metal / nullif(g.tonnage, 0) as mean, (g.tonnage - r.tonnage) / r.tonnage as tonnage_diff, (g.metal - r.metal) / r.metal as metal_diff, (g.metal / g.tonnage - r.metal / r.tonnage) / (r.metal / r.tonnage) as mean_diff from g join g r on r.model = 'a' and r.cutoff = g.cutoff",
    "cutoff tonnage metal mean tonnage_diff metal_diff mean_diff",
)
def _(t):
    df = t("lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"), "l_quantity")
    return eda.compare_models(df, ["a", "b"], [0.0, 30000.0, 60000.0], weights=W)


@query(
    "domain_change",
    "with c as (select distinct c from (select l_returnflag as c from lineitem union all select l_linestatus from lineitem)), g as (select l_returnflag as f, l_linestatus as t, sum(l_quantity) as w, sum(l_quantity * l_extendedprice) as m from lineitem group by 1, 2) select a.c as \"from\", b.c as \"to\", coalesce(w, 0) as tonnage, coalesce(m, 0) as metal, m / w as mean from c a cross join c b left join g on g.f = a.c and g.t = b.c",
    "tonnage metal mean",
)
def _(t):
    return eda.domain_change(t("lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", W)


EVENTS = "select user_id as h, date_diff('second', timestamp '2024-01-01', ts::timestamp) as d, event_type as c, value as v from events"


def events(t) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t("events").select(F.col("user_id").alias("h"), seconds.cast("double").alias("d"), F.col("event_type").alias("c"), F.col("value").alias("v"))


@query(
    "transition_matrix",
    f"with e as (select *, row_number() over () as r from ({EVENTS})), n as (select a.c as f, b.c as t, count(*) as n from e a join e b on a.h = b.h and b.d between a.d + 30000 and a.d + 50000 and a.r <> b.r group by 1, 2), k as (select distinct c from e) select x.c as \"from\", y.c as \"to\", coalesce(n, 0) as count, coalesce(n, 0)::DOUBLE / sum(n) over (partition by x.c) as frequency from k x cross join k y left join n on n.f = x.c and n.t = y.c",
    "frequency",
)
def _(t):
    return eda.transition_matrix(events(t), "d", "c", "h", 40000.0, 10000.0)


@query("swath", "select floor(p_retailprice / 100)::BIGINT as slice, (floor(p_retailprice / 100) + 0.5) * 100 as center, count(*) as n, sum((p_partkey % 97) * p_size * 2.5) / sum(p_size * 2.5) as mean, sum(p_size * 2.5) as tonnage, sum((p_partkey % 97) * p_size * 2.5) as metal from part group by 1, 2", "center mean tonnage metal")
def _(t):
    return eda.swath(t("part"), "p_retailprice", F.col("p_partkey") % 97, 100.0, "p_size", 2.5)


SAMPLES = "select vec_id as id, embedding[1]::DOUBLE * 100 as x, embedding[2]::DOUBLE * 100 as y, embedding[3]::DOUBLE * 100 as z, embedding[4]::DOUBLE as v, label as g, vec_id % 7 as h from embeddings"


def samples(t) -> DataFrame:
    e = [F.element_at("embedding", i + 1).cast("double") for i in range(4)]
    return t("embeddings").select(F.col("vec_id").alias("id"), (e[0] * 100).alias("x"), (e[1] * 100).alias("y"), (e[2] * 100).alias("z"), e[3].alias("v"), F.col("label").alias("g"), (F.col("vec_id") % 7).alias("h"))


@query(
    "contact",
    f"with s as (select * from ({SAMPLES}) where g in (1, 2)), n as (select a.id, a.g, a.v, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) as d from s a join s b on a.h = b.h and a.g <> b.g group by 1, 2, 3), k as (select *, least(floor(d / 7.3), 5)::BIGINT as k from n where d <= 43.8) select case when g = 1 then -k - 1 else k end as bin, (case when g = 1 then -k - 1 else k end + 0.5) * 7.3 as distance, count(*) as n, avg(v) as mean from k group by 1, 2",
    "distance mean",
)
def _(t):
    return eda.contact(samples(t), ["x", "y", "z"], "v", "g", "h", "1", "2", 43.8, 7.3)


def _cap_sql(caps: str) -> str:
    return f"with b as ({BASE}), c as ({caps}), m as (select cap, sum(case when v > cap then w else 0 end) / sum(w) as fraction, sum(w * v) / sum(w) as m0, sum(w * least(v, cap)) / sum(w) as mean, sum(w * least(v, cap) ** 2) / sum(w) as sq from b, c group by 1) select cap, fraction, 1 - mean / m0 as metal_removed, mean, sqrt(sq - mean ** 2) / mean as cv from m"


@query("capping", _cap_sql("select unnest([30000.0, 60000.0, 90000.0]::DOUBLE[]) as cap"), "cap fraction metal_removed mean cv")
def _(t):
    return eda.capping(t("lineitem"), "l_extendedprice", [30000.0, 60000.0, 90000.0], W)


_B1 = f"select v, w, 1 as k from ({BASE})"


@query("capping_default", _cap_sql(" union all ".join(f"select q as cap from {quantile_sql(_B1, 'k', q)}" for q in eda.DEFAULT_CAPS)), "cap fraction metal_removed mean cv")
def _(t):
    return eda.capping(t("lineitem"), "l_extendedprice", None, W)


_RC = f"select v, w, category, least(v, case o when 'A' then 50000.0 when 'N' then 70000.0 else 1e300 end) as c from (select v, w, g as category, g as o from ({BASE}) union all select v, w, 'all', g from ({BASE}))"


@query(
    "capping_report",
    f"with r as ({_RC}), m as (select category, count(*) as n, sum(case when v > c then 1 else 0 end)::BIGINT as n_capped, sum(w * v) / sum(w) as mean_before, sum(w * v * v) / sum(w) as s1, max(v) as max_before, sum(w * c) / sum(w) as mean_after, sum(w * c * c) / sum(w) as s2, max(c) as max_after, sum((v - c) * w) as metal_capped from r group by 1) select category, n, mean_before, sqrt(s1 - mean_before ** 2) / mean_before as cv_before, max_before, mean_after, sqrt(s2 - mean_after ** 2) / mean_after as cv_after, max_after, n_capped, metal_capped from m",
    "mean_before cv_before max_before mean_after cv_after max_after metal_capped",
)
def _(t):
    return eda.capping_report(t("lineitem"), "l_extendedprice", {"A": 50000.0, "N": 70000.0}, "l_returnflag", W)


@query("cap_by_quantile", f"select g as domain, q as cap from {quantile_sql(BASE, 'g', 0.97)}", "cap")
def _(t):
    return eda.cap_by_quantile(t("lineitem"), "l_extendedprice", 0.97, "l_returnflag", W)


@query("cap_transform", f"select l_orderkey, l_returnflag, least(l_extendedprice, q) as capped from lineitem join {quantile_sql(BASE, 'g', 0.97)} c on c.g = l_returnflag", "capped")
def _(t):
    li = t("lineitem")
    return eda.cap(li, "l_extendedprice", eda.cap_by_quantile(li, "l_extendedprice", 0.97, "l_returnflag", W), "l_returnflag").select("l_orderkey", "l_returnflag", "capped")


@query("cap_by_metal_removed", f"with recursive b as ({BASE}), t as (select g, sum(w * v) as m from b group by 1), s as (select g, 0::DOUBLE as lo, max(v) as hi, 0 as i from b group by 1 union all select s.g, case when r > 0.05 then (lo + hi) / 2 else lo end, case when r > 0.05 then hi else (lo + hi) / 2 end, i + 1 from s, lateral (select 1 - sum(b.w * least(b.v, (s.lo + s.hi) / 2)) / max(t.m) as r from b join t on t.g = b.g where b.g = s.g) x where i < 45) select g as domain, hi as cap from s where i = 45", "cap")
def _(t):
    return eda.cap_by_rule(t("lineitem"), "l_extendedprice", "metal_removed", 0.05, "l_returnflag", W)


_COLS = [("q", "l_quantity"), ("p", "l_extendedprice"), ("d", "l_discount")]


def _corr_sql(f: str) -> str:
    return " union all ".join(f"select '{b}' as a, '{d}' as b, count(*) as n, {f.format(x=x, y=y)} as value from lineitem" for i, (_, x) in enumerate(_COLS) for (_, y) in _COLS[i:] for b, d in ((x, y),))


@query("correlation", _corr_sql("corr({x}, {y})"), "value")
def _(t):
    return eda.correlation(t("lineitem"), [c for _, c in _COLS])


@query("covariance", _corr_sql("covar_pop({x}, {y})"), "value")
def _(t):
    return eda.correlation(t("lineitem"), [c for _, c in _COLS], method="covariance")


_RANK = "select (rank() over (order by l_quantity) + count(*) over (partition by l_quantity) / 2.0) as a, (rank() over (order by l_extendedprice) + count(*) over (partition by l_extendedprice) / 2.0) as b from lineitem"


@query("spearman", f"select 'l_quantity' as a, 'l_extendedprice' as b, count(*) as n, corr(q.a, q.b) as value from ({_RANK}) q union all select c, c, (select count(*) from lineitem), 1.0 from (values ('l_quantity'), ('l_extendedprice')) v(c)", "value")
def _(t):
    return eda.correlation(t("lineitem"), ["l_quantity", "l_extendedprice"], method="spearman")


@query("compare", "select count(*) as n, avg(e - t) as mean_error, avg(abs(e - t)) as mean_absolute_error, sqrt(avg((e - t) ** 2)) as rmse, corr(e, t) as correlation, regr_slope(t, e) as slope from (select l_extendedprice as e, l_quantity * 1000 as t from lineitem)", "mean_error mean_absolute_error rmse correlation slope")
def _(t):
    return eda.compare(t("lineitem"), "l_extendedprice", F.col("l_quantity") * 1000)


@query("global_bias", "select *, (estimate_mean - data_mean) / data_mean as relative_difference from (select sum(p_retailprice * p_size) / sum(p_size) as estimate_mean from part), (select sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity) as data_mean from lineitem)", "estimate_mean data_mean relative_difference")
def _(t):
    return eda.global_bias(t("part"), "p_retailprice", t("lineitem"), F.col("l_extendedprice") / F.col("l_quantity"), "p_size", W)


@query("classify", "select l_orderkey, l_partkey, case when l_quantity >= 40 and l_discount < 0.03 then 'measured' when l_quantity >= 20 then 'indicated' when l_quantity > 5 then 'inferred' else 'unclassified' end as class from lineitem")
def _(t):
    rules = [("measured", [("l_quantity", ">=", 40), ("l_discount", "<", 0.03)]), ("indicated", [("l_quantity", ">=", 20)]), ("inferred", [("l_quantity", ">", 5)])]
    return eda.classify(t("lineitem"), rules).select("l_orderkey", "l_partkey", "class")


_EDGES = [0.5, 10.5, 20.5, 30.5, 50.0, 70.0]
_BIN = "case " + " ".join(f"when d >= {a} and d <{'=' if i == 4 else ''} {b} then {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " end"


@query("paired_bias", f"with b as (select * from (values {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))}) v(bin, lower, upper)), g as (select {_BIN} as bin, count(*) as n, avg(a) as mean_a, avg(c) as mean_b from (select l_extendedprice as a, l_extendedprice * (1 - l_tax) as c, l_quantity as d from lineitem) group by 1) select b.bin, lower::DOUBLE as lower, upper::DOUBLE as upper, coalesce(n, 0) as n, mean_a, mean_b, mean_b / mean_a - 1 as bias from b left join g using (bin)", "lower upper mean_a mean_b bias")
def _(t):
    return eda.paired_bias(t("lineitem"), "l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_tax")), "l_quantity", _EDGES)


_CURVE = "select l_quantity as d, l_tax * 2 + l_quantity / 1000 as v, 1.0::DOUBLE as w from lineitem"
_CB = f"select v, w, {_BIN} as bin from ({_CURVE}) where {_BIN} is not null"


@query(
    "uncertainty_curve",
    f"with g as (select {_BIN} as bin, avg(d) as spacing, count(*) as n, avg(case when v <= 0.15 then 1.0 else 0.0 end) as share from ({_CURVE}) where {_BIN} is not null group by 1) select g.bin, spacing, n, max(a.q) over (order by g.bin) as p50, max(b.q) over (order by g.bin) as p90, share from g join {quantile_sql(_CB, 'bin', 0.5)} a using (bin) join {quantile_sql(_CB, 'bin', 0.9)} b using (bin) where n >= 8",
    "spacing p50 p90 share",
)
def _(t):
    return eda.uncertainty_curve(t("lineitem"), "l_quantity", F.col("l_tax") * 2 + F.col("l_quantity") / 1000, _EDGES)


@query("vertical_proportions", "with t as (select floor(p_size / 10)::BIGINT as slice, p_brand as category, p_retailprice as w from part), g as (select slice, category, sum(w) as w from t group by 1, 2) select s.slice, c.category, coalesce(w, 0) / sum(w) over (partition by s.slice) as share from (select distinct slice from t) s cross join (select distinct category from t) c left join g on g.slice = s.slice and g.category = c.category", "share")
def _(t):
    return eda.vertical_proportions(t("part"), "p_size", "p_brand", 10.0, "p_retailprice")


@query(
    "validate_model",
    "with r as (select 'naive' as kind, l_extendedprice as v, 1.0 as w, l_returnflag as c from lineitem union all select 'declustered', l_extendedprice, l_quantity, l_returnflag from lineitem union all select 'model', l_extendedprice * 0.9 + 1000, 1.0, l_returnflag from lineitem), b as (select kind, v, w, c as category from r union all select kind, v, w, 'all' from r), m as (select kind, category, count(*) as n, sum(w * v) / sum(w) as mean, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2 as variance from b group by 1, 2) select m.category, m.kind, m.n, m.mean, m.variance, (m.mean - d.mean) / d.mean as mean_diff, m.variance / d.variance as variance_ratio from m join m d on d.kind = 'declustered' and d.category = m.category",
    "mean variance mean_diff variance_ratio",
)
def _(t):
    li = t("lineitem")
    return eda.validate_model(li.withColumn("m", F.col("l_extendedprice") * 0.9 + 1000), "m", li, "l_extendedprice", W, "l_returnflag")


# ---- compositions



def parts() -> list:
    return [F.col("l_quantity"), 1 + 100 * F.col("l_discount"), 1 + 100 * F.col("l_tax")]


SQL_PARTS = "select l_orderkey as k, l_partkey as p, l_quantity as a, 1 + 100 * l_discount as b, 1 + 100 * l_tax as c from lineitem"
_G = "(ln(a) + ln(b) + ln(c)) / 3"


def _coda(name: str, build, sql: str, n: int) -> None:
    names = [f"y{i}" for i in range(n)]

    def f(t):
        made = build(parts())
        made = made if isinstance(made, list) else [made]
        return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), *[c.alias(x) for c, x in zip(made, names)])

    query(name, f"select k, p, {sql} from ({SQL_PARTS})", " ".join(names))(f)


_coda("closure", lambda p: X.closure(p), "a / (a + b + c) as y0, b / (a + b + c) as y1, c / (a + b + c) as y2", 3)
_coda("clr", lambda p: X.clr(p), f"ln(a) - {_G} as y0, ln(b) - {_G} as y1, ln(c) - {_G} as y2", 3)
_coda("clr_inverse", lambda p: X.clr_inverse([x / 100 for x in p]), "exp(a / 100) / (exp(a / 100) + exp(b / 100) + exp(c / 100)) as y0, exp(b / 100) / (exp(a / 100) + exp(b / 100) + exp(c / 100)) as y1, exp(c / 100) / (exp(a / 100) + exp(b / 100) + exp(c / 100)) as y2", 3)
_coda("alr", lambda p: X.alr(p), "ln(a / c) as y0, ln(b / c) as y1", 2)
_coda("alr_inverse", lambda p: X.alr_inverse([x / 10 for x in p[:2]]), "exp(a / 10) / (exp(a / 10) + exp(b / 10) + 1) as y0, exp(b / 10) / (exp(a / 10) + exp(b / 10) + 1) as y1, 1 / (exp(a / 10) + exp(b / 10) + 1) as y2", 3)
_coda("ilr", lambda p: X.ilr(p), "sqrt(0.5::DOUBLE) * ln(a / b) as y0, sqrt(2.0::DOUBLE / 3) * ((ln(a) + ln(b)) / 2 - ln(c)) as y1", 2)
_coda("ilr_inverse", lambda p: X.ilr_inverse(X.ilr(p)), "a / (a + b + c) as y0, b / (a + b + c) as y1, c / (a + b + c) as y2", 3)
_coda("ilr_basis", lambda p: X.ilr(p, X.partition_basis([[1, 1, -1], [1, -1, 0]])), "sqrt(2.0::DOUBLE / 3) * ((ln(a) + ln(b)) / 2 - ln(c)) as y0, sqrt(0.5::DOUBLE) * ln(a / b) as y1", 2)
_coda("replace_below_detection", lambda p: X.replace_below_detection(p, [2.0, 3.0, 3.0]), ", ".join(f"case when {x} < {d} then 0.65 * {d} else {x} * (s - (r - u)) / s end as y{i}" for i, (x, d) in enumerate(zip("abc", (2, 3, 3)))), 3)
ORACLES["replace_below_detection"] = ORACLES["replace_below_detection"].replace(f"from ({SQL_PARTS})", f"from (select *, case when a < 2 then 0 else a end + case when b < 3 then 0 else b end + case when c < 3 then 0 else c end as s, case when a < 2 then 1.3 else 0 end + case when b < 3 then 1.95 else 0 end + case when c < 3 then 1.95 else 0 end as r, case when a < 2 then a else 0 end + case when b < 3 then b else 0 end + case when c < 3 then c else 0 end as u from ({SQL_PARTS}))")
_coda("perturbation", lambda p: X.perturbation(p, [p[1], p[2], p[0]]), "a * b / (a * b + b * c + c * a) as y0, b * c / (a * b + b * c + c * a) as y1, c * a / (a * b + b * c + c * a) as y2", 3)
_coda("powering", lambda p: X.powering(p, 1.7), "a ** 1.7 / (a ** 1.7 + b ** 1.7 + c ** 1.7) as y0, b ** 1.7 / (a ** 1.7 + b ** 1.7 + c ** 1.7) as y1, c ** 1.7 / (a ** 1.7 + b ** 1.7 + c ** 1.7) as y2", 3)
_coda("aitchison_inner_product", lambda p: X.aitchison_inner_product(p, [p[1], p[2], p[0]]), f"(ln(a) - {_G}) * (ln(b) - {_G}) + (ln(b) - {_G}) * (ln(c) - {_G}) + (ln(c) - {_G}) * (ln(a) - {_G}) as y0", 1)
_coda("aitchison_norm", lambda p: X.aitchison_norm(p), f"sqrt((ln(a) - {_G}) ** 2 + (ln(b) - {_G}) ** 2 + (ln(c) - {_G}) ** 2) as y0", 1)
_coda("aitchison_distance", lambda p: X.aitchison_distance(p, [p[1], p[2], p[0]]), "sqrt((ln(a) - ln(b)) ** 2 + (ln(b) - ln(c)) ** 2 + (ln(c) - ln(a)) ** 2) as y0", 1)


# ---- space

_P = f"select a.id as i, b.id as j, a.v as v, b.v as w, a.g as g, b.g as k, a.h as h, b.h as l, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from ({SAMPLES}) a, ({SAMPLES}) b"
TARGETS = "select p_partkey as id, p_size * 2.0 - 50 as x, (p_partkey % 41) * 2.0 - 40 as y, (p_partkey % 17) * 2.0 - 16 as z from part"
_T = f"select t.id as id, s.id as j, s.v as v, s.h as h, sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2 + (t.z - s.z) ** 2) as d from ({TARGETS}) t, ({SAMPLES}) s"


def targets(t) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").select(k.alias("id"), (F.col("p_size") * 2.0 - 50).alias("x"), ((k % 41) * 2.0 - 40).alias("y"), ((k % 17) * 2.0 - 16).alias("z"))


XYZ = ["x", "y", "z"]
_NEAR = f"select *, row_number() over (partition by id order by d, j) as r from ({_T}) where d <= 30"


def _interpolation(name: str, sql: str) -> None:
    @query(f"estimate_{name}", f"with n as (select * from ({_NEAR}) where r <= 8), e as (select id, count(*) as n, {sql} as estimate from n group by 1) select t.id, case when n >= 2 then estimate end as estimate, coalesce(n, 0) as n from ({TARGETS}) t left join e using (id)", "estimate")
    def _(t):
        return spatial.interpolate(targets(t), samples(t), XYZ, "v", 30.0, 8, 2, name, target_id="id", data_id="id")


_interpolation("nearest", "min_by(v, r)")
_interpolation("idw", "sum(v / d ** 2) / sum(1 / d ** 2)")
_interpolation("average", "avg(v)")
_interpolation("median", "median(v)")


@query("neighborhood_stats", f"with w as (select id, count(*) as n_within, count(distinct h) as n_holes from ({_T}) where d <= 30 group by 1), k as (select id, min(d) as nearest, avg(d) as mean_distance, max(d) as max_distance, avg(v) as mean, var_pop(v) as variance, min(v) as min, max(v) as max, sum(v / d ** 2) / sum(1 / d ** 2) as idw from ({_NEAR}) where r <= 8 group by 1) select t.id, coalesce(n_within, 0) as n_within, coalesce(n_holes, 0) as n_holes, k.* exclude (id) from ({TARGETS}) t left join w using (id) left join k using (id)", "nearest mean_distance max_distance mean variance min max idw")
def _(t):
    return spatial.neighborhood_stats(targets(t), samples(t), XYZ, "v", 30.0, 8, "h", "id", "id")


@query("hole_distance", f"with p as (select id, h, min(d) as d from ({_T}) where d <= 30 group by 1, 2), r as (select *, row_number() over (partition by id order by d, h) as r from p), g as (select id, count(*) as n, avg(d) as d from r where r <= 3 group by 1) select t.id, case when n >= 3 then d end as distance from ({TARGETS}) t left join g using (id)", "distance")
def _(t):
    return spatial.hole_distance(targets(t), samples(t), XYZ, "h", 3, 30.0, "id", "id")


@query("data_spacing", f"select t.id, sqrt(4.0 / 3 * pi() * 27000 / 2.5 / n) as spacing from ({TARGETS}) t left join (select id, count(*) as n from ({_T}) where d <= 30 group by 1) using (id)", "spacing")
def _(t):
    return spatial.data_spacing(targets(t), samples(t), XYZ, 30.0, 2.5, "id", "id")


@query("duplicates", f"with recursive p as (select i, j from ({_P}) where i <> j and d <= 11.3), r as (select i, i as j from p union select r.i, p.j from r join p on r.j = p.i) select i as id, min(j) as \"group\" from r group by 1")
def _(t):
    return spatial.duplicates(samples(t), XYZ, 11.3, "id")


@query("nearest_pairs", f"select i as a, j as b, d as distance from (select *, row_number() over (partition by i order by d, j) as r from ({_P}) where g = 1 and k = 2 and d <= 40) where r = 1", "distance")
def _(t):
    s = samples(t)
    return spatial.nearest_pairs(s.filter("g = 1"), s.filter("g = 2"), XYZ, 40.0, "id", "id")


@query("unique_pairs")
def _(t):
    s = samples(t)
    return spatial.unique_pairs(s.filter("g = 1"), s.filter("g = 2"), XYZ, 40.0, "id", "id")


@query("soft_boundary", f"with s as ({SAMPLES}), n as (select distinct i, v from ({_P}) where g <> 3 and k = 3 and d <= 20), r as (select 'hard' as boundary, v, 1.0 as w from s where g = 3 union all select 'soft', v, 1.0 from s where g = 3 union all select 'soft', v, 1.0 from n) select boundary, count(*) as n, avg(v) as mean, var_pop(v) as variance, any_value(q) as q0 from r join {quantile_sql('select boundary, v, w from r', 'boundary', 0.5)} x using (boundary) group by 1", "mean variance q0")
def _(t):
    return spatial.soft_boundary(samples(t), XYZ, "v", "g", "3", 20.0, "id")


LAG, TOP = 7.3, 43.8
_B = f"least(floor(d / {LAG}), {round(TOP / LAG) - 1})::BIGINT"
_PAIRS = f"select * from ({_P}) where i < j and d > 0 and d <= {TOP}"
_CONE = f"{_PAIRS} and abs(dx * sin(radians(35)) + dy * cos(radians(35))) >= d * cos(radians(40)) - 1e-12"


def _variogram(name: str, gamma: str, source: str = _PAIRS, more: str = "", **options) -> None:
    @query(name, f"select bin, (bin + 0.5) * {LAG} as lag, distance, pairs, {more or 'gamma'} as gamma from (select {_B} as bin, avg(d) as distance, count(*) as pairs, {gamma} as gamma from ({source}) group by 1)", "lag distance gamma")
    def _(t):
        return spatial.experimental_variogram(samples(t), XYZ, "v", LAG, TOP, "id", **options)


_VAR = f"(select var_pop(v) from ({SAMPLES}))"
_variogram("variogram_matheron", "sum((v - w) ** 2) / (2 * count(*))")
_variogram("variogram_standardized", "sum((v - w) ** 2) / (2 * count(*))", more=f"gamma / {_VAR}", standardize=True)
_variogram("variogram_directional", "sum((v - w) ** 2) / (2 * count(*))", _CONE, azimuth=35.0, tolerance=40.0)
_variogram("variogram_bandwidth", "sum((v - w) ** 2) / (2 * count(*))", f"{_CONE} and sqrt(greatest(d ** 2 - (dx * sin(radians(35)) + dy * cos(radians(35))) ** 2, 0)) <= 15.1", azimuth=35.0, tolerance=40.0, bandwidth=15.1)
_variogram("variogram_cressie_hawkins", "0.5 * (sum(sqrt(abs(v - w))) / count(*)) ** 4 / (0.457 + 0.494 / count(*) + 0.045 / count(*) ** 2)", estimator="cressie_hawkins")
_variogram("variogram_madogram", "sum(abs(v - w)) / (2 * count(*))", estimator="madogram")
_variogram("variogram_pairwise_relative", "sum(case when v + w > 0 then (v - w) ** 2 / ((v + w) / 2) ** 2 end) / (2 * sum(case when v + w > 0 then 1 end))", estimator="pairwise_relative")
_variogram("variogram_covariance", "avg(v * w) - (sum(v + w) / (2 * count(*))) ** 2", more=f"{_VAR} - gamma", estimator="covariance")
_variogram("variogram_correlogram", "1 - (avg(v * w) - (sum(v + w) / (2 * count(*))) ** 2) / (sum(v ** 2 + w ** 2) / (2 * count(*)) - (sum(v + w) / (2 * count(*))) ** 2)", estimator="correlogram")


@query("variogram_cross", f"select bin, (bin + 0.5) * {LAG} as lag, distance, pairs, gamma from (select {_B} as bin, avg(d) as distance, count(*) as pairs, sum((w - v) * (k - g)) / (2 * count(*)) as gamma from ({_PAIRS}) group by 1)", "lag distance gamma")
def _(t):
    return spatial.experimental_variogram(samples(t), XYZ, "v", LAG, TOP, "id", other="g")


@query("variogram_downhole", f"select * from (select floor(d / {LAG} + 0.5)::BIGINT - 1 as bin, avg(d) as lag, count(*) as pairs, sum((v - w) ** 2) / (2 * count(*)) as gamma from ({_PAIRS}) where h = l group by 1) where bin >= 0", "lag gamma")
def _(t):
    return spatial.downhole_variogram(samples(t), XYZ, "v", LAG, TOP, "h", "id")


@query("dissemination", f"select bin, (bin + 0.5) * {LAG} as lag, sqrt(pi()) * m / sqrt(g) as dissemination from (select {_B} as bin, sum(abs(v - w)) / (2 * count(*)) as m, sum((v - w) ** 2) / (2 * count(*)) as g from ({_PAIRS}) group by 1)", "lag dissemination")
def _(t):
    s = samples(t)
    return spatial.dissemination(spatial.experimental_variogram(s, XYZ, "v", LAG, TOP, "id", "madogram"), spatial.experimental_variogram(s, XYZ, "v", LAG, TOP, "id"))


@query("h_scatter", f"select count(*) as n, corr(v, w) as correlation from ({_P}) where i <> j and abs(d - 25) <= 5 and dx * sin(radians(35)) + dy * cos(radians(35)) >= d * cos(radians(40)) - 1e-12", "correlation")
def _(t):
    return spatial.h_scatter(samples(t), XYZ, "v", 25.0, 5.0, "id", 35.0, 0.0, 40.0)


@query("variogram_map", f"select floor((degrees(atan2(dx, dy)) + 360) % 180 / 15)::BIGINT as sector, {_B} as bin, count(*) as pairs, sum((v - w) ** 2) / (2 * count(*)) as gamma from ({_PAIRS}) group by 1, 2", "gamma")
def _(t):
    return spatial.variogram_map(samples(t), XYZ, "v", LAG, TOP, "id", 12)


@query("variogram_volume", f"with f as (select case when dx < 0 or dx = 0 and (dy < 0 or dy = 0 and dz < 0) then -1 else 1 end as s, * from ({_PAIRS})) select floor(dx * s / {LAG} + 0.5)::BIGINT as ix, floor(dy * s / {LAG} + 0.5)::BIGINT as iy, floor(dz * s / {LAG} + 0.5)::BIGINT as iz, count(*) as pairs, sum((v - w) ** 2) / (2 * count(*)) as gamma from f group by 1, 2, 3", "gamma")
def _(t):
    return spatial.variogram_volume(samples(t), XYZ, "v", LAG, TOP, "id")


@query("experimental_transiogram", f"with p as (select {_B} as bin, g::VARCHAR as f, k::VARCHAR as t, count(*) as n from ({_P}) where i <> j and d > 0 and d <= {TOP} group by 1, 2, 3), c as (select distinct g::VARCHAR as c from ({SAMPLES})) select b.bin, x.c as \"from\", y.c as \"to\", coalesce(n, 0) as count, coalesce(coalesce(n, 0)::DOUBLE / nullif(sum(n) over (partition by b.bin, x.c), 0), 0) as probability from (select distinct bin from p) b cross join c x cross join c y left join p on p.bin = b.bin and p.f = x.c and p.t = y.c", "probability")
def _(t):
    return spatial.experimental_transiogram(samples(t), XYZ, "g", LAG, TOP, "id")


# ---- drill holes

_O = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity"
ASSAYS = f"select l_orderkey as HOLE_ID, (sum(l_quantity) over w) - l_quantity as \"FROM\", sum(l_quantity) over w as \"TO\", case when l_linenumber <> 3 then l_extendedprice / l_quantity end as au, l_returnflag as dom from lineitem window w as (partition by l_orderkey order by {_O} rows unbounded preceding)"
GEOLOGY = f"select HOLE_ID, k * 30.0::DOUBLE as \"FROM\", least((k + 1) * 30.0::DOUBLE, e) as \"TO\", (HOLE_ID + k) % 4 as lith from (select HOLE_ID, max(\"TO\") as e, unnest(generate_series(0, ceil(max(\"TO\") / 30)::BIGINT - 1)) as k from ({ASSAYS}) group by HOLE_ID)"


def assays(t) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*_O.split(", ")).rowsBetween(Window.unboundedPreceding, 0)
    li = t("lineitem").withColumn("TO", F.sum("l_quantity").over(w))
    return li.select(F.col("l_orderkey").alias("HOLE_ID"), (F.col("TO") - F.col("l_quantity")).alias("FROM"), "TO", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / F.col("l_quantity")).alias("au"), F.col("l_returnflag").alias("dom"))


def geology(t) -> DataFrame:
    e = assays(t).groupBy("HOLE_ID").agg(F.max("TO").alias("e"))
    k = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("e") / 30).cast("int") - 1)))
    return k.select("HOLE_ID", (F.col("k") * 30.0).alias("FROM"), F.least((F.col("k") + 1) * 30.0, F.col("e")).alias("TO"), ((F.col("HOLE_ID") + F.col("k")) % 4).alias("lith"))


@query("merge_intervals", f"with a as ({ASSAYS}), g as ({GEOLOGY}), c as (select HOLE_ID, \"FROM\" as d from a union select HOLE_ID, \"TO\" from a union select HOLE_ID, \"FROM\" from g union select HOLE_ID, \"TO\" from g), p as (select HOLE_ID, d as f, lead(d) over (partition by HOLE_ID order by d) as t from c) select p.HOLE_ID, f as \"FROM\", t as \"TO\", au, dom, lith from p left join a on a.HOLE_ID = p.HOLE_ID and a.\"FROM\" <= (f + t) / 2 and (f + t) / 2 < a.\"TO\" left join g on g.HOLE_ID = p.HOLE_ID and g.\"FROM\" <= (f + t) / 2 and (f + t) / 2 < g.\"TO\" where t is not null and (a.HOLE_ID is not null or g.HOLE_ID is not null)", "au")
def _(t):
    return holes.merge_intervals(assays(t), geology(t))


_UNIT = f"select HOLE_ID, run, dom, au, d, (row_number() over (partition by HOLE_ID, run order by d) - 1) // 20 as k, max(n) over (partition by HOLE_ID, run) as n from (select a.*, unnest(generate_series(\"FROM\"::BIGINT, \"TO\"::BIGINT - 1)) as d, sum(\"TO\" - \"FROM\") over (partition by HOLE_ID, run) as n from (select *, sum(b) over (partition by HOLE_ID order by \"FROM\") as run from (select *, case when dom is distinct from lag(dom) over (partition by HOLE_ID order by \"FROM\") then 1 else 0 end as b from ({ASSAYS}))) a)"


def _composites(residual: str, fix: str, where: str = "true") -> None:
    @query(f"composite_{residual}", f"select HOLE_ID, min(d)::DOUBLE as \"FROM\", max(d)::DOUBLE + 1 as \"TO\", count(*)::DOUBLE as length, any_value(dom) as dom, avg(au) as au, count(au)::DOUBLE as au_length from (select *, {fix} as k2 from ({_UNIT}) where {where}) group by HOLE_ID, run, k2 having count(au) > 0", "au")
    def _(t):
        return holes.composite(assays(t), 20.0, ["au"], domain="dom", residual=residual)


_TAIL = "(k = ceil(n / 20) - 1 and n - k * 20 < 10)"  # whole metres make this plain: each is one row
_composites("keep", "k")
_composites("drop", "k", f"not {_TAIL}")
_composites("merge", f"case when {_TAIL} and k > 0 then k - 1 else k end")

_ST = "select o_orderkey as h, s::DOUBLE as depth, radians((o_orderkey * 37 + s) % 360) as a, radians(45 + o_orderkey % 45) as dip, o_custkey + 0.37::DOUBLE as x0 from orders, (select unnest([0, 40, 80]) as s)"
_DIR = f"select *, cos(dip) * sin(a) as u, cos(dip) * cos(a) as v, -sin(dip) as w from ({_ST})"
_STEP = f"select *, lag(depth) over (partition by h order by depth) as d0, lag(u) over (partition by h order by depth) as u0, lag(v) over (partition by h order by depth) as v0, lag(w) over (partition by h order by depth) as w0 from ({_DIR})"


def surveys(t):
    o = t("orders")
    c = o.select(F.col("o_orderkey").alias("HOLE_ID"), (F.col("o_custkey") + 0.37).alias("X"), F.lit(500.0).alias("Y"), F.lit(0.0).alias("Z"))
    s = o.select(F.col("o_orderkey").alias("HOLE_ID"), F.explode(F.array(F.lit(0), F.lit(40), F.lit(80))).alias("DEPTH"))
    s = s.withColumn("AZIMUTH", (F.col("HOLE_ID") * 37 + F.col("DEPTH")) % 360).withColumn("DIP", 45 + F.col("HOLE_ID") % 45)
    return c, s


def _desurvey(method: str, m: str) -> None:
    move = ", ".join(f"coalesce(sum({m.format(c=c)}) over (partition by h order by depth), 0) {dict(x='+ x0', y='+ 500').get(n, '')} as {n}" for n, c in zip("xyz", "uvw"))

    @query(f"desurvey_{method}", f"select h as hole, depth, {move}, u, v, w from (select *, depth - d0 as s, 2 * asin(least(1, sqrt((u - u0) ** 2 + (v - v0) ** 2 + (w - w0) ** 2) / 2)) as beta from ({_STEP}))", "x y z u v w")
    def _(t):
        return holes.desurvey(*surveys(t), method=method)


_desurvey("minimum_curvature", "({c} + {c}0) / 2 * s * case when beta < 1e-9 then 1 else 2 / beta * tan(beta / 2) end")
_desurvey("balanced", "({c} + {c}0) / 2 * s")
_desurvey("tangential", "{c}0 * s")


@query("samples_at_midpoints", f"with p as (select h, depth, coalesce(sum(u0 * (depth - d0)) over (partition by h order by depth), 0) + x0 as x, coalesce(sum(v0 * (depth - d0)) over (partition by h order by depth), 0) + 500 as y, coalesce(sum(w0 * (depth - d0)) over (partition by h order by depth), 0) as z, u, v, w from ({_STEP})), a as (select HOLE_ID, (\"FROM\" + \"TO\") / 2 as d, au from ({ASSAYS})) select HOLE_ID as hole, d as depth, au, x + u * (d - depth) as x, y + v * (d - depth) as y, z + w * (d - depth) as z from a join p on p.h = a.HOLE_ID and p.depth = (select max(q.depth) from p q where q.h = a.HOLE_ID and q.depth <= a.d)", "au x y z")
def _(t):
    return holes.samples(holes.desurvey(*surveys(t), method="tangential"), assays(t), keep=["au"])


@query("ore_runs")
def _(t):
    return holes.runs(assays(t), "au", 1200.0, 20.0, 15.0)


@query("check_intervals", f"with a as (select *, \"TO\" + case when HOLE_ID % 5 = 0 then 0 else 0 end as t2 from ({ASSAYS})) select HOLE_ID, \"FROM\", \"TO\", au, dom, false as missing, false as no_collar, false as inverted, false as negative, false as duplicate, false as past_depth, coalesce(au = 1000.5, false) as sentinel, coalesce(au < 0, false) as negative_grade, false as overlap, false as gap from a", "au")
def _(t):
    a = assays(t)
    return holes.check_intervals(a, a.select("HOLE_ID").distinct(), grades=["au"], nodata=[1000.5])


# ---- transforms

_PPF_SQL = "case when p < {low} then ({c}) when p > 1 - {low} then -({d}) else ({m}) end"


def _horner(cs, x: str) -> str:
    out = f"({cs[0]}::DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c}::DOUBLE))"
    return out


def ppf_sql(p: str) -> str:
    t1, t2, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    end = [f"{_horner(X.PPF_C, t)} / {_horner((*X.PPF_D, 1.0), t)}" for t in (t1, t2)]
    mid = f"{_horner(X.PPF_A, f'({q} * {q})')} * {q} / {_horner((*X.PPF_B, 1.0), f'({q} * {q})')}"
    return f"case when {p} < {X.PPF_LOW} then {end[0]} when {p} > 1 - {X.PPF_LOW} then -({end[1]}) else {mid} end"


@query("normal_ppf", f"select l_orderkey, l_partkey, {ppf_sql('p')} as y from (select *, (l_extendedprice / 120000)::DOUBLE as p from lineitem)", "y")
def _(t):
    return t("lineitem").select("l_orderkey", "l_partkey", X.normal_ppf(F.col("l_extendedprice") / 120000).alias("y"))


@query("normal_cdf_round_trip")
def _(t):
    y = t("lineitem").select("l_orderkey", "l_partkey", X.normal_ppf(F.col("l_extendedprice") / 120000).alias("y"))
    return y.select("l_orderkey", "l_partkey", X.normal_cdf("y").alias("p"))


_NS = f"select *, {ppf_sql('p')} as score from (select id, v as value, (sum(w) over (order by v, id rows unbounded preceding) - w / 2) / sum(w) over () as p from (select *, 1 + id % 5 as w from ({SAMPLES})))"


@query("normal_score_fit", f"select value, p, score from ({_NS})", "value p score")
def _(t):
    return transforms.normal_score_table(samples(t), "v", 1 + F.col("id") % 5, ["id"])


@query("normal_score_transform", f"select id, score from ({_NS})", "score")
def _(t):
    s = samples(t)
    return transforms.normal_score(s, "v", transforms.normal_score_nodes(transforms.normal_score_table(s, "v", 1 + F.col("id") % 5, ["id"]))).select("id", "score")


@query("normal_score_inverse", f"select id, v as back from ({SAMPLES})", "back")
def _(t):
    s = samples(t)
    nodes = transforms.normal_score_nodes(transforms.normal_score_table(s, "v", None, ["id"]))
    return transforms.normal_score_inverse(transforms.normal_score(s, "v", nodes).select("id", "score"), "score", nodes, "back").select("id", "back")


@query("cell_declustering", f"with s as ({SAMPLES}), o as (select min(x) as ox, min(y) as oy, min(z) as oz from s), c as (select id, k, floor((x - ox + k * 3.1) / 15.5) as i, floor((y - oy + k * 3.1) / 15.5) as j, floor((z - oz + k * 3.1) / 15.5) as l from s, o, (select unnest([0, 1, 2, 3, 4]) as k)), n as (select k, i, j, l, count(*) as n from c group by all), m as (select k, count(*) as m, sum(n) as t from n group by 1) select id, avg(t / (m * n)) as weight from c join n using (k, i, j, l) join m using (k) group by 1", "weight")
def _(t):
    return transforms.cell_declustering(samples(t), XYZ, 15.5, 5)


@query("polygon_declustering", "with s as (select p_partkey as id, p_size::DOUBLE as x, (p_partkey * 7 % 53)::DOUBLE as y from part), b as (select min(x) as lx, min(y) as ly, max(x) - min(x) as ex, max(y) - min(y) as ey, count(*) as n from s), st as (select *, sqrt(ex * ey / 400) as h from b), g as (select (lx + (i + 0.5) * ex / nx) as x, (ly + (j + 0.5) * ey / ny) as y, nx * ny as t, n from (select *, ceil(ex / h - 1e-9)::BIGINT as nx, ceil(ey / h - 1e-9)::BIGINT as ny from st), lateral (select unnest(generate_series(0, nx - 1)) as i), lateral (select unnest(generate_series(0, ny - 1)) as j)), w as (select min_by(s.id, ((s.x - g.x) ** 2 + (s.y - g.y) ** 2, s.id)) as id, any_value(g.n) / any_value(t)::DOUBLE as u from g, s group by g.x, g.y) select s.id, coalesce(sum(u), 0) as weight from s left join w using (id) group by 1", "weight")
def _(t):
    s = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") * 7 % 53).cast("double").alias("y"))
    return transforms.polygon_declustering(s, ["x", "y"], 400)


@query("affine_correction", f"select l_orderkey, l_partkey, sqrt(0.6) * (l_extendedprice - m) + m as corrected from lineitem, (select sum(v * w) / sum(w) as m from ({BASE}))", "corrected")
def _(t):
    return transforms.affine_correction(t("lineitem"), "l_extendedprice", 0.6, W).select("l_orderkey", "l_partkey", "corrected")


@query("indirect_lognormal_correction", f"with m as (select sum(v * w) / sum(w) as m from ({BASE})), s as (select m, sum(w * (v - m) ** 2) / sum(w) / m ** 2 as c from ({BASE}), m group by m), p as (select m, sqrt(ln(0.6 * c + 1) / ln(c + 1)) as b from s), k as (select m, b, sum(w * v ** b) / sum(w) as k from ({BASE}), p group by m, b) select l_orderkey, l_partkey, l_extendedprice ** b * m / k as corrected from lineitem, k", "corrected")
def _(t):
    return transforms.indirect_lognormal_correction(t("lineitem"), "l_extendedprice", 0.6, W).select("l_orderkey", "l_partkey", "corrected")


@query("upscale", f"select (floor(x / 20) + 0.5) * 20 as x, (floor(y / 20) + 0.5) * 20 as y, (floor(z / 10) + 0.5) * 10 as z, avg(v) as mean, count(*) as n from ({SAMPLES}) group by floor(x / 20), floor(y / 20), floor(z / 10)", "x y z mean")
def _(t):
    return transforms.upscale(samples(t), XYZ, "v", (20.0, 20.0, 10.0))


@query("downscale", f"select id, x - 2 + (i + 0.5) * 2 as x, y - 1.5 + (j + 0.5) * 1 as y, z as z from ({SAMPLES}), (select unnest([0, 1]) as i), (select unnest([0, 1, 2]) as j)", "x y z")
def _(t):
    return transforms.downscale(samples(t).select("id", "x", "y", "z"), (4.0, 3.0, 2.0), (2, 3, 1))


@query("box_cox", "select l_orderkey, l_partkey, (l_extendedprice ** 0.3 - 1) / 0.3 as a, ln(l_extendedprice) as b, l_extendedprice as c from lineitem", "a b c")
def _(t):
    v = "l_extendedprice"
    return t("lineitem").select("l_orderkey", "l_partkey", X.box_cox(v, 0.3).alias("a"), X.box_cox(v, 0.0).alias("b"), X.box_cox_inverse(X.box_cox(v, 0.3), 0.3).alias("c"))


_BC = "select lam, case when lam = 0 then ln(l_extendedprice) else (l_extendedprice ** lam - 1) / lam end as y from lineitem, (select unnest([-0.5, 0.0, 0.5, 1.0]::DOUBLE[]) as lam)"


@query("box_cox_skewness", f"with b as ({_BC}), m as (select lam, avg(y) as m from b group by 1) select lam, avg((y - m) ** 3) / avg((y - m) ** 2) ** 1.5 as skewness from b join m using (lam) group by 1", "lam skewness")
def _(t):
    return transforms.box_cox_skewness(t("lineitem"), "l_extendedprice", [-0.5, 0.0, 0.5, 1.0])


@query("correct_distribution", f"with r as (select id, v, (row_number() over (order by v, id) - 0.5) / count(*) over () as q from ({SAMPLES})), n as (select (row_number() over (order by p_retailprice, p_partkey) - 0.5) / count(*) over () as p, p_retailprice as u from part), a as (select id, v, q, max_by(u, p) as u0, max(p) as p0 from r join n on p <= q group by 1, 2, 3), b as (select id, min_by(u, p) as u1, min(p) as p1 from r join n on p > q group by 1) select r.id, r.v + 0.7 * (case when u0 is null then u1 when u1 is null then u0 else u0 + (u1 - u0) * (r.q - p0) / (p1 - p0) end - r.v) as corrected from r left join a using (id) left join b using (id)", "corrected")
def _(t):
    return transforms.correct_distribution(samples(t), "v", t("part"), "p_retailprice", None, 0.7, ["id"]).select("id", "corrected")


@query("detrend", f"with s as ({SAMPLES}), m as (select regr_slope(v, x) as b, regr_intercept(v, x) as a from s) select id, a + b * x as trend, v - a - b * x as residual from s, m", "trend residual")
def _(t):
    return transforms.detrend(samples(t), ["x"], "v").select("id", "trend", "residual")


@query("pca", "with m as (select avg(l_quantity) as a, stddev_pop(l_quantity) as sa, avg(l_extendedprice) as b, stddev_pop(l_extendedprice) as sb, sign(corr(l_quantity, l_extendedprice)) as s from lineitem) select l_orderkey, l_partkey, abs((l_quantity - a) / sa + s * (l_extendedprice - b) / sb) / sqrt(2.0::DOUBLE) as pc1, abs((l_quantity - a) / sa - s * (l_extendedprice - b) / sb) / sqrt(2.0::DOUBLE) as pc2 from lineitem, m", "pc1 pc2")
def _(t):
    li = t("lineitem")
    p = transforms.fit_pca(li, ["l_quantity", "l_extendedprice"])
    out = li.select("l_orderkey", "l_partkey", *p.columns(["l_quantity", "l_extendedprice"]))
    return out.withColumn("pc1", F.abs("pc1")).withColumn("pc2", F.abs("pc2"))  # a vector's sign is free


@query("kernel_density", "select x, sum(exp(-(((x - p_retailprice) / 40.0::DOUBLE) ** 2) / 2)) / (count(*) * 40.0 * sqrt(2 * pi())) as density from part, (select unnest([900.0, 1000.0, 1200.0, 1500.0]::DOUBLE[]) as x) group by 1", "x density")
def _(t):
    return transforms.kernel_density(t("part"), "p_retailprice", [900.0, 1000.0, 1200.0, 1500.0], bandwidth=40.0)


SHAPES = {
    "spherical": "case when h >= 1 then 1 else 1.5 * h - 0.5 * h ** 3 end", "exponential": "1 - exp(-3 * h)", "gaussian": "1 - exp(-3 * h ** 2)",
    "cubic": "case when h >= 1 then 1 else 7 * h ** 2 - 8.75 * h ** 3 + 3.5 * h ** 5 - 0.75 * h ** 7 end", "pentaspherical": "case when h >= 1 then 1 else 1.875 * h - 1.25 * h ** 3 + 0.375 * h ** 5 end",
    "circular": "case when h >= 1 then 1 else 2 / pi() * (h * sqrt(greatest(0, 1 - h ** 2)) + asin(least(h, 1))) end", "sine_hole": "case when h = 0 then 0 else 1 - sin(pi() * h) / (pi() * h) end",
}


@query("variogram_shapes", "select l_orderkey, l_partkey, " + ", ".join(f"{s} as {n}" for n, s in SHAPES.items()) + " from (select *, (l_quantity / 40)::DOUBLE as h from lineitem)", " ".join(SHAPES))
def _(t):
    return t("lineitem").select("l_orderkey", "l_partkey", *[X.shape(n, F.col("l_quantity") / 40).alias(n) for n in SHAPES])


@query("cleaning_pipeline", "select p_partkey, upper(trim(p_brand)) as brand, ln(least(greatest(p_retailprice, 950), 1200) * 2) as price, case when p_size = 7 then -1 when p_size = 9 then -1 else p_size end::DOUBLE as size from part where p_size <> 11", "price size")
def _(t):
    p = steps.Pipeline([
        ("names", steps.RenameColumns({"p_brand": "brand", "p_retailprice": "price", "p_size": "size"})), ("text", steps.NormalizeText(["brand"], "upper")), ("clip", steps.Clip(["price"], 950, 1200)),
        ("scale", steps.Scale(["price"], 2.0)), ("log", steps.Log(["price"])), ("null", steps.ToNull([7, 11], ["size"])), ("replace", steps.Replace({9: 7}, ["size"])),
    ])
    d = p.transform(t("part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("p_size")).filter("p_size <> 11"))
    return steps.Pipeline([("back", steps.ToNull([7.0], ["size"])), ("fill", steps.FillNull(-1.0, ["size"]))]).transform(d).select("p_partkey", "brand", "price", "size")


@query("pipeline_inverse", f"select k, p, a / (a + b + c) as a, b / (a + b + c) as b, c / (a + b + c) as c from ({SQL_PARTS})", "a b c")
def _(t):
    d = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), *[c.alias(n) for c, n in zip(parts(), "abc")])
    p = steps.Pipeline.from_json(steps.Pipeline([("closure", steps.Closure(["a", "b", "c"])), ("ilr", steps.ILR(["a", "b", "c"]))]).to_json())
    return p.inverse(p.transform(d)).select("k", "p", "a", "b", "c")


# ---- kriging, simulation, blocks

def model():
    return kriging.Variogram(0.1, (kriging.Structure("spherical", 0.9, 60.0),))


_COV = "case when {d} = 0 then 1.0 when {d} >= 60 then 0.0 else 0.9 * (1 - 1.5 * {d} / 60 + 0.5 * ({d} / 60) ** 3) end"
_TWO = f"with n as (select id, j, v, d, row_number() over (partition by id order by d, j) as r from ({_T}) where d <= 30), s as ({SAMPLES}), p as (select a.id, a.v as v1, b.v as v2, a.d as d1, b.d as d2, sqrt((s.x - u.x) ** 2 + (s.y - u.y) ** 2 + (s.z - u.z) ** 2) as d12 from n a left join n b on b.id = a.id and b.r = 2 left join s on s.id = a.j left join s u on u.id = b.j where a.r = 1), c as (select *, {_COV.format(d='d1')} as b1, {_COV.format(d='d2')} as b2, {_COV.format(d='d12')} as c from p)"


@query("ordinary_kriging_two", f"{_TWO} select t.id, case when v2 is null then v1 else (0.5 + (b1 - b2) / (2 * (1 - c))) * v1 + (0.5 - (b1 - b2) / (2 * (1 - c))) * v2 end as estimate, case when v2 is null then 2 - 2 * b1 else 1 + (0.5 + (b1 - b2) / (2 * (1 - c))) * ((0.5 + (b1 - b2) / (2 * (1 - c))) - 2 * b1) + (0.5 - (b1 - b2) / (2 * (1 - c))) * ((0.5 - (b1 - b2) / (2 * (1 - c))) - 2 * b2) + 2 * c * (0.25 - ((b1 - b2) / (2 * (1 - c))) ** 2) end as variance, case when v1 is null then 0 when v2 is null then 1 else 2 end as n from ({TARGETS}) t left join c using (id)", "estimate variance")
def _(t):
    return kriging.krige(targets(t), samples(t), XYZ, "v", kriging.System(model()), 30.0, 2)


@query("simple_kriging_two", f"{_TWO} select t.id, case when v2 is null then b1 * v1 + (1 - b1) * 0.25 else (b1 - c * b2) / (1 - c * c) * v1 + (b2 - c * b1) / (1 - c * c) * v2 + (1 - (b1 - c * b2) / (1 - c * c) - (b2 - c * b1) / (1 - c * c)) * 0.25 end as estimate, case when v2 is null then 1 - b1 * b1 else 1 - (b1 - c * b2) / (1 - c * c) * b1 - (b2 - c * b1) / (1 - c * c) * b2 end as variance, case when v1 is null then 0 when v2 is null then 1 else 2 end as n from ({TARGETS}) t left join c using (id)", "estimate variance")
def _(t):
    return kriging.krige(targets(t), samples(t), XYZ, "v", kriging.System(model(), "simple", 0.25), 30.0, 2)


def _kriging(name: str, **options) -> None:
    @query(name)
    def _(t):
        return kriging.krige(targets(t), samples(t), XYZ, "v", kriging.System(model(), **options), 40.0, 12, 10)


_kriging("ordinary_kriging")
_kriging("simple_kriging", kind="simple", mean=0.2)
_kriging("universal_kriging", kind="universal", degree=1)
_kriging("block_kriging", kind="block", size=(4.0, 4.0, 4.0), discretization=(3, 3, 1))


@query("kriging_cross_validation")
def _(t):
    return kriging.cross_validate(samples(t), XYZ, "v", kriging.System(model()), 40.0, 8)


@query("kriging_cross_validation_by_hole")
def _(t):
    return kriging.cross_validate(samples(t), XYZ, "v", kriging.System(model()), 40.0, 8, folds=3, holes="h")


@query("indicator_kriging")
def _(t):
    return kriging.indicator_krige(targets(t), samples(t), XYZ, "v", [-0.1, 0.0, 0.1], model(), 40.0, 8)


@query("turning_bands_summary")
def _(t):
    return kriging.summarize(kriging.simulate_bands(targets(t), model(), 20, 7), [0.0], [0.1, 0.9])


_REAL = "select p_partkey % 40 as id, (p_partkey // 40) as realization, p_retailprice as value from part"


@query("simulation_summary", f"select id, count(*) as n, avg(value) as mean, var_pop(value) as variance, avg(case when value >= 1200 then 1.0 else 0.0 end) as p_above0, avg(case when value >= 1200 then value end) as mean_above0, quantile_cont(value, 0.1) as q0, quantile_cont(value, 0.9) as q1 from ({_REAL}) group by 1", "mean variance p_above0 mean_above0 q0 q1")
def _(t):
    return kriging.summarize(t("part").select((F.col("p_partkey") % 40).alias("id"), F.col("p_retailprice").alias("value")), [1200.0], [0.1, 0.9])


FINE, COARSE = ((0.0, 0.0, 0.0), (10.0, 10.0, 5.0), (12, 10, 4)), ((5.0, -5.0, 0.0), (25.0, 25.0, 10.0), (5, 5, 2))
MODEL = "select g as cell, g % 12 as i, g // 12 % 10 as j, g // 120 as k, ((g * 37) % 101)::DOUBLE as au, (g // 5 * 7) % 3 as dom from generate_series(0, 479) t(g)"


def block_model(t) -> DataFrame:
    g = F.col("cell")
    return t("region").sparkSession.range(480).withColumnRenamed("id", "cell").select("cell", ((g * 37) % 101).cast("double").alias("au"), ((F.floor(g / 5) * 7) % 3).alias("dom"))


_OVER = "greatest(0, least(({i} + 1) * {s}, {o} + ({k} + 1) * {t}) - greatest({i} * {s}, {o} + {k} * {t}))"


@query(
    "regularize",
    f"with m as ({MODEL}), t as (select c, c % 5 as x, c // 5 % 5 as y, c // 25 as z from generate_series(0, 49) q(c)), o as (select c, au, dom, {_OVER.format(i='i', s='10.0', o='5.0', k='x', t='25.0')} * {_OVER.format(i='j', s='10.0', o='-5.0', k='y', t='25.0')} * {_OVER.format(i='k', s='5.0', o='0.0', k='z', t='10.0')} as v from m, t), a as (select c, sum(v) / 6250 as fraction, sum(v * au) / sum(v) as au from o where v > 0 group by 1), d as (select c, dom, row_number() over (partition by c order by sum(v) desc, dom) as r from o where v > 0 group by 1, 2) select c as cell, fraction, case when fraction >= 0.3 then a.au end as au, case when fraction >= 0.3 then dom end as dom from a join d using (c) where r = 1",
    "fraction au",
)
def _(t):
    return blocks.regularize(block_model(t), blocks.Grid(*FINE), blocks.Grid(*COARSE), ["au"], ["dom"], 0.3)


@query("smooth_classes", f"with m as ({MODEL}), v as (select a.cell, a.dom as own, b.dom as c, count(*) as n from m a join m b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.k = b.k group by 1, 2, 3) select cell, c as dom from (select *, row_number() over (partition by cell order by n desc, case when c = own then 0 else 1 end, c) as r from v) where r = 1")
def _(t):
    return blocks.smooth_classes(block_model(t), blocks.Grid(*FINE), "dom")


@query("contact_distance", f"with m as ({MODEL}) select a.cell, min(case when a.dom = 1 then -1 else 1 end * 1.0::DOUBLE) * min(sqrt(100.0 * (a.i - b.i) ** 2 + 100.0 * (a.j - b.j) ** 2 + 25.0 * (a.k - b.k) ** 2)) as distance from m a join m b on (a.dom = 1) <> (b.dom = 1) group by 1", "distance")
def _(t):
    return blocks.contact_distance(block_model(t), blocks.Grid(*FINE), "dom", 40.0, 1)


@query("block_shell", f"with m as (select * from ({MODEL}) where dom <> 0), n as (select a.cell, f.face from m a, (values ('-x', -1, 0, 0), ('+x', 1, 0, 0), ('-y', 0, -1, 0), ('+y', 0, 1, 0), ('-z', 0, 0, -1), ('+z', 0, 0, 1)) f(face, x, y, z) where not exists (select 1 from m b where b.i = a.i + f.x and b.j = a.j + f.y and b.k = a.k + f.z)) select * from n")
def _(t):
    return blocks.block_shell(block_model(t).filter("dom <> 0"), blocks.Grid(*FINE))


@query("row_at", f"select id, case when floor(x / 10) between 0 and 11 and floor(y / 10) between 0 and 9 and floor(z / 5) between 0 and 3 then floor(x / 10)::BIGINT + 12 * (floor(y / 10)::BIGINT + 10 * floor(z / 5)::BIGINT) else -1 end as cell from ({SAMPLES})")
def _(t):
    return samples(t).select("id", blocks.Grid(*FINE).cell("x", "y", "z").alias("cell"))


@query("discretize", f"with m as ({MODEL}) select cell, n as node, (i + (n % 2 + 0.5) / 2) * 10 as x, (j + (n // 2 % 2 + 0.5) / 2) * 10 as y, (k + 0.5) * 5 as z from m, (select unnest([0, 1, 2, 3]) as n)", "x y z")
def _(t):
    return blocks.discretize(blocks.Grid(*FINE), block_model(t), (2, 2, 1))


RING = [(-20.0, -30.0), (35.0, -12.0), (22.0, 31.0), (1.0, 4.0), (-27.0, 25.0)]
_RING = "(values " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[1:] + RING[:1])) + ") e(ax, ay, bx, by_)"


@query("point_in_polygon", f"select id, sum(case when (ay > y) <> (by_ > y) and x < (bx - ax) * (y - ay) / (by_ - ay) + ax then 1 else 0 end) % 2 = 1 as inside from ({SAMPLES}), {_RING} group by 1")
def _(t):
    return blocks.in_polygon(samples(t), [RING])


@query("polygon_distance", f"select id, sqrt(min((x - ax - s * (bx - ax)) ** 2 + (y - ay - s * (by_ - ay)) ** 2)) as distance from (select *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0), 1) as s from ({SAMPLES}), {_RING}) group by 1", "distance")
def _(t):
    return blocks.polygon_distance(samples(t), [RING])


@query("mesh_contains", f"select id, x > -15 and x < 20 and y > -10 and y < 25 and z > -20 and z < 12 as inside from ({SAMPLES})")
def _(t):
    corners = [(x, y, z) for z in (-20, 12) for y in (-10, 25) for x in (-15, 20)]
    faces = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]
    return blocks.winding_number(samples(t), corners, faces).select("id", (F.abs("winding") > 0.5).alias("inside"))


@query("assign_domain", f"with n as (select t.id, g::VARCHAR as g, row_number() over (partition by t.id order by (t.x - s.x) ** 2 + (t.y - s.y) ** 2 + (t.z - s.z) ** 2, s.id) as r from ({TARGETS}) t, ({SAMPLES}) s), v as (select id, g, count(*) as m, min(r) as r, sum(count(*)) over (partition by id) as a from n where r <= 5 group by 1, 2), b as (select *, row_number() over (partition by id order by m desc, r) as q from v) select t.id, g as domain, m::DOUBLE / a as confidence from ({TARGETS}) t left join (select * from b where q = 1) b using (id)", "confidence")
def _(t):
    return blocks.assign_domain(targets(t), samples(t), "g", 5)


from . import more_queries  # noqa: E402, F401  (registers its queries)
