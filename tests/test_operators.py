"""Operators that SQL can't state: invariants and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.functions import columns as X
from stratalode.operators import blocks, eda, holes, kriging, spatial, steps, transforms


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.uniform(0, 50, 3)), float(rng.normal()), int(i % 4)) for i in range(150)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, v double, h int")


VARIOGRAM = kriging.Variogram(0.05, (kriging.Structure("exponential", 0.6, 30.0), kriging.Structure("gaussian", 0.35, 20.0)))


@pytest.mark.parametrize("kind", ["ordinary", "simple", "universal"])
def test_kriging(cloud, kind):
    system = kriging.System(VARIOGRAM, kind, mean=0.1)
    at_data = kriging.krige(cloud, cloud, ["x", "y", "z"], "v", system, 40.0, 12)
    truth = {r.id: r.v for r in cloud.collect()}
    assert all(abs(r.estimate - truth[r.id]) < 1e-6 and r.variance < 1e-6 for r in at_data.collect())
    away = cloud.select("id", (F.col("x") + 1.5).alias("x"), "y", "z")
    rows = kriging.krige(away, cloud, ["x", "y", "z"], "v", system, 40.0, 12, weights=True).collect()
    assert all(r.variance > 0 and len(r.weights) == r.n for r in rows)
    if kind != "simple":
        assert all(abs(sum(r.weights) - 1) < 1e-8 for r in rows)
    p = {r.id: (r.x, r.y, r.z) for r in cloud.collect()}
    if kind == "universal":  # a linear drift is honoured
        t = {r.id: r.x for r in away.collect()}
        assert all(abs(sum(w * p[s][0] for w, s in zip(r.weights, r.samples)) - t[r.id]) < 1e-6 for r in rows)


def test_indicator_and_cross_validation(cloud):
    rows = kriging.indicator_krige(cloud, cloud, ["x", "y", "z"], "v", [-0.5, 0.0, 0.5], VARIOGRAM, 30.0, 6).orderBy("id", "threshold").collect()
    for _, g in itertools.groupby(rows, lambda r: r.id):
        c = [r.cdf for r in g]
        assert c == sorted(c) and 0 <= c[0] and c[-1] <= 1
    cv = kriging.cross_validate(cloud, ["x", "y", "z"], "v", kriging.System(VARIOGRAM), 60.0, 8, folds=2, holes="h").collect()
    assert len(cv) == 150 and all(r.estimate is not None for r in cv)


def test_fields_do_not_depend_on_partitions(cloud):
    a = kriging.simulate_bands(cloud, VARIOGRAM, 3, 5).orderBy("realization", "id").collect()
    b = kriging.simulate_bands(cloud.repartition(7), VARIOGRAM, 3, 5).orderBy("realization", "id").collect()
    assert np.allclose([r.value for r in a], [r.value for r in b], atol=1e-9)
    s = kriging.simulate_bands(cloud, VARIOGRAM, 200, 6).agg(F.var_pop("value").alias("v"), F.avg("value").alias("m")).first()
    assert abs(s.v - 1) < 0.15 and abs(s.m) < 0.1


def test_fit_variogram(cloud, spark):
    h = np.arange(1, 12) * 5.0
    true = kriging.Variogram(0.2, (kriging.Structure("spherical", 0.8, 35.0),))
    g = true.sill - true.covariance(h)
    e = spark.createDataFrame([(float(a), float(b), 10) for a, b in zip(h, g)], "lag double, gamma double, pairs long")
    fit = kriging.fit_variogram(e, ranges=[25.0, 30.0, 35.0, 40.0])
    assert abs(fit.nugget - 0.2) < 1e-8 and fit.structures[0].range == 35.0
    cols = spark.createDataFrame([(float(a),) for a in h], "h double").select(true.gamma(F.col("h")).alias("g")).collect()
    assert np.allclose([r.g for r in cols], g)


def test_unique_pairs(cloud):
    a, b = cloud.filter("h = 0"), cloud.filter("h = 1")
    got = {(r.a, r.b) for r in spatial.unique_pairs(a, b, ["x", "y", "z"], 25.0, "id", "id").collect()}
    pts = {r.id: np.array([r.x, r.y, r.z]) for r in cloud.collect()}
    near = sorted((float(np.linalg.norm(pts[i] - pts[j])), i, j) for i in pts for j in pts if i % 4 == 0 and j % 4 == 1)
    want, left, right = set(), set(), set()
    for d, i, j in near:
        if d <= 25 and i not in left and j not in right:
            want.add((i, j))
            left.add(i)
            right.add(j)
    assert got == want


def test_normal_functions(spark):
    x = [-9.0, -3.2, -1.0, -1e-9, 0.0, 0.3, 2.0, 5.0, 7.5]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(X.normal_cdf("x").alias("c"), X.normal_ppf(X.normal_cdf("x")).alias("b")).collect()
    assert all(abs(r.c - 0.5 * math.erfc(-v / math.sqrt(2))) < 1e-13 for r, v in zip(got, x))
    assert all(abs(r.b - v) < 1e-5 for r, v in zip(got, x) if abs(v) < 4)


def test_null_model(spark):
    d = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (None, 1.0), (3.0, None), (5.0, 3.0)], "v double, w double")
    r = eda.describe(d, "v", "w", (0.5,)).first()
    assert r.n == 2 and abs(r.mean - 4.0) < 1e-12 and r.min == 1 and r.max == 5
    assert eda.describe(d.limit(0), "v", "w").collect() == []
    g = eda.grade_tonnage(d, "v", [0.0, 4.0, 9.0], "w").orderBy("cutoff").collect()
    assert [x.tonnage for x in g] == [4.0, 3.0, 0.0] and g[2].mean is None


def test_cap_by_cv(spark):
    rng = np.random.default_rng(3)
    v = rng.lognormal(0, 1, 400)
    cap = eda.cap_by_rule(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", "cv", 0.8).first().cap
    c = np.minimum(v, cap)
    assert abs(c.std() / c.mean() - 0.8) < 1e-6


def test_checks(spark):
    rows = [(1, 0.0, 2.0, 1.0), (1, 2.0, 5.0, -999.0), (1, 4.0, 6.0, 2.0), (1, 5.5, 7.0, 2.0), (1, 9.0, 10.0, -1.0), (2, 3.0, 3.0, 1.0), (2, None, 1.0, 1.0), (3, 0.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "HOLE_ID long, FROM double, TO double, au double")
    f = {(r.HOLE_ID, r.FROM): r for r in holes.check_intervals(d, spark.createDataFrame([(1,), (2,)], "HOLE_ID long"), grades=["au"]).collect()}
    assert f[1, 4.0].overlap and not f[1, 5.5].overlap and f[1, 5.5].gap and f[1, 9.0].gap and f[1, 2.0].sentinel and f[1, 9.0].negative_grade
    assert f[2, 3.0].inverted and f[2, None].missing and f[3, 0.0].no_collar
    fixed = holes.fix_intervals(holes.check_intervals(d, spark.createDataFrame([(1,), (2,)], "HOLE_ID long"), grades=["au"]), ["au"])
    assert {(r.HOLE_ID, r.FROM) for r in fixed.collect()} == {(1, 0.0), (1, 2.0), (1, 5.5), (1, 9.0)}


def test_ore_runs(spark):
    rows = [(1, float(i), float(i + 1), g) for i, g in enumerate([5.0, 5.0, 0.0, 5.0, 0.0, 0.0, 0.0, 5.0, 0.0, 5.0, 5.0])]
    got = holes.runs(spark.createDataFrame(rows, "HOLE_ID long, FROM double, TO double, au double"), "au", 3.0, 2.0, 1.0).orderBy("from").collect()
    assert [(r["from"], r.to, r.ore) for r in got] == [(0, 4, True), (4, 7, False), (7, 11, True)]


def test_steps(spark):
    d = spark.createDataFrame([(" a", "1.5", 2.0, 1), ("B ", "", None, 2), ("a", "x", -99.0, 3)], "Name string, n string, v double, k int")
    p = steps.Pipeline([("t", steps.NormalizeText(["Name"], "lower")), ("s", steps.ToNull([-99.0], ["v"])), ("r", steps.RenameColumns(case="snake"))])
    out = steps.Pipeline.from_json(p.to_json()).transform(d).orderBy("k").collect()
    assert [r.name for r in out] == ["a", "b", "a"] and [r.v for r in out] == [2.0, None, None]
    with pytest.raises(Exception, match="not a number"):
        steps.ToNumber(["n"]).transform(d).collect()
    assert steps.DropNull(["v"]).transform(d).count() == 2
    with pytest.raises(KeyError):
        steps.Scale(["nope"], 2.0).transform(d)
    assert steps.DropDuplicates(["Name"], order=["k"]).transform(d).count() == 3


def test_anamorphosis(spark):
    rng = np.random.default_rng(2)
    v = rng.lognormal(0, 0.5, 2000)
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    psi = transforms.anamorphosis(d, "v", 8)
    assert abs(psi[0] - v.mean()) < 1e-9 and 0.9 * v.var() < sum(p * p for p in psi[1:]) < 1.01 * v.var()


def test_grid_and_polygon(spark):
    g = blocks.Grid((10.0, 20.0, 0.0), (5.0, 4.0, 2.0), (6, 5, 3), 30.0)
    b = g.blocks(spark)
    assert b.select(g.cell("x", "y", "z").alias("c"), "cell").filter("c <> cell").count() == 0
    assert blocks.ring_area([(0, 0), (4, 0), (4, 3)]) == 6


@pytest.mark.parametrize(("model", "order"), [("spherical", None), ("exponential", None), ("gaussian", None), ("matern", 1.5), ("matern", 2.5)])
def test_fields_have_the_covariance_given(model, order):
    v = kriging.Variogram(0.0, (kriging.Structure(model, 1.0, 60.0, order),))
    w = kriging._frequencies(v.structures[0], 200_000, np.random.default_rng(3))
    for h in (3.0, 10.0, 20.0, 30.0, 45.0, 60.0, 90.0):
        for axis in range(3):
            assert abs(np.cos(w[:, axis] * h).mean() - v.covariance(np.array([h]))[0]) < 0.01


def test_fields_refuse_a_model_without_a_spectrum():
    with pytest.raises(ValueError):
        kriging._frequencies(kriging.Structure("cubic", 1.0, 60.0), 10, np.random.default_rng(3))
