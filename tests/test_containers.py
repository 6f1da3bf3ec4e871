"""Containers, anamorphosis, ensembles and their files: brute force and round trips."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.operators import containers, ensembles, hermite, kriging, steps
from stratalode.operators.blocks import Grid
from stratalode.sources import models, text


def test_rename_and_back(spark):
    d = spark.createDataFrame([(1, 2, 3)], "`AuPPM` int, ` Hole ID2X ` int, `b-c` int")
    s = steps.RenameColumns({"b-c": "bCol"}, case="snake", strip=True).fit(d)
    assert s.transform(d).columns == ["au_ppm", "hole_id2_x", "b_col"]
    assert s.inverse(s.transform(d)).columns == d.columns
    assert steps.words("x1Y__zÉw") == ["x1", "Y", "z", "w"]


def test_categories(spark):
    d = spark.createDataFrame([("10",), ("9",), ("2",), (None,), ("9",)], "v string")
    c = containers.categories(d, "v")
    assert c.names == ("2", "9", "10")
    assert [r.c for r in d.select(c.encode("v").alias("c")).collect()] == [2, 1, 0, None, 1]
    rare = containers.categories(d, "v", min_share=0.3)
    assert rare.names == ("9", "other") and [r.c for r in d.select(rare.encode("v").alias("c")).collect()] == [1, 0, 1, None, 0]
    with pytest.raises(Exception, match="no category"):
        spark.createDataFrame([("x",)], "v string").select(c.encode("v")).collect()
    with pytest.raises(KeyError):
        c.lump(["7"])
    assert containers.categories(d.limit(0), "v").names == ()
    assert containers.categories(d, "v", mapping={"10": "2"}).names == ("2", "9")


def test_local_grid(spark):
    g = containers.LocalGrid(2.0, 30.0, (100.0, 200.0), 5.0)
    d = spark.createDataFrame([(0.0, 0.0, 1.0), (10.0, 0.0, 2.0), (3.0, 7.0, 3.0)], "x double, y double, z double")
    p = d.select("*", *[c.alias(n) for c, n in zip(g.apply("x", "y", "z"), "abc")])
    fit = containers.fit_local_grid(p, "xyz", "abc")
    assert np.allclose([fit.scale, fit.rotation, *fit.shift, fit.z_shift], [2, 30, 100, 200, 5])
    r = p.filter("x = 10").first()
    assert np.allclose([r.a, r.b], [100 + 20 * math.cos(math.radians(30)), 200 - 20 * math.sin(math.radians(30))])  # clockwise
    with pytest.raises(ValueError):
        containers.fit_local_grid(p.limit(1), "xyz", "abc")


def test_anamorphosis_and_back(spark):
    a = hermite.Anamorphosis((10.0, -3.0, 0.8, -0.1))
    y = np.linspace(-2.5, 2.5, 41)
    d = spark.createDataFrame([(float(v),) for v in y], "y double").withColumn("z", a.inverse_transform("y"))
    rows = d.withColumn("back", a.transform("z")).collect()
    z = [10 + 3 * r.y + 0.8 * (r.y**2 - 1) / math.sqrt(2) + 0.1 * (r.y**3 - 3 * r.y) / math.sqrt(6) for r in rows]
    rising = [i for i in range(41) if all(z[j] < z[i] for j in range(i))]
    assert np.allclose([r.z for r in rows], z) and all(abs(rows[i].back - rows[i].y) < 2e-3 for i in rising if rows[i].y > -1.5)
    assert spark.range(1).select(a.transform(F.lit(None).cast("double"))).first()[0] is None
    assert abs(a.block(a.support(5.0)).variance - 5.0) < 1e-9
    s = np.random.default_rng(1).normal(size=400_000)
    v = a._at(s)
    for c, t, q, g in a.grade_tonnage([8.0, 10.0, 13.0]):
        assert abs((v >= c).mean() - t) < 5e-3 and abs((v * (v >= c)).mean() - q) < 5e-2 and abs(q / t - g) < 1e-12


def test_support(spark):
    v = kriging.Variogram(0.0, (kriging.Structure("spherical", 1.0, 20.0),))
    assert hermite.block_correlation(v, (0.0, 0.0, 0.0)) == 1
    rng = np.random.default_rng(2)
    p, q = rng.uniform(0, [10, 10, 0], (2, 100_000, 3))
    assert abs(v.covariance(np.sqrt(((p - q) ** 2).sum(1))).mean() - hermite.block_correlation(v, (10, 10, 0), (12, 12, 1))) < 0.02
    r, block = hermite.change_of_support(hermite.Anamorphosis((1.0, -2.0)), v, (10, 10, 0))
    assert 0 < r < 1 and abs(block.psi[1] + 2 * r) < 1e-12


def test_representative_realizations(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 10, (3, 25))
    rows = [(i, r, float(centers[r % 3, i] + rng.normal(0, 0.1))) for r in range(12) for i in range(25)]
    d = spark.createDataFrame(rows, "id int, realization int, value double")
    names, dist = ensembles.distances(d)
    x = np.array([[v for i, k, v in rows if k == r] for r in range(12)])
    assert names == list(range(12)) and np.allclose(dist, np.sqrt(((x[:, None] - x[None]) ** 2).mean(-1)))
    for seed in range(4):
        got = ensembles.select_realizations(d, 3, seed)
        assert sorted(r % 3 for r, _ in got) == [0, 1, 2] and all(abs(s - 1 / 3) < 1e-12 for _, s in got)
    assert len(ensembles.select_realizations(d, 12)) == 12


def test_localize(spark):
    b = spark.createDataFrame([(i, i % 2, float(-i)) for i in range(7)], "id int, panel int, ranking double")
    r = spark.createDataFrame([(p, k, float(10 * p + k * k)) for p in range(2) for k in range(6)], "panel int, realization int, value double")
    got = {x.id: x.localized for x in ensembles.localize(b, r).collect()}
    for panel in range(2):
        ids = sorted((i for i in range(7) if i % 2 == panel), key=lambda i: -i)
        v = np.repeat(sorted(10.0 * panel + k * k for k in range(6)), len(ids)).reshape(len(ids), -1).mean(1)
        assert np.allclose([got[i] for i in ids], v)


def test_model_files(spark, tmp_path):
    g = Grid((1.0, 2.0, 3.0), (5.0, 4.0, 2.0), (6, 5, 3), 30.0)
    d = text.set_units(g.blocks(spark), {"x": "m"}) if hasattr(text, "set_units") else g.blocks(spark)
    models.write_parquet(d, str(tmp_path / "m"), g, "EPSG:1234")
    back, grid, crs = models.read_parquet(spark, str(tmp_path / "m"))
    assert grid == g and crs == "EPSG:1234" and back.count() == 90
    f = models.BlockModelFile(spark, str(tmp_path / "m"))
    parts = [c.count() for c in f.chunks(40, ["x"])]
    assert parts == [40, 40, 10] and f.grid == g
    models.write_parquet(d, str(tmp_path / "n"))
    assert models.read_parquet(spark, str(tmp_path / "n"))[1:] == (None, None)


def test_mesh_and_polygon_files(spark, tmp_path):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.5, 0.25)], "vertex int, x double, y double, z double").repartition(3)
    models.write_mesh(v, spark.createDataFrame([(0, 1, 2)], "a int, b int, c int"), str(tmp_path / "o"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert lines == ["v 0.0 0.0 0.0", "v 1.0 0.0 0.0", "v 0.0 1.5 0.25", "f 1 2 3"]
    ring = containers.polyline_points(v.withColumn("k", F.lit("a")), "k", ["vertex"], ["x", "y", "z"])
    models.write_geojson(ring, str(tmp_path / "g"))
    feature = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert feature["geometry"] == {"type": "Polygon", "coordinates": [[[0, 0, 0], [1, 0, 0], [0, 1.5, 0.25], [0, 0, 0]]]} and feature["properties"] == {"id": "a"}
    assert containers.polyline_areas(ring).first().area == 0.75
