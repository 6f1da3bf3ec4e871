"""Text formats and streams."""

import json

import pytest
from pyspark.sql import functions as F

from stratalode.sources import text
from stratalode.streaming import models


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("HOLE,au [g/t],note\nA1,1.5,x\nA2,-999,NA\nA3,n/a,y\n")
    d = text.read_csv(spark, str(tmp_path / "a.csv"))
    assert d.dtypes == [("HOLE", "string"), ("au", "double"), ("note", "string")] and text.units(d) == {"au": "g/t"}
    assert [tuple(r) for r in d.orderBy("HOLE").collect()] == [("A1", 1.5, "x"), ("A2", None, None), ("A3", None, "y")]
    p = text.convert_units(d, "au", "%")
    assert abs(p.agg(F.sum("au")).first()[0] - 1.5e-4) < 1e-15 and text.units(p) == {"au": "%"}
    with pytest.raises(ValueError, match="can't turn"):
        text.convert_units(d, "au", "m")
    text.write_csv(d, str(tmp_path / "b"))
    assert sorted(map(tuple, text.read_csv(spark, str(tmp_path / "b")).collect()), key=str) == sorted(map(tuple, d.collect()), key=str)


def test_gslib(spark, tmp_path):
    d = spark.createDataFrame([(1.0, 2.0), (3.5, None)], "x double, v double")
    text.write_gslib(d, str(tmp_path / "g"))
    assert sorted(map(tuple, text.read_gslib(spark, str(tmp_path / "g")).collect())) == [(1.0, 2.0), (3.5, None)]


def test_geojson_and_obj(spark, tmp_path):
    g = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6, 7]}}]}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    rows = text.read_geojson(spark, str(tmp_path / "g.json")).orderBy("id").collect()
    assert rows[0].parts == [[[0, 0, 0], [1, 0, 0], [1, 1, 0]]] and rows[1].parts == [[[5, 6, 7]]] and json.loads(rows[0].properties) == {"a": 1}
    (tmp_path / "m.obj").write_text("# box\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    v, f = text.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4 and sorted(map(tuple, f.collect())) == [(0, 1, 2), (0, 2, 3)]


def test_stream(spark, tmp_path):
    d = spark.range(100).select(F.col("id").cast("double").alias("v"), F.lit(2.0).alias("w"))
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    s = models.read_stream(spark, str(tmp_path / "in"), d.schema, 1)
    q = models.grade_tonnage(s, "v", [0.0, 50.0], "w").writeStream.outputMode("complete").format("memory").queryName("gt").start()
    q.processAllAvailable()
    q.stop()
    assert {r.cutoff: r.tonnage for r in spark.table("gt").collect()} == {0.0: 200.0, 50.0: 100.0}
    m = models.map_blocks(d, lambda c: {"u": c["v"] * 2}, "u double")
    assert m.filter("u <> v * 2").count() == 0 and m.columns == ["v", "w", "u"]
