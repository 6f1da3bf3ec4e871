"""Text formats: headed CSV with units and no-data marks, GSLIB tables, GeoJSON, OBJ meshes."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as missing where the caller names nothing.
NODATA_NUMBERS = (-99.0, -999.0, 1e21)
NODATA_TEXTS = ("", "-", "--", "#n/a", "n.a.", "n/a", "n/d", "na", "nan", "nd", "none", "null")

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def split_unit(header: str) -> tuple[str, str | None]:
    """'au [g/t]' as ('au', 'g/t')."""
    m = re.fullmatch(r"\s*(.*?)\s*[\[(]([^\])]+)[\])]\s*", header)
    return (m[1], m[2]) if m and m[1] else (header.strip(), None)


def read_csv(spark: SparkSession, path: str, nodata: Sequence | None = None, delimiter: str = ",") -> DataFrame:
    """All columns as double where every value but the missing ones is a number, else as text; units go to column metadata.

    The kinds are found by one aggregation over the whole file.
    """
    raw = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False)
    numbers = [float(x) for x in (NODATA_NUMBERS if nodata is None else nodata) if not isinstance(x, str)]
    texts = [str(x).lower() for x in (NODATA_TEXTS if nodata is None else nodata) if isinstance(x, str)] + [""]
    names = [split_unit(c) for c in raw.columns]
    t = raw.toDF(*[f"_{i}" for i in range(len(names))])
    known = {c: F.when(~F.lower(F.trim(c)).isin(*texts), F.trim(c)) for c in t.columns}
    wrong = t.agg(*[F.max(F.when(known[c].isNotNull(), (~known[c].rlike(NUMBER)).cast("int"))).alias(c) for c in t.columns]).first()
    out = []
    for c, (name, unit) in zip(t.columns, names):
        v = known[c]
        if wrong[c] == 0 or wrong[c] is None:
            n = v.cast("double")
            v = F.when(~n.isin(*numbers), n) if numbers else n
        out.append(v.alias(name, metadata={"unit": unit} if unit else {}))
    return t.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Headed; missing values are empty; units stand in the header."""
    names = [f"{f.name} [{f.metadata['unit']}]" if f.metadata.get("unit") else f.name for f in df.schema.fields]
    kinds = dict(df.dtypes)
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
    clean.toDF(*names).write.csv(path, header=True, emptyValue="", nullValue="", mode="overwrite")


def units(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["unit"] for f in df.schema.fields if f.metadata.get("unit")}


#: Factors to the first unit of each kind.
FACTORS = {
    "length": {"m": 1.0, "cm": 0.01, "mm": 0.001, "km": 1000.0, "ft": 0.3048, "in": 0.0254},
    "mass": {"t": 1.0, "kg": 0.001, "g": 1e-6, "kt": 1e3, "Mt": 1e6, "lb": 0.00045359237, "oz": 3.11034768e-5},
    "grade": {"g/t": 1.0, "ppm": 1.0, "ppb": 0.001, "%": 10000.0, "kg/t": 1000.0, "oz/t": 31.1034768},
}


def convert_units(df: DataFrame, column: str, to: str) -> DataFrame:
    """The column in another unit of its kind; another kind is an error."""
    have = units(df).get(column)
    for kind in FACTORS.values():
        if have in kind and to in kind:
            return df.withColumn(column, F.col(column) * (kind[have] / kind[to])).withMetadata(column, {"unit": to})
    raise ValueError(f"{column}: can't turn {have} into {to}")


def read_gslib(spark: SparkSession, path: str, nodata: float | None = -999.0) -> DataFrame:
    """A title line, the number of columns, a name per line, then rows of numbers; x, y and the rest by name."""
    lines = spark.read.text(path, wholetext=False)
    head = lines.limit(2).collect()
    n = int(head[1].value.split()[0])
    names = [r.value.strip() for r in lines.limit(2 + n).collect()[2:]]
    v = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value").rlike(r"^[-+0-9.eE]+(\s+[-+0-9.eE]+)*$")).select(v.alias("v")).filter(F.size("v") == n)
    if n == 1:  # the line with the number of columns looks like a row of one
        rows = rows.filter(F.col("v")[0] != head[1].value.split()[0])
    cols = [F.element_at("v", i + 1).cast("double") for i in range(n)]
    return rows.select(*[(F.when(c != nodata, c) if nodata is not None else c).alias(m) for c, m in zip(cols, names)])


def write_gslib(df: DataFrame, path: str, title: str = "data", nodata: float = -999.0) -> None:
    """One part file: the numeric columns, missing ones as nodata."""
    names = [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint")]
    row = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("double"), F.lit(float(nodata))).cast("string") for c in names])
    head = df.sparkSession.createDataFrame([(0, i, s) for i, s in enumerate([title, str(len(names)), *names])], "p int, i long, value string")
    body = df.select(F.lit(1).alias("p"), F.monotonically_increasing_id().alias("i"), row.alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("p", "i").select("value").write.text(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, parts (arrays of x, y, z) and properties (as JSON) of each feature."""

    def rings(kind: str, c) -> list:
        return {"Point": lambda: [[c]], "MultiPoint": lambda: [[p] for p in c], "LineString": lambda: [c], "MultiLineString": lambda: c, "Polygon": lambda: c, "MultiPolygon": lambda: [r for p in c for r in p]}[kind]()

    def parse(batches):
        import pandas as pd

        for b in batches:
            out = []
            for text in b["value"]:
                held = json.loads(text)
                features = held["features"] if held["type"] == "FeatureCollection" else [held] if held["type"] == "Feature" else [{"geometry": held, "properties": {}}]
                for i, f in enumerate(features):
                    g = f.get("geometry")
                    parts = [[[*map(float, p), 0.0][:3] for p in r] for r in rings(g["type"], g["coordinates"])] if g else []
                    out.append((i, g["type"] if g else None, parts, json.dumps(f.get("properties") or {})))
            yield pd.DataFrame(out, columns=["id", "kind", "parts", "properties"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "id long, kind string, parts array<array<array<double>>>, properties string")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: vertex, x, y, z; triangles: a, b, c), numbered from 0 in file order; polygons become fans."""
    t = spark.read.text(path).withColumn("w", F.split(F.trim("value"), r"\s+")).withColumn("row", F.monotonically_increasing_id())
    from pyspark.sql import Window

    v = t.filter("w[0] = 'v'").withColumn("vertex", F.row_number().over(Window.orderBy("row")) - 1)
    vertices = v.select("vertex", *[F.element_at("w", i + 2).cast("double").alias(a) for i, a in enumerate("xyz")])
    f = t.filter("w[0] = 'f'").select("row", F.transform(F.slice("w", 2, 1000), lambda x: F.split(x, "/")[0].cast("int") - 1).alias("i"))
    fan = f.select("row", F.explode(F.transform(F.sequence(F.lit(1), F.size("i") - 2), lambda k: F.struct(F.get("i", F.lit(0)).alias("a"), F.get("i", k).alias("b"), F.get("i", k + 1).alias("c")))).alias("t"))
    return vertices, fan.select("t.*")
