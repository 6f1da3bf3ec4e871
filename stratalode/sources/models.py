"""Block models, meshes and polygons in files: Parquet with units and a grid, OBJ, GeoJSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import Grid


def write_parquet(df: DataFrame, path: str, grid: Grid | None = None, crs: str | None = None, partition_by=()) -> None:
    """Parquet with units (column metadata), and a grid and coordinate system in the first column's metadata; many files, as many tasks."""
    about = {k: v for k, v in (("grid", json.dumps(asdict(grid)) if grid else None), ("crs", crs)) if v}
    first = df.schema.fields[0]
    df = df.withMetadata(first.name, {**(first.metadata or {}), **about}) if about else df
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, Grid | None, str | None]:
    """(rows, grid, coordinate system); the two are None where the file names none. Columns and filters reach the scan."""
    df = spark.read.parquet(path)
    held = [f.metadata for f in df.schema.fields if f.metadata]
    grid = next((json.loads(m["grid"]) for m in held if "grid" in m), None)
    return df, Grid(**{k: tuple(v) if isinstance(v, list) else v for k, v in grid.items()}) if grid else None, next((m["crs"] for m in held if "crs" in m), None)


@dataclass(frozen=True)
class BlockModelFile:
    """A block model on disk, read in ranges of its `cell` numbers."""

    spark: SparkSession
    path: str

    @property
    def grid(self) -> Grid | None:
        return read_parquet(self.spark, self.path)[1]

    def chunks(self, blocks: int, columns=None) -> Iterator[DataFrame]:
        """DataFrames of the model's rows by ranges of `blocks` cells; each is a filter that the scan takes."""
        df, grid, _ = read_parquet(self.spark, self.path)
        df = df.select("cell", *columns) if columns else df
        n = math.prod(grid.count) if grid else (df.agg(F.max("cell")).first()[0] or 0) + 1
        for at in range(0, n, blocks):
            yield df.filter((F.col("cell") >= at) & (F.col("cell") < at + blocks))


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """An OBJ file from rows (vertex, x, y, z) and (a, b, c) of vertex numbers from 0. One file, so one task writes it."""
    number = lambda c: F.col(c).cast("double").cast("string")
    v = vertices.select(F.lit(0).alias("k"), F.col("vertex").alias("i"), F.concat_ws(" ", F.lit("v"), *[number(c) for c in "xyz"]).alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("a").cast("long").alias("i"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("long").cast("string") for c in "abc"]).alias("value"))
    v.unionByName(f).coalesce(1).sortWithinPartitions("k", "i", "value").select("value").write.mode("overwrite").text(path)


def write_geojson(vertices: DataFrame, path: str, closed: bool = True) -> None:
    """Features from rows (feature, part, vertex, x, y, z), one a line, as each is a task's row and not the whole file."""
    point = F.struct("vertex", F.array("x", "y", "z").alias("p"))
    rings = vertices.groupBy("feature", "part").agg(F.transform(F.array_sort(F.collect_list(point)), lambda r: r["p"]).alias("r"))
    rings = rings.withColumn("r", F.concat("r", F.slice("r", 1, 1))) if closed else rings
    parts = rings.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "r"))), lambda r: r["r"]).alias("c"))
    shape = F.struct(F.lit("Polygon" if closed else "MultiLineString").alias("type"), F.col("c").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("feature").alias("id")).alias("properties"), shape.alias("geometry"))
    parts.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
