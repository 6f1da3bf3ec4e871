"""Block models as streams: the operators' aggregates over files as they come, and chunk-wise mapping."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import value


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def grade_tonnage(stream: DataFrame, values, cutoffs: Sequence[float], weights=None) -> DataFrame:
    """Running tonnage, metal and mean at each cutoff; one state row a cutoff (output mode complete or update)."""
    v, w = value(values), F.lit(1.0) if weights is None else value(weights)
    t = stream.select(v.alias("v"), w.alias("w"), F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff")).filter("v is not null and v >= cutoff")
    return t.groupBy("cutoff").agg(F.sum("w").alias("tonnage"), F.sum(F.col("w") * F.col("v")).alias("metal"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))


def map_blocks(df: DataFrame, func: Callable, schema: str, keep: bool = True) -> DataFrame:
    """func(pandas chunk) -> new columns, beside (keep) or instead of the old ones, in memory bounded by an Arrow batch; batch or stream."""

    def run(chunks):
        import pandas as pd

        for c in chunks:
            new = pd.DataFrame(func(c))
            yield pd.concat([c.reset_index(drop=True), new], axis=1) if keep else new

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{old}, {schema}" if keep else schema)
