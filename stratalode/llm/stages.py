"""The stages of a corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

A row is told from others by its doc_id and a hash of its text, so rows without doc_id and rows that share one are judged each by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, overlap_join, quality, token_files
from .common import cut, fresh, maybe_broadcast, remove, shared_dir


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) with rows of doc_id and text_key."""
    a, b = fresh(docs.columns, "_id"), fresh(docs.columns, "_text_key")
    rows = cut(rows.select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct())
    return docs.join(maybe_broadcast(rows, rows.count()), docs["doc_id"].eqNullSafe(F.col(a)) & (F.xxhash64(docs["text"]) == F.col(b)), how)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5. Null or empty text: scored like a text without words."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id (then hash of text; no doc_id comes last), of each group that shingles of five words link at 0.8 or more.

    Of rows alike in doc_id and text one is kept. Rows without words are nobody's duplicates.
    """
    found = cut(overlap_join.join(docs, words=5, num=80, den=100).select("doc_id", "text_key", "n_shingles", "first"))
    out = _matching(docs, found.filter("not first"), "left_anti")
    again = cut(found.filter("first and n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1"))
    if again.isEmpty():
        return out
    return _matching(out, again, "left_anti").unionByName(_matching(out, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item, or a whole item of fewer. Null or empty text: stays."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _matching(docs, found.filter("contaminated"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, so that each source comes near its target of words.

    Rows alike in doc_id, source and text are taken together: one of them stands for all, as often as all are taken.
    A document without words is taken 0 times. Null source: a source of its own.
    """
    names = {c: fresh(docs.columns, f"_{c}") for c in ("doc_id", "source", "text_key", "times", "pass", "rows")}
    taken = mixing.whole(docs).groupBy("doc_id", "source", "text_key").agg(F.sum("times").cast("int").alias("times"), F.count(F.lit(1)).alias("rows"))
    taken = cut(taken.filter("times > 0").withColumnsRenamed(names))
    doc_id, source, key, times, again = (F.col(names[c]) for c in ("doc_id", "source", "text_key", "times", "rows"))
    same = docs["doc_id"].eqNullSafe(doc_id) & docs["source"].eqNullSafe(source) & (F.xxhash64(docs["text"]) == key)
    out = docs.join(maybe_broadcast(taken, taken.count()), same)
    if not taken.filter(again > 1).isEmpty():
        out = out.filter(again == 1).unionByName(out.filter(again > 1).dropDuplicates(["doc_id", "source", "text"]))
    return out.withColumn(names["pass"], F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, as read back."""
    import public_tokenizers

    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=300_000)  # beside what four stages left on the executors


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("token_files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. What each leaves lies in the shared folder until the next one has read it; the token files stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    out = STAGES[-1][1](spark, docs, sf_dir)  # the files are written by now
    remove(spark, folder)
    return out
