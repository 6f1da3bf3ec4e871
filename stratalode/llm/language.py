"""Language ID by Bayesian evidence fusion: text likelihoods, declared language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .overlap_join import LOWER
from .repeats import U64, _BYTES, _batches, mix

BUCKETS = 1 << 14


def visible(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments, navigation and tags; the common entities read."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    return F.regexp_replace(t, r"&[#a-zA-Z0-9]{1,8};", " ")


def declared(html: Column) -> Column:
    """The primary tag that the html element declares, lower case; empty if none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def suffix(host_: Column) -> Column:
    return F.element_at(F.split(host_, r"\."), -1)


def _grams(text: bytes) -> np.ndarray:
    """Hashed runs of one to four bytes of the lower-cased text, as bucket numbers."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    raw = raw[(raw > 64) | (raw == 32)]  # letters and spaces
    v = _BYTES[raw]
    out = []
    for n in (1, 2, 3, 4):
        if len(raw) >= n:
            h = v[: len(raw) - n + 1].copy()
            for k in range(1, n):
                h = h * U64(0x9E3779B97F4A7C15) + v[k : len(raw) - n + 1 + k]
            out.append((mix(h + U64(n)) % U64(BUCKETS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Model:
    """Log shares of hashed byte runs by language, from their counts."""

    def __init__(self, counted: dict[str, np.ndarray], smooth: float = 0.5):
        self.langs = sorted(counted)
        counts = np.full((BUCKETS, max(len(self.langs), 1)), smooth)
        for i, l in enumerate(self.langs):
            counts[:, i] += counted[l]
        self.log = np.log(counts / counts.sum(0))

    def __call__(self, text: str) -> np.ndarray:
        """Log likelihoods of the whole text: its mean run, counted as an eighth of its runs (they overlap), 50 at most.

        Runs of one text are far from independent; without the bound any other evidence would be nothing beside them.
        """
        g = _grams(text.encode())
        return self.log[g].mean(0) * min(len(g), 400) / 8 if len(g) else np.zeros(self.log.shape[1])


def train(docs: DataFrame, rows: int = 4_000) -> Model:
    """Fit on at most `rows` labelled documents, the first by a hash of doc_id; of rows that share one the least text.

    Runs are counted where the texts are; the driver gets a table of counts for each language and task, eight tasks at most.
    """
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang")).filter("text is not null and lang is not null")
    first = d.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows)
    some = d.join(F.broadcast(first.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[l] = held.get(l, 0) + np.bincount(_grams(t.encode()), minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(held), pa.string()), "counts": pa.array([x.astype("<i8").tobytes() for x in held.values()], pa.binary())})

    out: dict[str, np.ndarray] = {}
    for r in some.select("r.text", "r.lang").coalesce(8).mapInArrow(count, "lang string, counts binary").collect():
        out[r.lang] = out.get(r.lang, 0) + np.frombuffer(r.counts, "<i8")
    return Model(out)


def fuse(pages: DataFrame, docs: DataFrame, train_rows: int = 4_000, to_suffix: float = 4.0, to_all: float = 8.0, trust: float = 20.0) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix, host and log_odds of every page.

    For language l: log P(text | l) + log P(declared | l) + log P(l | host). Text likelihoods come from
    labelled documents. Their posteriors, taken as soft counts over all pages by grouped aggregation,
    give how often a page of l declares each tag, and the priors: a host's counts, less the page's own, are
    smoothed by `to_suffix` pages of its suffix's shares, those by `to_all` pages of all. P(declared | l)
    is smoothed by `trust` pages that declare truly; a page that declares nothing brings no such evidence.
    Pages without letters are decided by the rest. Null html or url: no such evidence. Ties: the first
    language by name. No labelled documents: lang null. Repeated rows give a row each.
    """
    model = train(docs, train_rows)
    langs = model.langs
    p = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("_url"), pages["html"].alias("_html"))
    p = p.select("page_id", host(F.col("_url")).alias("host"), declared(F.col("_html")).alias("declared"), visible(F.col("_html")).alias("text"))
    p = p.withColumn("suffix", suffix(F.col("host")))
    held = pages.sparkSession.sparkContext.broadcast(model)

    def likely(batches):
        m = held.value
        for b in batches:
            rows = [m(t or "").tolist() if m.langs else [] for t in b.column("text").to_pylist()]
            cols = {c: b.column(c) for c in ("page_id", "host", "suffix", "declared")}
            yield pa.RecordBatch.from_pydict({**cols, "ll": pa.array(rows, pa.list_(pa.float64()))})

    kind = f"page_id {dict(p.dtypes)['page_id']}, host string, suffix string, declared string, ll array<double>"
    t = p.mapInArrow(likely, kind)
    if not langs:
        null = F.lit(None).cast("string")
        return t.select("page_id", null.alias("lang"), F.lit(None).cast("double").alias("probability"), null.alias("text_lang"), "declared", "suffix", "host", F.lit(None).cast("double").alias("log_odds"))
    n = len(langs)
    names = F.array(*[F.lit(x) for x in langs])

    def softmax(a: str) -> Column:
        e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))

    t = cut(t.withColumn("q", softmax("ll")))

    def counts(by: list[str], out: str) -> DataFrame:
        return t.groupBy(*by).agg(F.array(*[F.sum(F.col("q")[i]) for i in range(n)]).alias(out))

    everything = [x or 0.0 for x in counts([], "c_all").first()["c_all"]]
    base = [(x + 1) / (sum(everything) + n) for x in everything]
    all_ = F.array(*[F.lit(x) for x in base])
    tags = counts(["declared"], "c_tag").withColumnRenamed("declared", "_tag")
    t = t.join(counts(["suffix"], "c_suffix").withColumnRenamed("suffix", "_s"), F.col("suffix").eqNullSafe(F.col("_s")), "left").drop("_s")
    t = t.join(counts(["host"], "c_host").withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")), "left").drop("_h")
    t = t.join(tags, F.col("declared").eqNullSafe(F.col("_tag")), "left").drop("_tag")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, y: s + y)

    t = t.withColumn("c_suffix", F.zip_with("c_suffix", "q", lambda c, q: F.greatest(c - q, F.lit(0.0)))).withColumn("c_host", F.zip_with("c_host", "q", lambda c, q: F.greatest(c - q, F.lit(0.0))))
    t = t.withColumn("p_suffix", F.zip_with("c_suffix", all_, lambda c, a: (c + to_all * a) / (total(F.col("c_suffix")) + to_all)))
    t = t.withColumn("p_host", F.zip_with("c_host", "p_suffix", lambda c, a: (c + to_suffix * a) / (total(F.col("c_host")) + to_suffix)))
    seen = F.array(*[F.lit(float(x)) for x in everything])
    tag = F.zip_with(F.zip_with("c_tag", seen, lambda c, s: F.struct(c.alias("c"), s.alias("s"))), names, lambda x, name: F.log((x["c"] + F.when(name == F.col("declared"), F.lit(trust)).otherwise(F.lit(trust / 20))) / (x["s"] + 2 * trust)))
    t = t.withColumn("e_tag", F.when(F.col("declared") != "", tag).otherwise(F.transform(names, lambda _: F.lit(0.0))))
    t = t.withColumn("lp", F.zip_with(F.zip_with("ll", "e_tag", lambda a, b: a + b), "p_host", lambda a, b: a + F.log(b)))
    t = t.withColumn("post", softmax("lp"))
    best = F.array_position("post", F.array_max("post")).cast("int")
    second = F.array_max(F.filter("lp", lambda x: x < F.array_max("lp")))
    return t.select(
        "page_id", F.get(names, best - 1).alias("lang"), F.array_max("post").alias("probability"), F.get(names, F.array_position("q", F.array_max("q")).cast("int") - 1).alias("text_lang"),
        "declared", "suffix", "host", (F.array_max("lp") - second).alias("log_odds"),
    )
