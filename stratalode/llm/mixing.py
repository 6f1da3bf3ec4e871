"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, maybe_broadcast


def _hash48(*cols: Column) -> Column:
    """48 bits of md5 of the joined values as a long; null reads as the empty string."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def word_counts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size: the words of the whole text; null text counts 0. Also the columns of `more`."""
    n = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), n.alias("size"), *more)


def source_targets(sized: DataFrame, weights=(5, 2, 1), total: int | None = None, max_repeat: int = 3) -> DataFrame:
    """One row per source: src, source, source_size, n_docs, weight, target.

    Targets share `total` words (default: all there are) by weight. A target stops at max_repeat
    times its source's size and the excess is shared again by weight: target = min(cap, level * weight)
    for the one level at which the targets add up, found on sources sorted by cap / weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = by_source.withColumn("src", F.row_number().over(order))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"pmod(src - 1, {len(weights)}) + 1").cast("int")))
    t = t.withColumn("whole", F.least(F.lit(total).cast("double"), F.sum("source_size").over(everything) * F.lit(float(max_repeat))) if total is not None else F.sum("source_size").over(everything).cast("double"))
    t = t.withColumn("cap", (F.col("source_size") * max_repeat).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "src")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("at", F.row_number().over(rising))
    open_ = F.col("ratio") >= F.col("level") * (1 - 1e-12)
    t = t.withColumn("level", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("at"))).over(everything))
    t = t.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")))
    return t.select("src", "source", "source_size", "n_docs", "weight", "target")


def sainte_lague(rows: DataFrame, share: str, seats: Column | str, order: str, by: list[str]) -> DataFrame:
    """Add `quota`: integer seats by highest quotients share / (2k - 1); ties go to the lower `order`.

    Only the quotients that can matter are listed. The divisor at which rounded shares add up to N
    differs from sum / N by at most half a seat per row, which bounds each row's quota from both
    sides; the seats under the lower bound are given at once and the rest by rank. Over n rows
    that lists about 3 n quotients, however many seats there are. Rows whose share is 0 get none.
    """
    group = Window.partitionBy(*by)
    seats = F.col(seats) if isinstance(seats, str) else seats
    t = rows.withColumn("_n", seats.cast("long")).withColumn("_all", F.sum(share).over(group)).withColumn("_rows", F.count(F.lit(1)).over(group))
    p = F.col(share) / F.when(F.col("_all") > 0, F.col("_all"))
    t = t.withColumn("_p", F.coalesce(p, F.lit(0.0)))
    t = t.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_p") * (F.col("_n") - F.col("_rows") / 2) - 0.5) - 1).cast("long"))
    t = t.withColumn("_top", F.ceil(F.col("_p") * (F.col("_n") + F.col("_rows") / 2) + 0.5).cast("long") + 1)
    t = t.withColumn("_left", F.col("_n") - F.sum("_low").over(group))
    ks = F.when(F.col("_p") > 0, F.sequence(F.col("_low") + 1, F.greatest(F.col("_low") + 1, F.col("_top"))))
    q = t.filter("_p > 0").select(*by, order, "_left", F.col(share).cast("double").alias("_share"), F.explode(ks).alias("_k"))
    q = q.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy((F.col("_share") / (2 * F.col("_k") - 1)).desc(), F.col(order))))
    won = q.filter("_rank <= _left").groupBy(*by, order).agg(F.count(F.lit(1)).alias("_won"))
    t = t.join(won, [*by, order], "left")
    return t.withColumn("quota", F.when(F.col("_p") > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("long")).drop("_n", "_all", "_rows", "_p", "_low", "_top", "_left", "_won")


def _dealt(sized: DataFrame, weights, total: int | None, max_repeat: int, block: int, shard_docs: int, seed: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each row of `sized` with its shard's `passes`, `extra` blocks, `start` and `n_blocks`, and `_to`: the words of its stream up to and with it."""
    sources = cut(source_targets(sized, weights, total, max_repeat).withColumn("one", F.lit(1)))
    n_sources = sources.count()
    seats = F.round(F.sum("target").over(Window.partitionBy("one")) / block)
    sources = sainte_lague(sources, "target", seats, "src", ["one"]).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long"))
    sources = cut(sources.select("src", "source", "source_size", "target", "n_shards", F.col("quota").alias("source_quota")))
    s = maybe_broadcast(sources.withColumnRenamed("source", "_source"), n_sources)
    d = sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("_h", _hash48(F.lit(seed), F.col("doc_id"))).withColumn("shard", F.pmod(F.col("_h"), F.col("n_shards")))
    shards = d.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, "shard_size", "source_quota", "shard", ["src"])
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / block).cast("long")).withColumn("quota", F.least(F.col("quota"), F.col("n_blocks") * max_repeat))
    one = F.greatest(F.col("n_blocks"), F.lit(1))
    shards = shards.select("src", "shard", one.alias("n_blocks"), F.floor(F.col("quota") / one).alias("passes"), F.pmod(F.col("quota"), one).alias("extra"), F.pmod(_hash48(F.lit(seed), F.lit("shard"), F.col("src"), F.col("shard")), one).alias("start"))
    shards = cut(shards)
    d = d.join(maybe_broadcast(shards, shards.count()), ["src", "shard"])
    stream = Window.partitionBy("src", "shard").orderBy("_h", "doc_id", "size", *ties)
    return d.withColumn("_to", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))


def mix(docs: DataFrame, weights=(5, 2, 1), total: int | None = None, max_repeat: int = 3, block: int = 8, shard_docs: int = 500, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes.

    The total is dealt in equal blocks of `block` words. Sainte-Lague gives each source, then each of
    its shards (documents by a seeded hash, about `shard_docs` a shard, so that a hot source is many
    shards), an integer quota of blocks. A shard's documents in seeded order form one stream of words;
    quota div blocks whole passes are taken, and the remaining blocks are every so-manieth of the
    stream from a seeded start. The last block of a stream may be short.

    Null or empty texts: size and taken 0. Null source: a source of its own, last. Repeated rows are
    documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    d = _dealt(cut(word_counts(docs)), weights, total, max_repeat, block, shard_docs, seed)
    words_before = "{b} * ((({p} div {b}) * extra + start) div n_blocks) + ({p} % {b}) * (((({p} div {b}) + 1) * extra + start) div n_blocks - (({p} div {b}) * extra + start) div n_blocks)"
    upto, since = (F.expr(words_before.format(p=p, b=block)) for p in ("_to", "(_to - size)"))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + upto - since).cast("long").alias("taken"))


def whole(docs: DataFrame, weights=(5, 2, 1), total: int | None = None, max_repeat: int = 3, block: int = 8, shard_docs: int = 500, seed: int = 17) -> DataFrame:
    """doc_id, source, text_key, size, target, times: how often the mix takes each document, whole.

    Quotas are those of `mix`. A shard's whole passes take all its documents; the words beyond those are
    filled with its documents in seeded order, the last one only if half of it or more fits, so that a
    shard's words differ from its quota by at most about half a document. A document without words: 0 times.
    text_key is a hash of the text, which tells rows of one doc_id apart.
    """
    sized = cut(word_counts(docs, F.xxhash64(docs["text"]).alias("text_key")))
    d = _dealt(sized, weights, total, max_repeat, block, shard_docs, seed, ("text_key",))
    once_more = (2 * F.col("_to") - F.col("size") <= 2 * block * F.col("extra")).cast("int")
    times = F.when(F.col("size") > 0, F.col("passes").cast("int") + once_more).otherwise(F.lit(0))
    return d.select("doc_id", "source", "text_key", "size", "target", times.alias("times"))
