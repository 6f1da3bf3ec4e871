"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

#: A word before A-Z are lower-cased (which makes none longer or shorter): 0-9, A-Z, a-z and all beyond ASCII.
#: Two named classes, as six ranges take Java's matcher six times as long.
TERM = r"[\p{Alnum}\P{ASCII}]+"


def low(text: Column) -> Column:
    """A-Z lower-cased, other letters kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: Column) -> Column:
    """The words of a whole text as they stand, in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0))


def windows(benchmark: DataFrame, length: int = 10) -> DataFrame:
    """item_id, win, words: each run of `length` words; an item of fewer words, but not none, is one window."""
    b = benchmark.select(benchmark["item_id"].alias("item_id"), terms(low(benchmark["text"])).alias("_t")).filter(F.size("_t") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_t") - length + 1)))
    w = b.select("item_id", "_t", at.alias("_at")).select("item_id", F.slice("_t", F.col("_at"), length).alias("words"))
    return w.select("item_id", F.md5(F.concat_ws(" ", "words")).alias("win"), "words").distinct()


def listed_terms(wins: DataFrame, common: float = 0.05, least: int = 3) -> DataFrame:
    """term, tid: the terms whose postings are stored.

    Of a window these are its terms that few items have (at most `common` of them, or `least`); if it
    has none such, all its terms. Which terms are listed changes the work, not the matches. Terms are
    stored in lower case beyond ASCII too, as postings are: that lists more places, and matches() compares words.
    """
    placed = wins.select("item_id", "win", F.explode("words").alias("term")).withColumn("term", F.lower("term")).distinct()
    n = wins.select("item_id").distinct().count()
    rare = placed.groupBy("term").agg((F.countDistinct("item_id") <= max(least, int(common * n))).alias("rare"))
    placed = placed.select("win", "term").distinct().join(rare, "term")
    any_ = placed.groupBy("win").agg(F.max("rare").alias("any"))
    return placed.join(any_, "win").filter("rare or not any").select("term").distinct().withColumn("tid", F.xxhash64("term"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tid, doc_id, pos: where the vocabulary's terms stand in the documents.

    Each word is lower-cased by itself, as the vocabulary's are: in a text a letter's lower case may depend on its neighbours.
    """
    d = docs.select(docs["doc_id"].alias("doc_id"), F.posexplode(terms(docs["text"])).alias("pos", "term")).withColumn("term", F.lower("term"))
    return d.join(maybe_broadcast(vocabulary, vocabulary.count()), "term").select("tid", "doc_id", "pos")


def ranked(stored: DataFrame, wins: DataFrame, vocabulary: DataFrame, depth: int = 3) -> DataFrame:
    """win, words, lists array<struct<n, tid, off>>: each window's listed terms, the rarest by training occurrences first, `depth` at most.

    Occurrences are counted over all documents. A window with a listed term that never occurs can't
    occur and is left out. Ties: the lower tid; a term that a window has twice: its first place.
    """
    counted = vocabulary.join(stored.groupBy("tid").agg(F.count(F.lit(1)).alias("n")), "tid", "left")
    placed = wins.select("win", "words").distinct().select("win", "words", F.posexplode(F.transform("words", lambda w: F.lower(w))).alias("off", "term")).join(counted, "term")
    placed = placed.groupBy("win", "tid").agg(F.first(F.coalesce("n", F.lit(0))).alias("n"), F.min("off").alias("off"), F.first("words").alias("words"))
    best = placed.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("n", "tid", "off"))).alias("lists"), F.first("words").alias("words"))
    return best.filter(F.col("lists")[0]["n"] > 0).select("win", "words", F.slice("lists", 1, depth).alias("lists"))


def intersected(stored: DataFrame, index: DataFrame, length: int, slop: int) -> DataFrame:
    """doc_id, start, off, win: where the postings of all of a window's lists, less their offsets, agree.

    The rarest list gives the places, its other lists are asked for them in one join, and a place where all answer is
    left. With slop the lists' places need only lie within the window's length plus slop of the rarest term's.
    """
    found = stored.join(maybe_broadcast(index.select(F.col("lists")[0]["tid"].alias("tid"), F.col("lists")[0]["off"].alias("off"), "win"), index.count()), "tid")
    found = found.select("doc_id", (F.col("pos") - F.col("off")).alias("start"), "off", "win")
    found = cut(found if slop else found.filter("start >= 0"))
    more = index.filter(F.size("lists") > 1).select("win", F.expr("shiftleft(1, size(lists) - 1) - 1").alias("all"), F.posexplode(F.expr("slice(lists, 2, size(lists))")).alias("k", "l"))
    asked = found.join(maybe_broadcast(more, more.count()), "win")
    asked = asked.select(F.col("doc_id").alias("_doc"), "start", "off", "win", "all", F.expr("shiftleft(1, k)").alias("bit"), F.col("l.tid").alias("_tid"), (F.col("start") + F.col("l.off" if not slop else "off")).alias("_at"))
    here = (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    here &= F.col("pos") == F.col("_at") if not slop else F.abs(F.col("pos") - F.col("_at")) < length + slop
    answers = stored.join(maybe_broadcast(asked, 2 * found.count()), here).groupBy("doc_id", "start", "off", "win", "all").agg(F.bit_or("bit").alias("bits"))
    single = index.filter(F.size("lists") == 1).select("win")
    alone = found.join(maybe_broadcast(single, single.count()), "win", "left_semi")
    columns = ["doc_id", "start", "off", "win"]
    return answers.filter(F.col("bits") == F.col("all")).select(*columns).unionByName(alone.select(*columns))


def matches(docs: DataFrame, benchmark: DataFrame, length: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(found, wins). found: doc_id, text_key, hits array<struct<start, win, n, exact>> of documents with any.

    The postings of listed terms are stored in the shared folder. Those of each window's rarest terms, less their
    offsets, are intersected; where all agree, the words of the document are compared, as terms that most items have are
    not listed and lists know no case. exact: the words stand there in order. With slop > 0 also proximity matches: all words
    of the window within its length plus slop words around the rarest term, in any order (start is
    then where that span begins, n its length). text_key tells rows of one doc_id apart.
    """
    wins = cut(windows(benchmark, length))
    vocabulary = cut(listed_terms(wins))
    stored = cut(postings(docs, vocabulary))
    index = cut(ranked(stored, wins, vocabulary).withColumn("name", F.col("win")).withColumn("win", F.monotonically_increasing_id()))
    found = intersected(stored, index, length, slop).join(maybe_broadcast(index.select("win", "name", "words"), index.count()), "win").withColumn("win", F.col("name"))
    by_doc = cut(found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "off", "win", "words")).alias("_c")))
    near = by_doc.count()
    d = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text"))
    if near <= 200_000:  # else all documents are shuffled once
        d = d.join(F.broadcast(by_doc.select(F.col("doc_id").alias("_k"))), F.col("_id").eqNullSafe(F.col("_k")), "left_semi")
    d = d.join(by_doc, F.col("_id").eqNullSafe(F.col("doc_id")))
    # exploded so that the words are made once a document, not inside the functions over candidates
    d = d.select("doc_id", F.xxhash64("_text").alias("text_key"), F.explode(F.array(terms(F.col("_text")))).alias("_t"), "_c")

    def exact(c: Column) -> Column:
        return (c["start"] >= 0) & (low(F.array_join(F.slice(F.col("_t"), F.greatest(c["start"], F.lit(0)) + 1, F.size(c["words"])), " ")) == F.array_join(c["words"], " "))

    def around(c: Column) -> Column:
        left = F.greatest(c["start"] + c["off"] - F.size(c["words"]) - slop + 1, F.lit(0))
        return F.size(F.array_except(c["words"], F.transform(F.slice(F.col("_t"), left + 1, 2 * (F.size(c["words"]) + slop) - 1), low))) == 0

    kept = F.filter("_c", exact if not slop else lambda c: exact(c) | around(c))
    hits = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["win"].alias("win"), F.size(c["words"]).alias("n"), exact(c).alias("exact")))
    return d.select("doc_id", "text_key", hits.alias("hits")).filter(F.size("hits") > 0), wins


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated of every document; text_key: a hash of the text.

    A document word inside any occurrence of a benchmark window is hit. Null or empty texts have no
    words. Repeated rows give a row each; rows that share a doc_id are judged each by its own text.
    """
    found, wins = matches(docs, benchmark, length)
    found = cut(found.distinct())
    spans = F.flatten(F.transform(F.filter("hits", lambda h: h["exact"]), lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))
    hit = found.select("doc_id", "text_key", F.size(F.array_distinct(spans)).cast("long").alias("n_hit"))
    hit = hit.groupBy("doc_id", "text_key").agg(F.max("n_hit").alias("n_hit"))
    owners = wins.select("win", "item_id").distinct()
    items = found.select("doc_id", "text_key", F.explode(F.array_distinct(F.col("hits.win"))).alias("win")).join(maybe_broadcast(owners, wins.count()), "win")
    items = items.select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    sums = hit.join(items, hit["doc_id"].eqNullSafe(items["doc_id"]) & (hit["text_key"] == items["text_key"])).select(hit["doc_id"].alias("_id"), hit["text_key"].alias("_key"), "n_hit", "n_items", "items_sha256")
    sums = cut(sums)
    d = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(TERM)).cast("long").alias("n_words"))
    d = d.join(maybe_broadcast(sums, sums.count()), d["doc_id"].eqNullSafe(F.col("_id")) & (d["text_key"] == F.col("_key")), "left")
    zero = F.lit(0).cast("long")
    return d.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
