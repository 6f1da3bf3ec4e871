"""Document fingerprints by winnowing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, partitions

POS_BITS = 28
_MASK = (1 << POS_BITS) - 1
#: Each run of so many code points, at every code point (not between the halves of one that Java keeps in two).
RUN = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))"
COARSE = 256  # buckets of the first level, whose bounds stand in the plan


def _roll(h: str, few: str, n: int, f, step: int = 1, last=lambda x, i: x) -> list[Column]:
    """Steps that, from folds of `step` neighbours on, fold every n (a power of 2) neighbours of array h by f: neighbours of neighbours, four or eight at a time.

    What has too few neighbours folds those that it has; the last step cuts these off. `last` is done to each value and its place in that step.
    """
    if step == n:
        return [F.transform(h, last)]
    out, begun = [], step
    while step < n:
        ways = n // step if n // step in (2, 8) else 4
        apart = [j * step for j in range(1, ways)]
        step *= ways

        then = last if step == n else lambda x, i: x

        def fold(x: Column, i: Column) -> Column:
            return then(f(x, *[F.get(F.col(h), i + j) for j in apart]), i)

        each = F.transform(h, fold)
        alone = F.col(h) if step < n else F.transform(h, last)
        out.append(F.when(F.col(few), alone).otherwise(each if step < n else F.slice(each, F.lit(1), F.size(h) - n + begun)))
    return out


def _least(df: DataFrame, h: str, few: str, window: int) -> DataFrame:
    """Array h made the distinct least values of its windows, by place; the values differ and tell their places.

    The least of a window is at most the least of each whole block of half a window in it, one of which is beside the value's
    own block or is that block. Few values are: these may be selected. From one window to the next the least changes only where
    one of them enters or where one has left, so only those windows are looked at, each by folds of neighbours.
    """
    step, half = min(4, window // 2), window // 2
    fold, block, found = (fresh(df.columns, n) for n in ("_w", "_m", "_c"))
    df = df.withColumn(fold, F.transform(h, lambda x, i: F.least(x, *[F.get(F.col(h), i + j) for j in range(1, step)]) if step > 1 else x))

    def low(at: Column, n: int) -> Column:
        folds = [F.get(F.col(fold), at + j) for j in range(0, n, step)]
        return F.least(*folds) if len(folds) > 1 else folds[0]

    blocks = F.sequence(F.lit(0), F.greatest(F.floor(F.size(h) / half).cast("int") - 1, F.lit(0)))
    df = df.withColumn(block, F.transform(blocks, lambda b: low(b * half, half)))
    df = df.withColumn(block, F.transform(block, lambda x, b: F.greatest(x, F.get(F.col(block), b - 1), F.get(F.col(block), b + 1))))
    df = df.withColumn(found, F.filter(h, lambda x, i: x <= F.coalesce(F.get(F.col(block), F.shiftright(i, half.bit_length() - 1)), F.get(F.col(block), F.size(block) - 1))))
    at = F.concat(F.array(F.lit(0)), F.transform(found, lambda x: position(x).cast("int") - (window - 1)), F.transform(found, lambda x: position(x).cast("int") + 1))
    at = F.sort_array(F.filter(at, lambda a: (a >= 0) & (a <= F.size(h) - window)))
    one = F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.col(h))
    return df.withColumn(h, F.when(F.col(few), one).otherwise(F.array_distinct(F.transform(at, lambda a: low(a, window))))).drop(fold, block, found)


def winnow(df: DataFrame, text: str, out: str, k: int = 16, window: int = 32) -> DataFrame:
    """Add `out`: array<long>, the selected k-gram hashes with their positions, ascending by position.

    Grams are k consecutive code points, at every code point. Their hashes roll: from 8 code points on a hash of 2n
    is made of two of n. Each window of `window` consecutive grams gives its least hash, ties the rightmost, so
    that any run of k + window - 1 code points that two texts share, at whatever places, gives both a common hash. k and
    window are powers of 2. A value holds 36 bits of hash above 28 bits that fall with the position in code
    points (`hashes`, `positions`). Fewer than k code points: one gram of all; fewer than `window` grams: one
    window. Null or empty text: an empty array. Other columns stay as they are.
    """
    if k & (k - 1) or window & (window - 1):
        raise ValueError("k and window must be powers of 2")
    keep = df.columns
    h, few = fresh(keep, "_h"), fresh(keep, "_few")
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(h, F.when(F.char_length(t) >= k, F.transform(F.regexp_extract_all(t, F.lit(RUN % min(k, 8)), F.lit(1)), lambda x: F.xxhash64(x))).when(t != "", F.array(F.xxhash64(t))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn(few, F.char_length(t) < k)
    for each in _roll(h, few, k, F.xxhash64, min(k, 8), lambda x, i: x.bitwiseOR(F.lit(_MASK)) - i):
        df = df.withColumn(h, each)
    df = df.withColumn(few, F.size(h) < window)
    if window > 1:
        df = _least(df, h, few, window)
    return df.select(*keep, F.col(h).alias(out))


def hashes(fp: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, POS_BITS)))


def position(x: Column) -> Column:
    return F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK))


def positions(fp: Column) -> Column:
    return F.transform(fp, position)


def as_string(fp: Column) -> Column:
    """Each value in hexadecimal, in order, joined by spaces: the hash, and in the last 7 digits 0xfffffff less the position."""
    return F.concat_ws(" ", F.transform(fp, F.hex))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared distinct hashes over the sum of both counts; two empty fingerprints are alike (1)."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def _upto(fp: Column, n: Column, k: int, window: int) -> Column:
    """The part of a text's fingerprint that windows wholly within its first n code points select.

    Places that windows select never fall as windows go on, so it ends with the last such window's.
    """
    last = n - (k + window - 1)
    inside = F.filter(fp, lambda x: (position(x) >= last) & (position(x) < last + window))
    return F.when(last < 0, F.array().cast("array<long>")).otherwise(F.slice(fp, F.lit(1), F.coalesce(F.array_position(fp, F.array_min(inside)), F.lit(0)).cast("int")))


def _bounds(d: DataFrame, key: str, n: int, by: list[str]) -> DataFrame:
    """For each group: n - 1 values of key that deal its text into about equal parts; a long text counts as many."""
    each = d.select(*by, key, F.explode(F.sequence(F.lit(0), (F.col("_len") / 4096).cast("int"))))
    return each.groupBy(*by).agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [1.0], 10 * n).alias("_cuts"))


def _below(cuts: Column, key: Column) -> Column:
    return F.size(F.filter(cuts, lambda x: x < key))


def with_next(docs: DataFrame, bytes_each: int = 4 << 20) -> tuple[DataFrame, object]:
    """doc_id, text and `_b`, `_ghost`, `_key`: dealt so that the next document is in the same bucket; and the window.

    Buckets are ranges of doc_id with about equal text, in two levels: up to 256 bounds in the plan, and a broadcast
    row of up to 4096 more for each of those. The first document of a bucket also goes, as a ghost, to the bucket before
    it; that of the first bucket to the last. One exchange of the texts. Rows that share a doc_id are in one bucket.
    """
    n = partitions(docs, bytes_each)
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.coalesce(docs["doc_id"], F.lit(-(1 << 63))).alias("_key"))
    coarse = min(COARSE, n)
    narrow = d.select("_key", F.char_length("text").alias("_len"))
    first = F.array(*[F.lit(x) for x in sorted(set(_bounds(narrow, "_key", coarse, []).first()[0] or [0]))])
    fine = min(4096, -(-n // coarse))
    inner = cut(_bounds(narrow.withColumn("_g", _below(first, F.col("_key"))), "_key", fine, ["_g"]).withColumnRenamed("_g", "_g2"))
    d = d.withColumn("_g", _below(first, F.col("_key"))).join(F.broadcast(inner), F.col("_g") == F.col("_g2"), "left")
    within = _below(F.coalesce("_cuts", F.array().cast("array<long>")), F.col("_key")) if fine > 1 else F.lit(0)
    d = d.select("doc_id", "text", "_key", (F.col("_g") * fine + within).cast("int").alias("_home"))
    firsts = cut(d.groupBy(F.col("_home").alias("_h2")).agg(F.min("_key").alias("_first")))  # one row a bucket
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_h2").over(Window.orderBy("_h2")), F.max("_h2").over(Window.partitionBy())))
    d = d.join(F.broadcast(firsts), (F.col("_home") == F.col("_h2")) & (F.col("_key") == F.col("_first")), "left")
    own = F.struct(F.col("_home").alias("b"), F.lit(0).alias("ghost"))
    both = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_before").alias("b"), F.lit(1).alias("ghost"))))
    d = d.select("doc_id", "text", "_key", F.explode(both).alias("_e")).select("doc_id", "text", "_key", F.col("_e.b").alias("_b"), F.col("_e.ghost").alias("_ghost"))
    return d.repartition(partitions(docs), "_b"), Window.partitionBy("_b").orderBy("_ghost", "_key", "text")


def fingerprint(docs: DataFrame, k: int = 16, window: int = 32) -> DataFrame:
    """doc_id and fp of every document (see winnow)."""
    return winnow(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), "text", "fp", k, window).drop("text")


def edited_fingerprints(docs: DataFrame, k: int = 16, window: int = 32) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last half (rounded down, in code points) replaced by the first as many of
    the next document by doc_id (the last's next is the first; ties by text). Null text: empty. Null doc_id: first.

    Windows wholly within one of its two parts select what they select in the document that the part comes from; only
    those across the seam are looked at again.
    """
    span = k + window - 1
    d, order = with_next(docs)
    d = winnow(d, "text", "fp", k, window)
    d = d.select("doc_id", "_ghost", "text", "fp", F.lead("text").over(order).alias("_next"), F.lead("fp").over(order).alias("_next_fp")).filter("_ghost = 0")
    n = F.char_length("text")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("_m", n - F.floor(n / 2).cast("int"))
    d = d.withColumn("_tail", F.substring("_next", F.lit(1), n - F.col("_m")))
    d = d.withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.col("_m")), F.col("_tail"))).withColumn("_h", F.char_length("_tail"))
    d = d.withColumn("_from", F.greatest(F.col("_m") - span + 1, F.lit(0)))
    seam = F.substring("_edited", F.col("_from") + 1, F.col("_m") - F.col("_from") + F.least("_h", F.lit(span - 1)))
    alone = (F.char_length(seam) < span) & ((F.col("_m") >= span) | (F.col("_h") >= span))
    d = winnow(d.drop("text", "_next", "_tail").withColumn("_seam", F.when(alone, F.lit("")).otherwise(seam)), "_seam", "_sfp", k, window)
    parts = F.concat(
        _upto(F.col("fp"), F.col("_m"), k, window), F.transform("_sfp", lambda x: x - F.col("_from")),
        F.transform(_upto(F.col("_next_fp"), F.col("_h"), k, window), lambda x: x - F.col("_m")),
    )
    d = d.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fp", F.array_distinct(parts).alias("_efp"), hashes(F.col("fp")).alias("_hashes"), hashes(F.col("_next_fp")).alias("_next_hashes"))
    return d.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("_efp")).alias("edited_fingerprint"), likeness(F.col("_hashes"), hashes(F.col("_efp"))).alias("near_edited"), likeness(F.col("_hashes"), F.col("_next_hashes")).alias("near_next"))
