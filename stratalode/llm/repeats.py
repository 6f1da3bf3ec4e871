"""Which windows of a fixed length occur more than once in a corpus: rolling hashes, anchors and rounds of counting.

Documents are dealt into chunks once. Every round hashes what is still in question in each chunk,
counts the hashes by hash range, and tells each chunk which of its own are repeated. Only distinct
hashes of a chunk travel, so a text that millions of documents share is one record a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, partitions, trim

U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits; never 0 or the largest."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return np.clip(h, U64(1), TOP - U64(1), out=h)


def slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over every `width` neighbours, by doubling."""
    have = 1
    while have < width and len(a):
        step = min(have, width - have)
        a, have = f(a[: max(len(a) - step, 0)], a[step:]), have + step
    return a


class Units:
    """Units (bytes or words) of some documents side by side, each with a 64-bit value; off: where documents begin."""

    def __init__(self, values: np.ndarray, off: np.ndarray):
        self.n, self.off = len(values), off
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(values * powers(self.n)[0], dtype=U64, out=self.sums[1:])

    def grams(self, length: int) -> np.ndarray:
        if self.n < length:
            return np.zeros(0, U64)
        return mix((self.sums[length:] - self.sums[:-length]) * powers(self.n)[1][: self.n - length + 1])

    def whole(self, width: int) -> np.ndarray:
        """Of each start: whether a window fits into its document."""
        if self.n < width:
            return np.zeros(0, bool)
        ends = np.repeat(self.off[1:], np.diff(self.off))[: self.n - width + 1]
        return ends - np.arange(self.n - width + 1) >= width


def _split(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of bytes other than 0x20 and 0x09-0x0D."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, U64)
    up, down = powers(len(raw) + 1)
    np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def byte_batches(texts: list[bytes], size: int = 1 << 17) -> Iterator[tuple[int, int, Units, np.ndarray]]:
    """(first, end, units, raw): documents first..end side by side as byte units."""
    for i, j in _batches(texts, size):
        raw = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])])
        yield i, j, Units(_BYTES[raw], off), raw


def word_batches(texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int, Units, tuple]]:
    """The same with words as units; the last item is (joined bytes, word starts, word ends)."""
    for i, j in _batches(texts, size):
        joined = b" ".join(texts[i:j])
        raw = np.frombuffer(joined, np.uint8)
        starts, ends = _split(raw)
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[i:j]])])
        yield i, j, Units(word_hashes(raw, starts, ends), np.searchsorted(starts, edges)), (joined, starts, ends)


def _batches(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def member(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


def anchors(g: np.ndarray, alive: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """least: of each window the least of its `span` gram hashes; at: grams that are the least of a window in question.

    Windows of equal content have equal least hashes, so one can only be repeated if that hash is.
    """
    least = slide(g, span, np.minimum)
    if span == 1:
        return least, alive.copy()
    asked = np.zeros(len(least) + 2 * (span - 1), U64)
    asked[span - 1 : span - 1 + len(least)] = np.where(alive, least, U64(0))
    return least, slide(asked, span, np.maximum) == g


def survive(u: Units, width: int, lengths: list[int], repeated: list[np.ndarray]) -> np.ndarray:
    """Which window starts are in question after the rounds for `lengths`, given each round's repeated hashes."""
    alive = u.whole(width)
    for length, rep in zip(lengths, repeated):
        if not alive.any():
            break
        g, span = u.grams(length), width - length + 1
        least, at = anchors(g, alive, span)
        kept = np.full(len(g), TOP)
        where = np.flatnonzero(at)
        where = where[member(g[where], rep)]
        kept[where] = g[where]
        alive &= slide(kept, span, np.minimum) == least
    return alive


def ask(u: Units, width: int, length: int, alive: np.ndarray) -> np.ndarray:
    """The hashes of one round: of the anchors of the windows in question, one for each place."""
    if not alive.any():
        return np.zeros(0, U64)
    g = u.grams(length)
    return g[anchors(g, alive, width - length + 1)[1]]


KIND = "bucket int, chunk int, many boolean, hashes binary"
BACK = "chunk int, round int, hashes binary"


def spread(h: np.ndarray) -> np.ndarray:
    """Anchors' hashes are the least of many, so near 0; one to one, evenly over 64 bits."""
    return h * U64(_BASE)


def by_bucket(chunk: int, values: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct values of a chunk by bucket (the top bits of their spread), those with several places apart."""
    v, n = np.unique(values, return_counts=True)
    bucket = (spread(v) >> U64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    v, n, bucket = v[order], n[order], bucket[order]
    for many in (False, True):
        some, at = v[(n > 1) == many], bucket[(n > 1) == many]
        cuts = np.searchsorted(at, np.arange((1 << bits) + 1)).tolist()
        rows = [(b, s, e) for b, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int32()), pa.array([many] * len(rows)), pa.array([some[s:e].tobytes() for _, s, e in rows], pa.binary())], ["bucket", "chunk", "many", "hashes"])


def count(table: pa.Table, round_: int) -> pa.Table:
    """Tell each chunk which of its hashes have several places."""
    blobs = table.column("hashes").to_pylist()
    sizes = np.array([len(b) // 8 for b in blobs])
    v = np.frombuffer(b"".join(blobs), U64)
    chunk = np.repeat(np.array(table.column("chunk").to_pylist(), np.int32), sizes)
    many = np.repeat(np.array(table.column("many").to_pylist(), bool), sizes)
    order = np.argsort(v, kind="stable")
    v, chunk, many = v[order], chunk[order], many[order]
    first = np.concatenate([[True], v[1:] != v[:-1]])
    group = np.cumsum(first) - 1
    rep = (np.bincount(group) > 1) | (np.bincount(group, weights=many) > 0)
    keep = rep[group]
    v, chunk = v[keep], chunk[keep]
    order = np.argsort(chunk, kind="stable")
    v, chunk = v[order], chunk[order]
    names, at = np.unique(chunk, return_index=True)
    ends = [*at[1:].tolist(), len(v)]
    return pa.table([pa.array(names, pa.int32()), pa.array(np.full(len(names), round_), pa.int32()), pa.array([v[s:e].tobytes() for s, e in zip(at.tolist(), ends)], pa.binary())], ["chunk", "round", "hashes"])


def told(table: pa.Table | None, rounds: int) -> list[np.ndarray]:
    """The repeated hashes of each round, sorted, from the rows that came back for a chunk."""
    out: list[list[bytes]] = [[] for _ in range(rounds)]
    if table is not None:
        for r, b in zip(table.column("round").to_pylist(), table.column("hashes").to_pylist()):
            if r is not None and r < rounds:
                out[r].append(b)
    return [np.sort(np.frombuffer(b"".join(x), U64)) for x in out]


def texts_of(table: pa.Table) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else (x or b"") for x in table.column("text").to_pylist()]


class Rounds:
    """The plan: documents in chunks, and what has come back to each chunk so far."""

    def __init__(self, docs: DataFrame, width: int, batches: Callable, per_partition: int = 4):
        n = partitions(docs)
        self.n, self.width, self.batches = n, width, batches
        self.bits = buckets(docs, n)
        text = F.coalesce(docs["text"], F.lit("")).cast("binary")
        d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
        d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(per_partition * n)).cast("int"))
        self.docs = d.repartition(n, "chunk")
        self.lengths: list[int] = []
        self.back: DataFrame | None = None

    def run(self, length: int) -> None:
        """One round of counting at one length."""
        width, bits, batches, lengths = self.width, self.bits, self.batches, list(self.lengths)

        def asked(key, table, back=None):
            rep = told(back, len(lengths))
            found = [ask(u, width, length, survive(u, width, lengths, rep)) for _, _, u, _ in batches(texts_of(table))]
            trim()
            if found:
                yield from by_bucket(key[0].as_py(), np.concatenate(found), bits)

        if self.back is None:
            q = self.docs.groupBy("chunk").applyInArrow(lambda key, t: pa.Table.from_batches(list(asked(key, t)), schema=ASKED), KIND)
        else:
            q = self.docs.groupBy("chunk").cogroup(self.back.groupBy("chunk")).applyInArrow(lambda key, t, b: pa.Table.from_batches(list(asked(key, t, b)), schema=ASKED), KIND)
        r = len(lengths)
        got = q.groupBy("bucket").applyInArrow(lambda t: count(t, r), BACK)
        self.back = got if self.back is None else self.back.unionByName(got)
        self.lengths.append(length)

    def finish(self, f: Callable, kind: str) -> DataFrame:
        """f(key, documents of a chunk, what came back) for every chunk."""
        return self.docs.groupBy("chunk").cogroup(self.back.groupBy("chunk")).applyInArrow(f, kind)


ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("many", pa.bool_()), ("hashes", pa.binary())])
