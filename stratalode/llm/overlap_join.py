"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists of word shingles.

Documents with one set of shingles are one class; classes are joined. Two sets of sizes a <= b that link
differ in at most (a + b)(1 - t)/(1 + t) shingles. Shingles are dealt by hash into more parts than that,
so linked sets agree wholly on a part; sets that agree on none are never compared. Bitmaps of a few bits a
shingle then rule out pairs that differ in too many. Of the sets that are left the inverted lists are searched:
short lists are merged, long ones probed by binary search, and sets that reach the overlap required by their
sizes are links. Only these sets' shingles travel.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, maybe_broadcast, partitions, sliced, trim
from .repeats import U64, mix, word_batches

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Measure:
    """Exact integer arithmetic of a Jaccard bound of `num` in `den`."""

    def __init__(self, num: int = 90, den: int = 100, first: int = 1):
        g = math.gcd(num, den)
        self.num, self.den = num // g, den // g
        # sizes in one range link only with their own range or the next
        self.low = [first]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def need(self, a, b):
        """Least overlap of sets of sizes a and b that link."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """(range, parts, spare) for a set of n: as the smaller set of a pair, and as the larger.

        Linked sets differ in at most d shingles, so of d + 1 + spare parts they agree on spare + 1 at least.
        """
        i = int(np.searchsorted(self.low, n, "right")) - 1
        out = []
        for k in (i, i - 1):
            if k >= 0 and (d := self.differ(self.low[k + 1] - 1, self.low[k + 2] - 1)) > 0:
                spare = 1 + math.ceil(2 * d * math.exp(-self.low[k] / d))
                out.append((k, d + 1 + spare, spare))
        return out


def shingle_sets(texts: list[bytes], words: int):
    """Yield the sorted distinct 64-bit hashes of each text's shingles; fewer words: the whole sequence as one."""
    for _, _, u, _ in word_batches([t.translate(LOWER) for t in texts]):
        grams = u.grams(words)
        off = u.off.tolist()
        for s, e in zip(off, off[1:]):
            if e - s >= words:
                yield np.unique(grams[s : e - words + 1])
            elif e > s:
                yield mix((u.sums[e : e + 1] - u.sums[s : s + 1]) * U64(pow(_inverse(), s, 1 << 64)) + U64(e - s))
            else:
                yield np.zeros(0, U64)


def _inverse() -> int:
    from .repeats import _BASE

    return pow(_BASE, -1, 1 << 64)


def set_key(h: np.ndarray) -> int:
    """A 64-bit name of a set."""
    both = mix(np.array([mix(h * U64(0xC2B2AE3D27D4EB4F)).sum(dtype=U64) + U64(len(h))], U64))
    return int(both.view(np.int64)[0])


def signatures(h: np.ndarray, measure: Measure) -> np.ndarray:
    """Hashes of the parts of a set that are not empty.

    If no more than `spare` parts are empty, one part on which a linked set agrees is not. A set
    with more empty parts also gives the least of its hashes, as many as must meet any linked set's
    (a prefix filter); two such sets find each other by those. Nothing is lost either way.
    """
    out, sparse = [], False
    spread = mix(h ^ U64(0x165667B19E3779F9))
    for k, parts, spare in measure.schemes(len(h)):
        part = (h % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(spread[order], dtype=U64)])
        at = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(at))
        sparse |= parts - len(full) > spare
        out.append(mix((sums[at[full + 1]] - sums[at[full]]) + mix(full.astype(U64) * U64(1_000_003) + U64(k + 1))))
    if sparse:
        out.append(mix(h[: len(h) - int(-(-measure.num * len(h) // measure.den)) + 1] + U64(0x27D4EB2F165667C5)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def _encoded(column) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


SIGS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])


def pack(sigs: list[np.ndarray], keys: list[int], bits: int) -> list[tuple[int, bytes]]:
    """Signatures of some sets by bucket, their top bits: keys, counts, and 40 more bits of each signature.

    A signature only proposes what the search then decides, so 40 bits beside the bucket's do, and a
    set's key stands once for all its signatures in a bucket.
    """
    s, owner = np.concatenate(sigs), np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
    bucket = (s >> U64(64 - bits)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    s, owner, bucket = s[order], owner[order], bucket[order]
    five = np.ascontiguousarray((s << U64(bits)) >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
    named, out = np.array(keys, np.int64), []
    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1)).tolist()
    for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
        if y > x:
            who, n = np.unique(owner[x:y], return_counts=True)
            out.append((b, np.array([len(who)], "<i8").tobytes() + named[who].tobytes() + n.astype("<u4").tobytes() + five[x:y].tobytes()))
    return out


def unpack(blobs: list[bytes]) -> np.ndarray:
    """Rows (signature, key)."""
    out = []
    for b in blobs:
        n = int(np.frombuffer(b, "<i8", 1)[0])
        keys, counts = np.frombuffer(b, "<i8", n, 8), np.frombuffer(b, "<u4", n, 8 + 8 * n)
        sigs = np.zeros((int(counts.sum()), 8), np.uint8)
        sigs[:, :5] = np.frombuffer(b, np.uint8, 5 * len(sigs), 8 + 12 * n).reshape(-1, 5)
        out.append(np.stack([sigs.view("<i8").ravel(), np.repeat(keys, counts)], axis=1))
    return np.concatenate(out)


GROUPS = pa.schema([("gid", pa.int64()), ("key", pa.int64()), ("leader", pa.int64())])


def six(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, in order: enough to tell the shingles of two sets apart."""
    return np.ascontiguousarray((h >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def groups_of(table: pa.Table) -> pa.Table:
    """Of each signature that several sets have: the sets, under a name of that list, and the first of them."""
    pairs = unpack(table.column("packed").to_pylist())
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
    first = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(pairs)))
    at, size = at[size > 1], size[size > 1]
    if not len(at):
        return GROUPS.empty_table()
    take = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    keys, leader = pairs[take, 1], np.repeat(pairs[at, 1], size)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    gid = np.repeat(mix(np.add.reduceat(mix(keys.view(U64) * U64(0x9FB21C651E98DF25)), start) + size.astype(U64)).view(np.int64), size)
    order = np.lexsort((keys, gid))
    gid, keys, leader = gid[order], keys[order], leader[order]
    new = np.concatenate([[True], (gid[1:] != gid[:-1]) | (keys[1:] != keys[:-1])])
    out = pa.table([pa.array(x[new]) for x in (gid, keys, leader)], schema=GROUPS)
    del pairs, first, take, keys, leader, gid, order, new
    trim()
    return out


class Lists:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.terms, self.at = np.unique(flat[order], return_index=True)
        self.end = np.append(self.at[1:], len(flat))
        self.size = np.array([len(s) for s in sets])

    def search(self, query: np.ndarray, measure: Measure) -> np.ndarray:
        """Numbers of the sets that link with the query: T-occurrence by DivideSkip."""
        a = len(query)
        least = -(-measure.num * a // measure.den)
        need = int(measure.need(a, least))
        i = np.searchsorted(self.terms, query)
        i[i == len(self.terms)] = 0
        has = self.terms[i] == query
        i, terms = i[has], query[has]
        if len(i) < need:
            return np.zeros(0, np.int64)
        length = self.end[i] - self.at[i]
        order = np.argsort(length, kind="stable")
        i, terms = i[order], terms[order]
        n_long = min(need - 1, int(need / (0.0085 * math.log2(length.max() + 1) + 1)))
        n_short = len(i) - n_long
        parts = [self.owner[s:e] for s, e in zip(self.at[i[:n_short]].tolist(), self.end[i[:n_short]].tolist())]
        found, times = self._merge(parts)
        keep = times >= max(1, need - n_long)
        found, times = found[keep], times[keep].copy()
        if n_long and len(found):
            if len(found) <= n_long:  # few candidates: the long lists' terms are looked up in each
                times += np.array([np.count_nonzero(_in(terms[n_short:], self.sets[f])) for f in found.tolist()])
            else:
                left = n_long
                for j in i[n_short:].tolist():
                    times += _in(found, self.owner[self.at[j] : self.end[j]])
                    left -= 1
                    fit = times + left >= need
                    if not fit.all():
                        found, times = found[fit], times[fit]
        size = self.size[found]
        return found[(times >= measure.need(a, size))]

    def _merge(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        total = sum(map(len, parts))
        if total <= 256:  # a heap; beyond, one counting pass does the same merge
            found: list[int] = []
            times: list[int] = []
            for x in heapq.merge(*[p.tolist() for p in parts]):
                if found and found[-1] == x:
                    times[-1] += 1
                else:
                    found.append(x)
                    times.append(1)
            return np.array(found, np.int64), np.array(times, np.int64)
        n = np.bincount(np.concatenate(parts), minlength=len(self.sets))
        at = np.flatnonzero(n)
        return at, n[at]


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def searched(table: pa.Table, measure: Measure) -> pa.Table:
    """Links of each block: of every query set to the listed sets of another component."""
    block = np.array(table.column("block").to_pylist(), np.int64)
    asks, listed = (np.array(table.column(c).to_pylist(), bool) for c in ("asks", "listed"))
    key, comp = (np.array(table.column(c).to_pylist(), np.int64) for c in ("key", "comp"))
    blobs = table.column("shingles")
    out_a, out_b = [], []
    order = np.lexsort((asks, key, block))
    order = order[np.concatenate([[True], np.diff(block[order]) != 0]) | np.concatenate([[True], np.diff(key[order]) != 0])]  # a set once a block
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for rows in np.split(order, cuts):
        some, query = rows[listed[rows]], rows[asks[rows]]
        if not len(some) or not len(query) or len(np.unique(comp[rows])) < 2:
            continue
        lists = Lists([from_six(blobs[int(r)].as_py()) for r in some])
        for q in query.tolist():
            hit = some[lists.search(from_six(blobs[q].as_py()), measure)]
            hit = hit[comp[hit] != comp[q]]
            if len(hit):  # one link to each component
                hit = hit[np.unique(comp[hit], return_index=True)[1]]
                out_a += [int(key[q])] * len(hit)
                out_b += key[hit].tolist()
    trim()
    return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=LINKS)


def parity(h: np.ndarray, measure: Measure) -> bytes:
    """A bitmap of a set: a bit is on if an odd number of its hashes fall on it; at least 4 bits for each shingle that a linked set may lack or add.

    Two sets' bitmaps differ in no more bits than the sets in shingles, so a pair that differs in more can't link.
    Halves laid over one another by XOR give the bitmap of half the length.
    """
    i = int(np.searchsorted(measure.low, len(h), "right")) - 1
    d = measure.differ(measure.low[i + 1] - 1, measure.low[i + 2] - 1)
    m = 1 << max(6, (4 * d - 1).bit_length())
    odd = np.bincount(((h >> U64(16)) & U64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each, 64 bits a column) at a length of `words` columns."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _may_link(maps_a: np.ndarray, n_a, maps_b: np.ndarray, n_b, measure: Measure) -> np.ndarray:
    """Of pairs: whether sizes and bitmaps (last axis: 64 bits a column) allow a link."""
    least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    apart = np.bitwise_count(maps_a ^ maps_b).sum(axis=-1, dtype=np.int64)
    return (measure.num * most <= measure.den * least) & (apart <= (n_a + n_b) * (measure.den - measure.num) // (measure.den + measure.num))


def that_may_link(batches, measure: Measure):
    """Rows (leader, key, n, n2, bits, bits2) that may link, as (leader, key)."""
    for b in sliced(batches, 20_000):
        n, n2 = (np.array(b.column(c).to_pylist(), np.int64) for c in ("n", "n2"))
        bits, bits2 = b.column("bits").to_pylist(), b.column("bits2").to_pylist()
        length = np.array([len(x) for x in bits], np.int64) * (1 << 32) + np.array([len(x) for x in bits2], np.int64)
        keep = np.zeros(b.num_rows, bool)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            one, two = (np.frombuffer(b"".join([side[i] for i in at.tolist()]), "<u8").reshape(len(at), -1) for side in (bits, bits2))
            words = min(one.shape[1], two.shape[1])
            keep[at] = _may_link(fold(one, words), n[at], fold(two, words), n2[at], measure)
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("leader", "key")], ["leader", "key"])


LEFT = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("comp", pa.int64())])


def still_open(table: pa.Table, measure: Measure) -> pa.Table:
    """Of each block of a list: the sets that may link with a set of another component, under a name of those sets."""
    block, key, comp, n = (np.array(table.column(c).to_pylist(), np.int64) for c in ("block", "key", "comp", "n"))
    bits = table.column("bits").to_pylist()
    out = [np.zeros((0, 3), np.int64)]
    order = np.lexsort((key, block))
    for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        if len(rows) < 2 or len(np.unique(comp[rows])) < 2:
            continue
        length = np.array([len(bits[i]) for i in rows.tolist()])
        near = np.zeros(len(rows), bool)
        for x in np.unique(length).tolist():  # a set against those whose bitmaps are as long or longer
            mine = np.flatnonzero(length == x)
            for y in np.unique(length[length >= x]).tolist():
                theirs = np.flatnonzero(length == y)
                maps, other = (np.frombuffer(b"".join([bits[rows[i]] for i in some.tolist()]), "<u8").reshape(len(some), -1) for some in (mine, theirs))
                other = fold(other, x // 8)
                step = max(1, (1 << 17) // other.size)
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    fit = _may_link(maps[at : at + step, None], n[rows[some]][:, None], other[None], n[rows[theirs]][None], measure)
                    fit &= comp[rows[some]][:, None] != comp[rows[theirs]][None]
                    near[some] |= fit.any(axis=1)
                    near[theirs] |= fit.any(axis=0)
        rows = rows[near]
        if len(rows):
            name = mix(np.array([mix(key[rows].view(U64) * U64(0x9FB21C651E98DF25)).sum(dtype=U64) + U64(len(rows))], U64)).view(np.int64)[0]
            out.append(np.stack([np.full(len(rows), name), key[rows], comp[rows]], axis=1))
    got = np.concatenate(out)
    trim()
    return pa.table([pa.array(np.ascontiguousarray(got[:, i])) for i in range(3)], schema=LEFT)


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """key, comp: the least key reachable by links (a, b).

    Each round every vertex goes to the least one next to it, and on to where that goes; links then join what
    they have become, each once, and links within one are gone. So there are fewer vertices and links every round.
    """
    edge = links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).filter("x <> y").distinct()
    label, edge = nodes.select("key", F.col("key").alias("comp")), cut(edge)
    for _ in range(max_rounds):
        if edge.isEmpty():
            return label
        ends = edge.select(F.col("y").alias("v"), "x").union(edge.select(F.col("x").alias("v"), "x"))
        to = ends.groupBy("v").agg(F.min("x").alias("to"))
        hop = to.select(F.col("v").alias("to"), F.col("to").alias("then"))
        to = cut(to.join(hop, "to").select("v", F.col("then").alias("root")))
        label = cut(label.join(to.select(F.col("v").alias("comp"), "root"), "comp", "left").select("key", F.coalesce("root", "comp").alias("comp")))
        edge = edge.join(to.select(F.col("v").alias("x"), F.col("root").alias("x2")), "x").join(to.select(F.col("v").alias("y"), F.col("root").alias("y2")), "y")
        edge = cut(edge.select(F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y")).filter("x <> y").distinct())
    raise RuntimeError("components did not settle")


def join(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, block_sets: int = 512, list_sets: int = 2048) -> DataFrame:
    """doc_id, text_key, n_shingles, key, component_id, first: classes of documents that links (Jaccard >= num/den) connect.

    component_id is the least doc_id reachable; first: whether the row has the least doc_id and then text_key (a hash
    of the text) of all that it reaches, or no words. Words are lower-cased (A-Z); a set is the distinct
    shingles of `words` words, or the whole sequence if there are fewer. Null, empty or blank texts have
    an empty set and link with nothing. A row without doc_id links like any other and has the component_id of what it
    reaches, null if that has no doc_id. Rows that share a doc_id are documents of their own.

    Equal sets are one class at once, however many documents have them, and only one of them goes on. Each
    list of sets that share a part is searched from its first set. Lists that then still hold several components lose
    the sets whose bitmaps rule out every other component's; what is left of them is searched whole. Lists of more
    than `list_sets` sets are compared block by block. No list or set of candidates is capped.
    """
    measure, n = Measure(num, den), partitions(docs)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))

    def name(batches):
        for b in sliced(batches):
            sets = list(shingle_sets(_encoded(b.column(1)), words))
            bits = [parity(h, measure) if len(h) else b"" for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(h) for h in sets], pa.int64()), pa.array([set_key(h) for h in sets], pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "text_key", "n_shingles", "key", "bits"])
        trim()

    named = cut(d.withColumn("text_key", F.xxhash64("text")).mapInArrow(name, "doc_id long, text_key long, n_shingles long, key long, bits binary"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = named.filter("n_shingles > 0").groupBy("key").agg(F.min(row).alias("least"), F.first("doc_id").alias("rep"), F.first("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    bits = buckets(docs, n)

    def sign(batches):
        seen: set[int] = set()
        for b in sliced(batches):
            keys, sigs = [], []
            for h in shingle_sets(_encoded(b.column(1)), words):
                if len(h) and (k := set_key(h)) not in seen:
                    seen.add(k)
                    if len(s := signatures(h, measure)):
                        keys.append(k)
                        sigs.append(s)
            if sigs:
                rows = pack(sigs, keys, bits)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=SIGS)
        trim()

    signed = d.mapInArrow(sign, "bucket int, packed binary")
    groups = cut(signed.groupBy("bucket").applyInArrow(groups_of, "gid long, key long, leader long").distinct())
    nodes = cut(groups.select("key").distinct().join(classes, "key"))
    size = nodes.select("key", "n", "bits")

    def spell(batches):
        for b in sliced(batches):
            sets = list(shingle_sets(_encoded(b.column(1)), words))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in sets], pa.int64()), pa.array([six(h) for h in sets], pa.binary())], ["key", "shingles"])
        trim()

    def search(rows: DataFrame) -> DataFrame:
        """rows: block, key, comp, asks, listed. The sets are spelled again from the texts, only those that are asked for."""
        rows = cut(rows)
        wanted = cut(rows.select("key").distinct().join(nodes, "key").select("rep", "text_key"))
        same = d["doc_id"].eqNullSafe(F.col("rep")) & (F.xxhash64(d["text"]) == F.col("text_key"))
        texts = d.join(maybe_broadcast(wanted, wanted.count()), same, "left_semi")
        full = texts.mapInArrow(spell, "key long, shingles binary").join(maybe_broadcast(rows, rows.count()), "key")
        full = full.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(8 * n)))
        return full.groupBy("bucket").applyInArrow(lambda t: searched(t, measure), "a long, b long")

    # from the first set of each list, to the others that may link with it, in blocks
    star = groups.filter("key <> leader").select("leader", "key").distinct()
    star = star.join(size, "key").join(size.select(F.col("key").alias("leader"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "leader")
    star = cut(star.mapInArrow(lambda batches: that_may_link(batches, measure), "leader long, key long"))
    salts = star.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("salts"))
    star = star.join(salts, "leader").withColumn("block", F.xxhash64("leader", F.pmod(F.xxhash64("key"), F.col("salts"))))
    star = cut(star.select("block", "leader", "key"))
    no, yes = F.lit(False), F.lit(True)
    members = star.select("block", "key", F.col("key").alias("comp"), no.alias("asks"), yes.alias("listed"))
    firsts = star.select("block", F.col("leader").alias("key")).distinct().select("block", "key", F.col("key").alias("comp"), yes.alias("asks"), no.alias("listed"))
    links = cut(search(members.unionByName(firsts)))
    label = components(nodes, links)

    # lists that still hold several components, without their first set; a large one is dealt into blocks that meet one another
    open_ = groups.filter("key <> leader").join(label, "key")
    held = open_.groupBy("gid").agg((F.min("comp") < F.max("comp")).alias("open"), F.count(F.lit(1)).alias("sets")).filter("open").select("gid", "sets")
    open_ = open_.join(held, "gid").join(size, "key")
    weight = open_.groupBy("gid").agg(F.greatest(F.ceil(F.count(F.lit(1)) / list_sets), F.ceil(F.sum("n") / (8 << 20))).cast("int").alias("salts"))
    open_ = open_.select("gid", "key", "comp", "n", "bits").join(weight, "gid").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.col("salts")))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    open_ = open_.select(F.xxhash64("gid", F.least("salt", "other"), F.greatest("salt", "other")).alias("block"), "key", "comp", "n", "bits")
    open_ = open_.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(8 * n)))
    left = cut(open_.groupBy("bucket").applyInArrow(lambda t: still_open(t, measure), "block long, key long, comp long").distinct())
    # lists of the same sets overlap: those that hang together are searched as one block where that is no larger than a list's may be
    first = left.groupBy("block").agg(F.min("key").alias("b"))
    family = components(left.select("key").distinct(), left.join(first, "block").select(F.col("key").alias("a"), "b")).withColumnRenamed("comp", "family")
    family = family.join(size.select("key", "n"), "key")
    sums = family.groupBy("family").agg(((F.count(F.lit(1)) <= list_sets) & (F.sum("n") <= 8 << 20)).alias("small"))
    left = left.join(family.join(sums, "family").select("key", "family", "small"), "key")
    left = left.select(F.when(F.col("small"), F.col("family")).otherwise(F.col("block")).alias("block"), "key", "comp").distinct()
    more = cut(search(left.select("block", "key", "comp", yes.alias("asks"), yes.alias("listed"))))
    label = components(nodes, links.unionByName(more))

    classes = classes.select("key", "least").join(label, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = classes.groupBy("comp").agg(F.min("least").alias("first"))
    of_key = classes.join(least, "comp").select(F.col("key").alias("_key"), "first")
    out = named.join(of_key, (F.col("key") == F.col("_key")) & (F.col("n_shingles") > 0), "left")
    first = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    return out.select("doc_id", "text_key", "n_shingles", "key", F.coalesce("first.doc_id", "doc_id").alias("component_id"), first.alias("first"))
