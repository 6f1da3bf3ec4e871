"""Suffix-array dedup: a distributed merge sort of suffixes that knows common prefixes.

Suffixes are sorted at anchors only. An anchor is the place of the least hash among the grams of a
window, so equal windows have it at the same offset; a window is then what stands left of the anchor
and a prefix of the suffix that begins there. Rounds of counting (see repeats) first leave out windows
whose anchor gram occurs once; they cannot be repeated. The anchors that are left are sorted in each
chunk of documents, front-coded runs (length of the prefix shared with the suffix before, rest) are
exchanged by ranges of the gram's hash, which leads the sort key, and a loser tree merges the runs of a
range. Equal windows are then found among neighbours by bytes, not by hashes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trim
from .repeats import U64, Rounds, Units, byte_batches, member, slide, spread, survive, texts_of, told
from .substrings import covered

LEAD = 8  # bytes of the gram's hash before each suffix


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: list):
    """Yield (length shared with the one before, suffix, run, index in run) in order, from sorted runs.

    Each run is an iterator of (shared with the run's one before, suffix). A loser tree: whoever lost
    at a node keeps the length that it shares with the winner there. Of two players the one that
    shares more with the last output is the lesser, without a look at the bytes; only on a tie are bytes
    compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = [iter(r) for r in runs]
    text: list = [None] * k  # None: the run is at its end
    lcp, at = [0] * k, [-1] * k

    def step(r: int) -> None:
        got = next(runs[r], None)
        if got is None:
            text[r] = None
        else:
            lcp[r], text[r] = got
            at[r] += 1

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = lcp[a], lcp[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        h = shared(x, y, p)
        if (len(x) == h) if h == len(x) or h == len(y) else x[h] < y[h]:
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    for r in range(len(runs)):
        step(r)
        lcp[r] = 0
    losers, winners = [0] * k, [0] * (2 * k)
    for r in range(k):
        winners[k + r] = r
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    best = winners[1] if k > 1 else 0
    while text[best] is not None:
        yield lcp[best], text[best], best, at[best]
        step(best)
        i = (k + best) // 2
        while i:
            best, losers[i] = play(best, losers[i])
            i //= 2


def blocks(u: Units, raw: np.ndarray, width: int, gram: int, alive: np.ndarray):
    """Yield (first start, last start, anchor, key, left): runs of windows in question with one anchor.

    key: the gram's hash, spread, and the bytes from the anchor to the end of the last window; left: the bytes
    before the anchor from the first start on, backwards.
    """
    g = u.grams(gram)
    least = slide(g, width - gram + 1, np.minimum)
    p = np.flatnonzero(alive)
    # the anchor of p is the first place from p on with the least hash
    values = np.unique(least[p])
    at = np.flatnonzero(member(g, values)) if len(values) < len(g) // 64 else np.arange(len(g))
    at = at[member(g[at], values)]
    rank = np.searchsorted(values, g[at]).astype(np.int64) * (u.n + 1)
    composite = np.sort(rank + at)
    asked = np.searchsorted(values, least[p]).astype(np.int64) * (u.n + 1) + p
    q = composite[np.searchsorted(composite, asked)] % (u.n + 1)
    cut = np.flatnonzero((np.diff(q) != 0) | (np.diff(p) != 1)) + 1
    first, last = p[np.concatenate([[0], cut])], p[np.concatenate([cut - 1, [len(p) - 1]])]
    q = q[np.concatenate([[0], cut])]
    data = raw.tobytes()
    for s, e, a, h in zip(first.tolist(), last.tolist(), q.tolist(), spread(g[q]).tolist()):
        yield s, e, a, h.to_bytes(8, "big") + data[a : e + width], data[s:a][::-1]


def pack(run: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (key, left, number, many), front-coded."""
    before, lcps, tails = b"", [], []
    for key, _, _, _ in run:
        h = shared(before, key)
        lcps.append(h)
        tails.append(key[h:])
        before = key
    n = len(run)
    heads = [np.array(lcps, "<u2"), np.array([len(t) for t in tails], "<u2"), np.array([len(x[1]) for x in run], "<u2"), np.array([x[2] for x in run], "<u4"), np.array([x[3] for x in run], "u1")]
    return struct.pack("<q", n) + b"".join(h.tobytes() for h in heads) + b"".join(tails) + b"".join(x[1] for x in run)


def unpack(blob: bytes):
    """(iterator of (shared, key), lefts, numbers, many) of a packed run."""
    n = struct.unpack_from("<q", blob)[0]
    at, cols = 8, []
    for kind in ("<u2", "<u2", "<u2", "<u4", "u1"):
        cols.append(np.frombuffer(blob, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    lcps, tails, lefts, numbers, many = cols

    def keys(at=at):
        before = b""
        for h, t in zip(lcps, tails):
            before = before[:h] + blob[at : at + t]
            at += t
            yield h, before

    at += sum(tails)
    held = []
    for x in lefts:
        held.append(blob[at : at + x])
        at += x
    return keys(), held, numbers, many


RUN = "bucket int, chunk int, run binary"
RUN_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("run", pa.binary())])
MARKS = "chunk int, round int, hashes binary"


def marks(table: pa.Table, width: int, gram: int, round_: int) -> pa.Table:
    """Merge the runs of a range and tell each chunk which windows of its blocks are repeated."""
    span = width - gram + 1
    chunks = table.column("chunk").to_pylist()
    runs = [unpack(b) for b in table.column("run").to_pylist()]
    lcps, lefts, low, high, many, owners, same = [], [], [], [], [], [], {}
    deep, last = 0, -1  # deep: the least length shared since the last block that was kept
    for h, key, r, i in merge([x[0] for x in runs]):
        _, held, numbers, several = runs[r]
        left = held[i]
        deep = h if last < 0 else min(deep, h)
        if h < len(key) or last < 0:
            same = {}
        if (k := same.get(left)) is not None and k[1] == len(key):  # the same block in another chunk
            many[k[0]] = True
            owners[k[0]].append((r, numbers[i]))
            continue
        last = len(lcps)
        same[left] = (last, len(key))
        lcps.append(deep)
        deep = 1 << 30
        lefts.append(left)
        low.append(width + LEAD - len(key))
        high.append(len(left))
        many.append(bool(several[i]))
        owners.append([(r, numbers[i])])
    m = len(lcps)
    lcp, low, high, many = np.array(lcps, np.int64), np.array(low), np.array(high), np.array(many, bool)
    flags = np.zeros((m, span), bool)
    flags |= many[:, None] & (np.arange(span) >= low[:, None]) & (np.arange(span) <= high[:, None])
    near = np.zeros(m, bool)  # shares the gram with a neighbour; others have no equal
    if m > 1:
        near[1:] = lcp[1:] >= LEAD + gram
        near[:-1] |= lcp[1:] >= LEAD + gram
    todo = np.flatnonzero(near)
    if len(todo):
        # common prefix of neighbours in todo: between two of them stands nobody or someone who breaks the group
        t_lcp = lcp[todo].copy()
        t_lcp[np.concatenate([[True], np.diff(todo) != 1])] = 0
        order = sorted(range(len(todo)), key=lambda i: lefts[todo[i]])
        back = np.zeros(len(todo), np.int64)
        for i, (a, b) in enumerate(zip(order, order[1:]), 1):
            back[i] = shared(lefts[todo[a]], lefts[todo[b]])
        place = np.empty(len(todo), np.int64)
        place[order] = np.arange(len(todo))
        lo, hi = low[todo], high[todo]
        for o in range(int(lo.min()), int(hi.max()) + 1):
            on = np.flatnonzero((lo <= o) & (hi >= o))
            if len(on) < 2:
                continue
            key = np.cumsum(t_lcp < LEAD + width - o)[on] * (len(todo) + 1) + np.cumsum(back < o)[place[on]]
            s = np.sort(key)
            double = s[1:][s[1:] == s[:-1]]
            if len(double):
                flags[todo[on[member(key, double)]], o] = True
    out: dict[int, list[bytes]] = {}
    bits = np.packbits(flags, axis=1)
    for i in np.flatnonzero(flags.any(axis=1)).tolist():
        b = bits[i].tobytes()
        for r, number in owners[i]:
            out.setdefault(chunks[r], []).append(struct.pack("<I", number) + b)
    trim()
    return pa.table([pa.array(list(out), pa.int32()), pa.array([round_] * len(out), pa.int32()), pa.array([b"".join(v) for v in out.values()], pa.binary())], ["chunk", "round", "hashes"])


def in_order(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a chunk by id, then text: a shuffle may bring the rows to each stage in another order, and blocks are numbered as they come."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), texts_of(table)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def numbered(chunk_texts: list[bytes], width: int, grams: list[int], rep: list[np.ndarray]):
    """Yield (first document, units, raw, starts in question, blocks with their numbers); equal blocks have one number."""
    known: dict[tuple[bytes, bytes], list] = {}
    for i, j, u, raw in byte_batches(chunk_texts):
        alive = survive(u, width, grams, rep)
        found = []
        if alive.any():
            for s, e, a, key, left in blocks(u, raw, width, grams[0], alive):
                k = known.setdefault((key, left), [len(known), 0])
                k[1] += 1
                found.append((s, e, a, k[0]))
        yield i, u, raw, found, known


def repeated_bytes(docs: DataFrame, width: int = 200, gram: int = 48, long_gram: int = 120, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes) of every document.

    Each byte covered by a string of `width` bytes that also starts anywhere else, in this or another
    document, is removed; overlaps count. n_spans: maximal removed runs. Null text: empty. Repeated rows
    are documents of their own, and repeat one another.
    """
    r = Rounds(docs, width, byte_batches)
    grams = [gram, long_gram]  # the second leaves out lines that many documents have, but not in one surrounding
    for n in grams:
        r.run(n)
    bits = r.bits

    def sorted_runs(key, table, back):
        rep, known = told(back, len(grams)), {}
        for _, _, _, _, known in numbered(in_order(table)[1], width, grams, rep):
            pass
        run = sorted((k, left, n, c > 1) for (k, left), (n, c) in known.items())
        rows, at = [], 0
        while at < len(run):
            b = int.from_bytes(run[at][0][:8], "big") >> (64 - bits)
            end = at
            while end < len(run) and int.from_bytes(run[end][0][:8], "big") >> (64 - bits) == b:
                end += 1
            rows.append((b, key[0].as_py(), pack(run[at:end])))
            at = end
        cols = list(zip(*rows)) or [[], [], []]
        trim()
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, RUN_SCHEMA)], schema=RUN_SCHEMA)

    runs = r.docs.groupBy("chunk").cogroup(r.back.groupBy("chunk")).applyInArrow(sorted_runs, RUN)
    r.back = r.back.unionByName(runs.groupBy("bucket").applyInArrow(lambda t: marks(t, width, gram, len(grams)), MARKS))
    span = width - gram + 1
    size = 4 + (span + 7) // 8

    def done(key, table, back):
        ids, texts = in_order(table)
        rep = told(back, len(grams))
        blob = b"".join(b for q, b in zip(back.column("round").to_pylist(), back.column("hashes").to_pylist()) if q == len(grams))
        flat = np.frombuffer(blob, np.uint8).reshape(-1, size)
        numbers = np.ascontiguousarray(flat[:, :4]).view("<u4").ravel()
        row = dict(zip(numbers.tolist(), range(len(numbers))))
        flags = np.unpackbits(flat[:, 4:], axis=1).astype(bool)
        rows = []
        for i, u, raw, found, _ in numbered(texts, width, grams, rep):
            starts = np.zeros(u.n, bool)
            for s, e, a, number in found:
                if (k := row.get(number)) is not None:
                    starts[s : e + 1] = flags[k, a - e : a - s + 1][::-1]
            gone = covered(starts, width, u.n)
            off = u.off.tolist()
            for d, (s, e) in enumerate(zip(off, off[1:])):
                out = gone[s:e]
                n = int(out.sum())
                left = raw[s:e][~out].tobytes() if n else raw[s:e].tobytes()
                spans = int(np.count_nonzero(np.diff(np.concatenate([[False], out]).view(np.int8)) == 1)) if n else 0
                rows.append((ids[i + d], e - s, n, spans, hashlib.sha256(left).hexdigest(), *([left] if keep_text else [])))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return r.finish(done, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
