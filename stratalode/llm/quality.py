"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sliced, trim
from .overlap_join import LOWER
from .repeats import U64, _batches, word_hashes

WORDS, DIMS, ONES = 1 << 14, 64, 4  # hashed vocabulary, vector length, non-zero entries of an index vector
UP, AGAIN = 0, 1  # marks: a word in capitals; a word like the one before
SLICES = 64

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each word's index vector; fixed by the seed."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMS, (WORDS, ONES)), rng.choice([-1.0, 1.0], (WORDS, ONES))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets): of each text the words, numbers and runs of one mark as hashed words, and marks after them."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    kind = _CLASS[raw]
    new = np.ones(len(raw) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] == 3) & (raw[1:] != raw[:-1]))
    edge = np.flatnonzero(new)
    starts, ends = edge[:-1], edge[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    h = word_hashes(np.frombuffer(joined.translate(LOWER), np.uint8), starts, ends)
    ids = (h % U64(WORDS - 2)).astype(np.int32) + 2
    word = kind[starts] == 1
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    lower = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    shout = word & (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    off = np.searchsorted(starts, edges)
    w = np.flatnonzero(word)
    again = np.zeros(len(ids), bool)
    if len(w) > 1:
        doc = np.searchsorted(off, w, "right")
        again[w[1:]] = (h[w[1:]] == h[w[:-1]]) & (doc[1:] == doc[:-1])
    n = 1 + shout + again
    place = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(ids, n)
    out[place[:-1][shout] + 1] = UP
    out[place[1:][again] - 1] = AGAIN
    return out, place[off]


def _encoded(column) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def word_vectors(docs: DataFrame, near: int = 2) -> np.ndarray:
    """WORDS x DIMS: of each hashed word the sum of the index vectors of its neighbours, over all documents, at unit length.

    Each task sums its own documents; tasks' sums are added by ranges of words. What reaches the driver
    is the table itself, 8 bytes times WORDS times DIMS (8 MB) and the counts.
    """
    step = WORDS // SLICES

    def add(batches):
        places, signs = _index_vectors()
        total, counts = np.zeros(WORDS * DIMS), np.zeros(WORDS)
        for b in sliced(batches):
            texts = _encoded(b.column(0))
            for i, j in _batches(texts, 1 << 20):
                ids, off = tokens(texts[i:j])
                doc = np.repeat(np.arange(j - i), np.diff(off))
                counts += np.bincount(ids, minlength=WORDS)
                for d in range(1, near + 1):
                    if len(ids) <= d:
                        continue
                    same = doc[d:] == doc[:-d]
                    left, right = ids[:-d][same].astype(np.int64), ids[d:][same].astype(np.int64)
                    for k in range(ONES):
                        total += np.bincount(left * DIMS + places[right, k], signs[right, k], WORDS * DIMS)
                        total += np.bincount(right * DIMS + places[left, k], signs[left, k], WORDS * DIMS)
        table = np.concatenate([total.reshape(WORDS, DIMS), counts[:, None]], axis=1).astype(np.int64)
        del total, counts
        small = np.int32 if np.abs(table).max(initial=0) < 1 << 31 else np.int64
        trim()
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(SLICES), pa.int32()), "wide": pa.array([small is np.int64] * SLICES), "sums": pa.array([table[s * step : (s + 1) * step].astype(small).tobytes() for s in range(SLICES)], pa.binary())})

    def total(t):
        out = np.zeros((step, DIMS + 1), np.int64)
        for wide, b in zip(t.column("wide").to_pylist(), t.column("sums")):
            out += np.frombuffer(b.as_py(), np.int64 if wide else np.int32).reshape(out.shape)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "sums": pa.array([out.tobytes()], pa.binary())})

    kind = "part int, wide boolean, sums binary"
    rows = docs.select(docs["text"].alias("text")).mapInArrow(add, kind).groupBy("part").applyInArrow(total, "part int, sums binary").collect()
    out = np.zeros((WORDS, DIMS + 1))
    for r in rows:
        out[r.part * step : (r.part + 1) * step] = np.frombuffer(r.sums, np.int64).reshape(step, DIMS + 1)
    vectors, counts = out[:, :DIMS], out[:, DIMS]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(length > 0, length, 1)
    rare = 1e-3 / (1e-3 + counts / max(counts.sum(), 1))
    return np.concatenate([vectors, rare[:, None]], axis=1).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Of each text the mean of its words' vectors, plain and with rare words ahead, and the log of its length."""
    out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
    for i, j in _batches(texts, 1 << 17):
        ids, off = tokens(texts[i:j])
        n = np.diff(off)
        some = np.flatnonzero(n)
        if len(some):
            v = vectors[ids]
            at = off[:-1][some]
            plain = np.add.reduceat(v[:, :DIMS], at, axis=0)
            weight = v[:, DIMS:]
            heavy = np.add.reduceat(v[:, :DIMS] * weight, at, axis=0)
            out[i + some, :DIMS] = plain / n[some, None]
            out[i + some, DIMS : 2 * DIMS] = heavy / np.maximum(np.add.reduceat(weight, at, axis=0), 1e-9)
            out[i + some, 2 * DIMS] = np.log1p(n[some])
    return out


class Network:
    """Two layers of numpy arrays; probabilities are divided by a temperature fitted on rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, seed: int = 11):
        self.t, self.prior = 1.0, float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        self.fit = len(y) >= 20 and 0 < y.mean() < 1
        if not self.fit:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        apart, order = order[: len(y) // 5], order[len(y) // 5 :]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), 128):
                b = order[at : at + 128]
                h = np.tanh(x[b] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[b]) / len(b)
                dh = np.outer(d, w[2]) * (1 - h * h)
                grads = [x[b].T @ dh + 1e-3 * w[0], dh.sum(0), h.T @ d + 1e-3 * w[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w
        z, yy = self._logits(x[apart]), y[apart]
        grid = np.geomspace(0.25, 8, 61)
        self.t = float(grid[int(np.argmin([np.mean(np.logaddexp(0, z / t) - yy * z / t) for t in grid]))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fit:
            return np.full(len(x), self.prior)
        z = self._logits((x - self.mean) / self.scale) / self.t
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Scorer:
    """Vectors of all documents' words and a network fitted on at most `train_rows` labelled rows that are not held out.

    The rows are the first by a hash of doc_id, so the sample is bounded and the same each time. Of rows that share a
    doc_id the least text counts.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 8_000):
        sc = docs.sparkSession.sparkContext
        sample = labels.select(labels["doc_id"].alias("_id"), labels[label].cast("double").alias("_y")).filter("_id is not null and _y is not null").filter(~held_out(F.col("_id")))
        sample = sample.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
        self.vectors = vectors = sc.broadcast(word_vectors(docs))

        def features(batches):
            for b in sliced(batches):
                x = pooled(_encoded(b.column(1)), vectors.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

        d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
        known = d.join(F.broadcast(sample), d["doc_id"] == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("y"))
        rows = sorted((r.doc_id, r.y, bytes(r.x)) for r in known.mapInArrow(features, "doc_id long, y double, x binary").collect())
        x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), 2 * DIMS + 1).astype(float)
        self.net = sc.broadcast(Network(x, np.array([r[1] for r in rows])))

    def over(self, rows: DataFrame, text: str = "text", out: str = "_score") -> DataFrame:
        """All columns of rows and the score of each text."""
        vectors, net, at = self.vectors, self.net, rows.columns.index(text)

        def scores(batches):
            for b in sliced(batches):
                s = net.value(pooled(_encoded(b.column(at)), vectors.value).astype(float))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out])
            trim()

        return rows.mapInArrow(scores, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 8_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every document.

    Only the text is an input of a score. A doc_id labelled twice counts by its highest label; null labels
    don't count. Null or empty text: scored like a text without words. With fewer than 20 labelled
    rows or one class the score is the share of label 1 (0.5 without labels). Repeated rows give a row each.
    """
    scorer = Scorer(docs, labels, label, train_rows)
    out = scorer.over(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), out="score").drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "quality", train_rows: int = 8_000) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold."""
    out = fresh(docs.columns, "_score")
    return Scorer(docs, labels, label, train_rows).over(docs, out=out).filter(F.col(out) >= threshold).select(*docs.columns)
