"""Substring dedup by level-wise doubling: windows of words repeated at one length alone go on to twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Rounds, survive, texts_of, told, word_batches

KIND = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def lengths(width: int) -> list[int]:
    """The levels: a fourth of the width, then twice as long each time, the last the width itself."""
    out = [width]
    while out[0] > 8:
        out.insert(0, -(-out[0] // 2))
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units a window beginning at one of `starts` (a mask) covers."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_words(docs: DataFrame, width: int = 35, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept text) of every document.

    Each word covered by a window of `width` words that also starts anywhere else is removed. At each
    level a window is represented by the least hash of its grams of that length, so two equal windows
    ask for the same hash; a window whose hash is not repeated is out. At the last level every window
    that is left is hashed whole (64 bits). Words are kept unchanged, joined by one space. Null or
    empty text: no words. Repeated rows are documents of their own, and repeat one another.
    """
    r = Rounds(docs, width, word_batches)
    levels = lengths(width)
    for n in levels:
        r.run(n)

    def done(key, table, back):
        texts, ids = texts_of(table), table.column("doc_id").to_pylist()
        rep, rows = told(back, len(levels)), []
        for i, _, u, (joined, starts, ends) in word_batches(texts):
            gone = covered(survive(u, width, levels, rep), width, u.n)
            off = u.off.tolist()
            for k, (s, e) in enumerate(zip(off, off[1:])):
                left = np.flatnonzero(~gone[s:e]) + s
                text = b" ".join([joined[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist())])
                rows.append((ids[i + k], e - s, e - s - len(left), hashlib.sha256(text).hexdigest(), *([text.decode()] if keep_text else [])))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return r.finish(done, KIND + (", kept string" if keep_text else ""))
