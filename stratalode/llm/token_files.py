"""Token ids in flat unsigned integer files with 64-bit document offsets, read back through memory maps."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import partitions, shared_dir, sliced, trim
from .repeats import U64, _batches, word_hashes

def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Write under a name of this attempt's own, then rename: a retried task leaves whole files only."""
    fs, path = _fs(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for x in parts:
            f.write(memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b"")
    fs.move(part, f"{path}/{name}")


def _get(folder: str, name: str, dtype) -> np.ndarray:
    fs, path = _fs(folder)
    size = fs.get_file_info(f"{path}/{name}").size
    if not size:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.memmap(f"{path}/{name}", dtype=dtype, mode="r")
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def _pieces(raw: np.ndarray) -> np.ndarray:
    """Where a piece may begin in UTF-8 bytes: at a space between two visible characters, and at a mark after a letter.

    Characters are looked at up to U+07FF (marks: letters up to U+023F); elsewhere a piece just goes on.
    """
    lead, tail = (raw >= 0xC3) & (raw <= 0xDF), (raw >= 0x80) & (raw <= 0xBF)
    seen = (raw >= 0x21) & (raw <= 0x7E)
    begins = np.zeros(len(raw), bool)
    if len(raw) > 2:
        before = seen[:-2].copy()  # the character that ends at byte i - 1
        before[1:] |= tail[1:-2] & lead[:-3]
        begins[1:-1] = (raw[1:-1] == 0x20) & before & (seen | lead)[2:]
    if len(raw) > 1:
        small = raw | 0x20
        letter = ((small >= 0x61) & (small <= 0x7A))[:-1]
        wide = (raw >= 0xC3) & (raw <= 0xC8)
        letter[1:] |= tail[1:-1] & wide[:-2] & ~((raw[:-2] == 0xC3) & ((raw[1:-1] == 0x97) | (raw[1:-1] == 0xB7)))
        begins[1:] |= letter & _MARKS[raw[1:]]
    return begins


_MARKS = np.zeros(256, bool)
_MARKS[list(b",.;:!?*#$%&")] = True


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all places of some ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Encoder:
    """Encodes whole texts with a tokenizers file.

    Where the file splits text as byte-level vocabularies do (no normaliser, no prefix space), a
    single space between two visible characters always begins a new piece, and so does a mark such as
    a comma after a letter. What stands between two such places encodes alike anywhere; it is encoded
    once and kept, found again by a 64-bit hash and compared byte by byte. Beyond `keep` pieces the later half is
    forgotten: the earlier half came up first and so is the commoner. Other files encode text by text.
    """

    def __init__(self, path: str, dtype: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.t, self.dtype, self.keep = Tokenizer.from_file(path), dtype, keep
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        split, vocab = held.get("pre_tokenizer") or {}, held["model"]["vocab"]
        self.pieces = held.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and held["model"]["type"] == "BPE" and not held["model"].get("dropout") and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in held["added_tokens"])
        if self.pieces:
            self.begins = np.zeros(max([*vocab.values(), *(x["id"] for x in held["added_tokens"])]) + 1, bool)
            self.begins[[i for w, i in vocab.items() if w.startswith("\u0120")]] = True
        # pieces by number: their bytes and ids, each with offsets; their hashes in order, with the numbers
        self.raw, self.raw_off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_off = np.zeros(0, dtype), np.zeros(1, np.int64)
        self.hash, self.number = np.zeros(0, U64), np.zeros(0, np.int64)

    def _encoded(self, some: list[str]) -> list[np.ndarray]:
        """Ids of each piece. Those with one leading space are encoded side by side and told apart by the ids that begin with it."""
        out: list = [None] * len(some)
        plain = [i for i, x in enumerate(some) if x[0] == " " and len(x.split()) == 1 and "<|" not in x]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.array(self.t.encode_batch_fast(["".join([some[i] for i in part])], add_special_tokens=False)[0].ids)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part):
                ids = ids.astype(self.dtype)
                for i, s, e in zip(part, starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                    out[i] = ids[s:e]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.t.encode_batch_fast([some[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.dtype)
        return out

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.hash) > self.keep:
            n = self.keep // 2
            self.raw, self.raw_off = self.raw[: self.raw_off[n]].copy(), self.raw_off[: n + 1].copy()
            self.ids, self.ids_off = self.ids[: self.ids_off[n]].copy(), self.ids_off[: n + 1].copy()
            self.hash, self.number = self.hash[self.number < n], self.number[self.number < n]
        joined = raw.tobytes()
        ids = self._encoded([joined[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())])
        n = len(self.raw_off) - 1
        self.raw = np.concatenate([self.raw, raw[_ranges(starts, ends - starts)]])
        self.raw_off = np.concatenate([self.raw_off, self.raw_off[-1] + np.cumsum(ends - starts)])
        self.ids = np.concatenate([self.ids, *ids])
        self.ids_off = np.concatenate([self.ids_off, self.ids_off[-1] + np.cumsum([len(x) for x in ids])])
        at = np.searchsorted(self.hash, hashes)  # both in order
        self.hash, self.number = np.insert(self.hash, at, hashes), np.insert(self.number, at, np.arange(n, n + len(hashes)))

    def _numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return self.number[at], self.hash[at] == h

    def _side_by_side(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of some texts."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        begins = _pieces(raw)
        begins[off[off < len(raw)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        distinct, first, which = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        number, known = self._numbers(distinct)
        if not known.all():
            new = first[~known]
            self._learn(raw, starts[new], ends[new], distinct[~known])
            number, _ = self._numbers(distinct)
        number = number[which]
        there = self.raw_off[number]
        lengths = self.raw_off[number + 1] - there
        same = lengths == ends - starts
        if not same.all() or (self.raw[_ranges(there, lengths)] != raw).any():  # two pieces have one hash
            parts = [np.array(e.ids, self.dtype) for e in self.t.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        there = self.ids_off[number]
        lengths = self.ids_off[number + 1] - there
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[_ranges(there, lengths)], upto[np.searchsorted(starts, off)]

    def __call__(self, texts: list[str], size: int = 1 << 18):
        """Ids of each text, in order; about `size` bytes are worked on at once."""
        if not self.pieces:
            for e in self.t.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, self.dtype)
            return
        held = [t.encode() for t in texts]
        for i, j in _batches(held, size):
            ids, off = self._side_by_side(held[i:j])
            off = off.tolist()
            for s, e in zip(off, off[1:]):
                yield ids[s:e]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str, keep: int) -> Encoder:
    """One per worker process, so that what it keeps (some 40 bytes a piece) serves the stage's later tasks too."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype, keep)
    _ENCODERS[path, dtype].keep = keep
    return _ENCODERS[path, dtype]


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, bytes_at_once: int = 1 << 18, keep: int = 1_000_000, reuse: bool = True) -> str:
    """Encode every whole text, append end_id, write shards in ascending doc_id order; returns the folder.

    Documents are range-partitioned and sorted by doc_id (ties: by text), one shard a partition:
    `<n>.ids` flat uint16 or uint32 (by the vocabulary's size), `<n>.off` 64-bit offsets from the shard's start,
    `<n>.doc` 64-bit doc_ids. `manifest.json` holds each shard's base, the prefix sum of the ids
    before it, and how many of its documents, the first ones, have no doc_id. Null text: empty, only the end id. Null doc_id: first. An empty table: no shards.
    Only the tokenizer's path goes to executors, where the file must be found. `keep` bounds the encoded
    pieces that a worker holds; with `reuse` a worker holds them from task to task. Both change the time, not the ids.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = re.sub("^file:/+", "file:///", folder) if ":/" in folder else f"file://{os.path.abspath(folder)}"
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    small = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16
    dtype = "<u2" if small else "<u4"

    def encode(batches):
        t = encoder(tokenizer, dtype, keep) if reuse else Encoder(tokenizer, dtype, keep)
        done = None
        end = np.array([end_id], dtype)
        n, ids, lengths, owners, nulls = TaskContext.get().partitionId(), [], [], [], 0
        for b in sliced(batches):
            nulls += b.column(0).null_count
            owners.append(np.array([x or 0 for x in b.column(0).to_pylist()], "<i8"))
            for x in t([x or "" for x in b.column(1).to_pylist()], bytes_at_once):
                ids += (x, end)
                lengths.append(len(x) + 1)
        if lengths:
            _put(folder, f"{n:06d}.ids", ids)
            _put(folder, f"{n:06d}.off", [np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")])
            _put(folder, f"{n:06d}.doc", owners)
            done = pa.RecordBatch.from_pydict({"shard": [n], "docs": [len(lengths)], "ids": [int(sum(lengths))], "nulls": [nulls]})
        b = x = None
        del t, ids, lengths, owners  # else they would outlive what is given back
        trim()
        if done:
            yield done

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    d = d.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    shards, base = [], 0  # one row a partition comes to the driver
    for r in sorted(d.mapInArrow(encode, "shard long, docs long, ids long, nulls long").collect()):
        shards.append({"shard": r.shard, "docs": r.docs, "ids": r.ids, "nulls": r.nulls, "base": base})
        base += r.ids
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "shards": shards}).encode())
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that `write` left."""
    fs, path = _fs(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        held = json.loads(f.read())
    dtype = held["dtype"]

    def rows(batches):
        for b in sliced(batches):
            for n, base, nulls in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids, off, doc = _get(folder, f"{n:06d}.ids", dtype), _get(folder, f"{n:06d}.off", "<i8"), _get(folder, f"{n:06d}.doc", "<i8")
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=np.arange(len(doc)) < nulls), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    todo = [(x["shard"], x["base"], x["nulls"]) for x in held["shards"]]
    if not todo:
        return spark.createDataFrame([], kind)
    df = spark.createDataFrame(spark.sparkContext.parallelize(todo, len(todo)), "shard long, base long, nulls long")
    return df.mapInArrow(rows, kind)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, keep: int = 1_000_000, reuse: bool = True) -> DataFrame:
    """Write the files, then give one row per document as read back from them."""
    return read(docs.sparkSession, write(docs, tokenizer, end_id, folder, keep=keep, reuse=reuse))
