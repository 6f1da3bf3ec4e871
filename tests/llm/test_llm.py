"""Every operator against a brute-force version, with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import decontaminate, fingerprints, language, licenses, mixing, overlap_join, quality, repeats, stages, substrings, suffixes, token_files

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, chunk int, key string, _w string, bucket int, term string, score double, _text string"


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = words(60), words(150)
    texts = [None, "", " ", "one", "one two", "One TWO", "\t\n ", words(5000), base, base, base, base.upper()]
    for i in range(25):
        near = base.split(" ")
        for _ in range(rng.choice([0, 1, 2, 5])):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [words(rng.randrange(1, 90)) for _ in range(30)]
    texts += [f"{words(40)} {passage} {words(30)}" for _ in range(8)] + [passage + " " + passage, "日本語 " * 80, "a" * 900, "ab" * 700]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 6 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    out += [(3, "one", "en", "s0", None), (3, "one", "en", "s0", None), (None, base, "en", "s1", None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", None, None, "t", None, "x") for r in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def covered(units, width, counts):
    gone = [False] * len(units)
    for i in range(len(units) - width + 1):
        if counts[units[i : i + width]] > 1:
            gone[i : i + width] = [True] * width
    return gone


def test_substrings(docs, nothing):
    rows = [(r[0], tuple(SPACE.findall(r[1] or ""))) for r in corpus()]
    counts = Counter(w[i : i + 35] for _, w in rows for i in range(len(w) - 34))
    want = []
    for k, w in rows:
        gone = covered(w, 35, counts)
        want.append((k, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    same(substrings.repeated_words(docs).collect(), want)
    assert substrings.repeated_words(nothing).collect() == []
    assert substrings.lengths(35) == [5, 9, 18, 35]


def test_suffixes(docs, nothing):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    counts = Counter(w[i : i + 200] for _, w in rows for i in range(len(w) - 199))
    want = []
    for k, w in rows:
        gone = covered(w, 200, counts)
        spans = sum(g and not b for g, b in zip(gone, [False, *gone]))
        want.append((k, len(w), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(w, gone) if not g)).hexdigest()))
    same(suffixes.repeated_bytes(docs).collect(), want)
    assert suffixes.repeated_bytes(nothing).collect() == []


def test_suffixes_whatever_order_rows_come_in(spark, docs, monkeypatch):
    class Turned(repeats.Rounds):
        def finish(self, f, kind):
            self.docs = self.docs.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"))
            return super().finish(f, kind)

    want = suffixes.repeated_bytes(docs).collect()
    monkeypatch.setattr(suffixes, "Rounds", Turned)
    same(suffixes.repeated_bytes(docs).collect(), want)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(30))) for _ in range(k)]
        coded = [[(suffixes.shared(b"" if not i else r[i - 1], x), x) for i, x in enumerate(r)] for r in runs]
        got = list(suffixes.merge(coded))
        assert [x for _, x, _, _ in got] == sorted(x for r in runs for x in r)
        assert [h for h, *_ in got] == [suffixes.shared(a, b) for a, b in zip([b"", *[x for _, x, _, _ in got]], [x for _, x, _, _ in got])]
        assert all(runs[r][i] == x for _, x, r, i in got)
        run = [(x, x[:2], i, i % 2) for i, x in enumerate(runs[0])] if k else []
        keys, lefts, numbers, many = suffixes.unpack(suffixes.pack(run))
        assert list(zip([x for _, x in keys], lefts, numbers, many)) == run


def test_rolling_hashes():
    rng = np.random.default_rng(0)
    u = repeats.Units(rng.integers(0, 4, 500).astype(np.uint64), np.array([0, 200, 500]))
    g = u.grams(3)
    raw = np.diff(u.sums) * repeats.powers(500)[1]
    seen = {}
    for i in range(498):
        assert seen.setdefault(tuple(raw[i : i + 3]), g[i]) == g[i]
    assert len(set(seen.values())) == len(seen)
    a = rng.integers(0, 99, 50).astype(np.uint64)
    assert (repeats.slide(a, 7, np.minimum) == [a[i : i + 7].min() for i in range(44)]).all()


def jaccard_classes(rows, words, num, den):
    sets = []
    for _, t, *_ in rows:
        w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    return [(r[0], len(sets[i]), least.get(find(i), r[0])) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_overlap_join(docs, nothing, words, num):
    got = overlap_join.join(docs, words, num, 100, block_sets=4).select("doc_id", "n_shingles", "component_id").collect()
    same(got, jaccard_classes(corpus(), words, num, 100))
    got = overlap_join.join(docs, words, num, 100, block_sets=4, list_sets=3).select("doc_id", "n_shingles", "component_id").collect()
    same(got, jaccard_classes(corpus(), words, num, 100))
    assert overlap_join.join(nothing).collect() == []


def test_overlap_join_bridges_and_families(spark):
    """Rows without doc_id that alone connect others, repeated ids, and large families of near but unlinked texts."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]

    def edited(words, at):
        return [f"e{a}" if i in at else w for i, (w, a) in enumerate(zip(words, range(10_000)))]

    one, two = edited(base, {10}), edited(base, {10, 60})
    rows = [(7, " ".join(base)), (None, " ".join(one)), (None, " ".join(one)), (3, " ".join(two)), (3, "alone " * 5), (None, "z " * 9), (None, "y x z")]
    for k in range(60):  # all share most words, few link
        at = rng.sample(range(120), rng.choice([2, 3, 4, 8]))
        rows.append((100 + k, " ".join(f"f{k}" if i in at else w for i, w in enumerate(base))))
    rows = [(*r, None, None, None) for r in rows]
    for words, num in ((3, 90), (3, 95), (5, 80)):
        got = overlap_join.join(frame(spark, rows), words, num, 100, block_sets=5, list_sets=7).select("doc_id", "n_shingles", "component_id").collect()
        same(got, jaccard_classes(rows, words, num, 100))


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(8)
    for num in (90, 80, 55):
        m = overlap_join.Measure(num)
        for n in (1, 2, 7, 40, 300, 900):
            for _ in range(8):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                b = np.unique(np.concatenate([a[rng.integers(0, max(1, n // 8)) :], rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 1), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < num * (len(a) + len(b) - both) or not len(b):
                    continue
                x, y = (np.frombuffer(overlap_join.parity(s, m), "<u8")[None] for s in (a, b))
                w = min(x.shape[1], y.shape[1])
                assert overlap_join._may_link(overlap_join.fold(x, w), len(a), overlap_join.fold(y, w), len(b), m).all()


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for num in (90, 80, 60):
        m = overlap_join.Measure(num)
        for n in [*range(1, 60), 150, 400]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            d = m.differ(len(a), len(a)) // 2
            b = np.unique(np.concatenate([a[d:], rng.integers(0, 1 << 63, d, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if d and 100 * both >= num * (len(a) + len(b) - both):
                assert len(np.intersect1d(overlap_join.signatures(a, m), overlap_join.signatures(b, m)))


def test_divide_skip():
    rng = np.random.default_rng(2)
    m = overlap_join.Measure(70)
    sets = [np.unique(rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint64)) for _ in range(80)]
    lists = overlap_join.Lists(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 70 * len(np.union1d(q, s))]
        assert sorted(lists.search(q, m).tolist()) == want


def test_decontaminate(spark, docs, nothing):
    texts = [r[1] for r in corpus() if r[1]]
    bench = [(1, " ".join(texts[-5].split()[42:70])), (2, "One"), (3, "two one"), (4, None), (5, ""), (10, "Not here at all, never " * 3), (11, texts[5]), (12, "日本語 " * 12)]
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, n int")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for k, t in bench:
        w = cut(t)
        for i in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[i : i + 10]), set()).add(k)
    want = []
    for k, t, *_ in corpus():
        w, hit, items = cut(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in wins}:
                if len(x := tuple(w[i : i + n])) == n and x in wins:
                    hit.update(range(i, i + n))
                    items |= wins[x]
        want.append((k, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    same(decontaminate.decontaminate(docs, b).drop("text_key").collect(), want)
    assert decontaminate.decontaminate(nothing, b).collect() == []
    assert not decontaminate.decontaminate(docs, b.limit(0)).filter("contaminated").count()
    near, _ = decontaminate.matches(docs.limit(0).unionByName(frame(spark, [(1, "x alpha y beta gamma z", None, None, None)])), spark.createDataFrame([(1, "beta alpha gamma")], "item_id long, text string"), slop=2)
    assert [h.exact for r in near.collect() for h in r.hits] == [False]


def test_decontaminate_capitals_beyond_ascii(spark):
    items = ["МОСКВА СЛЕЗАМ НЕ ВЕРИТ", "École Étage Île Ñandú", "ΟΔΟΣ.ΟΔΟΣ ΛΟΓΟΣ", "İzmir K ÅB", "ÉTUDE " + "the " * 12, "москва слезам не верит им"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"before {t} after" for t in items] + [items[0].lower(), "école étage île ñandú"]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), b).collect()}
    assert got == {0: (4, 1), 1: (4, 1), 2: (3, 1), 3: (3, 1), 4: (13, 1), 5: (5, 1), 6: (0, 0), 7: (0, 0)}  # the contract lower-cases A-Z only


def test_mix(docs, nothing):
    rows = mixing.mix(docs, block=2, shard_docs=10).collect()
    sizes = [len(SPACE.findall(r[1] or "")) for r in corpus()]
    same([(r.doc_id, r.size) for r in rows], [(r[0], n) for r, n in zip(corpus(), sizes)])
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        x = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        x[0] += r.size
        x[1] += r.taken
    assert all(x[0] == x[3] and x[2] <= 3 * x[3] + 1e-6 for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - sum(sizes)) < 1e-6
    assert all(abs(x[1] - x[2]) <= 60 for x in by.values())
    same(rows, mixing.mix(docs.repartition(5), block=2, shard_docs=10).collect())
    assert mixing.mix(nothing).collect() == []


def test_sainte_lague(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 12):
        shares = [rng.randrange(0, 1000) for _ in range(n)]
        seats = rng.randrange(1, 400)
        t = spark.createDataFrame([(1, i, s) for i, s in enumerate(shares)], "g int, i int, s long")
        got = {r.i: r.quota for r in mixing.sainte_lague(t, "s", F.lit(seats), "i", ["g"]).collect()}
        won = Counter(sorted(((-s / (2 * k - 1), i) for i, s in enumerate(shares) if s for k in range(1, seats + 1)))[:seats][j][1] for j in range(seats if any(shares) else 0))
        assert got == {i: won[i] for i in range(n)}


def test_licenses(spark, docs, nothing):
    rows = [(1, "Released under the MIT Licence!!", None, None, None), (2, "words\nALL RIGHTS RESERVED\nmore\nreleased under the mit license.", None, None, None), (3, "Copyright 2020 me\nCopyright 2021 you", None, None, None), (4, None, None, None, None)]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: (1, "MIT", "MIT"), 2: (2, "MIT,Proprietary", None), 3: (0, "", None), 4: (0, "", None)}
    assert licenses.scan(nothing).collect() == []
    assert licenses.scan(docs).count() == len(corpus())


def test_token_files(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for k, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(token_files.token_files(docs, path).collect(), want)
    assert token_files.token_files(nothing, path).collect() == []
    e = token_files.Encoder(path, "<u2", keep=20)
    odd = ["a<|endoftext|>, b x", "it's, don't  two\n new \x85 x", "  lead", "tail ", "", "日本 語, x.y", " .a ,b!!! c'll? 's,", "x" * 3000, "é, é. ü;ß  \xa0 y z"] * 3
    assert [t.encode(x, add_special_tokens=False).ids for x in odd] == [x.tolist() for x in e(odd, 40)]


def spark_hash(values):
    """xxhash64 as Spark chains it over strings or longs."""
    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def winnowed(text, k=16, w=32):
    """(position, hash) of the selected grams, as the method has it: the least of each window, ties the rightmost."""
    known = {}

    def gram(x):
        if x not in known:
            known[x] = spark_hash([x]) if len(x) == 8 else spark_hash([gram(x[: len(x) // 2]), gram(x[len(x) // 2 :])])
        return known[x]

    grams = [gram(text[i : i + k]) for i in range(len(text) - k + 1)] or ([spark_hash([text])] if text else [])
    grams = [g >> fingerprints.POS_BITS for g in grams]
    return sorted({max(range(i, min(i + w, len(grams))), key=lambda p: (-grams[p], p)) for i in range(max(1, len(grams) - w + 1)) if grams}), grams


def fp_text(places, grams):
    return " ".join(f"{(grams[p] & (1 << 36) - 1) << 28 | (1 << 28) - 1 - p:X}" for p in places)


def test_fingerprints(docs, nothing):
    rows = sorted(((-(1 << 63) if r[0] is None else r[0], r[1] or "", r[0]) for r in corpus()))
    want = []

    def said(t):
        places, grams = winnowed(t)
        return fp_text(places, grams), {grams[p] for p in places}

    def like(a, b):
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    for i, (_, t, k) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        (f, a), (e, b), (_, c) = said(t), said(edited), said(nxt)
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, like(a, b), like(a, c)))
    same(fingerprints.edited_fingerprints(docs).collect(), want)
    assert fingerprints.edited_fingerprints(nothing).collect() == []


def test_edited_fingerprints_of_all_lengths(spark):
    """Texts around the lengths at which windows begin to fit, beside long and empty ones, and code points beyond 16 bits."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab😀é") for _ in range(n))
    texts = [word(n) for n in [0, 1, 2, 15, 16, 17, 31, 32, 46, 47, 48, 60, 92, 93, 94, 95, 96, 140, 0, 300, 20, 300, 0, 95, 3]]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        for text, said in ((t, got[i].fingerprint), (edited, got[i].edited_fingerprint)):
            places, grams = winnowed(text)
            assert said == fp_text(places, grams), (i, len(text))


def test_windows_are_looked_at_where_the_least_may_change(spark, monkeypatch):
    """Windows of all code points are not folded, and what they select is that of every window: equal grams, long and short texts."""
    folded, roll = [], fingerprints._roll
    monkeypatch.setattr(fingerprints, "_roll", lambda h, few, n, f, *more: folded.append(f) or roll(h, few, n, f, *more))
    rng = random.Random(11)
    texts = ["a" * 400, "ab" * 150 + "b" * 90, "".join(rng.choice("abc😀") for _ in range(900)), "abcdefgh" * 3, "x" * 47]
    got = fingerprints.fingerprint(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).select("doc_id", fingerprints.as_string(F.col("fp")).alias("f")).collect()
    assert {r.doc_id: r.f for r in got} == {i: fp_text(*winnowed(t)) for i, t in enumerate(texts)}
    assert F.xxhash64 in folded and F.least not in folded


def test_quality(spark, docs, nothing):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice(["stone", "river", "hill", "moss", "cloud"]) + rng.choice(["", "s"]) for _ in range(rng.randrange(5, 60))]
        bad = i % 3 == 0
        texts.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), None, None, None))
        labels.append((i, int(not bad)))
    y = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(frame(spark, texts), y).collect()
    truth = dict(labels)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    assert quality.score(nothing, y).collect() == []
    few = quality.score(docs, y.limit(0)).collect()
    assert len(few) == len(corpus()) and {r.score for r in few} == {0.5}
    kept = quality.keep(frame(spark, texts), y)
    assert kept.columns == frame(spark, []).columns and abs(kept.count() - 400) < 20


def test_language(spark, nothing):
    rng = random.Random(8)
    words = {"en": "the of and with that this from have".split(), "de": "der die und nicht auch ist ein für".split()}
    text = lambda l, n: " ".join(rng.choice(words[l]) for _ in range(n))
    rows = [(i, text(l := rng.choice(["en", "de"]), 30), l, None, None) for i in range(100)]
    pages = [(i, f"http://{l}{i % 3}.example.{'de' if l == 'de' else 'com'}/x", f'<html lang="{l}"><script>x</script><p>{text(l, 12 if i % 4 else 0)}</p>', l) for i in range(80) for l in [rng.choice(["en", "de"])]]
    p = spark.createDataFrame([(i, u, h, 1) for i, u, h, _ in pages] + [(100, None, None, 1), (101, "", "", 1)], "page_id long, url string, html string, q int")
    got = {r.page_id: r for r in language.fuse(p, frame(spark, rows)).collect()}
    assert len(got) == 82 and all(got[i].lang == l for i, _, _, l in pages)
    assert all(0 <= r.probability <= 1 for r in got.values())
    assert language.fuse(p.limit(0), frame(spark, rows)).collect() == []
    assert all(r.lang is None for r in language.fuse(p, nothing).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    d = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[40][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = str(tmp_path)
    good, distinct, clean, mixed, _ = (f for _, f in corpus_pipeline.STAGES)
    kept = good(spark, d, at)
    assert kept.count() == len(rows)
    once = distinct(spark, d, at)
    least = {(k, c) for k, _, c in jaccard_classes(rows, 5, 80, 100)}
    assert {r.doc_id for r in once.collect()} == {k for k, c in least if k == c}  # the row without an id is a copy of one that stays
    assert once.filter("doc_id = 3").count() == 1  # of rows alike
    left = clean(spark, d, at)
    assert rows[40][0] not in {r.doc_id for r in left.collect()} and left.count() >= len(rows) - 12
    assert mixed(spark, left, at).columns == d.columns
    out = corpus_pipeline.run(spark, at).collect()
    assert out and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_mixed_documents_meet_the_targets(spark, nothing):
    mixed = stages.mixed

    rng = random.Random(6)
    sizes = [(i, rng.randrange(5, 40), f"s{i % 4}") for i in range(480)]
    rows = [(i, " ".join(["x"] * n), None, s, None) for i, n, s in sizes] + [(7, "y " * 20, None, "s3", None), (None, "z " * 15, None, "s0", None), (None, "z " * 15, None, "s0", None), (None, "", None, "s0", None)]
    d = frame(spark, rows)
    targets = {r.source: r.target for r in mixing.mix(d).collect()}
    got = mixed(spark, d, "").collect()
    kept = Counter()
    for r in got:
        kept[r.source] += len(r.text.split())
    assert {s: abs(kept[s] - t) <= 20 + 8 for s, t in targets.items()} == dict.fromkeys(targets, True)  # half a document and a block
    same(got, mixed(spark, d.repartition(5), "").collect())
    times = Counter((r.doc_id, r.text) for r in got)
    assert all(max(times[(i, t)] for i, t, _, s, _ in rows if s == x and i is not None) - min(times[(i, t)] for i, t, _, s, _ in rows if s == x and i is not None) <= 1 for x in targets)
    assert mixed(spark, nothing, "").collect() == []


def test_license_full_texts_and_headers(spark):
    import pkgutil

    full = {n: pkgutil.get_data("stratalode.llm", f"license_texts/{n}.txt").decode() for n in licenses.FULL}
    apache = ["Copyright 2020 me", "", 'Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", "", "Unless required by applicable law or agreed to in writing, software", 'distributed under the License is distributed on an "AS IS" BASIS,', "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and", "limitations under the License."]
    texts = [full[n].replace("(c) <year>", "(c) 2020").replace("<copyright holders>", "me") for n in licenses.FULL]
    texts += ["\n".join(["x = 1", "", *apache, "", "y = 2"]), "\n".join(["/*", *(f" * {x}" for x in apache), " */", "", "int x;"]), "words\n\n" + texts[0] + "\nmore\nwords"]
    got = {r.doc_id: (r.n_notices > 0, r.licenses, r.whole_license) for r in licenses.scan(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    for i, n in enumerate(licenses.FULL):
        assert got[i][2] == n
    assert got[4] == (True, "Apache-2.0", None) and got[5] == (True, "Apache-2.0", None) and got[6] == (True, "MIT", None)


def test_shared_runs_share_a_hash(spark):
    """The guarantee: any 47 code points that two texts share, at whatever places and without spaces, give both a common hash at the same place in the run."""
    rng = random.Random(2)
    cjk = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    run = cjk(47)
    rows = [(i, cjk(before) + run + cjk(after), None, None, None) for i, (before, after) in enumerate([(0, 0), (1, 30), (3, 0), (50, 7), (211, 400)])]
    start = [0, 1, 3, 50, 211]
    got = {r.doc_id: dict(zip([p - start[r.doc_id] for p in r.p], r.h)) for r in fingerprints.fingerprint(frame(spark, rows)).select("doc_id", fingerprints.positions(F.col("fp")).alias("p"), F.transform("fp", lambda x: F.shiftright(x, fingerprints.POS_BITS)).alias("h")).collect()}
    (place, value), = got[0].items()
    assert all(got[i].get(place) == value for i in got)


def test_stages_tell_rows_apart(spark):
    """Rows without doc_id, rows that share one, and columns named like the stages' own."""
    passage = " ".join(f"p{i}" for i in range(12))
    words = lambda k, n=40: " ".join(f"{k}x{i}" for i in range(n))
    texts = [(1, words("a")), (1, f"{words('b')} {passage}"), (None, f"{words('c')} {passage}"), (None, words("d")), (2, words("e")), (2, words("f")), (3, words("f")), (None, words("g")), (None, words("g")), (None, None), (4, ""), (5, words("h")), (5, words("h"))]
    kind = "doc_id long, text string, source string, _n int, _id long, _times int, _text_key long, _doc_id long, _score double, _pass int, _rows int"
    d = spark.createDataFrame([(k, t, "s", 7, 8, 9, 10, 11, 0.5, 12, 13) for k, t in texts], kind)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.mode("overwrite").parquet(f"{(at := shared(spark))}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert key(stages.good(spark, d, at)) == Counter(texts)
    gone = Counter([(3, words("f")), (None, words("g")), (5, words("h"))])
    assert key(stages.distinct(spark, d, at)) == Counter(texts) - gone
    assert key(stages.clean(spark, d, at)) == Counter(x for x in texts if passage not in (x[1] or ""))
    out = stages.mixed(spark, d, at)
    assert set(key(out)) <= {x for x in texts if x[1]}
    for f in (stages.good, stages.distinct, stages.clean, stages.mixed):
        got = f(spark, d, at)
        assert got.columns == d.columns and {tuple(r)[3:] for r in got.collect()} == {(7, 8, 9, 10, 11, 0.5, 12, 13)}


def shared(spark):
    from stratalode.llm.common import shared_dir

    return shared_dir(spark)


def test_fresh_names():
    from stratalode.llm.common import fresh

    assert fresh(["a", "_ID"], "_id") == "_id_" and fresh([], "x") == "x"


def test_token_pieces():
    """Pieces may begin only where the tokenizer's own pattern begins one; and ids are those of whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), token_files.Encoder(path, "<u2", keep=3)
    rng = random.Random(3)
    chars = "ab ,.'é×÷ß ĀȿɀΩж日\u00a0\u0085\n\t19<|>!?\u1680\u2003’"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for size in (50, 1 << 20):
        assert all(list(x) == w.ids for x, w in zip(e(texts, size), t.encode_batch_fast(texts, add_special_tokens=False), strict=True))
    ids = token_files.Encoder(path, "<u2")
    ids.raw = None  # not reached for empty texts
    assert [len(x) for x in ids(["", ""])] == [0, 0]


def test_quality_against_brute_force(spark):
    """Word vectors, pooled texts and scores, by plain loops over words; the network itself is fitted the same way."""
    rng = random.Random(4)
    words = ["stone", "river", "HILL", "moss", "cloud", "é", "42", "!!", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["", "one", None]
    index = quality._index_vectors()
    numbered = [quality.tokens([(t or "").encode()])[0].tolist() for t in texts]
    sums, counts = np.zeros((quality.WORDS, quality.DIMS)), np.zeros(quality.WORDS)
    for ids in numbered:
        for i, a in enumerate(ids):
            counts[a] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    for place, sign in zip(index[0][ids[j]], index[1][ids[j]]):
                        sums[a, place] += sign
    length = np.linalg.norm(sums, axis=1)
    vector = {a: sums[a] / (length[a] or 1) for a in range(quality.WORDS)}
    rare = 1e-3 / (1e-3 + counts / counts.sum())
    feature = []
    for ids in numbered:
        plain = sum((vector[a] for a in ids), np.zeros(quality.DIMS)) / max(len(ids), 1)
        heavy = sum((vector[a] * rare[a] for a in ids), np.zeros(quality.DIMS)) / max(sum(rare[a] for a in ids), 1e-9)
        feature.append(np.concatenate([plain, heavy, [math.log1p(len(ids))]]))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    y = {i: float(i % 2) for i in range(len(texts))}
    learned = [i for i in y if zlib.crc32(str(i).encode()) % 3 != 1]
    net = quality.Network(np.array([feature[i] for i in learned], np.float32).astype(float), np.array([y[i] for i in learned]))
    want = net(np.array(feature, np.float32).astype(float))
    labels = spark.createDataFrame([(i, int(v)) for i, v in y.items()], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(frame(spark, rows), labels).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4 and len(got) == len(texts)


def test_language_against_brute_force(spark):
    """The fusion of all evidence, by loops over pages; only the likelihoods of the texts are taken from the model."""
    rng = random.Random(3)
    words = {"en": "the of and with that this from have".split(), "de": "der die und nicht auch ist ein war".split(), "fr": "le la et les des une pour dans".split()}
    text = lambda l, n: " ".join(rng.choice(words[l]) for _ in range(n))
    d = frame(spark, [(i, text(l := rng.choice(list(words)), 20), l, None, None) for i in range(60)])
    pages = [(i, f"https://h{rng.randrange(4)}.x.{rng.choice(['de', 'fr', 'com'])}/p", f'<html lang="{rng.choice(["en", "de", "fr", "xx"])}">{text(rng.choice(list(words)), rng.randrange(4))}', 1) for i in range(50)] + [(50, None, None, 1), (51, "http://only.de/", "", 1)]
    got = {r.page_id: r for r in language.fuse(spark.createDataFrame(pages, "page_id long, url string, html string, q int"), d).collect()}
    model = language.train(d)
    langs, read = model.langs, []
    for i, url, html, _ in pages:
        tag = re.search(r'lang="(..)"', html or "")
        host = re.sub(r"^https?://|/.*", "", url or "")
        ll = model(re.sub("<[^>]*>", " ", html or ""))
        q = np.exp(ll - ll.max())
        read.append((i, host, host.rsplit(".", 1)[-1], tag[1] if tag else "", ll, q / q.sum()))
    total = sum(r[5] for r in read)
    base = (total + 1) / (total.sum() + len(langs))
    for i, host, suffix, tag, ll, q in read:
        of_suffix = np.maximum(sum(r[5] for r in read if r[2] == suffix) - q, 0)
        of_host = np.maximum(sum(r[5] for r in read if r[1] == host) - q, 0)
        p_suffix = (of_suffix + 8 * base) / (of_suffix.sum() + 8)
        p_host = (of_host + 4 * p_suffix) / (of_host.sum() + 4)
        said = sum(r[5] for r in read if r[3] == tag)
        e = np.log((said + np.array([20.0 if l == tag else 1.0 for l in langs])) / (total + 40)) if tag else 0
        lp = ll + e + np.log(p_host)
        post = np.exp(lp - lp.max()) / np.exp(lp - lp.max()).sum()
        assert got[i].lang == langs[int(post.argmax())] and abs(got[i].probability - post.max()) < 1e-9
        assert got[i].text_lang == langs[int(q.argmax())] and (got[i].host, got[i].suffix, got[i].declared) == (host, suffix, tag)
