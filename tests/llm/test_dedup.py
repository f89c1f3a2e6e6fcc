"""Near-duplicates, repeated passages and fingerprints against plain Python."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import bucket_refinement, components, minhash_hamming, spot_signatures


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _groups(docs, share):
    """{doc_id: (set size, smallest linked doc_id)} by comparing all pairs."""
    sets = {d: _shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= share * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def _edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_all_pairs(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 8, 60, 200]))) for _ in range(25)]
    docs = [(i, t) for i, t in enumerate(base + [_edited(r, r.choice(base[2:]), r.randrange(1, 6)) for _ in range(120)] + base[:5] + ["", None])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_hamming.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 0.85).collect()}
    assert got == _groups(docs, 85)


def test_near_duplicates_odd_rows(odd, odd_rows, nothing):
    out = minhash_hamming.near_duplicates(odd, 0.85).collect()
    assert len(out) == len(odd_rows)
    assert all(x.component_id is None and x.kept for x in out if x.doc_id is None)
    assert {x.component_id for x in out if x.doc_id in (0, 1, 2)} == {0, 1, 2}
    named = sorted({d for _, d, *_ in odd_rows if d is not None})
    texts = {d: [t for t, e, *_ in odd_rows if e == d] for d in named}
    up = {d: d for d in named}
    for a in named:  # a document has all links of its rows
        for b in named:
            if any(_shingles(x) and 100 * len(_shingles(x) & _shingles(y)) >= 85 * len(_shingles(x) | _shingles(y)) for x in texts[a] for y in texts[b]):
                low, high = sorted((up[a], up[b]))
                up = {d: low if t == high else t for d, t in up.items()}
    assert {x.doc_id: x.component_id for x in out if x.doc_id is not None} == up
    assert minhash_hamming.near_duplicates(nothing).count() == 0


def test_links_at_the_threshold_are_kept(spark):
    r = random.Random(11)
    rows = []
    for k in range(60):  # 100 shingles each, of which two share 92 of 108 (0.8518) or 91 of 109 (0.8348)
        own = [f"{k}w{i}" for i in range(104)]
        shared = 92 if k % 2 else 91
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: shared + 4] + [f"{k}z{i}" for i in range(100 - shared)]))]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in minhash_hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == {d: top for d, (_, top) in _groups(rows, 85).items()}
    assert all(got[2 * k + 1] == 2 * k + (k + 1) % 2 for k in range(60))


def test_unlike_texts_of_one_template_make_no_links(spark):
    r = random.Random(12)
    head = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(head + [f"o{i}x{k}" for k in range(12)])) for i in range(120)] + [(500 + i, " ".join(head + [f"o{i}x{k}" for k in range(11)])) for i in range(40)]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in minhash_hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == {d: top for d, (_, top) in _groups(rows, 85).items()}


def test_index_finds_every_pair_under_the_guaranteed_distance():
    import numpy as np

    r = np.random.default_rng(0)
    n = minhash_hamming._SYMBOLS
    a = r.integers(0, 1 << minhash_hamming.BITS, (200, n)).astype(np.uint64)
    b = a.copy()
    for row in b:
        row[r.choice(n, 2 * minhash_hamming.CHUNKS - 1, replace=False)] ^= np.uint64(1)
    keys = minhash_hamming.index_keys(a), minhash_hamming.index_keys(b)
    assert ((keys[0] == keys[1]).sum(axis=1) > 0).all()
    assert (minhash_hamming.unpacked(minhash_hamming.packed(a)) == a).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 1), (None, 3), *((i, i + 1) for i in range(100, 140))]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: c for n, c in got.items() if n < 100 and n != c} == {2: 1, 3: 1, 4: 1, 9: 7, 8: 7}
    assert all(got[i] == 100 for i in range(101, 141))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _cut(rows):
    first = {}
    for d, t in rows:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], d), d)
    out = []
    for d, t in rows:
        keep = bytearray(b"\1" * len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < d:
                keep[s : s + 50] = b"\0" * 50
        left = bytes(x for x, y in zip(t, keep, strict=True) if y)
        runs = sum(not keep[i] and (i == 0 or keep[i - 1]) for i in range(len(t)))
        out.append((d, len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark):
    r = random.Random(3)
    words = ["the", "of", "a", "to", "it", "cat", "dog", "été", "x"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(r.randint(5, 60)) for _ in range(12)]
    rows = [(i * 3 if r.random() < 0.9 else 7, " ".join(r.choice([text(r.randint(0, 30)), r.choice(shared), r.choice(shared)[r.randint(0, 9) :]]) for _ in range(r.randint(1, 6)))) for i in range(250)]
    rows += [(9000, ""), (9001, "it " * 300), (9002, "it " * 200 + "zz" + "it " * 90), (9003, "a" * 400), (9004, "ba" + "a" * 300)]
    got = sorted(tuple(x) for x in bucket_refinement.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == _cut([(d, t.encode()) for d, t in rows])


def test_groups_are_sparks_own(spark):
    import numpy as np

    ids = [0, 1, -5, 1000, 10**15, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(37))).collect()
    assert bucket_refinement._group(np.array(ids, np.int64), 37).tolist() == [r[0] for r in rows]


def test_pointers_are_classes_of_windows():
    import numpy as np

    r = random.Random(9)
    parts = [bytes(r.choice(b"ab") for _ in range(90)) for _ in range(20)]
    stretches = [(p + r.choice(parts))[r.randrange(30) :][: r.randrange(50, 81)] for p in parts * 6] + [b"a" * 80] * 3
    data = np.frombuffer(b"".join(stretches), np.uint8)
    size = np.array([len(s) for s in stretches])
    pointer, classes, at = bucket_refinement.window_pointers(data, size), {}, 0
    for s in stretches:
        for k in range(len(s)):
            assert (pointer[at + k] >= 0) == (len(s) - k >= 50)
            if len(s) - k >= 50:
                classes.setdefault(s[k : k + 50], set()).add(int(pointer[at + k]))
        at += len(s)
    assert all(len(x) == 1 for x in classes.values()) and len({min(x) for x in classes.values()}) == len(classes)


def test_repeats_with_frequent_grams_and_spaced_ids(spark, monkeypatch):
    monkeypatch.setattr(bucket_refinement, "HOT", 1 << 9)
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    phrase, passage = "a phrase of thirty bytes, held ", "a passage of more than fifty bytes that very many of all documents share. "
    rows = [(i * 1000, word(r.randrange(20, 60)) + phrase + word(r.randrange(20, 60)) + (passage if i % 3 == 0 else "") + word(10) + (phrase * 2 if i % 5 == 0 else "")) for i in range(400)]
    rows += [(7000, rows[3][1]), (None, rows[0][1]), (None, rows[0][1]), (400_000, None)]
    out = bucket_refinement.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    named = [(d, (t or "").encode()) for d, t in rows if d is not None]
    assert sorted(tuple(x) for x in out if x.doc_id is not None) == _cut(named)
    assert [(x.n_bytes, x.n_removed, x.n_spans) for x in out if x.doc_id is None] == [(len(rows[0][1]), 0, 0)] * 2


def test_repeats_odd_rows(odd, odd_rows, nothing):
    out = bucket_refinement.remove_repeats(odd, text=True)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert out.count() == len(odd_rows)
    assert bucket_refinement.remove_repeats(nothing).count() == 0


def test_samples_depend_on_the_window_only():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 100, r.integers(0, 300)).astype(np.uint8)) for _ in range(200)] + [b"it " * 200, b"a" * 500, b""]
    from parlance.llm import kernels

    data, offsets = kernels.buffers(pa.array(texts, pa.binary()))
    s = bucket_refinement.Samples(data, offsets)
    windows, place = {}, {}
    for p, low, high in zip(s.place, s.low, s.high, strict=True):
        for w in range(low, high + 1):
            assert windows.setdefault(w, p) == p
            assert place.setdefault(data[w : w + 50].tobytes(), p - w) == p - w
    assert len(windows) == sum(max(0, len(t) - 49) for t in texts)


def _signatures(text):
    """The definition, word by word."""
    import xxhash

    def hashed(*words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64(w.encode(), seed=seed).intdigest() if w is not None else seed
        return seed - (1 << 64) if seed >> 63 else seed

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    content, since = [], 0
    for w in words:
        if w in spot_signatures.COMMON:
            since = 0
        else:
            content.append((w, since == 0 or since >= spot_signatures.FAR and hashed(w) % spot_signatures.ONE_IN == 0))
            since += 1
    return {hashed(w, content[i + 1][0] if i + 1 < len(content) else None) for i, (w, spot) in enumerate(content) if spot}


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _next_documents(rows):
    """{row number: text of the next document}"""
    order = sorted((i for i, (d, _) in enumerate(rows) if d is not None), key=lambda i: (-rows[i][0], rows[i][1] or ""))
    out = {i: rows[order[(k + 1) % len(order)]][1] or "" for k, i in enumerate(order)}
    return out | {i: rows[order[0]][1] or "" if order else "" for i, (d, _) in enumerate(rows) if d is None}


@pytest.mark.parametrize("far", [False, True])
def test_next_document_edits_and_likeness(spark, nothing, far):
    r = random.Random(2)
    vocabulary = "the of and der la cat dog sat été Haus casa grande lamp stone river 1984 #tag 日本 語 мир дом сад лес".split()
    text = lambda n: "".join(r.choice(vocabulary) + r.choice("  \n") for _ in range(n))
    rows = [(i * 7 + r.randrange(5), text(r.randrange(0, 40))) for i in range(1500)]
    rows += [(r.randrange(10**6), "".join(r.choice("абвгд ") for _ in range(r.randrange(200)))) for _ in range(50)] + [(None, text(9)), (None, None), (rows[5][0], "the same id"), rows[6], rows[6]]
    if far:
        rows += [(1 << 60, "far off"), (-(1 << 61), "far off, too"), ((1 << 63) - 1, None)]
    out = collections.Counter(
        (x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9))
        for x in spot_signatures.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    )
    after = _next_documents(rows)
    want = collections.Counter()
    shown = lambda sigs: ",".join(f"{x & (1 << 64) - 1:X}" for x in sorted(sigs))
    for i, (d, t) in enumerate(rows):
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[i][:half]
        own, changed, then = _signatures(t), _signatures(edited), _signatures(after[i])
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(changed), round(_like(own, changed), 9), round(_like(own, then), 9)] += 1
    assert out == want
    assert spot_signatures.compare_with_next(nothing).count() == 0


def test_fingerprints(odd, odd_rows):
    out = spot_signatures.compare_with_next(odd).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in out)
    nameless = spot_signatures.compare_with_next(odd.where("doc_id IS NULL")).collect()
    assert [x.doc_id for x in nameless] == [None]


def test_similar_documents_equal_all_pairs(spark, odd, nothing):
    r = random.Random(8)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(300))]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([6, 60, 200]))) for _ in range(20)]
    rows = list(enumerate(base + [_edited(r, r.choice(base), r.randrange(1, 4)) for _ in range(60)] + base[:6] + ["", "the of", None]))
    sets = {d: frozenset(_signatures(t or "")) for d, t in rows}
    classes = {}
    for d, s in sets.items():
        if s:
            classes.setdefault(s, d)
    links = {s: sum(_like(s, x) >= 0.8 for x in classes if x != s) for s in classes}
    want = {d: (len(s), classes.get(s, d), links.get(s, 0)) for d, s in sets.items()}
    got = {x.doc_id: (x.n_signatures, x.class_id, x.n_links) for x in spot_signatures.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(links.values()) > 0
    assert spot_signatures.similar_documents(odd).count() == odd.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert spot_signatures.similar_documents(nothing).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_similar_pairs_equal_all_pairs(spark, similarity):
    r = random.Random(4)
    sets = [set(r.sample(range(60), r.randrange(0, 30))) for _ in range(60)]
    sets += [s - {next(iter(s))} | {99} if s else s for s in sets[:30]]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, sigs array<long>")
    got = {(x.a, x.b) for x in spot_signatures.similar_pairs(rows, similarity).collect()}
    assert got == {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def test_common_words_between_do_not_matter(spark):
    row = spark.createDataFrame([("the cat of the dog sat", "The cat and dog sat", "the cat of dogs sat")], "a string, b string, c string")
    a, b, c = (spot_signatures.signatures(F.col(x)) for x in "abc")
    assert tuple(row.select(a == b, a == c).first()) == (True, False)
