"""Exact and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup as ex
from tidewire.llm import simhash as sh

SCHEMA = "doc_id long, text string, source string, digest string, rest int"


def rows():
    rng = random.Random(3)
    texts = ["", None, "a", "A", "a ", "same text", "x" * 50_000, "two\nlines"]
    out = [(i, rng.choice(texts), "s", "d", i) for i in range(300)]
    return out + [(7, "same text", "s", "d", 7)] * 3 + [(None, "same text", "t", "d", 1), (None, "only null id", "t", "d", 1), (5, "same text", "z", "d", 2)]


def want(data):
    by = {}
    for i, t, *_ in data:
        by.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


def test_groups(spark):
    data = rows()
    docs, by = spark.createDataFrame(data, SCHEMA).repartition(6), want(data)
    expect = sorted(((i, *by[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in data), key=str)
    assert sorted((tuple(r) for r in ex.groups(docs).collect()), key=str) == expect
    weak = lambda c: F.length(c).cast("string")  # noqa: E731  many texts share a digest
    few = ex.groups(docs, salts=3)  # every text here is hot
    assert sorted((tuple(r) for r in few.collect()), key=str) == expect
    got = sorted(((r.id, r.keep, r.n) for r in ex.groups(docs, digest=weak).collect()), key=str)
    assert got == [e[:3] for e in expect]


def test_exact_dedup_keeps_one_row(spark):
    data = rows()
    docs, by = spark.createDataFrame(data, SCHEMA), want(data)
    got = ex.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(((r.text, r.doc_id) for r in got.collect()), key=str) == sorted(((t, k) for t, (k, _) in by.items()), key=str)
    assert all(tuple(r) in {(i, t or "", *x) for i, t, *x in data} for r in got.collect())
    assert ex.exact_dedup(docs.limit(0)).count() == 0 and ex.groups(docs.limit(0)).count() == 0


def brute(texts):
    """Contract fingerprints, and components of links at 2 or fewer differing bits."""
    fps = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return fps, [find(a) for a in range(len(texts))]


def near_texts():
    rng = random.Random(11)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 60, 400]))) for _ in range(40)]
    out = []
    for t in base:
        for _ in range(rng.choice([1, 1, 3, 8])):
            w = t.split(" ")
            if len(w) > 50:
                for _ in range(rng.randrange(3)):
                    w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return [*out, "", " \t\n", "ABC Def", "abc def", "é\x1cü a b", "a\xa0b c d e"]


def test_contract_components(spark):
    texts = near_texts()
    fps, root = brute(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "doc_id long, text string").repartition(5)
    for tile in (4096, 3):
        f = sh.fingerprints(docs)
        got = f.join(sh.near_groups(f, sh.exact_keys(4, 2), slice(0, 1), 2, tile), "fp").select("id", F.lower(F.hex("fp")), "component").collect()
        empty = fps.index(0)
        expect = {i: (f"{fps[i]:016x}", root[i]) for i in range(len(texts))} | {9999: ("0" * 16, root[empty])}
        assert {r[0]: (r[1], r[2]) for r in got} == expect


def test_bit_sliced_links_equal_popcount():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, (20, 2), dtype=np.uint64)[rng.integers(0, 20, 700)]
    for i in range(700):
        for _ in range(rng.integers(0, 9)):
            fp[i, rng.integers(0, 2)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    group = np.sort(rng.integers(0, 9, 700))
    for radius in (0, 1, 5, 8, 64, 128):
        d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)
        a, b = np.nonzero(np.triu((d <= radius) & (group[:, None] == group[None]), 1))
        got = sh.links(group, fp, radius)
        assert [x.tolist() for x in got] == [x.tolist() for x in sh._forest(700, a, b)]


def shingles(t):
    w = sh.plain_words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_recall_and_precision(spark):
    """All pairs of similarity 0.8 and more are found; unrelated texts are left alone."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts, pairs = [], []
    for _ in range(150):
        w = [rng.choice(words) for _ in range(rng.randrange(40, 500))]
        copy = list(w)
        for _ in range(rng.randrange(0, max(1, len(w) // 55))):
            copy[rng.randrange(len(w))] = rng.choice(words)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(w), " ".join(copy).upper() + "."]
    lone = len(texts)
    texts += [" ".join(rng.choice(words) for _ in range(120)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "row") for i, t in enumerate(texts)] + [(None, None, "row"), (5000, "", "row")], "doc_id long, text string, row string")
    got = sh.near_dedup(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    near = [(a, b) for a, b in pairs if len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b]))]
    assert len(near) > 100 and all(a in kept for a, _ in pairs)
    assert all(b not in kept for _, b in near)
    assert all(i in kept for i in range(lone, len(texts)))
    assert None in kept and 5000 not in kept  # both empty: the null id counts as smallest
    assert sh.near_dedup(docs.limit(0)).count() == 0


def edited(rng, words, low, high, n):
    """Pairs of texts, the second with its tail cropped, a passage appended or words exchanged, of similarity from low to under high."""
    out = []
    while len(out) < n:
        w = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        kind, x = len(out) % 3, rng.uniform(0.05, 0.35)
        copy = w[: int(len(w) * (1 - x))] if kind == 0 else w + [rng.choice(words) for _ in range(int(len(w) * x))] if kind == 1 else [rng.choice(words) if rng.random() < x / 9 else v for v in w]
        a, b = shingles(" ".join(w)), shingles(" ".join(copy))
        if low <= len(a & b) / len(a | b) < high:
            out.append((" ".join(w), " ".join(copy)))
    return out


def test_near_dedup_finds_every_block_edit(spark):
    """Cropped and appended copies just over 0.8, and one large group: all but the first of each go."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    pairs = edited(rng, words, 0.8, 0.86, 120)
    texts = [t for p in pairs for t in p]
    base = [rng.choice(words) for _ in range(200)]
    texts += [" ".join(base)] + [" ".join(rng.choice(words) if rng.random() < 0.01 else v for v in base) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [shingles(t) for t in texts]
    hot, root = range(240, len(texts)), list(range(len(texts)))
    for a in hot:
        for b in range(240, a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    want = set(range(0, 240, 2)) | {root[i] for i in hot}
    for tiles in ((sh.SKETCH_TILE, sh.SET_TILE), (64, 32)):  # the second cuts the large group into tiles
        assert {r.doc_id for r in sh.near_dedup(docs, tiles=tiles).collect()} == want


def test_near_dedup_leaves_pairs_under_the_threshold(spark):
    """Block and word edits of similarity 0.70 to 0.79 are no near copies: every document stays."""
    rng = random.Random(22)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [t for p in edited(rng, words, 0.7, 0.795, 120) for t in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sh.near_dedup(docs).count() == len(texts)


def test_near_dedup_equals_brute_force_on_documents(spark):
    """All documents of the smallest table but one: recall and precision at the declared similarity are whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    sets = [shingles(texts[i]) if sh.plain_words(texts[i]) else set() for i in ids]
    by, root = {}, list(range(len(ids)))
    for k, s in enumerate(sets):
        for x in s or {None}:
            by.setdefault(x, []).append(k)
    for a, b in {(a, b) for ks in by.values() for a in ks for b in ks if a < b}:
        x, y = sets[a], sets[b]
        if root[a] != root[b] and len(x & y) >= 0.8 * len(x | y):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if r == hi else r for r in root]
    assert sorted(r.doc_id for r in sh.near_dedup(docs).collect()) == sorted(ids[r] for r in set(root))


def test_set_links_connect_what_brute_force_links():
    rng = np.random.default_rng(9)
    sets = [np.zeros(0, np.uint64)]
    for _ in range(30):
        base = rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)
        for _ in range(rng.integers(1, 6)):
            sets.append(np.unique(np.r_[base[rng.random(len(base)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)]))
    sets.append(np.zeros(0, np.uint64))
    group = np.sort(rng.integers(0, 3, len(sets)))
    a, b = sh.set_links(0.8)(group, [s.tobytes() for s in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if group[i] == group[j] and len(u := np.union1d(sets[i], sets[j])) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(u)]
    want = sh._forest(len(sets), *np.array(pairs).T)
    got = sh._forest(len(sets), a, b)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] and len(a) == len(want[0])
