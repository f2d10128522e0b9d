"""Mixing against brute force."""

import re

from tidewire.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight; stop at most * size; reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        got = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if got[s] > most * sizes[s]}
        if not over:
            return got
        capped |= over


def make(spark, n=3000):
    src = [None, "b", "a", "é", "zz", "tiny"]
    rows = [(i, "w " * (i * 7919 % 90) if i % 50 else None, "tiny" if i in (3, 5) else src[min(4, i % 9 % 7 if i % 3 else 0)], i) for i in range(n)]
    return rows + [(1, "dup dup", "a", 1)] * 4 + [(None, "no id here", "a", 0)], "doc_id long, text string, source string, m int"


def test_plan(spark):
    rows, schema = make(spark)
    docs = spark.createDataFrame(rows, schema).repartition(5)
    p = mixing.plan(docs).toPandas()
    assert p.m.sum() == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    for s, g in p.groupby("source", dropna=False):
        s = None if s != s else s
        assert set(g.source_size) == {sizes[s]}
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs((g["size"] * g.copies).sum() - want[s]) <= max(g["size"]), s
    assert (p.copies <= 3 * p.m).all() and (p.copies >= 0).all()
    again = mixing.plan(docs.repartition(3)).toPandas()
    key = ["id", "h"]
    assert p.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert not p.copies.equals(mixing.plan(docs, seed=9).toPandas().copies)


def test_rounding_is_unbiased(spark):
    items = spark.createDataFrame([("s", i, i * 31, 1 + i % 40, 0.3) for i in range(200)], "source string, id long, h long, w long, p double")
    n, rounds = 0, 12
    for seed in range(rounds):
        got = mixing.round_copies(items, seed, fan=8).toPandas()
        assert len(got) == 200
        words = sum((1 + i % 40) * b for i, b in zip(got.id, got.bit, strict=True))
        assert abs(words - 0.3 * sum(1 + i % 40 for i in range(200))) <= 20
        n += got.bit.sum()
    assert abs(n / (200 * rounds) - 0.3) < 0.04


def test_mix_repeats_rows(spark):
    rows, schema = make(spark, 400)
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = {(r.id, r["source"], r["size"]): 0 for r in mixing.plan(docs).collect()}
    for r in mixing.plan(docs).collect():
        want[(r.id, r["source"], r["size"])] += r.copies
    got = dict.fromkeys(want, 0)
    for r in out.collect():
        got[(r.doc_id, r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))] += 1
    assert got == want
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_that_differ_in_nulls_or_maps_stay_apart(spark):
    """Rows with one id that differ only in where a null stands, or within a nested column, are different rows."""
    rows = [(1, "a b", "s", None, "q", {"k": 1}, (None, "x")), (1, "a b", "s", "q", None, {"k": 1}, (None, "x")), (1, "a b", "s", "q", None, {"k": 2}, (None, "x")), (1, "a b", "s", "q", None, {"k": 2}, ("x", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, a string, b string, m map<string,int>, st struct<u:string,v:string>")
    p = mixing.plan(docs).collect()
    assert len(p) == 4 and all(r.m == 1 and r.copies == 1 for r in p)
    key = lambda r: (r.a, r.b, tuple(r.m.items()), r.st.u, r.st.v)
    assert sorted(map(key, mixing.mix(docs).collect()), key=str) == sorted(map(key, docs.collect()), key=str)
