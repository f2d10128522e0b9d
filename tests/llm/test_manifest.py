"""Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewire.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests, arity):
    """(root, proofs) by whole levels."""
    proofs, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for j, (_, below) in enumerate(run):
                for i in below:
                    proofs[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((h(*[d for d, _ in run]), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], proofs


def plain_forest(rows, arity):
    """doc_id -> (subroot, root, proof) of rows (doc_id, lang, leaf)."""
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted([r for r in rows if r[1] == x], key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for x in langs}
    trees = {x: plain_tree([r[2] for r in own[x]], arity) for x in langs}
    root, tops = plain_tree([trees[x][0] for x in langs], arity)
    return [(r[0], r[1], r[2], trees[x][0], root, p + t) for x, t in zip(langs, tops) for r, p in zip(own[x], trees[x][1])]


@pytest.mark.parametrize(("arity", "block"), [(2, 4096), (2, 4), (3, 9), (3, 2)])
def test_proofs(spark, arity, block):
    sizes = {"en": 61, "de": 1, None: 17, "": 2, "é": 8, "z": 9, "=": 3}
    rows = [(i, lang, h(str(lang), str(i))) for lang, n in sizes.items() for i in range(n)]
    rows += [(5, "en", h("again")), (5, "en", h("again")), (None, "en", h("no id"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumns({"pos": F.lit("mine"), "n": F.lit(7), "tree": F.lit(None).cast("string")})
    got = manifest.proofs(df, "lang", ["doc_id"], arity=arity, block=block)
    assert got.columns == ["doc_id", "lang", "leaf", "pos", "n", "tree", "proof", "subroot", "root"]
    got = got.withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root and r.pos == "mine" for r in got)
    key = lambda r: (r[0] is not None, r[0] or 0, str(r[1]), r[2], str(r[5]))
    have = sorted([(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got], key=key)
    assert have == sorted(plain_forest(rows, arity), key=key)


def test_empty(spark):
    assert manifest.proofs(spark.createDataFrame([], "doc_id long, lang string, leaf string"), "lang", ["doc_id"]).collect() == []


def test_leaves_and_tampering(spark, tmp_path):
    rows = [(i, ["ü" * i, None, ""][i % 3], ["a", "b", None][i % 3], "en" if i % 2 else None, None if i % 5 == 0 else i) for i in range(40)] + [(10**6, "long " * 200_000, "a", "en", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {d: h(*map(field, (d, s, g, n, t))) for d, t, s, g, n in rows}
    for d, lang, digest, subroot, root, proof in plain_forest([(r[0], r[3], leaf[r[0]]) for r in rows], 2):
        r = got[d]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (digest, subroot, root, h(*[b + a for b, a in proof]))
        text, source, n = next((t, s, n) for i, t, s, _, n in rows if i == d)
        struck = zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        assert r.verified == (not struck)
        x = h(*map(field, (d, source, lang, n + 1 if struck else n, text)))
        for b, a in proof:
            x = h(b, x, a)
        assert r.folded_root == x
