"""Tool calls, image copies, and the pipeline's stages."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import bpe, media, mixing, toolchat

SCHEMAS = {"get": {"key": ("string", True), "n": ("integer", False)}, "put": {"items": ("array", True), "opts": ("object", False), "x": ("number", False), "ok": ("boolean", False)}}


def test_link(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    msgs = [
        (1, 0, "user", "hi {tool_calls"),
        (1, 1, "assistant", call(("a", "get", '{"n": 1, "key": "k\\u00e9\\n"}'), ("b", "put", '{"items": [2, {"z": 1, "a": null}], "$ref": ["a"]}'))),
        (1, 2, "tool", result("a", "A")), (1, 3, "tool", result("a", "later")), (1, 4, "tool", result("zz", "orphan")),
        (1, 5, "assistant", call(("c", "put", '{"items": 1, "x": 2.5, "ok": "no", "$ref": ["b", "a"]}'), ("a", "get", '{"key": "again"}'), (None, "get", '{"key": "x"}'))),
        (1, 6, "assistant", call(("d", "nope", "{}"), ("e", "get", "not json"), ("f", "get", '{"key": "k", "more": 1, "$ref": ["gone"]}'))),
        (2, 0, "assistant", call(("p", "get", '{"key": "1", "$ref": ["q"]}'), ("q", "get", '{"key": "2", "$ref": ["p"]}'), ("r", "get", '{"n": 1, "$ref": ["q"]}'))),
        (None, 0, "assistant", call(("a", "get", '{"key": null}'))), (3, None, "assistant", None), (3, 1, "assistant", "plain tool_calls text"), (3, 2, "tool", None),
    ]
    calls, results = toolchat.read_calls(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.call_id, r.turn, r.level): r for r in toolchat.link(calls, results, SCHEMAS).collect()}
    at = lambda c, i: next(r for k, r in got.items() if k[:2] == (c, i) and "repeated" not in r.problems)
    assert len(got) == 12
    a, b, c = at("1", "a"), at("1", "b"), at("1", "c")
    assert (a.level, a.n_results, a.problems) == (0, 2, "") and (b.level, b.problems) == (1, "no result")
    assert (c.level, c.problems) == (2, "no result, type of items, type of ok")
    assert a.record == '{"arguments":{"key":"ké\\n","n":1},"id":"a","level":0,"name":"get","result":"A"}'
    assert b.record == '{"arguments":{"$ref":["a"],"items":[2,{"a":null,"z":1}]},"id":"b","level":1,"name":"put"}'
    assert at("1", "d").problems == "no result, unknown tool" and at("1", "e").problems == "no result, arguments"
    assert at("1", "f").problems == "dangling reference, no result, unknown field" and at("1", "f").level == 0
    assert {at("2", x).problems for x in "pq"} == {"cycle, no result"} and at("2", "r").problems == "cycle, no result, missing key"
    assert at(None, "a").problems == "no result, missing key"  # null is told from the empty conversation
    assert sorted(r.problems for r in got.values() if "id" in r.problems.split(", ")[0]) == ["no id", "repeated id"]
    assert toolchat.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def brute_copies(described, queries):
    """Links by comparing all features of a query with all of an image, with the same votes."""
    found = set()
    for q in queries:
        qp, qb = described[q]
        for i, (fp, fb) in described.items():
            if not len(qp) or not len(fp):
                continue
            a, b = np.nonzero((qb[:, None] != fb[None]).sum(-1) <= media.NEAR)
            ratio, turn = fp[b, 2] / qp[a, 2], fp[b, 3] - qp[a, 3]
            sx = fp[b, 0] - ratio * (np.cos(turn) * qp[a, 0] - np.sin(turn) * qp[a, 1])
            sy = fp[b, 1] - ratio * (np.sin(turn) * qp[a, 0] + np.cos(turn) * qp[a, 1])
            for g in (0, 0.5):
                cell = {}
                for k, key in zip(a, zip(np.round(np.log2(ratio) * 1.5), np.floor(turn / (np.pi / 6) % 12 + g) % 12, np.floor(sx / 24 + g), np.floor(sy / 24 + g), strict=True), strict=True):
                    cell.setdefault(key, set()).add(k)
                if any(len(v) >= media.VOTES for v in cell.values()):
                    found.add((q, i))
    return found


def pictures(rng, n=30):
    """Pictures, and for each a crop to about a third of each side, one to a half, and one at 0.85 of its size, which is no level's."""
    imgs = {i: media.resize(media._box(rng.normal(0, 1, (96, 96)).astype(np.float32), 1), 192, 192) for i in range(n)}
    imgs = {i: np.clip((a - a.min()) / (a.max() - a.min()) * 255, 0, 255).astype(np.uint8) for i, a in imgs.items()}
    edits = {100 + i: imgs[i][60:126, 64:130] for i in range(n)} | {200 + i: imgs[i][30:130, 40:140] for i in range(n)}
    return imgs | edits | {300 + i: media.resize(imgs[i].astype(float), 163, 163).astype(np.uint8) for i in range(n)}


def image_rows(imgs):
    return [(i, x.shape[0], x.shape[1], bytearray(x.tobytes())) for i, x in imgs]


IMAGES = "image_id long, height int, width int, pixels binary"


def plain_levels(deps):
    """call -> level by repeated passes; calls on a cycle or behind one are missing."""
    out = {c: 0 for c, d in deps.items() if not d}
    while True:
        new = {c: 1 + max(out[x] for x in d) for c, d in deps.items() if c not in out and d and all(x in out for x in d)}
        if not new:
            return out
        out |= new


def test_levels_of_chains_graphs_and_cycles(spark):
    rng = random.Random(9)
    deps = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(1000)}
    deps |= {f"g{i}": sorted({f"g{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))}) if i else [] for i in range(60)}
    deps |= {"m0": ["c999", "g59"], "m1": ["m0", "c3"], "r0": ["r1"], "r1": ["r2"], "r2": ["r0"], "r3": ["r0"], "r4": ["r3", "c1"], "r5": ["r4"], "s": ["s"]}
    nodes = spark.createDataFrame([("k", c) for c in deps], "conv_id string, call_id string")
    edges = spark.createDataFrame([("k", c, d) for c, ds in deps.items() for d in ds], "conv_id string, call_id string, dep string")
    got = {r.call_id: r.level for r in toolchat.levels(nodes, edges).collect()}
    assert got == plain_levels(deps) and got["c999"] == 999 and "r5" not in got


def test_repeats_and_null_conversations(spark):
    call = lambda conv, turn, id_, args="{}", name="f": (conv, turn, 0, id_, name, args)
    rows = [call("a", 1, "x")] * 3 + [call("a", 2, "x"), call(None, 1, "y"), call("", 1, "y"), call("a", 3, None), call("a", 3, None), call("", 5, "z", '{"$ref": "y"}'), call("", 6, "w", '{"$ref": 7}'), call("", 7, "v", '{"$ref": ["y", "no"]}')]
    calls = spark.createDataFrame(rows, "conv_id string, turn long, pos int, call_id string, name string, arguments string").withColumns({"first": F.lit(1), "level": F.lit("x")})
    results = spark.createDataFrame([(None, 2, "y", "null's"), ("", 2, "y", "empty's")], "conv_id string, turn long, call_id string, content string")
    got = toolchat.link(calls, results, {"f": {}}).collect()
    assert len(got) == len(rows)
    of = lambda conv, id_: sorted(((r.turn, r.level, r.problems) for r in got if (r.conv_id, r.call_id) == (conv, id_)), key=str)
    assert of("a", "x") == [(1, 0, "no result"), (1, None, "repeated id"), (1, None, "repeated id"), (2, None, "repeated id")]
    assert sum("repeated id" in r.problems for r in got) == 3 and sum("no id" in r.problems for r in got) == 2
    assert [json.loads(r.record)["result"] for r in got if r.call_id == "y" and r.conv_id is None] == ["null's"] and [json.loads(r.record)["result"] for r in got if r.call_id == "y" and r.conv_id == ""] == ["empty's"]
    assert of("", "z") == [(5, 1, "no result")] and of("", "w") == [(6, 0, "references, no result")] and of("", "v") == [(7, 1, "dangling reference, no result")]


def test_image_copies_against_brute_force(spark):
    """Recall of the key tables over all links that comparing every feature with every other finds, and of the edits themselves."""
    imgs = pictures(np.random.default_rng(8))
    described = {i: media.describe_image(x) for i, x in imgs.items()}
    want = brute_copies(described, range(30))
    f = media.describe(spark.createDataFrame(image_rows(imgs.items()), IMAGES))
    got = {(r.query_id, r.image_id) for r in media.find_copies(f, f.where("image_id < 30")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    for edit, share in ((0, 1.0), (100, 0.9), (200, 0.9), (300, 0.9)):
        assert len({(i, edit + i) for i in range(30)} & got) >= share * 30, edit
    assert len(got) <= 125
    few, media.FEW_KEYS = media.FEW_KEYS, 0  # without the broadcast
    try:
        assert {(r.query_id, r.image_id) for r in media.find_copies(f, f.where("image_id < 30")).collect()} == got
    finally:
        media.FEW_KEYS = few


def test_image_classes(spark):
    """Planted edits; equal pictures are searched for once; repeated ids, broken and blank images."""
    rng = np.random.default_rng(5)
    imgs = [(i, media.draw(rng.normal(0, 0.2, 64))) for i in range(1, 60)]
    imgs += [(1000 + i, media.edit(x, i % 4)) for i, x in imgs if i % 5 == 0]
    imgs += [(70, imgs[4][1]), (75, imgs[4][1]), (2003, np.zeros((128, 128), np.uint8)), (7, imgs[6][1])]  # id 5 thrice, 7 twice
    rows = [*image_rows(imgs), (2000, 10, 10, bytearray(100)), (2001, 5, 5, bytearray(3)), (2002, None, 4, None), (None, 128, 128, bytearray(imgs[0][1].tobytes()))]
    images = spark.createDataFrame(rows, IMAGES).repartition(3)
    got = {r.image_id: (r.class_id, r.n_links) for r in classes_of(images, "image_id % 5 = 0 and image_id < 100").collect()}
    want = {i: (i, 0) for i, *_ in rows if i is not None}
    want |= {1000 + i: (i, 1) for i in range(5, 60, 5)} | {5: (5, 2), 70: (5, 2), 75: (5, 2), 1005: (5, 3)}
    assert got == want
    assert classes_of(images.limit(0), "image_id = 5").count() == 0


def classes_of(images, asked):
    heads, members = media.distinct_pictures(images, ["height", "width", "pixels"])
    f = corpus_pipeline.save(media.describe(heads), "features")
    shown = members.where(asked).select(F.col("head").alias("image_id")).distinct()
    return media.image_classes(f, members, members.where(asked).select("image_id"), f.join(shown, "image_id", "left_semi"))


def brute_classes(links, queries, ids):
    """image -> (class, links) from all links (query, image): classes of query images first, then what they connect."""

    def least(edges, nodes):
        root = {x: x for x in nodes}
        for _ in nodes:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    among = least([(a, b) for a, b in links if b in queries], queries)
    whole = least(links, ids)
    out = {}
    for i in ids:
        met = {among[q] for q, x in links if x == i} | ({among[i]} if i in queries else set())
        out[i] = (whole[i], sum(among[q] in met for q in queries if q != i))
    return out


def halves(a, b):
    return np.concatenate([a[:, :64], b[:, :64]], axis=1)


def test_image_classes_lose_no_link(spark):
    """Pictures of two halves that link to several classes, a chain of half overlaps, and 60 pictures against all links found."""
    rng = np.random.default_rng(6)
    a, c, d = (media.draw(rng.normal(0, 0.2, 64)) for _ in range(3))
    base = [media.draw(rng.normal(0, 0.2, 64)) for _ in range(13)]
    imgs = [(5, a), (10, halves(a, c)), (15, d), (1001, halves(c, d))]
    imgs += [(100 + 5 * k, halves(base[k], base[k + 1])) for k in range(12)]  # each shares a half, at its place or moved, with the next
    imgs += [(k, base[3]) for k in (402, 403, 404, 405)]  # equal pictures, one of them asked for
    imgs += [(200 + k, media.draw(rng.normal(0, 0.2, 64))) for k in range(30)] + [(300 + 5 * k, media.edit(base[k], k % 4)) for k in range(12)] + [(400, base[3]), (401, base[4])]
    f = corpus_pipeline.save(media.describe(spark.createDataFrame(image_rows(imgs), IMAGES)), "features")
    asked = f.where("image_id % 5 = 0")
    links = {(r.query_id, r.image_id) for r in media.find_copies(f, asked).collect()}
    assert (10, 1001) in links and (15, 1001) in links
    queries, ids = {i for i, _ in imgs if i % 5 == 0}, {i for i, _ in imgs}
    got = {r.image_id: (r.class_id, r.n_links) for r in classes_of(spark.createDataFrame(image_rows(imgs), IMAGES), "image_id % 5 = 0").collect()}
    assert got == brute_classes(links, queries, ids) and got[1001] == (5, 3)


@pytest.fixture(scope="module")
def staged(spark):
    docs, seen = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.save(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        seen.append((name, docs, out))
        docs = out
    return seen


def test_stages(spark, staged):
    assert [n for n, *_ in staged] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing to target weights", "bpe encoding"]
    first = staged[0][1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in staged[0][2].collect()}
    assert all(i in kept for i, q in labels.items() if q) and sum(i in kept for i, q in labels.items() if not q) <= 1
    for _, before, after in staged[:-1]:
        assert after.columns == first.columns
        assert after.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or _ .startswith("mixing")
    texts = {}
    for r in staged[1][1].collect():
        texts.setdefault(r.text, []).append(r.doc_id)
    assert {(r.doc_id, r.text) for r in staged[1][2].collect()} == {(max(v), t) for t, v in texts.items()}
    plan = {r.id: r.copies for r in mixing.plan(staged[3][1]).collect()}
    got = {r.doc_id: r.n for r in staged[3][2].groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {i: n for i, n in plan.items() if n}
    enc = bpe.Encoder(bpe.word_bpe())
    text = {r.doc_id: r.text for r in first.collect()}
    for r in staged[4][2].limit(20).collect():
        assert r.ids == enc.encode([text[r.doc_id]])[0].tolist()
