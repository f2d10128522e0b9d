"""Quality, secret and licence models: held-out accuracy and brute force."""

import random
import re
import textwrap

import numpy as np

from tidewire.llm import licenses, quality, secrets


def prose(rng, n):
    """Words in sentences; no word follows itself."""
    out = []
    while len(out) < n:
        w = rng.choice(["the", "and", "harbour", "evening,", "slowly", "of", "letters.", "a", "between", "winter"]) if rng.random() < 0.5 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 11)))
        if not out or out[-1] != w:
            out.append(w)
    return " ".join(out).capitalize() + "."


def spoil(rng, text):
    w = text.split()
    return rng.choice([" ".join(x + rng.choice(["***", "$$$", "%%%"]) for x in w), " ".join(x.upper() + "!!" for x in w), " | ".join(w)])


def test_quality_on_labelled_documents(spark):
    """The labels of the table are not trained on."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.score(docs.select("doc_id", "text"), quality.fit(docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    right = (got.score >= 0.5) == (got.quality == 1)
    assert right[got.quality == 1].mean() >= 0.99 and right[got.quality == 0].mean() >= 0.9


def test_quality(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        t = prose(rng, rng.randrange(25, 200))
        good = rng.random() < 0.75
        rows.append((i, t if good else spoil(rng, t), int(good)))
    docs = spark.createDataFrame([*rows, (700, "", 0), (701, None, 0), (None, "  \n", 0)], "doc_id long, text string, score int")
    model = quality.fit(docs)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "weak_label", "_score"]
    p = got.toPandas()
    seen = p[p.doc_id < 700]
    assert ((seen._score >= 0.5) == (seen.score == 1)).mean() > 0.97
    assert ((seen.weak_label >= 0.5) == (seen.score == 1)).mean() > 0.95
    assert (p[~(p.doc_id < 700)]._score == 0).all()
    # the scorer has not seen these
    fresh = [(good := k % 2, model.judge(t if good else spoil(rng, t))[1]) for k in range(200) if (t := prose(rng, 80))]
    assert np.mean([(s >= 0.5) == bool(g) for g, s in fresh]) > 0.95
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("score = 1").count() >= 0.98 * sum(r[2] for r in rows)
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.7
    acc = np.array([0.95, 0.8, 0.7, 0.9])
    v = np.where(rng.random((len(y), 4)) < acc, y[:, None], ~y[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = 2
    pattern, n = np.unique(v, axis=0, return_counts=True)
    prior, table = quality.fit_labels(pattern, n.astype(float))
    assert abs(prior - 0.7) < 0.02
    assert np.abs(table[1, :, 1] - acc).max() < 0.03 and np.abs(table[0, :, 0] - acc).max() < 0.03


def base(text):
    """The base patterns as written, one at a time."""
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_secrets(spark):
    rng = random.Random(6)
    token = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    odd = ["secret:token:abcdef", "toKen = ab, token=abcdefg", "toKen=abcdefgh ſecret=abcdefgh", "AKIAAKIA AKIA" + "Z" * 16, "é password: 'hunter22' deadbeef" + "0" * 24, "API_KEY==abc api-key=abcdefg", "0" * 23, "0" * 24 + "G" + "f" * 30, "", "passwd\t=abcdefg"]
    texts = odd + [prose(rng, 60) + rng.choice(["", ' token = "' + token(40, "0123456789abcdef") + '"', " AKIA" + token(16, "ABCDEFGHIJ0123456789"), "\nAPIKEY: " + token(32, b64)]) + " end" for _ in range(300)]
    hidden = {len(texts) + k: token(40, b64) for k in range(60)}
    texts += [prose(rng, 40) + " " + s + " " + prose(rng, 5) for s in hidden.values()]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    got = {r.id: [(s.start, s.end, s.kind) for s in r.spans] for r in secrets.scan(docs, secrets.fit(docs)).collect()}
    assert got[None] == []
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[2] != "markov"] == base(t), t
    found = {i for i, s in got.items() if any(x[2] == "markov" for x in s)}
    assert len(found & hidden.keys()) >= 0.95 * len(hidden) and len(found - hidden.keys()) <= 2
    for i in found & hidden.keys():
        assert any(texts[i][s[0] : s[1]] in hidden[i] or hidden[i] in texts[i][s[0] : s[1]] for s in got[i])
    assert secrets.scan(docs.limit(0), secrets.fit(docs.limit(0))).count() == 0


def test_licences(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(240):
        lines = [prose(rng, 20) for _ in range(4)]
        if i % 3 == 0:
            family = rng.choice(list(licenses.TEMPLATES))
            want[i] = family
            lines.insert(rng.randrange(5), rng.choice(licenses.TEMPLATES[family]))
        elif i % 3 == 1:
            lines.insert(2, rng.choice(["The driver showed a licence at the border.", "She had the copyright in mind, slowly.", "With your permission is the evening over."]))
        rows.append((i, rng.choice(["\n", "\n\n", " "]).join(lines)))
    mit = "Copyright (c) 2021 Some Body\n\n" + textwrap.fill(licenses.TEMPLATES["MIT"][4], 72) + "\n\n" + textwrap.fill(licenses.TEMPLATES["MIT"][5], 72)
    wrapped = {1100: mit, **{1101 + k: textwrap.fill(prose(rng, 30) + " " + max(licenses.TEMPLATES[f], key=len), 70) for k, f in enumerate(["Apache-2.0", "GPL", "BSD"])}}
    long = " ".join(prose(rng, 25) for _ in range(400)) + " Released under the MIT License. " + " ".join(prose(rng, 25) for _ in range(400)) + " Licensed under CC BY-NC 4.0."
    rows += [(1000, "x\nLicensed under the Foo Bar Licence, version 7.\ny"), (1001, None), (1002, ""), (1003, "Distributed under the ISC licence."), (1004, "This code is provided under the zlib license."), (1005, long), (1006, long), (1006, long), (1007, " \n.;")]
    rows += wrapped.items()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = licenses.fit(docs)
    found = licenses.scan(docs, model).collect()
    got, text = {r.id: r.licences for r in found}, dict(rows)
    right = sum([x.family for x in got[i]] == [f] for i, f in want.items())
    assert right >= 0.95 * len(want)
    assert sum(bool(got[i]) for i in range(240) if i not in want) <= 4
    for i in (1000, 1003, 1004):
        assert [x.family for x in got[i]] == ["unknown"], got[i]
    assert got[1001] == got[1002] == got[1007] == []
    assert {x.family for x in got[1100]} <= {"MIT", "unknown"} and "MIT" in {x.family for x in got[1100]}
    assert [{x.family for x in got[i]} for i in (1101, 1102, 1103)] == [{"Apache-2.0"}, {"GPL"}, {"BSD"}]
    assert [x.family for x in got[1005]] == ["MIT", "CC-BY-NC"] and "MIT License" in long[got[1005][0].start : got[1005][0].end]
    assert len(found) == len(rows) and all(r.licences == got[1005] for r in found if r.id == 1006)
    assert licenses.scan(docs.limit(0), licenses.fit(docs.limit(0))).count() == 0
    # every notice by itself, and wrapped
    for f, ts in licenses.TEMPLATES.items():
        for t in ts:
            for shown in (t, textwrap.fill(t, 72)):
                assert {x[0] for x in model.statements(shown)} == {f}, shown


def test_licence_scores_equal_brute_force():
    """Sums over a text's n-grams give what each segment's own features give."""
    rng = random.Random(7)
    model = licenses.train([prose(rng, 15).lower().split() for _ in range(50)], rounds=20)
    ws = licenses.words(" ".join([prose(rng, 40), *licenses.TEMPLATES["MIT"], prose(rng, 3)]))
    ends = np.cumsum([1, 2, 3, 10, 0, 25, len(ws) - 41])
    starts = np.r_[0, ends[:-1]]
    got = model.probabilities(starts, ends, licenses.grams(ws))
    for s, e, p in zip(starts, ends, got, strict=True):
        at, v = licenses.features(ws[s:e])
        z = (v @ model.weights[at] + model.weights[-1]) / model.temperature
        q = np.exp(z - z.max())
        assert np.abs(q / q.sum() - p).max() < 1e-4


def test_markov_spans_equal_brute_force(spark):
    """Every run of LEAST and more letters apart from the base spans is judged by the sum of its transitions."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcXYZ019+/_=- .,\n") for _ in range(rng.randrange(0, 400))) + rng.choice(["", " token=abcdef" + "0a" * 14]) for _ in range(80)] + ["", None, "x" * 30_000, "q7" * 4000]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    llr = secrets.fit(docs)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    for r in secrets.scan(docs, llr).collect():
        t, want = texts[r.id] or "", []
        known = base(t)
        for m in re.finditer(f"[{re.escape(letters)}]{{8,}}", t):
            if m.end() - m.start() >= secrets.LEAST and not any(s < m.end() and m.start() < e for s, e, _ in known):
                at = [0] + [letters.index(c) + 1 for c in m[0]]
                x = sum(llr[a, b] for a, b in zip(at, at[1:], strict=False))
                if x >= secrets.TOTAL and x >= secrets.MEAN * len(m[0]):
                    want.append((m.start(), m.end()))
        assert [(s.start, s.end) for s in r.spans if s.kind == "markov"] == want
