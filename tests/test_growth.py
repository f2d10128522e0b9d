"""Plans and odd values that show only on larger tables."""

import inspect
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.llm import media
from tidewire.operators import dedupe, entity, evaluate, routing, score
from tidewire.plans import market, news, registry
from tidewire.sources import sinks

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_probes_are_not_broadcast(spark):
    """an exploded side is many times the table it comes from."""
    df = sinks.written(spark.range(1000).select(F.xxhash64("id").bitwiseAND(2**63 - 1).alias("cls"), F.lit(1).cast("long").alias("day")), "t")
    got = dedupe.near_signatures(df, df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    probes = [line for line in plan.splitlines() if "key#" in line and "Join" in line]
    assert probes and all("SortMergeJoin" in line for line in probes)


def test_days_and_brands_are_distinct_before_they_meet(spark):
    """orders and parts of a remainder make no pairs of all with all."""
    plan = [x.strip(" :+-") for x in optimized(market.QUERIES["asof_forward"](spark, SF)).splitlines()]
    at = next(i for i, x in enumerate(plan) if x.startswith("Join Inner, (k#"))
    assert plan[at + 1].startswith("Aggregate") and sum("Aggregate" in x and re.search(r"Aggregate \[k#|_groupingexpression", x) is not None for x in plan[at:]) >= 2


def test_figures_beyond_a_long(spark, tmp_path):
    """amounts over 2^63 are written in full, and digits beyond a double are none."""
    t = ["4416123456789 bi", "9" * 400 + " bi", "1 milhao e 12346 tri", None, "9223372 trilhao e 92233720 trilhao"]
    spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.figs for r in registry.QUERIES["figures"](spark, str(tmp_path)).collect()}
    assert got == {0: "4416" + "0" * 18, 1: "1500000 1100000000", 2: "1000000 2500000 2200000000 1235" + "0" * 13, 3: "", 4: "1500000 4400000000 9223" + "0" * 15 + " 9223" + "0" * 16}


def test_normal_form_is_worked_out_once(spark):
    """each condition on a text worked out its normal form anew."""
    for name in ("orientation", "event_nature", "arousal"):
        assert optimized(registry.QUERIES[name](spark, SF)).count("translate(") == 1


def test_links_do_not_follow_the_number_of_images(spark):
    """two pictures whose features agree in one band of 16 bits are linked, however many others are asked for."""
    rnd = random.Random(5)
    words = lambda d: [int.from_bytes((d >> 64 * k & 2**64 - 1).to_bytes(8, "little"), "little", signed=True) for k in range(4)]
    feature = lambda image, n, d: (image, n, float(40 * n), float(13 * n), 1.0, 0.0, *words(d))
    one = [rnd.getrandbits(256) for _ in range(6)]
    other = [d ^ sum(1 << 16 * band + (8 if band % 4 in (1, 2) and band != 6 else 0) for band in range(16) if band != 5) for d in one]
    pair = [feature(1, n, d) for n, d in enumerate(one)] + [feature(2, n, d) for n, d in enumerate(other)]
    noise = [feature(100 + k // 50, k % 50, rnd.getrandbits(256)) for k in range(20_000)]
    schema = "image_id long, n int, x double, y double, scale double, angle double, d0 long, d1 long, d2 long, d3 long"
    for rows in (pair, pair + noise):
        f = spark.createDataFrame(rows, schema)
        links = {(r.query_id, r.image_id) for r in media.find_copies(f, f.where("image_id != 2")).collect()}
        assert (1, 2) in links and {i for q, i in links if q == 1} == {1, 2}


def test_words_are_sifted_before_texts_are_repeated(spark):
    """F7 and all that link mentions: a text was repeated for each of its words, not for those that a term begins with."""
    plan = optimized(registry.QUERIES["mentions"](spark, SF))
    assert all("array_intersect" in x for x in plan.splitlines() if "Generate explode" in x and "#" in x) and "Generate explode(array_intersect" in plan


def test_normal_form_has_no_slow_class(spark):
    """F11 to F15, F17: Java tries a negated class of many parts for each character in turn, at eight times the cost of its ranges."""
    every = "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000) + "\U0001f600 a\U0010ffffb"
    t = [every, " a  b\t", "", "x.-+%9", None, "É́c KKZ{|}/09:`"]
    df = spark.createDataFrame(list(enumerate(t)), "id long, t string")
    low = F.lower(text.strip_accents(F.coalesce("t", F.lit(""))))
    plain = F.trim(F.regexp_replace(low, r"[^a-z0-9%+\-.]+", " "))
    assert df.where(text.norm(F.col("t")) != plain).isEmpty()
    assert "[^a-z0-9%" not in optimized(df.select(text.norm(F.col("t"))))


def test_texts_are_scored_where_they_stand(spark, monkeypatch):
    """F11 to F15: articles were scored after a join with their clusters, which moved whole texts."""
    plans, scored = [], news._scored
    monkeypatch.setattr(news, "_scored", lambda *a: plans.append(optimized(scored(*a))) or scored(*a))
    news._evidence(spark, SF)
    assert plans and not any("Join" in p for p in plans)


def test_texts_are_cut_by_tables_of_characters(spark):
    """F12 to F14: normal forms and words were cut by ranges of a class, which Java tries in turn, and every word was prefixed by an interpreted
    function before the few that a term begins with were kept."""
    plan = optimized(registry.QUERIES["mentions"](spark, SF))
    assert all(x in plan for x in (text.GAP, text.BREAK)) and not re.search(r"\\x7B-|\[\^a-z0-9\]\+|lambdafunction\(concat\(", plan)


def test_forms_that_stand_first_in_a_pattern(spark):
    """F12 to F14: each place of a text was looked at for what stands before it, instead of for the form."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab1 %.-") for _ in range(rnd.randrange(12))) for _ in range(3000)]
    forms = ["a", "ab", "a b", "%a", "b.", "1%", "aa", ".-.", "b1 a"]
    df = spark.createDataFrame([(t, f) for t in texts for f in forms], "t string, f string")
    plain = F.concat(F.lit(r"(?<![a-z0-9])\Q"), "f", F.lit(r"\E(?![a-z0-9])"))
    pattern = text.whole(F.col("f"), "[a-z0-9]")
    assert df.where(F.rlike("t", plain) != F.rlike("t", pattern)).isEmpty() and not df.where(F.rlike("t", pattern)).isEmpty()
    assert df.select(pattern.alias("p")).where(~F.col("p").startswith(r"\Q")).isEmpty()


def test_terms_without_letters_and_words_that_adjoin(spark):
    """A term that no word begins was found only in texts that start or end with such characters."""
    docs = [(1, "t", "a +++ b AAAA3"), (2, "t", "a ++ b XAAAA3 AAAA34 AAAA345"), (3, "+++", "aaaa3"), (4, None, "nothing"), (5, "AAAA3. x", None)]
    a = spark.createDataFrame(docs, "article_id long, title string, body string")
    got = {(r.article_id, r.ticker, r.matched_alias) for r in entity.link_mentions(a, entity.gazetteer(entity.entities_from(spark, {"P": ["+++"], "A": ["AAAA3"], "B": ["AAAA34"]}))).collect()}
    assert got == {(1, "P", "+++"), (1, "A", "AAAA3"), (2, "B", "AAAA34"), (3, "P", "+++"), (4, "__none__", None), (5, "A", "AAAA3")}
    hits = routing.match_terms(a, spark.createDataFrame([("p", "+++"), ("n", "nothing")], "topic string, term string"))
    assert {tuple(r) for r in hits.select("article_id", "topic").collect()} == {(1, "p"), (3, "p"), (4, "n")}


def test_only_tokens_found_look_back(spark):
    """F12 to F14: three tokens were sliced and compared for every token of a text, and events were searched for twice."""
    words = ["good", "bad", "not", "x", "y", "never"]
    rnd = random.Random(11)
    rows = [(i, "", " ".join(rnd.choice(words) for _ in range(rnd.randrange(9)))) for i in range(300)]
    got = score.lexicon_score(spark.createDataFrame(rows, "article_id long, title string, body string"), positive={"good": 0.5}, negative={"bad": -0.4}, phrases={}, negators=["not", "never"], hedges=[], events=[("e", "x", 0.9), ("f", "y", 0.6)])
    plan = optimized(got)
    assert "slice(" not in plan and plan.count("RLIKE(text_") == 4  # name and weight of two events
    for r in got.collect():
        k = r.body.split()
        w = [{"good": 0.5, "bad": -0.4}[x] * (-0.7 if {"not", "never"} & set(k[max(i - 3, 0) : i]) else 1) for i, x in enumerate(k) if x in ("good", "bad")]
        assert abs(r.s - (max(-1, min(1, sum(w) / len(w) ** 0.5)) if w else 0)) < 6e-5
        assert r.event_type == ("e" if "x" in k else "f" if "y" in k else "unclassified")


def test_news_of_an_event_study_are_scored_once(spark):
    """each window's ranks, counts and hits scored all news again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def strength(i):
        seen.add(1)
        return float(i % 7 - 3)

    day = F.timestamp_seconds(1_700_000_000 + F.col("id") * 3600)
    res = spark.range(40).select(F.lit("x").alias("ticker"), day.alias("ts"), ((F.col("id") * 37 % 11) - 5.0).alias("residual"))
    news_ = spark.range(20).select(F.lit("x").alias("ticker"), day.alias("published_ts"), strength("id").alias("strength"))
    assert len(evaluate.event_study(news_, res, (1, 5)).collect()) == 2
    assert seen.value == 20


def test_chance_meetings_of_features_make_no_rows(spark):
    """op9_image_copies' check: pairs of features that share a key were rows that a shuffle carried, before they were compared. All images
    show features of one key, so all pairs meet, in blocks and in lists, and in tiles of any size; only links leave a task."""
    rng = np.random.default_rng(3)
    d = rng.integers(-(2**62), 2**62, (600, 4))
    d[:, 0] = d[:, 0] >> 16 << 16 | 77
    d[590:] = d[:10]  # the last image is a copy of the first
    rows = [(k // 10, k % 10, float(30 * (k % 10)), float(k % 3), 1.0, 0.0, *map(int, d[k])) for k in range(600)]
    f = spark.createDataFrame(rows, "image_id long, n int, x double, y double, scale double, angle double, d0 long, d1 long, d2 long, d3 long")
    asked = f.where("image_id < 20")
    want = {(i, i) for i in range(20)} | {(0, 59)}
    kept = media.FEW_KEYS, media.IMAGE_TILE, media.BLOCK, media.PAIRS
    try:
        for media.FEW_KEYS, media.IMAGE_TILE, media.BLOCK, media.PAIRS in ((kept), (300, 1, 4_096, 1 << 18), (0, 1, 10**9, 50), (kept[0], kept[1], 1, 50)):
            got = media.find_copies(f, asked, images=60 if media.IMAGE_TILE > 1 else 4)
            assert {(r.query_id, r.image_id) for r in got.collect()} == want
            assert "Join" not in optimized(got)
    finally:
        media.FEW_KEYS, media.IMAGE_TILE, media.BLOCK, media.PAIRS = kept


def _late_codes(spark, path):
    """Documents that name AAAA3 beyond their first 2 000 characters only, and some that name it nowhere."""
    rows = [(k, f"Story {k} w{k * k} x{k % 5}. " + "lorem ipsum " * 200 + ("AAAA3 falls." if k % 3 else "nothing."), "en", f"s{k % 4}", 0) for k in range(1, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return sum(k % 3 > 0 for k in range(1, 40))


def _as_sql(spark, path, name):
    """Rows of a query on the tables of a folder, which its SQL gives too."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = c.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, path).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    return got


def test_codes_count_anywhere_in_a_text_for_the_panel(spark, tmp_path):
    """attention_panel looked for codes in the first 2 000 characters of a text."""
    n = _late_codes(spark, str(tmp_path))
    assert entity.link_mentions(news.articles(spark, str(tmp_path)), entity.gazetteer(entity.entities_from(spark, {"A": ["AAAA3"]}))).where("ticker = 'A'").count() == n
    live = [r.n for r in _as_sql(spark, str(tmp_path), "attention_panel") if r.ticker == "AAAA3"]
    assert max(live) > 0


def test_codes_count_anywhere_in_a_text_for_signals_with_macro(spark, tmp_path):
    """signals_with_macro looked for codes in the first 2 000 characters of a text; so does signals, as its SQL says."""
    _late_codes(spark, str(tmp_path))
    assert {r.ticker for r in _as_sql(spark, str(tmp_path), "signals_with_macro")} == {"AAAA3"}
    assert _as_sql(spark, str(tmp_path), "signals") == []


def test_features_of_pictures_are_not_dealt(spark, monkeypatch, tmp_path):
    """features, twenty times as large as what their pictures are drawn from, were dealt once a tile of queries, and those of queries once a tile
    of images, of which there are as many as images ask for. Blocks and tiles of any size link the same."""
    rng = np.random.default_rng(12)
    v = rng.normal(0, 0.2, (24, 64))
    rows = [(25 * k, v[k].tolist()) for k in range(24)] + [(7, v[8].tolist()), (500, v[4].tolist()), (200, v[1].tolist()), (300, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    links, find = [], media.find_copies
    monkeypatch.setattr(media, "find_copies", lambda *a, **k: links.append((find(*a, **k), a[1])) or links[-1][0])
    given = []
    classes = media.image_classes
    monkeypatch.setattr(media, "image_classes", lambda *a, **k: given.append(a) or classes(*a, **k))
    want = sorted(map(tuple, media.op9_image_copies(spark, str(tmp_path)).collect()))
    assert max(r[2] for r in want) > 1 and len(links) == 2
    for got, queries in links:
        plan = [x for x in optimized(got).splitlines() if "#" in x]
        at = next(i for i, x in enumerate(plan) if "RepartitionBy" in x)
        assert not any("d0#" in x for x in plan[at:])
    features, queries = given[0][0], links[1][1]
    many = find(features, queries, images=10**9, described=media.drawn_features)  # two tiles a core, however many images
    assert re.search(r"RepartitionBy\w*.*, (\d+)", optimized(many))[1] == "8"
    first = sorted(map(tuple, many.collect()))
    kept = media.FEW_KEYS, media.IMAGE_TILE, media.QUERY_ROWS, media.HELD
    try:
        for media.FEW_KEYS, media.IMAGE_TILE, media.QUERY_ROWS, media.HELD in ((16 * 500, 4, kept[2], 1), (16 * 500, 4, kept[2], 100), (kept[0], 0, 4, 1)):
            assert sorted(map(tuple, find(features, queries, described=media.drawn_features).collect())) == first
    finally:
        media.FEW_KEYS, media.IMAGE_TILE, media.QUERY_ROWS, media.HELD = kept
    whole = features.mapInArrow(media.drawn_features, media.FEATURES)
    described = [sinks.written(x, "features") for x in (whole, whole.join(queries.select("image_id").distinct(), "image_id", "left_semi"))]
    assert sorted(map(tuple, classes(described[0], given[0][1], given[0][2], described[1]).collect())) == want


def test_features_that_meet_are_told_by_the_other_words():
    """three words that the key is not of rule out most pairs; the pairs are those of comparing all, in blocks and in lists of any size."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, (80, 4)).astype(np.uint64)
    b = np.concatenate([a, a, rng.integers(0, 2**63, (40, 4)).astype(np.uint64)])
    b[:160] ^= np.uint64(1) << rng.integers(0, 64, (160, 4)).astype(np.uint64)
    b[80:160, 1] ^= rng.integers(0, 2**28, 80).astype(np.uint64)
    b[:, 2] = b[0, 2]
    a[:, 2] = b[0, 2]
    same = (np.ascontiguousarray(a).view(np.uint16)[:, None] == np.ascontiguousarray(b).view(np.uint16)[None]).any(axis=2)
    want = set(zip(*np.nonzero(same & (np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2) <= 20)), strict=True))
    assert len(want) > 80
    kept = media.BLOCK, media.PAIRS
    try:
        for media.BLOCK, media.PAIRS in (kept, (1, 7), (10**9, 7), (1, 1000)):
            got = list(zip(*media._near_features(a, b, 20), strict=True))
            assert len(got) == len(want) and set(got) == want
    finally:
        media.BLOCK, media.PAIRS = kept
