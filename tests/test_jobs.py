"""Jobs against plain Python on hand-made and random rows."""

import datetime as dt
import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire import config
from tidewire.functions import stats, text, timeutil
from tidewire.operators import alarms, asof, attention, calibrate, calendars, dedupe, documents, entity, evaluate, exposure, fundamentals, models, score, sources_weight, volatility
from tidewire.sources import readers, sinks
from tidewire.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, text.norm, "  Ação: LUCRO. +3,5% d'água ß ") == "acao lucro. +3 5% d agua"
    assert one(spark, text.figures, "R$ 3,8 bi e 3.8 bilhoes, 12 mil, 1.5 milhões") == [1.5e6, 3.8e9]
    assert one(spark, lambda c: text.simhash(c, "md5"), "") == one(spark, lambda c: text.simhash(c, "md5"), None)
    a = one(spark, text.simhash, "um dois tres quatro cinco")
    assert 0 < a < 2**63 and a == plain_simhash("um dois tres quatro cinco", hashlib.blake2b)
    some = ["", "um", "a b", "a b c d", "x " * 50, *(" ".join(f"w{i * k % 11}" for i in range(k)) for k in range(3, 40))]
    assert text._simhashes(some, "blake2b", 63).tolist() == [plain_simhash(t, hashlib.blake2b) for t in some]
    assert text._simhashes(some, "md5", 63).tolist() == [plain_simhash(t, hashlib.md5) for t in some]


def plain_simhash(t, hash):
    w = t.split()
    got = [hash(" ".join(w[i : i + 3]).encode(), **({"digest_size": 8} if hash is hashlib.blake2b else {})).digest()[:8] for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(63) if 2 * sum(int.from_bytes(h, "big") >> i & 1 for h in got) > len(got))


def lexicon(spark, title, **kw):
    return score.lexicon_score(spark.createDataFrame([(title, None)], "title string, body string"), **kw).first()


def test_scores(spark):
    assert lexicon(spark, "record loss at company").s < -0.3
    full, short = lexicon(spark, "empresa paga juros sobre o capital próprio"), lexicon(spark, "empresa paga JCP")
    assert full.s > 0 and short.s > 0 and full.event_type == short.event_type == "dividend"
    assert lexicon(spark, "nao ha lucro").s == pytest.approx(-0.35)
    assert lexicon(spark, "weather is fine").magnitude == pytest.approx(0.075)
    t = spark.createDataFrame([("ANP avanca para reduzir concentracao apesar de resistencia da Petrobras", None, ["petrobras"]), ("Petrobras avanca apesar da resistencia do MPF", None, ["petrobras"])], "title string, body string, al array<string>")
    s = [r.s for r in score.lexicon_score(t, aliases="al").collect()]
    assert s[0] < 0 < s[1]
    assert one(spark, score.orientation, "Vale divulgara balanco do 3T26 em 28 de outubro") == ["futuro"]
    assert one(spark, lambda c: score.event_nature(c, F.lit("operational")), "MPF apresenta recurso contra exploracao de petroleo") == "judicial"
    assert [one(spark, lambda c: score.language_covered(c), x) for x in ("German", "EN ", None)] == [False, True, True]
    r = spark.createDataFrame([('```json\n{"s": 2, "magnitude": 0.8, "ja_precificado": true}\n```',), ("none",)], "resp string")
    assert [(x.s, x.magnitude) for x in score.structured_score(r, "resp").collect()] == [(1.0, 0.2), (None, None)]


def test_links(spark):
    ents = entity.entities_from(spark, {"VALE3": ["VALE3", "Vale", "Companhia Vale"], "PETR4": ["PETR4", "Petrobras"]})
    a = spark.createDataFrame([(1, "vale a pena ver vale3", None), (2, "VALE3 sobe", "petrobras."), (3, "x", "a Companhia Vale, hoje"), (4, None, None)], "article_id long, title string, body string")
    got = {(r.article_id, r.ticker): r.matched_alias for r in entity.link_mentions(a, entity.gazetteer(ents)).collect()}
    assert got == {(1, config.NOBODY): None, (2, "VALE3"): "VALE3", (2, "PETR4"): "Petrobras", (3, "VALE3"): "Companhia Vale", (4, config.NOBODY): None}


def test_clusters_equal_the_greedy_loop(spark):
    rng = random.Random(2)
    words = ["lucro", "queda", "banco", "acordo", "vale", "petroleo", "juros", "dolar", "alta", "risco"]
    for trial in range(3):
        rows = []
        for i in range(60):
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))) + rng.choice(["", " 3,8 bi", " 5 bilhoes"])
            rows.append((i, t, None, T0 + dt.timedelta(hours=rng.randrange(0, 120))))
        df = spark.createDataFrame(rows, "article_id long, title string, body string, published_ts timestamp")
        f = {r.article_id: r for r in dedupe.story_features(df).collect()}

        def same(a, b):
            ta, tb = set(f[a].toks), set(f[b].toks)
            j = len(ta & tb) / len(ta | tb) if ta and tb else 0
            return j >= 0.55 or bin(f[a].sig ^ f[b].sig).count("1") <= 12 or (bool(set(f[a].figs) & set(f[b].figs)) and j >= 0.25)

        want, done = {}, []
        for i, _, _, ts in sorted(rows, key=lambda r: (r[3], r[0])):
            want[i] = next((want[b] for b, tb in done if (ts - tb).total_seconds() < 48 * 3600 and same(i, b)), i)
            done.append((i, ts))
        got = {r.article_id: r.cluster_id for r in dedupe.cluster(df).collect()}
        assert got == want
    assert dedupe.cluster_history(df, parity=False).count() == 60


def test_novelty_and_sources(spark):
    rows = [(i, "c", T0 + dt.timedelta(minutes=max(i, 1)), "d1") for i in range(4)] + [(9, None, T0, "d2"), (10, "e", T0, "d1"), (11, "e", T0 + dt.timedelta(hours=1), "d3")]
    df = spark.createDataFrame(rows, "article_id long, cluster_id string, published_ts timestamp, domain string")
    n = {r.article_id: (round(r.novelty, 4), r.cluster_size) for r in dedupe.novelty(df).collect()}
    assert n[0] == n[1] == (1.0, 4) and n[2] == (round(1 / 3**0.5, 4), 4) and n[9] == (1.0, 1)
    assert {r.cluster_id: round(r.effective_sources, 6) for r in attention.effective_sources(df, ["cluster_id"]).collect()}["c"] == 1.0
    st = {r.domain: (r.n, r.scoops) for r in sources_weight.cluster_stats(df).collect()}
    assert st == {"d1": (2, 2), "d3": (1, 0)}


def test_time(spark):
    close = lambda d: one(spark, lambda c: timeutil.session_close_utc(c.cast("date")), d)
    assert close("2018-12-03").hour == 19 and close("2020-12-03").hour == 20
    assert one(spark, readers.feed_date, "Mon, 05 Feb 2024 10:00:00 -0000") == dt.datetime(2024, 2, 5, 10)
    assert one(spark, readers.feed_date, "Tue, 6 Feb 2024 10:00:00 -0300") == dt.datetime(2024, 2, 6, 13)
    assert one(spark, readers.feed_date, "2024-02-05T10:00:00Z") == dt.datetime(2024, 2, 5, 10)
    d = {r.event: r.date.isoformat() for r in calendars.rule_dates(spark, "2024-06-01", "2024-06-30").collect()}
    assert d == {"Payroll EUA": "2024-06-07", "PMI China": "2024-06-03", "CPI EUA": "2024-06-12"}


def test_asof(spark):
    rng = random.Random(3)
    day = lambda k: T0 + dt.timedelta(days=k)
    left = [(rng.choice("ab"), day(rng.randrange(30)), i) for i in range(40)]
    right = [(rng.choice("ab"), day(rng.randrange(30)), v) for v in range(20)]
    lf, rf = spark.createDataFrame(left, "k string, t timestamp, i int"), spark.createDataFrame(right, "k string, u timestamp, v int")
    for direction in ("backward", "forward"):
        for strict in (False, True):
            for tol in (None, 3 * 86400):
                got = {r.i: r.r_u for r in asof.asof_join(lf, rf, ["k"], "t", "u", direction, strict, tol).collect()}
                for k, t, i in left:
                    ok = [u for kk, u, _ in right if kk == k and ((u < t or (u == t and not strict)) if direction == "backward" else (u > t or (u == t and not strict)))]
                    best = (max(ok) if direction == "backward" else min(ok)) if ok else None
                    if best is not None and tol is not None and abs((best - t).total_seconds()) > tol:
                        best = None
                    assert got[i] == best
    pairs = asof.range_explode(lf, "t", spark.createDataFrame([(day(k),) for k in range(0, 31, 5)], "g timestamp"), "g", 48).count()
    assert pairs == sum(0 <= (day(k) - t).total_seconds() < 48 * 3600 for _, t, _ in left for k in range(0, 31, 5))


def test_calibration(spark):
    rng = np.random.default_rng(1)
    z = np.round(rng.normal(0, 0.45, 3000).clip(-1, 1), 2)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * z - 0.3)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "cls": np.where(y == 1, 1, -1), "n_eff": 0.0, "base_up": 0.5, "base_flat": 0.1, "base_down": 0.4}))
    a, b = calibrate.fit_platt(df, "z", "y")
    assert abs(a - 2) < 0.3 and abs(b + 0.3) < 0.15
    m = models.logit_fit(df.withColumn("x", F.col("z")), ["x"], "y", 0.0)
    assert m.b[1] / m.sd[0] == pytest.approx(a, rel=1e-4)
    knots = calibrate.fit_isotonic(df, "z", "y")
    assert all(p <= q + 1e-12 for (_, p), (_, q) in zip(knots, knots[1:], strict=False)) and len({k for k, _ in knots}) == len(knots)
    p = np.interp(z, [k for k, _ in knots], [v for _, v in knots])
    assert ((p - y) ** 2).mean() <= y.mean() * (1 - y.mean())
    fit = calibrate.fit_direction(df)
    assert fit.passed and fit.metrics["skill_up"] > 0.01
    r = calibrate.probabilities(df, fit).first()
    assert (r.p_up, r.p_down) == (0.5, 0.4) and r.calibrated == 1  # no evidence: the base rates
    assert not calibrate.fit_direction(df.limit(50)).passed
    r = stats.auc(df.withColumn("p", F.col("y").cast("double")), "p", "y").first()
    assert r.auc == 1.0


def test_ranks_without_a_single_partition(spark):
    rng = random.Random(1)
    v = [rng.randrange(50) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v int").repartition(6)
    got = {r.i: r.r for r in stats.avg_rank(df, "v", "r").collect()}
    want = pd.Series(v).rank().to_dict()
    assert got == want
    assert stats.spearman(df.withColumn("w", F.lit(1)), "v", "w").first().ic is None
    ic = stats.spearman(df.withColumn("w", F.col("i") % 37), "v", "w").first()
    assert ic.ic == pytest.approx(pd.Series(v).rank().corr(pd.Series([i % 37 for i in range(400)]).rank()))


def test_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [0.01, 0.03], (300, 2))
    y = x @ [0.5, -0.2] + rng.normal(0, 0.005, 300)
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    rets = spark.createDataFrame([("A", d, float(v)) for d, v in zip(days, y, strict=True)], "ticker string, date date, ret double")
    drv = spark.createDataFrame([(n, d, float(x[i, k])) for i, d in enumerate(days) for k, n in enumerate("PQ")], "driver string, date date, ret double")
    got = {r.driver: r for r in exposure.fit_exposures(rets, drv, "2023-10-20", 250, 120).collect()}
    use = [i for i, d in enumerate(days) if d < dt.date(2023, 10, 20)][-250:]
    xs = (x[use] - x[use].mean(0)) / x[use].std(0)
    b = np.linalg.solve(xs.T @ xs + np.eye(2), xs.T @ (y[use] - y[use].mean()))
    assert [got["P"].beta, got["Q"].beta] == pytest.approx(list(b)) and got["P"].n == 250
    assert got["P"].share + got["Q"].share == pytest.approx(1)


def test_threshold_and_walk_forward(spark):
    v = list(np.random.default_rng(3).normal(0, 1, 90))
    abn = spark.createDataFrame([("A", dt.date(2023, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(v)], "ticker string, date date, abn double")
    got = [r.threshold for r in volatility.expanding_threshold(abn).orderBy("date").collect()]
    want = [None if i < 39 else sorted(np.abs(v[: i + 1]))[int(0.8 * i)] for i in range(90)]
    assert got[:39] == [None] * 39 and got[39:] == pytest.approx(want[39:])
    pairs = spark.createDataFrame([(i, T0 + dt.timedelta(days=i)) for i in range(400)], "i int, asof timestamp")
    for f, g in evaluate.walk_forward(pairs, min_train=50).toPandas().groupby("fold"):
        assert g[g.role == "train"]["asof"].max() < g[g.role == "test"]["asof"].min() - pd.Timedelta(days=5)


def alarm_rows(spark):
    at = [T0 + dt.timedelta(minutes=m) for m in (0, 30, 89, 90, 100, 200)]
    return spark.createDataFrame([("A", t, "up", 90) for t in at] + [("A", at[1], "down", 90)], "ticker string, asof timestamp, direction string, cooldown_min int")


def test_alarms(spark, tmp_path):
    a = alarm_rows(spark)
    fired = sorted((r.direction, (r.asof - T0).seconds // 60) for r in alarms.cooldown(a).collect())
    assert fired == [("down", 30), ("up", 0), ("up", 90), ("up", 200)]
    a.repartition(1).write.parquet(f"{tmp_path}/in")
    q = streams.cooldown(spark.readStream.schema(a.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.direction, (r.asof - T0).seconds // 60) for r in spark.table("fired").collect()) == fired
    sig = spark.createDataFrame([("T1", 0.25, 6.0, 1), ("T2", 0.04, 6.0, 1), ("T3", 0.25, 0.4, 1), ("T4", 0.25, 6.0, 0), ("T5", 0.25, 6.0, 1), ("T6", 0.25, 6.0, 1)], "ticker string, e double, n_eff double, calibrated int")
    sig = sig.select("ticker", F.lit(T0).alias("asof"), "n_eff", "calibrated", F.lit(0.3).alias("z"), (0.3 + F.col("e")).alias("p_up"), F.lit(0.1).alias("p_down"), F.lit(0.3).alias("base_up"), F.lit(0.3).alias("base_down"))
    rules = spark.createDataFrame([("*", None), ("T5", "down")], "ticker string, direction string")
    for c, k in alarms.FIELDS.items():
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(None).cast(k))
    seen = spark.createDataFrame([(t, T0 - dt.timedelta(hours=1), 1.0) for t in ("T1", "T2", "T3", "T4", "T5")], "ticker string, published_ts timestamp, novelty double")
    assert [r.ticker for r in alarms.candidates(sig, alarms.resolve_rules(sig, rules), seen).collect()] == ["T1"]


def test_streaming_ingest_equals_batch(spark, tmp_path):
    rows = [(f"u{i % 7}", "t", T0 + dt.timedelta(minutes=i % 7), T0 + dt.timedelta(minutes=30), "d") for i in range(20)]
    df = spark.createDataFrame(rows, "url string, title string, published_ts timestamp, ingested_ts timestamp, domain string")
    df.repartition(1).write.parquet(f"{tmp_path}/a")
    q = streams.ingest_articles(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/a")).writeStream.format("memory").queryName("got").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = sinks.insert_new(df.limit(0), df, ["url"])
    assert sorted(r.url for r in spark.table("got").collect()) == sorted(r.url for r in want.collect())


def test_readers(spark, tmp_path):
    def put(name, content):
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
        return f"file://{tmp_path}/{name}"

    g = put("g.json", json.dumps({"articles": [{"url": "u1", "title": " A ", "seendate": "20260101T123000Z", "domain": "d", "language": "English"}, {"url": "u1", "title": "later", "seendate": "20260102T123000Z"}, {"url": None, "seendate": "20260101T123000Z"}, {"url": "u2", "seendate": "bad"}]}))
    assert [(r.url, r.title, r.published_ts) for r in readers.read_gdelt_json(spark, g).collect()] == [("u1", "A", dt.datetime(2026, 1, 1, 12, 30))]
    f = put("f.xml", '<rss><channel><link>https://www.site.com/x</link><language>pt-BR</language><item><title><![CDATA[One]]></title><link>https://site.com/1</link><description>Body</description><pubDate>Mon, 05 Feb 2024 10:00:00 -0000</pubDate></item><item><title></title><link>https://site.com/2</link></item><item><title>No date</title><link>https://site.com/3</link></item></channel></rss>')
    got = {r.url: r for r in readers.read_feeds(spark, f, "2024-03-01 00:00:00").collect()}
    assert set(got) == {"https://site.com/1", "https://site.com/3"} and got["https://site.com/1"].title == "One" and got["https://site.com/1"].lang == "portuguese"
    assert got["https://site.com/3"].published_ts == dt.datetime(2024, 3, 1) and got["https://site.com/1"].domain == "site.com"
    c = put("c.json", json.dumps({"chart": {"result": [{"meta": {"symbol": "S"}, "timestamp": [86400, 172800, 259200], "indicators": {"quote": [{"open": [1.0, 2.0, 3.0], "close": [1.5, None, 0.0]}]}}]}}))
    assert [(r.symbol, str(r.date), r.close) for r in readers.read_chart_json(spark, c).collect()] == [("S", "1970-01-02", 1.5)]
    e = put("e.json", json.dumps({"value": [{"Indicador": "IPCA", "DataReferencia": "03/2024", "Data": "2024-03-20", "Mediana": 0.3, "DesvioPadrao": 0.1, "numeroRespondentes": 20}]}))
    assert [str(r.ref_month) for r in readers.read_expectations(spark, e).collect()] == ["2024-03-01"]
    v = put("r.json", json.dumps([{"data": "01/03/2024", "valor": "0.42"}, {"data": "15/03/2024", "valor": "0,5"}]))
    assert [(str(r.ref_month), r.value) for r in readers.read_realized(spark, v, "IPCA").collect()] == [("2024-03-01", 0.5)]
    head = "CNPJ_CIA;DENOM_CIA;DT_REFER;DT_FIM_EXERC;ORDEM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA;ESCALA_MOEDA\n"
    lines = [("ÚLTIMO", "3.01", "Receita de Venda", "100"), ("ÚLTIMO", "3.02", "Custo", "-60"), ("ÚLTIMO", "3.03", "Bruto", "50"), ("PENÚLTIMO", "3.01", "Receita", "9"), ("ÚLTIMO", "3.05", "Outras Receitas e Despesas", "7"), ("ÚLTIMO", "3.11", "Lucro", "20"), ("ÚLTIMO", "9.99", "x", "1")]
    s = put("s.csv", (head + "".join(f"1;ACME;2024-05-01;2024-03-31;{o};{cd};{ds};{vl};MIL\n" for o, cd, ds, vl in lines)).encode("latin-1"))
    p = fundamentals.ratios(fundamentals.validate(fundamentals.pivot_statements(readers.read_statements_csv(spark, s)))).first()
    assert p.concepts == {"receita_liquida": 1e5, "custo": -6e4, "lucro_bruto": 5e4, "outras_receitas_despesas": 7e3, "lucro_liquido": 2e4}
    assert p.problems and p.net_margin == pytest.approx(0.2) and p.family == "industria" and p.roe is None


def test_documents(spark):
    t = "[PÁGINA 1]" + "a" * 50 + "[PÁGINA 2]" + "b" * 30 + "[PÁGINA 3]" + "c" * 200 + "[PÁGINA 4]d"
    got = one(spark, lambda c: documents.page_chunks(c, 110), t)
    assert [list(x.pages) for x in got] == [[1, 2], [3], [4]] and "".join(x.text for x in got) == t
    pages = spark.createDataFrame([("https://x.com/ri/", '<a href="rel.pdf#z">Resultado &amp; x</a> <a href="https://y.com/a.pdf">no</a> <a class=b href=\'/f/wp-json.pdf\'>no</a><a href="/plain">no</a>')], "url string, html string")
    assert [tuple(r) for r in documents.extract_links(pages).collect()] == [("https://x.com/ri/", "https://x.com/ri/rel.pdf", "Resultado & x", "RESULTADO")]


def test_first_near(spark):
    """The earliest earlier row within 12 bits; copies, ties of time and repeated SimHashes included."""
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(5)]
    rows = []
    for i in range(160):
        sig, ts = base[i % 5], rng.choice([rng.randrange(0, 900), 100, 250])
        for _ in range(rng.choice([0, 0, 3, 9, 14])):
            sig ^= 1 << rng.randrange(63)
        rows.append((i, ts, sig, ts - 299))
    want = {}
    for b, tb, sb, lo in rows:
        met = [(ta, a) for a, ta, sa, _ in rows if (ta, a) < (tb, b) and ta >= lo and (sa ^ sb).bit_count() <= 12]
        if met:
            want[b] = min(met)
    df = spark.createDataFrame(rows, "article_id long, ts long, sig long, lo long")
    assert {r.b: (r.ta, r.a) for r in dedupe._first_near(df, 300).collect()} == want
    assert dedupe._first_near(df.limit(0), 300).count() == 0


def test_statement_lines_keep_the_order_of_files(spark, tmp_path):
    """The last line of the last file by name counts, however large the files are."""
    head = "CNPJ_CIA;DENOM_CIA;DT_REFER;DT_FIM_EXERC;ORDEM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA;ESCALA_MOEDA\n"
    line = lambda v, code="3.01": f"1;N;2024-01-01;2023-12-31;ULTIMO;{code};Receita;{v};UNIDADE\n"
    (tmp_path / "b.csv").write_text(head + line(3) + line(4))
    (tmp_path / "a.csv").write_text(head + "".join(line(i, "9.99") for i in range(5000)) + line(9))
    rows = readers.read_statements_csv(spark, str(tmp_path)).where("code = '3.01'")
    assert [r.value for r in rows.orderBy("line").collect()] == ["9", "3", "4"]
    bars = json.dumps({"chart": {"result": [{"meta": {"symbol": "S"}, "timestamp": [3600, 7200, 10800], "indicators": {"quote": [{"open": [1.0, 2.0, 3.0], "close": [1.5, None, 2.5]}]}}]}})
    (tmp_path / "c.json").write_text(bars)
    assert [(r.ts.hour, r.open, r.close) for r in readers.read_chart_json(spark, f"{tmp_path}/c.json", bars=True).orderBy("ts").collect()] == [(1, 1.0, 1.5), (3, 3.0, 2.5)]
    (tmp_path / "f.txt").write_text("Nome_Companhia;Categoria;Link_Download\nACME S.A.;Fato Relevante;http://x\n")
    (r,) = readers.read_filings_csv(spark, f"{tmp_path}/f.txt").collect()
    assert (r.name, r.category, r.link, r.tax_id) == ("ACME S.A.", "Fato Relevante", "http://x", None)


def test_near_signatures(spark):
    """Every pair within 12 bits once, none beyond, at every distance; dealt rows grow with the SimHashes alone."""
    rng = random.Random(5)
    sigs = [rng.getrandbits(63) for _ in range(12)]
    for base in sigs[:6]:
        for far in range(1, 16):
            sigs.append(base ^ sum(1 << i for i in rng.sample(range(63), far)))
        sigs.append(base ^ sum(1 << i for i in range(12)))  # all in one band
    df = spark.createDataFrame([(s, 0) for s in sigs], "cls long, day long")
    got = sorted((r.b_cls, r.a_cls) for r in dedupe.near_signatures(df, df).collect())
    assert got == sorted((b, a) for b in sigs for a in sigs if (a ^ b).bit_count() <= config.HAMMING_MAX)
    assert sum(r + 1 for _, _, r in dedupe.BANDS) > config.HAMMING_MAX and sum(w for _, w, _ in dedupe.BANDS) == 63
    n = {late: df.select(F.size(dedupe._probes(F.col("cls"), late)).alias("n")).distinct().collect() for late in (True, False)}
    assert [len(x) for x in n.values()] == [1, 1] and n[True][0].n + n[False][0].n < 300


def test_clusters_of_copies(spark):
    """Half of the articles are copies of one; a day's classes, not its articles, meet each other."""
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(6)
    rows = [(i, "mesma noticia repetida do dia", "corpo igual", T0 + dt.timedelta(minutes=20 * i)) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.sample(words, 6)), " ".join(rng.sample(words, 30)), T0 + dt.timedelta(minutes=rng.randrange(6000))) for i in range(300)]
    df = spark.createDataFrame(rows, "article_id long, title string, body string, published_ts timestamp")
    got = {r.article_id: r.parent for r in dedupe.parents(df).collect()}
    assert all(got[i] == (max(0, i - 143) if i else None) for i in range(300))  # the copy 48 hours less a second before, or the first
    assert all(got[1000 + i] is None or got[1000 + i] >= 1000 for i in range(300))


def test_rolling_exposures(spark):
    """Windows that overlap, end between sessions, hold too few or reach before the first, against NumPy on each."""
    rng = np.random.default_rng(11)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    x = {d: rng.normal(size=3) * 0.01 for d in days if d.day != 13}
    drivers = [(f"d{i}", d, float(v[i])) for d, v in x.items() for i in range(3)] + [("d0", dt.date(2024, 1, 13), 0.5)]
    rets, asofs = [], [days[20], days[40], days[41], dt.date(2024, 3, 15), dt.date(2025, 1, 1)]
    for n, t in enumerate(("A", "B", "C")):
        rets += [(t, d, float(v @ np.array([1.0, -0.5, n]) + rng.normal() * 0.002)) for d, v in x.items() if d > days[25 * n] and rng.random() < 0.9]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {(r.ticker, r.asof, r.driver): r for r in exposure.rolling_exposures(frame(rets, "ticker string, date date, ret double"), frame(drivers, "driver string, date date, ret double"), frame([(a,) for a in asofs], "asof date"), 30, 12).collect()}
    want = {}
    for t in ("A", "B", "C"):
        for a in asofs:
            mine = sorted((d, y) for k, d, y in rets if k == t and d < a and d in x)[-30:]
            if len(mine) < 12:
                continue
            m, y = np.array([x[d] for d, _ in mine]), np.array([v for _, v in mine])
            z = (m - m.mean(0)) / m.std(0)
            b = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
            r2 = 1 - ((y - y.mean() - z @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()
            want |= {(t, a, f"d{i}"): (b[i], abs(b[i]) / np.abs(b).sum(), r2, len(mine)) for i in range(3)}
    assert set(got) == set(want) and len(want) > 20
    for k, v in want.items():
        assert np.allclose((got[k].beta, got[k].share, got[k].r2, got[k].n), v, rtol=1e-8, atol=1e-10)


def test_cluster_features_as_of(spark):
    """Running sums against sets of articles; ties of time, a null domain and instants before the first article included."""
    rng = random.Random(12)
    arts = [(c, T0 + dt.timedelta(minutes=30 * rng.randrange(20)), rng.choice(["a", "b", "c", None]), rng.random()) for c in ("x", "y") for _ in range(40)] + [("z", T0 + dt.timedelta(hours=9), "a", 0.5)]
    asofs = [(c, T0 + dt.timedelta(minutes=30 * k)) for c in ("x", "y", "z", "none") for k in range(0, 24, 3)]
    got = {(r.cluster_id, r.asof): r for r in attention.cluster_features(spark.createDataFrame(arts, "cluster_id string, published_ts timestamp, domain string, arousal double"), spark.createDataFrame(asofs, "cluster_id string, asof timestamp"), 2).collect()}
    hill = lambda d: np.exp(-sum(d.count(v) / len(d) * np.log(d.count(v) / len(d)) for v in set(d)))
    seen = 0
    for c, at in asofs:
        mine = [a for a in arts if a[0] == c and a[1] <= at]
        assert ((c, at) in got) == bool(mine)
        if mine:
            seen, r, t0 = seen + 1, got[c, at], min(a[1] for a in mine)
            es = hill([a[2] or "" for a in mine])
            want = (es, hill([a[2] or "" for a in mine if a[1] - t0 <= dt.timedelta(hours=2)]), len(mine), 1 - es / len(mine), (at - t0).total_seconds() / 3600, max(a[3] for a in mine))
            assert np.allclose((r.effective_sources, r.cascade, r.copies, r.repetition, r.hours_alive, r.arousal), want)
    assert seen > 10


def test_running(spark):
    rng = random.Random(13)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b"]), i, rng.choice([None, 1, 2, 5]), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, n long, v double").repartition(7)
    got = {r.t: r for r in asof.running(df, ["k"], ["t"], ["n"], ["v"]).collect()}
    for k, t, _, _ in rows:
        upto = [r for r in rows if r[0] == k and r[1] <= t]
        assert got[t].run_n == sum(r[2] or 0 for r in upto) and got[t].run_v == max(r[3] for r in upto)


def np_logit(x, y, lam=1e-3):
    """(b, mean, sd) by Newton's method on standardized columns."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    b = np.zeros(z.shape[1])
    b[0] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + lam * np.eye(len(b)), z.T @ (p - y) + lam * b)
    return b, mean, sd


def np_predict(m, x):
    b, mean, sd = m
    return 1 / (1 + np.exp(-(b[0] + ((x - mean) / sd) @ b[1:])))


def np_auc(p, y):
    pos, neg = p[y > 0.5], p[y <= 0.5]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)


def vol_rows(seed, strength):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(240):
        d = dt.date(2023, 1, 2) + dt.timedelta(days=i)
        for t in ("A", "B", "C"):
            x = rng.normal(size=3)
            rows.append((t, d, d + dt.timedelta(days=1), *map(float, x), float(rng.random() < 1 / (1 + np.exp(1.2 - strength * x[0])))))
    return rows


VOL_XS = ["abs_ret", "vol5", "vol20"]


def np_version(rows, asof, folds):
    """(p, y, base) out of sample and the final model of the rows known at asof."""
    known = [r for r in rows if r[2] <= asof]
    days = sorted({r[1] for r in known})
    cuts = [days[len(days) * k // folds] for k in range(1, folds)] + [dt.date.max]
    p, y, base = [], [], []
    take = lambda rs: (np.array([r[3:6] for r in rs]), np.array([r[6] for r in rs]))
    for a, b in zip(cuts, cuts[1:]):
        (x0, y0), (x1, y1) = take([r for r in known if r[1] < a]), take([r for r in known if a <= r[1] < b])
        p.append(np_predict(np_logit(x0, y0), x1))
        y.append(y1)
        base.append(np.full(len(y1), y0.mean()))
    return *map(np.concatenate, (p, y, base)), np_logit(*take(known))


@pytest.mark.parametrize(("strength", "passes"), [(1.5, True), (0.0, False)])
def test_model_versions(spark, strength, passes):
    rows = vol_rows(3, strength)
    ds = spark.createDataFrame(rows, "ticker string, date date, target_date date, abs_ret double, vol5 double, vol20 double, y double")
    asofs = [dt.date(2023, 2, 1), dt.date(2023, 6, 1), dt.date(2023, 9, 15)]
    table = volatility.fit_versions(ds, asofs, VOL_XS, 4, {"n": 80, "auc": 0.55, "skill": 0.01})
    got = {r.asof: r for r in table.collect()}
    assert got[asofs[0]].failed == ["sample"] and got[asofs[0]].b is None and not got[asofs[0]].calibrated
    models = {}
    for a in asofs[1:]:
        p, y, base, models[a] = np_version(rows, a, 4)
        r = got[a]
        brier, brier_base = ((p - y) ** 2).mean(), ((base - y) ** 2).mean()
        assert r.n_oos == len(y) and np.allclose((r.auc, r.brier, r.skill, r.base_oos), (np_auc(p, y), brier, 1 - brier / brier_base, y.mean()), atol=1e-6)
        assert np.allclose(r.b, models[a][0], atol=1e-6) and np.allclose(r.mean, models[a][1]) and r.calibrated == passes and bool(r.failed) != passes
    m, model = volatility.fit_calibrator(ds.where("target_date <= '2023-09-15'"), VOL_XS, 4, {"n": 80, "auc": 0.55, "skill": 0.01})
    assert m["calibrated"] == passes == (model is not None) and abs(m["auc"] - got[asofs[2]].auc) < 1e-9
    # rows are scored by the last version at or before their day, and by the ordinal score where that is not calibrated
    latest = spark.createDataFrame([("A", d, 0.5, 0.4, 0.3, 1.0, 2.0, 0.5) for d in (dt.date(2023, 1, 5), asofs[0], dt.date(2023, 5, 31), asofs[1], dt.date(2023, 9, 14), asofs[2], dt.date(2024, 1, 1))],
                                   "ticker string, date date, abs_ret double, vol5 double, vol20 double, threshold double, n_eff double, dispersion double")
    old = table.where(f"asof = '{asofs[1]}'").withColumns({"asof": F.lit(asofs[2]), "feature_version": F.lit(99)})  # of other features: never used
    for r in volatility.vol_head_asof(latest, table.unionByName(old), VOL_XS).collect():
        a = max((x for x in asofs if x <= r.date), default=None)
        assert r.model_asof == a and r.vol_calib == int(passes and a in models)
        if r.vol_calib:
            p = float(np_predict(models[a], np.array([[0.5, 0.4, 0.3]]))[0])
            assert abs(r.p_vol - round(p, 4)) < 1e-9 and abs(r.vol_score - p) < 1e-6 and r.vol_base == got[a].base_oos
        else:
            assert r.p_vol is None and r.vol_base is None and abs(r.vol_score - round((0.25 + 0.12 + 0.06) * (1 + 0.1 + 0.025), 6)) < 1e-9


def test_feature_subsets_share_the_fits(spark):
    rows = vol_rows(5, 1.0)
    ds = spark.createDataFrame(rows, "ticker string, date date, target_date date, abs_ret double, vol5 double, vol20 double, y double")
    got = {(r.kind, r.features): r for r in evaluate.feature_ablation(ds, VOL_XS, 4).collect()}
    assert len(got) == 8
    for (_, names), r in got.items():
        at = [VOL_XS.index(x) for x in names.split(", ")]
        few = [(*x[:3], *[x[3 + i] for i in at], *[0.0] * (3 - len(at)), x[6]) for x in rows]
        p, y, base, _ = np_version(few, dt.date.max, 4)
        assert np.allclose((r.n, r.auc, r.skill), (len(y), np_auc(p, y), 1 - ((p - y) ** 2).mean() / ((base - y) ** 2).mean()), atol=1e-6)


def test_direction_horizons(spark):
    rng = np.random.default_rng(7)
    abn = [(t, dt.date(2023, 1, 1) + dt.timedelta(days=i), float(rng.normal())) for t in "ABCD" for i in range(150)]
    signals = [(t, d, v + float(rng.normal())) for t, d, v in abn]
    frame = lambda rows, c: spark.createDataFrame(rows, f"ticker string, date date, {c} double")
    got = {(r.horizon, r.side): r for r in evaluate.direction_horizons(frame(signals, "signal"), frame(abn, "abn"), (1, 20), 4).collect()}
    from tidewire.operators.labels import future_sessions

    f = {(r.ticker, r.date): r for r in future_sessions(frame(abn, "abn"), (1, 20)).collect()}
    for h in (1, 20):
        for side, sign in (("up", 1), ("down", -1)):
            rows = [(t, d, d, s, 0.0, 0.0, float(f[t, d][f"car_{h}"] * sign > 0.5 * f[t, d][f"sigma_{h}"])) for t, d, s in signals if (t, d) in f and f[t, d][f"car_{h}"] is not None and (f[t, d][f"sigma_{h}"] or 0) > 0]
            p, y, _, _ = np_version(rows, dt.date.max, 4)
            assert got[h, side].n == len(y) and abs(got[h, side].auc - np_auc(p, y)) < 1e-6


def test_running_order(spark):
    rng = random.Random(14)
    rows = [(k, i, float(rng.randrange(12) if k == "ties" else rng.random())) for k, n in (("ties", 300), ("long", 700), ("one", 1)) for i in range(n)]
    got = {(r.k, r.i): r for r in stats.running_order(spark.createDataFrame(rows, "k string, i long, v double").repartition(5), "k", "i", "v", {"low": lambda n: F.floor(0.2 * (n - 1)), "top": lambda n: n - 1}).collect()}
    seen = {}
    for k, i, v in rows:
        mine = sorted([*seen.get(k, []), v])
        seen[k] = mine
        assert (got[k, i].n, got[k, i].low, got[k, i].top) == (len(mine), mine[int(0.2 * (len(mine) - 1))], mine[-1])
    assert stats.running_order(spark.createDataFrame([], "k string, i long, v double"), "k", "i", "v", {"a": lambda n: n - 1}).count() == 0


def test_shuffled_keeps_groups(spark):
    rows = [(g, i, float(100 * g + i)) for g in range(3) for i in range(20 + g)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    for by in ((), ("g",)):
        got = evaluate.shuffled(df, "v", 3, by).collect()
        assert len(got) == 3 * len(rows) and {(r.perm, r.g, r.i) for r in got} == {(p, g, i) for p in (1, 2, 3) for g, i, _ in rows}
        for p in (1, 2, 3):
            mine = [r for r in got if r.perm == p]
            assert sorted(r.v for r in mine) == sorted(v for _, _, v in rows)
            assert any(r.v != 100 * r.g + r.i for r in mine)
            if by:
                assert all(r.v // 100 == r.g for r in mine)


def test_permutation_ic(spark):
    rng = random.Random(4)
    x = [rng.random() for _ in range(120)]
    near = evaluate.permutation_ic(spark.createDataFrame([(v, v + rng.random() / 10) for v in x], "x double, y double"), "x", "y", 60).first()
    none = evaluate.permutation_ic(spark.createDataFrame([(v, rng.random()) for v in x], "x double, y double"), "x", "y", 60).first()
    assert near.ic > 0.9 and abs(near.p_value - 1 / 61) < 1e-9 and near.n == 120
    assert 0.1 < near.null_p95 < 0.3 and 0.1 < none.null_p95 < 0.3 and abs(none.ic) < 0.3
