"""Queries over panels: returns, labels, statistics, volatility, exposures, surprises."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import asof, calendars, evaluate, exposure, labels, panel, surprise, themes, volatility
from ..sources.sinks import written
from .mapping import ABN, BARS, R, bars, prices, prices_sql, r6, returns_sql, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _rets(spark, sf):
    return panel.returns(prices(spark, sf))


def _abn(spark, sf):
    return panel.abnormal_returns(_rets(spark, sf))


def _driver_rets(spark, sf):
    return panel.returns(prices(spark, sf, "p_type", "driver"), "driver")


DRIVERS = prices_sql("p_type", "driver", "dprices") + ", " + returns_sql("dprices", "driver", "drets")


@query("returns", f"WITH {prices_sql()}, {returns_sql()} SELECT ticker, date, {R('ret')} AS ret FROM rets")
def q_returns(spark, sf):
    return _rets(spark, sf).select("ticker", "date", r6("ret").alias("ret"))


@query("abnormal_returns", f"WITH {ABN} SELECT ticker, date, {R('abn')} AS abn FROM abn")
def q_abn(spark, sf):
    return _abn(spark, sf).select("ticker", "date", r6("abn").alias("abn"))


@query("market_return", f"WITH {ABN} SELECT date, {R('market')} AS market FROM market")
def q_market(spark, sf):
    return panel.market_return(_rets(spark, sf)).select("date", r6("market").alias("market"))


@query("cross_sectional_residual", f"""WITH {prices_sql()}, {returns_sql()}, m AS (SELECT date, avg(ret) AS m FROM rets GROUP BY date HAVING count(*) >= 8)
SELECT ticker, date, {R('ret - m')} AS residual FROM rets JOIN m USING (date)""")
def q_residual(spark, sf):
    return panel.cross_sectional_residual(_rets(spark, sf), least=8).select("ticker", "date", r6("residual").alias("residual"))


@query("bar_returns", f"""WITH {BARS}, x AS (SELECT *, lag(close) OVER w AS p, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, {R('close / p - 1')} AS ret FROM x WHERE gap <= 14400 AND p <> 0""")
def q_bar_returns(spark, sf):
    return panel.bar_returns(bars(spark, sf)).select("symbol", "ts", r6("ret").alias("ret"))


@query("gaps", f"""WITH {prices_sql()}, o AS (SELECT ticker, date, close, close * (1 + (day(date) % 5 - 2) / 100.0) AS open FROM prices), x AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM o)
SELECT ticker, date, {R('open / p - 1')} AS gap, {R('close / open - 1')} AS open_close, {R('close / p - 1')} AS close_close FROM x""")
def q_gaps(spark, sf):
    p = prices(spark, sf).withColumn("open", F.col("close") * (1 + (F.dayofmonth("date") % 5 - 2) / 100.0))
    return panel.gaps(p).select("ticker", "date", *[r6(c).alias(c) for c in ("gap", "open_close", "close_close")])


@query("weekly", f"""WITH {prices_sql()}
SELECT ticker, CAST(isoyear(date) AS INT) AS iso_year, CAST(weekofyear(date) AS INT) AS iso_week, max(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY ticker, isoyear(date), weekofyear(date)""")
def q_weekly(spark, sf):
    return panel.resample_weekly(prices(spark, sf))


@query("common_dates", f"WITH {prices_sql('p_type', 'driver')} SELECT date FROM prices GROUP BY date HAVING count(DISTINCT driver) = (SELECT count(DISTINCT driver) FROM prices)")
def q_common(spark, sf):
    return panel.common_dates(prices(spark, sf, "p_type", "driver"))


@query("macro_vol", f"WITH {DRIVERS} SELECT date, {R('avg(abs(ret))')} AS macro_vol FROM drets GROUP BY date")
def q_macro_vol(spark, sf):
    return panel.driver_vol(_driver_rets(spark, sf)).select("date", r6("macro_vol").alias("macro_vol"))


@query("asymmetry", f"""WITH {ABN}, j AS (SELECT * FROM rets JOIN market USING (date)), a AS (SELECT ticker,
  CASE WHEN count(*) FILTER (market < 0) >= 30 THEN regr_slope(ret, market) FILTER (market < 0) END AS d, CASE WHEN count(*) FILTER (market > 0) >= 30 THEN regr_slope(ret, market) FILTER (market > 0) END AS u,
  count(*) FILTER (market < 0) AS n_down, count(*) FILTER (market > 0) AS n_up FROM j GROUP BY ticker)
SELECT ticker, {R('d')} AS beta_down, {R('u')} AS beta_up, {R('d - u')} AS asymmetry, n_down, n_up FROM a""")
def q_asymmetry(spark, sf):
    rets = _rets(spark, sf)
    return panel.asymmetry(rets, panel.market_return(rets)).select("ticker", *[r6(c).alias(c) for c in ("beta_down", "beta_up", "asymmetry")], "n_down", "n_up")


@query("anomaly_signals", f"""WITH {prices_sql()}, {returns_sql()}, p AS (SELECT ticker, date, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom, -(close / lag(close, 21) OVER w - 1) AS rev FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
v AS (SELECT ticker, date, ret, CASE WHEN count(ret) OVER a = 60 THEN stddev_pop(ret) OVER a END AS v60, CASE WHEN count(ret) OVER b = 20 THEN stddev_pop(ret) OVER b END AS v20 FROM rets
  WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))
SELECT ticker, date, {R('mom')} AS momentum_12_1, {R('rev')} AS reversal_1m, {R('-ret')} AS reversal_1d, {R('-v60')} AS low_vol_60, {R('v20')} AS vol_20 FROM p JOIN v USING (ticker, date)""")
def q_anomalies(spark, sf):
    p = prices(spark, sf)
    return panel.anomaly_signals(p, panel.returns(p)).select("ticker", "date", *[r6(c).alias(c) for c in ("momentum_12_1", "reversal_1m", "reversal_1d", "low_vol_60", "vol_20")])


@query("zscore", f"WITH {prices_sql()}, {returns_sql()} SELECT ticker, date, {R('CASE WHEN stddev_pop(ret) OVER w > 0 THEN (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w ELSE 0 END')} AS z FROM rets WINDOW w AS (PARTITION BY date)")
def q_zscore(spark, sf):
    return panel.zscore_by(_rets(spark, sf), "ret").select("ticker", "date", r6("z").alias("z"))


FUTURE = """fut AS (SELECT ticker, date, CASE WHEN count(abn) OVER p >= 8 THEN stddev_pop(abn) OVER p END AS sd,
  CASE WHEN count(abn) OVER n1 = 1 THEN sum(abn) OVER n1 END AS c1, CASE WHEN count(abn) OVER n5 = 5 THEN sum(abn) OVER n5 END AS c5, CASE WHEN count(abn) OVER n20 = 20 THEN sum(abn) OVER n20 END AS c20
  FROM abn WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), n1 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING),
  n5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), n20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
asofs AS (SELECT ticker, a.at_ FROM (SELECT DISTINCT ticker FROM abn), (SELECT DISTINCT CAST(date_trunc('week', date) AS DATE) + 5 AS at_ FROM abn) a),
lab0 AS (SELECT a.ticker, a.at_, f.* EXCLUDE (ticker, date) FROM asofs a ASOF JOIN fut f ON a.ticker = f.ticker AND a.at_ >= f.date),
lab1 AS (SELECT ticker, at_, '1d' AS horizon, c1 AS car, sd AS sigma FROM lab0 UNION ALL SELECT ticker, at_, '5d', c5, sd * sqrt(5) FROM lab0 UNION ALL SELECT ticker, at_, '20d', c20, sd * sqrt(20) FROM lab0),
labs AS (SELECT *, CASE WHEN car > 0.5 * sigma THEN 1 WHEN car < -0.5 * sigma THEN -1 ELSE 0 END AS cls FROM lab1 WHERE car IS NOT NULL AND sigma > 0)"""


def _labels(spark, sf):
    """Labels at every entity's Saturdays, which are no sessions of their own."""
    abn = _abn(spark, sf)
    days = abn.select(F.date_add(F.trunc("date", "week"), 5).alias("asof")).distinct()
    return labels.build_labels(abn.select("ticker").distinct().join(days), abn)


@query("labels", f"""WITH {ABN}, {FUTURE} SELECT ticker, at_ AS "asof", horizon, {R('car')} AS car, {R('sigma')} AS sigma, cls FROM labs""")
def q_labels(spark, sf):
    return _labels(spark, sf).select("ticker", "asof", "horizon", r6("car").alias("car"), r6("sigma").alias("sigma"), "cls")


@query("base_rates", f"""WITH {ABN}, {FUTURE}, o AS (SELECT horizon, ticker, count(*) AS n, avg((cls = 1)::INT) AS up, avg((cls = 0)::INT) AS flat, avg((cls = -1)::INT) AS down FROM labs GROUP BY ALL),
p AS (SELECT horizon, avg((cls = 1)::INT) AS pu, avg((cls = 0)::INT) AS pf, avg((cls = -1)::INT) AS pd FROM labs GROUP BY ALL)
SELECT horizon, ticker, n, {R('CASE WHEN n < 30 THEN pu ELSE up END')} AS up, {R('CASE WHEN n < 30 THEN pf ELSE flat END')} AS flat, {R('CASE WHEN n < 30 THEN pd ELSE down END')} AS down, n < 30 AS pooled FROM o JOIN p USING (horizon)""")
def q_base_rates(spark, sf):
    return labels.base_rates(_labels(spark, sf)).select("horizon", "ticker", "n", *[r6(c).alias(c) for c in ("up", "flat", "down")], "pooled")


RANKED = f"""WITH {ABN}, nx AS (SELECT ticker, date, abn, lead(abn) OVER (PARTITION BY ticker ORDER BY date) AS y FROM abn), ok AS (SELECT * FROM nx WHERE y IS NOT NULL)"""


def _pairs(spark, sf):
    from pyspark.sql import Window

    return _abn(spark, sf).withColumn("y", F.lead("abn").over(Window.partitionBy("ticker").orderBy("date"))).where("y is not null")


@query("spearman_ic", RANKED + f""", r AS (SELECT rank() OVER (ORDER BY abn) + (count(*) OVER (PARTITION BY abn) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM ok)
SELECT {R('corr(a, b)')} AS ic, count(*) AS n FROM r""")
def q_spearman(spark, sf):
    return stats.spearman(_pairs(spark, sf), "abn", "y").select(r6("ic").alias("ic"), "n")


FM = """, r AS (SELECT date, count(*) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY abn) + (count(*) OVER (PARTITION BY date, abn) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS b FROM ok), ics AS (SELECT date, corr(a, b) AS ic FROM r WHERE n >= 8 GROUP BY date)"""


@query("fama_macbeth", RANKED + FM + f" SELECT count(*) AS n_dates, {R('avg(ic)')} AS mean_ic, {R('avg(ic) / (stddev_samp(ic) / sqrt(count(*)))')} AS t FROM ics WHERE ic IS NOT NULL AND NOT isnan(ic)")
def q_fama_macbeth(spark, sf):
    return evaluate.fama_macbeth(_pairs(spark, sf), "abn", "y").select("n_dates", r6("mean_ic").alias("mean_ic"), r6("t").alias("t"))


LL = f"""WITH {prices_sql("p_type", "ticker")}, {returns_sql()}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM rets)), x AS (SELECT * FROM rets JOIN d USING (date)),
j AS (SELECT a.ticker AS lead, b.ticker AS follow, a.ret AS x, b.ret AS y FROM x a JOIN x b ON b.i = a.i + 1 AND a.ticker <> b.ticker),
r AS (SELECT lead, follow, rank() OVER (PARTITION BY lead, follow ORDER BY x) + (count(*) OVER (PARTITION BY lead, follow, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lead, follow ORDER BY y) + (count(*) OVER (PARTITION BY lead, follow, y) - 1) / 2.0 AS b FROM j)
SELECT lead, follow, count(*) AS n, {R('corr(a, b)')} AS ic FROM r GROUP BY ALL HAVING count(*) >= 60"""


@query("leadlag_pairs", LL)
def q_leadlag(spark, sf):
    return evaluate.leadlag_pairs(panel.returns(prices(spark, sf, "p_type"))).withColumn("ic", r6("ic"))


@query("leadlag_null")
def q_leadlag_null(spark, sf):
    got = evaluate.leadlag_null(panel.returns(prices(spark, sf, "p_type")), 100)
    return got.select(*[r6(c).alias(c) if k == "double" else c for c, k in got.dtypes])


@query("leadlag_block_shuffled")
def q_leadlag_shuffled(spark, sf):
    return evaluate.leadlag_pairs(evaluate.block_shuffled(panel.returns(prices(spark, sf, "p_type")))).withColumn("ic", r6("ic"))


VOL = f"""{ABN}, {DRIVERS}, mv AS (SELECT date, avg(abs(ret)) AS macro_vol FROM drets GROUP BY date),
f0 AS (SELECT ticker, date, abn, row_number() OVER w AS i, abs(abn) AS abs_ret, stddev_pop(abn) OVER w5 AS vol5, stddev_pop(abn) OVER w20 AS vol20, count(abn) OVER w20 AS n, lead(date) OVER w AS target_date, lead(abs(abn)) OVER w AS next_abs FROM abn
  WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
f AS (SELECT ticker, f0.date, target_date, abn, next_abs, abs_ret, vol5, vol20, coalesce(macro_vol, 0) AS macro_vol,
  CASE WHEN target_date = CAST(date_trunc('month', target_date) AS DATE) + CAST((5 - isodow(date_trunc('month', target_date)) + 7) % 7 AS INT) THEN 1.0 ELSE 0.0 END AS event FROM f0 LEFT JOIN mv ON f0.date = mv.date WHERE i >= 22 AND n >= 15)"""


@query("volatility_features", f"WITH {VOL} SELECT ticker, date, target_date, {R('abs_ret')} AS abs_ret, {R('vol5')} AS vol5, {R('vol20')} AS vol20, {R('macro_vol')} AS macro_vol, CAST(event AS DOUBLE) AS event FROM f")
def q_vol_features(spark, sf):
    f = volatility.features(_abn(spark, sf), panel.driver_vol(_driver_rets(spark, sf)))
    return f.select("ticker", "date", "target_date", *[r6(c).alias(c) for c in ("abs_ret", "vol5", "vol20", "macro_vol")], "event")


@query("volatility_dataset", f"""WITH {VOL}, l AS (SELECT ticker, date, list_sort(list(abs(abn)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS l FROM abn), t AS (SELECT ticker, date, l[CAST(floor(0.8 * (len(l) - 1)) AS INT) + 1] AS threshold FROM l WHERE len(l) >= 40)
SELECT ticker, date, {R('threshold')} AS threshold, CAST(next_abs > threshold AS DOUBLE) AS y FROM f JOIN t USING (ticker, date) WHERE next_abs IS NOT NULL""")
def q_vol_dataset(spark, sf):
    d = volatility.dataset(_abn(spark, sf), panel.driver_vol(_driver_rets(spark, sf)))
    return d.select("ticker", "date", r6("threshold").alias("threshold"), "y")


def _vol_latest(spark, sf):
    abn = _abn(spark, sf)
    f = volatility.features(abn, panel.driver_vol(_driver_rets(spark, sf))).join(volatility.expanding_threshold(abn), ["ticker", "date"])
    return f.where("threshold is not null").withColumns({"n_eff": (F.dayofmonth("date") % 6).cast("double"), "dispersion": F.lit(0.25)})


@query("volatility_bands", f"""WITH {VOL}, l AS (SELECT ticker, date, list_sort(list(abs(abn)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS l FROM abn), t AS (SELECT ticker, date, l[CAST(floor(0.8 * (len(l) - 1)) AS INT) + 1] AS threshold FROM l WHERE len(l) >= 40),
s AS (SELECT ticker, date, {R('(0.5 * abs_ret + 0.3 * vol5 + 0.2 * vol20) / threshold * (1 + 0.05 * least(CAST(day(date) % 6 AS DOUBLE), 4.0) + 0.05 * least(0.25, 1.0))')} AS vol_score FROM f JOIN t USING (ticker, date)),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY vol_score DESC, ticker) AS vol_rank, count(*) OVER (PARTITION BY date) AS n FROM s)
SELECT ticker, date, vol_score, vol_rank, CASE WHEN vol_rank - 1 < n / 3.0 THEN 'high' WHEN vol_rank - 1 < 2 * n / 3.0 THEN 'medium' ELSE 'low' END AS vol_band FROM k""")
def q_vol_bands(spark, sf):
    return volatility.bands(volatility.vol_head(_vol_latest(spark, sf)), "date").select("ticker", "date", "vol_score", F.col("vol_rank").cast("long").alias("vol_rank"), "vol_band")


@query("volatility_calibrator")
def q_vol_calibrator(spark, sf):
    d = written(volatility.dataset(_abn(spark, sf), panel.driver_vol(_driver_rets(spark, sf))), "volatility")
    m, _ = volatility.fit_calibrator(d)
    return spark.createDataFrame([(k, str(v)) for k, v in m.items()], "metric string, value string")


@query("volatility_calibrated")
def q_vol_calibrated(spark, sf):
    """Versions fitted at four year ends, and every row scored by the one that stood then. The gates are laxer than the defaults,
    so that versions pass on these tables."""
    d = written(volatility.dataset(_abn(spark, sf), panel.driver_vol(_driver_rets(spark, sf))), "volatility")
    models = volatility.fit_versions(d, [dt.date(y, 12, 31) for y in (1993, 1994, 1995, 1996)], gates={"n": 500, "auc": 0.5, "auc_lo": 0.4, "skill": -0.01})
    got = volatility.vol_head_asof(_vol_latest(spark, sf), models)
    return got.select("ticker", "date", "model_asof", "p_vol", r6("vol_base").alias("vol_base"), "vol_calib", r6("vol_score").alias("vol_score"))


@query("volatility_target_variants")
def q_vol_variants(spark, sf):
    return volatility.target_variants(written(volatility.dataset(_abn(spark, sf), panel.driver_vol(_driver_rets(spark, sf))), "volatility"))


@query("feature_ablation")
def q_ablation(spark, sf):
    d = written(volatility.dataset(_abn(spark, sf), panel.driver_vol(_driver_rets(spark, sf))), "volatility")
    return evaluate.feature_ablation(d, ["abs_ret", "vol20", "macro_vol"], 3)


@query("exposures")
def q_exposures(spark, sf):
    rets, d = _rets(spark, sf), written(_driver_rets(spark, sf), "drivers")
    return exposure.rolling_exposures(rets, d, d.select(F.last_day("date").alias("asof")).distinct(), 120, 60).withColumns({c: r6(c) for c in ("beta", "share", "r2")})


UNI = f"""WITH {prices_sql()}, {returns_sql()}, {DRIVERS}, d AS (SELECT date, avg(ret) AS x FROM drets GROUP BY date), j AS (SELECT ticker, date, ret, x FROM rets JOIN d USING (date)),
b AS (SELECT ticker, date, x, CASE WHEN count(ret) OVER w >= 120 THEN covar_pop(ret, x) OVER w / nullif(var_pop(x) OVER w, 0) END AS beta FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))
SELECT ticker, date, {R('beta')} AS beta, {R('beta * x')} AS signal FROM b WHERE beta IS NOT NULL"""


@query("univariate_signal", UNI)
def q_univariate(spark, sf):
    d = _driver_rets(spark, sf).groupBy("date").agg(F.avg("ret").alias("x"))
    return exposure.univariate_signal(_rets(spark, sf), d).select("ticker", "date", r6("beta").alias("beta"), r6("signal").alias("signal"))


BETAS = f"""WITH {prices_sql()}, {returns_sql()}, {DRIVERS}, sd AS (SELECT driver, stddev_pop(ret) AS sd FROM drets GROUP BY driver), dm AS (SELECT driver, date, ret AS x FROM drets),
e AS (SELECT ticker, driver, regr_slope(ret, x) AS beta FROM rets JOIN dm USING (date) GROUP BY ALL)"""


def _static_betas(spark, sf):
    d = _driver_rets(spark, sf).select("driver", "date", F.col("ret").alias("x"))
    return _rets(spark, sf).join(d, "date").groupBy("ticker", "driver").agg(F.regr_slope("ret", "x").alias("beta"))


@query("driver_signal", BETAS + f""", s AS (SELECT e.ticker, d.date, sum(beta * x / sd) AS raw FROM e JOIN dm d ON e.driver = d.driver JOIN sd ON sd.driver = e.driver GROUP BY ALL)
SELECT ticker, date, {R('raw - avg(raw) OVER (PARTITION BY date)')} AS signal FROM s""")
def q_driver_signal(spark, sf):
    d = _driver_rets(spark, sf)
    e = _static_betas(spark, sf).join(d.select("driver", "date"), "driver")
    return exposure.driver_signal(e, d, d.groupBy("driver").agg(F.stddev_pop("ret").alias("sd"))).withColumn("signal", r6("signal"))


@query("top_drivers", BETAS + """, h AS (SELECT *, abs(beta) / sum(abs(beta)) OVER (PARTITION BY ticker) AS share FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY share DESC, driver) AS rank FROM h WHERE share >= 0.08)
SELECT ticker, driver, round(share, 6) AS share, rank FROM k WHERE rank <= 4""")
def q_top_drivers(spark, sf):
    from pyspark.sql import Window

    e = _static_betas(spark, sf).withColumn("share", F.abs("beta") / F.sum(F.abs("beta")).over(Window.partitionBy("ticker"))).withColumn("asof", F.lit("2000-01-01").cast("date"))
    return exposure.top_drivers(e).select("ticker", "driver", r6("share").alias("share"), F.col("rank").cast("long").alias("rank"))


THEME = f"""WITH {ABN}, ent AS (SELECT DISTINCT p_brand AS ticker, 's' || right(p_brand, 1) AS sector, [substr(p_brand, 7, 1)] AS attrs FROM part),
se(theme, sector, effect) AS (VALUES ('rates', 's1', 1), ('rates', 's2', -1), ('rates', 's3', -1), ('energy', 's4', -1), ('energy', 's1', 1)), ae(theme, attribute, effect) AS (VALUES ('rates', '1', -1), ('energy', '2', 1), ('state', '3', -1), ('state', '4', 1)),
u AS (SELECT theme, ticker, effect FROM ent JOIN se USING (sector) UNION ALL SELECT theme, ticker, effect FROM (SELECT ticker, unnest(attrs) AS attribute FROM ent) JOIN ae USING (attribute)),
eff AS (SELECT theme, ticker, CAST(sign(sum(effect)) AS INT) AS effect FROM u GROUP BY ALL)"""


def _effects(spark, sf):
    ent = table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct().select("ticker", F.concat(F.lit("s"), F.right("ticker", F.lit(1))).alias("sector"), F.array(F.substring("ticker", 7, 1)).alias("attributes"))
    se = spark.createDataFrame([("rates", "s1", 1), ("rates", "s2", -1), ("rates", "s3", -1), ("energy", "s4", -1), ("energy", "s1", 1)], "theme string, sector string, effect int")
    ae = spark.createDataFrame([("rates", "1", -1), ("energy", "2", 1), ("state", "3", -1), ("state", "4", 1)], "theme string, attribute string, effect int")
    return themes.effect_matrix(ent, se, ae)


@query("theme_effects", THEME + " SELECT theme, ticker, effect FROM eff")
def q_theme_effects(spark, sf):
    return _effects(spark, sf)


PORT = ", s AS (SELECT * FROM eff WHERE effect <> 0), n AS (SELECT theme, count(*) AS n FROM s GROUP BY theme), port AS (SELECT s.theme, a.date, sum(effect * abn) / sum(abs(effect)) AS ret, count(*) AS k, any_value(n.n) AS n FROM abn a JOIN s USING (ticker) JOIN n ON n.theme = s.theme GROUP BY s.theme, a.date HAVING count(*) >= greatest(2.0, any_value(n.n) / 2.0))"


@query("theme_portfolio", THEME + PORT + f" SELECT theme, date, {R('ret')} AS ret FROM port")
def q_theme_portfolio(spark, sf):
    return themes.portfolio(_abn(spark, sf), _effects(spark, sf)).withColumn("ret", r6("ret"))


@query("lagged_ic", THEME + PORT + f""", {DRIVERS}, x AS (SELECT date, avg(ret) AS x FROM drets GROUP BY date), l AS (SELECT theme, date, ret AS y0, lead(ret, 1) OVER w AS y1, lead(ret, 2) OVER w AS y2 FROM port WINDOW w AS (PARTITION BY theme ORDER BY date)),
u2 AS (SELECT theme, 0 AS lag, x, y0 AS y FROM l JOIN x USING (date) UNION ALL SELECT theme, 1, x, y1 FROM l JOIN x USING (date) UNION ALL SELECT theme, 2, x, y2 FROM l JOIN x USING (date)), o AS (SELECT * FROM u2 WHERE y IS NOT NULL),
r AS (SELECT theme, lag, rank() OVER (PARTITION BY theme, lag ORDER BY x) + (count(*) OVER (PARTITION BY theme, lag, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY theme, lag ORDER BY y) + (count(*) OVER (PARTITION BY theme, lag, y) - 1) / 2.0 AS b FROM o)
SELECT theme, lag, count(*) AS n, {R('corr(a, b)')} AS ic FROM r GROUP BY ALL""")
def q_lagged_ic(spark, sf):
    x = _driver_rets(spark, sf).groupBy("date").agg(F.avg("ret").alias("x"))
    return evaluate.lagged_ic(x, themes.portfolio(_abn(spark, sf), _effects(spark, sf))).withColumn("ic", r6("ic"))


EARN = """act AS (SELECT o_custkey AS k, o_orderpriority AS metric, l_shipdate AS rel, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS actual FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
con AS (SELECT o_custkey AS k, o_orderpriority AS metric, o_orderdate AS ts_, o_totalprice AS consensus, o_orderkey % 7 AS disp FROM orders)"""


@query("earnings_surprise", f"""WITH {EARN}, b AS (SELECT k, metric, ts_, max((consensus, disp)) AS c FROM con GROUP BY ALL), j AS (SELECT a.*, b.c[1] AS consensus, b.c[2] AS disp FROM act a ASOF LEFT JOIN b ON a.k = b.k AND a.metric = b.metric AND a.rel > b.ts_)
SELECT id, {R('consensus')} AS consensus, {R('CASE WHEN disp <> 0 THEN (actual - consensus) / disp END')} AS surprise FROM j""")
def q_earnings(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    con = o.select(F.col("o_custkey").cast("string").alias("ticker"), F.lit("p").alias("period"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("consensus"), (F.col("o_orderkey") % 7).cast("double").alias("dispersion"), F.col("o_orderdate").alias("asof_ts"))
    act = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").cast("string").alias("ticker"), F.lit("p").alias("period"), F.col("o_orderpriority").alias("metric"), F.col("l_extendedprice").alias("actual"), F.col("l_shipdate").alias("released_ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    got = asof.asof_join(act, con.drop("period"), ["ticker", "metric"], "released_ts", "asof_ts", "backward", strict=True)
    return got.select("id", r6("r_consensus").alias("consensus"), r6(F.try_divide(F.col("actual") - F.col("r_consensus"), F.nullif("r_dispersion", F.lit(0.0)))).alias("surprise"))


SUMMARY = """act AS (SELECT o_custkey::VARCHAR AS ticker, year(o_orderdate)::VARCHAR AS period, o_orderpriority AS metric, l_shipdate AS rel, l_extendedprice AS actual FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
con AS (SELECT o_custkey::VARCHAR AS ticker, year(o_orderdate)::VARCHAR AS period, o_orderpriority AS metric, o_orderdate AS ts_, o_totalprice AS consensus, (o_orderkey % 7)::DOUBLE AS disp FROM orders WHERE o_orderkey % 3 <> 0)"""


@query("earnings_summary", f"""WITH {SUMMARY}, b AS (SELECT ticker, period, metric, ts_, max((consensus, disp)) AS c FROM con GROUP BY ALL),
j AS (SELECT a.*, b.c[1] AS consensus, CASE WHEN b.c[2] <> 0 THEN (actual - b.c[1]) / b.c[2] END AS surprise FROM act a ASOF LEFT JOIN b ON a.ticker = b.ticker AND a.period = b.period AND a.metric = b.metric AND a.rel > b.ts_),
g AS (SELECT ticker, period, max(rel) AS at_, median(surprise) AS m, count(surprise) AS n, count(*) FILTER (consensus IS NULL) AS k FROM j GROUP BY ALL)
SELECT ticker, period, {R('m')} AS median_surprise, n AS n_metrics, k AS n_without_consensus FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY at_ DESC, period DESC) AS r FROM g) WHERE r = 1""")
def q_earnings_summary(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    who = [F.col("o_custkey").cast("string").alias("ticker"), F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderpriority").alias("metric")]
    con = o.where("o_orderkey % 3 != 0").select(*who, F.col("o_totalprice").alias("consensus"), (F.col("o_orderkey") % 7).cast("double").alias("dispersion"), F.col("o_orderdate").alias("asof_ts"))
    act = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(*who, F.col("l_extendedprice").alias("actual"), F.col("l_shipdate").alias("released_ts"))
    got = surprise.earnings_summary(surprise.earnings_surprise(act, con))
    return got.select("ticker", "period", r6("median_surprise").alias("median_surprise"), "n_metrics", "n_without_consensus")


@query("asof_forward", f"""WITH {prices_sql()}, {returns_sql()}, ev AS (SELECT DISTINCT p_brand AS ticker, CAST(o_orderdate AS DATE) AS event FROM orders JOIN part ON o_orderkey % 200 = p_partkey % 200), j AS (SELECT ev.ticker, event, r.date, r.ret FROM ev ASOF LEFT JOIN rets r ON ev.ticker = r.ticker AND ev.event <= r.date)
SELECT ticker, event, CASE WHEN date - event <= 5 THEN date END AS session, {R('CASE WHEN date - event <= 5 THEN ret END')} AS ret FROM j""")
def q_asof_forward(spark, sf):
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    # days and brands of a remainder are distinct before they meet: orders and parts themselves would make all pairs of a remainder
    days = o.select((F.col("o_orderkey") % 200).alias("k"), F.to_date("o_orderdate").alias("event")).distinct()
    brands = p.select((F.col("p_partkey") % 200).alias("k"), F.col("p_brand").alias("ticker")).distinct()
    ev = days.join(brands, "k").select("ticker", "event").distinct()
    j = asof.asof_join(ev, _rets(spark, sf), ["ticker"], "event", "date", "forward", tolerance=5)
    return j.select("ticker", "event", F.col("r_date").alias("session"), r6("r_ret").alias("ret"))


MACRO = """con AS (SELECT o_orderpriority AS indicator, CAST(date_trunc('month', o_orderdate) AS DATE) AS ref_month, CAST(o_orderdate AS DATE) AS projected, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 1000000.0 AS median, (day(o_orderdate) % 4)::DOUBLE AS stddev, CAST(count(*) + 9 AS INT) AS n_resp FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE), date_trunc('month', o_orderdate), day(o_orderdate)),
rea AS (SELECT o_orderpriority AS indicator, CAST(date_trunc('month', l_shipdate) AS DATE) AS ref_month, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / count(*) / 1000000.0 AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority, date_trunc('month', l_shipdate)),
la AS (SELECT indicator, ref_month, max((projected, median, stddev, n_resp)) AS x FROM con WHERE n_resp >= 10 GROUP BY ALL),
sur AS (SELECT indicator, ref_month, x[1] AS projected, x[2] AS median, value AS realized, CASE WHEN x[3] <> 0 THEN (value - x[2]) / x[3] END AS surprise FROM la JOIN rea USING (indicator, ref_month))"""


def _macro(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    mean = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count("*") / 1000000.0
    con = o.groupBy(F.col("o_orderpriority").alias("indicator"), F.to_date("o_orderdate").alias("projected")).agg(mean("o_totalprice").alias("median"), (F.count("*") + 9).cast("int").alias("n_resp"))
    con = con.withColumns({"ref_month": F.to_date(F.trunc("projected", "month")), "stddev": (F.dayofmonth("projected") % 4).cast("double")})
    rea = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_orderpriority").alias("indicator"), F.to_date(F.trunc("l_shipdate", "month")).alias("ref_month")).agg(mean("l_extendedprice").alias("value"))
    return surprise.macro_surprise(con, rea)


@query("macro_surprise", f"WITH {MACRO} SELECT indicator, ref_month, projected, {R('median')} AS median, {R('realized')} AS realized, {R('surprise')} AS surprise FROM sur")
def q_macro_surprise(spark, sf):
    return _macro(spark, sf).select("indicator", "ref_month", "projected", *[r6(c).alias(c) for c in ("median", "realized", "surprise")])


REL = """rel0 AS (SELECT indicator, surprise, ref_month, CAST(ref_month + INTERVAL 1 MONTH AS DATE) + 9 AS d FROM sur WHERE surprise IS NOT NULL), rel AS (SELECT indicator, surprise, ref_month, d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS event FROM rel0),
ok AS (SELECT indicator FROM rel GROUP BY indicator HAVING count(*) >= 8), pr AS (SELECT t.ticker, r.indicator, r.event, r.surprise FROM rel r JOIN ok USING (indicator), (SELECT DISTINCT ticker FROM abn) t),
hit AS (SELECT p.ticker, p.indicator, p.surprise, a.abn FROM pr p ASOF JOIN abn a ON p.ticker = a.ticker AND p.event <= a.date),
bet AS (SELECT ticker, indicator, regr_slope(abn, surprise) AS beta, count(*) AS n FROM hit GROUP BY ALL HAVING count(*) >= 8)"""


def _betas(spark, sf):
    s = _macro(spark, sf).where("surprise is not null").withColumn("date", surprise.release_date(F.col("indicator"), F.col("ref_month")))
    return surprise.fit_betas(_abn(spark, sf), s), s


@query("surprise_betas", f"WITH {ABN}, {MACRO}, {REL} SELECT ticker, indicator, {R('beta')} AS beta, n FROM bet WHERE beta IS NOT NULL")
def q_surprise_betas(spark, sf):
    return _betas(spark, sf)[0].withColumn("beta", r6("beta"))


@query("implied_effect", f"WITH {ABN}, {MACRO}, {REL}, las AS (SELECT indicator, max((ref_month, surprise)) AS x FROM rel GROUP BY ALL) SELECT ticker, indicator, {R('(beta - avg(beta) OVER (PARTITION BY indicator)) * x[2] * 100')} AS implied_pp FROM bet JOIN las USING (indicator) WHERE beta IS NOT NULL")
def q_implied(spark, sf):
    b, s = _betas(spark, sf)
    return surprise.implied_effect(b, s, demean=True).select("ticker", "indicator", r6("implied_pp").alias("implied_pp"))


@query("rule_calendar", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem), d AS (SELECT 'Payroll EUA' AS event, m + CAST((5 - isodow(m) + 7) % 7 AS INT) AS d FROM m UNION ALL SELECT 'PMI China', m FROM m UNION ALL SELECT 'CPI EUA', m + 11 FROM m)
SELECT event, d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS date FROM d""")
def q_calendar(spark, sf):
    from ..config import EVENT_RULES

    months = table(spark, sf, "lineitem").select(F.to_date(F.trunc("l_shipdate", "month")).alias("m")).distinct()
    rules = F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.lit(r).alias("rule")) for e, (_, r) in EVENT_RULES.items()])).alias("x")
    return months.select("m", rules).select("x.event", calendars.rule_date(F.col("x.rule"), F.col("m")).alias("date"))


RULES = {"payroll": ("ECONOMY", "first_friday"), "prices": ("LARGE", "day12"), "orders": ("PROMO", "day1")}  #: types of parts stand for instruments
_FROM, _TO = "1994-01-01", "1996-06-30"
SCHEDULED = f"""sm AS (SELECT unnest(generate_series(DATE '{_FROM}', DATE '{_TO}', INTERVAL 1 MONTH))::DATE AS m),
sd0 AS (SELECT 'payroll' AS event, 'ECONOMY' AS instrument, m + CAST((5 - isodow(m) + 7) % 7 AS INT) AS d FROM sm UNION ALL SELECT 'orders', 'PROMO', m FROM sm UNION ALL SELECT 'prices', 'LARGE', m + 11 FROM sm),
scheduled AS (SELECT event, instrument, d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS date FROM sd0)"""


@query("market_proxy", f"""WITH {DRIVERS}, {SCHEDULED}, ps AS (SELECT driver, stddev_pop(ret) AS sd FROM drets GROUP BY driver), pj AS (SELECT s.event, s.instrument, s.date, r.date AS session, ret FROM scheduled s ASOF JOIN drets r ON s.instrument = r.driver AND s.date <= r.date),
p1 AS (SELECT event, instrument, session, min(date) AS date, any_value(ret) AS ret FROM pj WHERE session - date <= 5 GROUP BY ALL)
SELECT event, instrument, date, session, {R('ret / nullif(sd, 0)')} AS proxy FROM p1 JOIN ps ON driver = instrument""")
def q_proxy(spark, sf):
    rets = written(_driver_rets(spark, sf), "drivers").withColumnRenamed("driver", "instrument")
    got = surprise.market_proxy(calendars.rule_dates(spark, _FROM, _TO, RULES), rets)
    return got.withColumn("proxy", r6("proxy"))


@query("pre_event_context", BETAS + f""", {SCHEDULED}, h AS (SELECT *, abs(beta) / sum(abs(beta)) OVER (PARTITION BY ticker) AS share FROM e)
SELECT ticker, event, s.date, driver, {R('share')} AS share, {R("share * CASE WHEN s.date = DATE '1995-03-03' THEN 1.0 ELSE 0.7 END")} AS context FROM h JOIN scheduled s ON s.instrument = h.driver WHERE s.date BETWEEN DATE '1995-03-03' AND DATE '1995-03-13'""")
def q_context(spark, sf):
    e = _static_betas(spark, sf)
    total = e.groupBy("ticker").agg(F.sum(F.abs("beta")).alias("t_"))
    shares = e.join(total, "ticker").select("ticker", "driver", (F.abs("beta") / F.col("t_")).alias("share"))
    got = calendars.pre_event_context(shares, calendars.rule_dates(spark, _FROM, _TO, RULES), "1995-03-03", 10)
    return got.select("ticker", "event", "date", "driver", r6("share").alias("share"), r6("context").alias("context"))


@query("event_car", f"""WITH {ABN}, {MACRO}, {REL}, c AS (SELECT ticker, date, CASE WHEN count(abn) OVER w = 4 THEN sum(abn) OVER w END AS car FROM abn WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)), e AS (SELECT DISTINCT ticker, event FROM pr)
SELECT e.ticker, event, {R('car')} AS car FROM e ASOF LEFT JOIN c ON e.ticker = c.ticker AND e.event <= c.date""")
def q_event_car(spark, sf):
    b, s = _betas(spark, sf)
    abn = _abn(spark, sf)
    enough = s.groupBy("indicator").count().where("count >= 8")
    ev = s.join(enough, "indicator", "left_semi").select(F.col("date").alias("event")).distinct().join(abn.select("ticker").distinct())
    return evaluate.event_car(abn, ev, -1, 2).withColumn("car", r6("car"))


@query("permutation_dispersion")
def q_perm_dispersion(spark, sf):
    s = _macro(spark, sf).where("surprise is not null").withColumn("date", surprise.release_date(F.col("indicator"), F.col("ref_month"))).groupBy("date").agg(F.max("surprise").alias("surprise"))
    return evaluate.permutation_dispersion(_abn(spark, sf), s, 50)


@query("random_day_control")
def q_random_days(spark, sf):
    s = _macro(spark, sf).where("surprise is not null").withColumn("date", surprise.release_date(F.col("indicator"), F.col("ref_month"))).groupBy("date").agg(F.max("surprise").alias("surprise"))
    return evaluate.random_day_control(_abn(spark, sf), s, 30)


@query("asymmetry_persistence", f"""WITH {prices_sql()}, {returns_sql()}, m AS (SELECT date, avg(ret) AS x FROM rets GROUP BY date HAVING count(*) >= 3), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM rets)),
a AS (SELECT ticker, i // 378 AS cut, i % 378 < 252 AS past, regr_slope(ret, x) FILTER (x < 0) - regr_slope(ret, x) FILTER (x > 0) AS a, least(count(*) FILTER (x < 0), count(*) FILTER (x > 0)) AS n FROM rets JOIN m USING (date) JOIN i USING (date) GROUP BY ALL),
o AS (SELECT cut, p.a AS x, f.a AS y FROM a p JOIN a f USING (ticker, cut) WHERE p.past AND NOT f.past AND p.n >= 10 AND f.n >= 3 AND p.a IS NOT NULL AND f.a IS NOT NULL),
r AS (SELECT cut, rank() OVER (PARTITION BY cut ORDER BY x) + (count(*) OVER (PARTITION BY cut, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY cut ORDER BY y) + (count(*) OVER (PARTITION BY cut, y) - 1) / 2.0 AS b FROM o),
c AS (SELECT cut, corr(a, b) AS ic FROM r GROUP BY cut HAVING count(*) >= 3) SELECT count(*) AS n_cuts, {R('avg(ic)')} AS mean_ic, {R('avg(ic) / (stddev_samp(ic) / sqrt(count(*)))')} AS t FROM c WHERE ic IS NOT NULL""")
def q_asym_persistence(spark, sf):
    rets = _rets(spark, sf)
    return evaluate.asymmetry_persistence(rets, panel.market_return(rets), 252, 126, 10).withColumns({c: r6(c) for c in ("mean_ic", "t")})


@query("asymmetry_walk")
def q_asym_walk(spark, sf):
    rets = written(_rets(spark, sf), "returns")
    got = evaluate.asymmetry_walk(rets, panel.market_return(rets), 252, 126, 63, 10, 100)
    return got.select("n_cuts", *[r6(c).alias(c) for c in ("mean_ic", "t", "p_value")])


@query("direction_horizons")
def q_direction(spark, sf):
    d = _driver_rets(spark, sf)
    e = _static_betas(spark, sf).join(d.select("driver", "date"), "driver")
    s = exposure.driver_signal(e, d, d.groupBy("driver").agg(F.stddev_pop("ret").alias("sd")))
    return evaluate.direction_horizons(s, _abn(spark, sf), (1, 5, 20), 3)
