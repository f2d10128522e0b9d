"""Queries over statements, filings, structured scores, rules, routing plans and combined signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alarms, evaluate, filings, fundamentals, panel, quality, routing, score
from .mapping import BARS, R, bars, prices, prices_sql, r6, returns_sql, table
from .market import BETAS, _static_betas
from .news import ARTICLES, LEX, _scored

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


LINES = """l AS (SELECT l_suppkey AS company, strftime(l_shipdate, '%Y-%m') AS period, ['3.01', '3.02', '3.03', '3.05', '3.11', '3.06', '9.9'][l_linenumber] AS code, CAST(round(l_extendedprice) AS DOUBLE) * CASE WHEN l_linestatus = 'O' THEN 1000 ELSE 1 END AS v,
  l_orderkey * 10 + l_linenumber AS line FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 7),
c AS (SELECT company, period, arg_max(v, line) FILTER (code = '3.01') AS rev, arg_max(v, line) FILTER (code = '3.02') AS cost, arg_max(v, line) FILTER (code = '3.03') AS gross, arg_max(v, line) FILTER (code = '3.11') AS net FROM l GROUP BY ALL)"""


@query("statements", f"WITH {LINES} SELECT company, period, rev, cost, gross, net, {R('net / nullif(rev, 0)')} AS net_margin, {R('gross / nullif(rev, 0)')} AS gross_margin, coalesce(abs(gross - (rev + cost)) / greatest(abs(gross), abs(rev + cost), 1) > 0.02, false) AS off FROM c")
def q_statements(spark, sf):
    li = table(spark, sf, "lineitem")
    codes = F.array(*[F.lit(c) for c in ("3.01", "3.02", "3.03", "3.05", "3.11", "3.06", "9.9")])
    lines = li.select(F.col("l_suppkey").alias("company"), F.lit("x").alias("name"), F.lit("f").alias("filed"), F.date_format("l_shipdate", "yyyy-MM").alias("period"), F.when(F.col("l_returnflag") == "R", "PENÚLTIMO").otherwise("ÚLTIMO").alias("exercise"),
                      F.element_at(codes, F.col("l_linenumber").cast("int")).alias("code"), F.lit("linha").alias("label"), F.round("l_extendedprice").cast("long").cast("string").alias("value"), F.when(F.col("l_linestatus") == "O", "MIL").otherwise("UNIDADE").alias("scale"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    p = fundamentals.ratios(fundamentals.validate(fundamentals.pivot_statements(lines)))
    c = F.col("concepts")
    return p.select("company", "period", c["receita_liquida"].alias("rev"), c["custo"].alias("cost"), c["lucro_bruto"].alias("gross"), c["lucro_liquido"].alias("net"), r6("net_margin").alias("net_margin"), r6("gross_margin").alias("gross_margin"), (F.size("problems") > 0).alias("off"))


@query("filings", """WITH f AS (SELECT o_orderkey, o_custkey % 40 AS c, o_orderpriority AS category FROM orders WHERE o_orderkey % 3 <> 0),
co(ticker, id, term) AS (VALUES ('AAAA3', 7, NULL), ('BBBB4', 11, NULL), ('CCCC1', NULL, 'ACAO 1'))
SELECT ticker, 'l' || o_orderkey AS url, CASE WHEN category = '1-URGENT' THEN 'FATO_RELEVANTE' ELSE 'CVM' END AS kind FROM f JOIN co ON c = id OR (id IS NULL AND contains('ACAO ' || c, term))""")
def q_filings(spark, sf):
    o = table(spark, sf, "orders")
    c = (F.col("o_custkey") % 40).cast("string")
    f = o.select(F.concat(F.lit("Ação "), c).alias("name"), F.concat(F.lit("00."), F.lpad(c, 3, "0"), F.lit("/-")).alias("tax_id"), F.col("o_orderpriority").alias("category"), F.lit("s").alias("subject"), F.lit("r").alias("reference"), F.lit("d").alias("delivered"), F.col("o_orderkey").cast("string").alias("protocol"), F.lit("1").alias("version"),
                 F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("l"), F.col("o_orderkey").cast("string"))).alias("link"))
    co = spark.createDataFrame([("AAAA3", "00.007", ["nada"]), ("BBBB4", "00.011", ["nada"]), ("CCCC1", "", ["ação 1"])], "ticker string, tax_id string, terms array<string>")
    return filings.match_filings(f, co, kinds={"1-URGENT": "FATO_RELEVANTE"}).select("ticker", "url", "kind")


STRUCT = "st AS (SELECT article_id, greatest(-1.0, least(1.0, (article_id % 30 - 15) / 10.0)) AS s, (article_id % 11) / 10.0 * CASE WHEN article_id % 2 = 0 THEN 0.25 ELSE 1 END * CASE WHEN article_id % 5 = 0 THEN 0.45 ELSE 1 END AS m FROM articles WHERE article_id % 4 <> 0)"


@query("ensemble", f"""WITH {ARTICLES}, {LEX}, {STRUCT}, j AS (SELECT sc.article_id, sc.s AS ls, sc.magnitude AS lm, round(st.s, 4) AS ts, round(st.m, 4) AS tm FROM sc LEFT JOIN st USING (article_id)), k AS (SELECT *, abs(ls) * lm AS wl, abs(ts) * tm AS wt FROM j)
SELECT article_id, CASE WHEN ts IS NULL OR (wt <= 1e-6 AND wl > 0.05) THEN ls ELSE ts END + 0.0 AS s, round(CASE WHEN ts IS NULL THEN lm WHEN wt <= 1e-6 AND wl > 0.05 THEN round(lm * 0.4, 4) ELSE tm END, 3) AS magnitude, round(round(CASE WHEN ts IS NULL THEN 0 ELSE wl - wt END, 4), 2) + 0.0 AS disagreement FROM k""")
def q_ensemble(spark, sf):
    lex = _scored(spark, sf).withColumn("ticker", F.lit("T"))
    i = F.col("article_id")
    resp = F.format_string('ok {"s": %s, "magnitude": %s, "ja_precificado": %s, "is_rumor": %s}', ((i % 30 - 15) / 10.0).cast("string"), ((i % 11) / 10.0).cast("string"), F.when(i % 2 == 0, "true").otherwise("false"), F.when(i % 5 == 0, "true").otherwise("false"))
    st = score.structured_score(lex.where("article_id % 4 != 0").select("article_id", "ticker", resp.alias("resp")), "resp")
    return score.ensemble(lex, st).select("article_id", "s", F.round("magnitude", 3).alias("magnitude"), F.round("disagreement", 2).alias("disagreement"))


@query("alarm_rules", "SELECT DISTINCT n_name AS ticker, CASE WHEN n_nationkey % 3 = 0 THEN 0.2 ELSE 0.12 END::DOUBLE AS min_edge, CASE WHEN n_nationkey % 3 = 0 THEN 'up' ELSE 'both' END AS direction, CASE WHEN n_nationkey % 3 = 0 THEN 2.0 ELSE 1.5 END::DOUBLE AS min_n_eff FROM nation")
def q_rules(spark, sf):
    n = table(spark, sf, "nation")
    own = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("ticker"), F.lit(0.2).alias("min_edge"), F.lit(None).cast("double").alias("min_n_eff"), F.lit("up").alias("direction"))
    star = spark.createDataFrame([("*", None, 1.5, None)], "ticker string, min_edge double, min_n_eff double, direction string")
    rules = own.unionByName(star).withColumns({"cooldown_min": F.lit(None).cast("int"), "require_calibrated": F.lit(None).cast("boolean"), "require_novelty": F.lit(None).cast("boolean")})
    return alarms.resolve_rules(n.select(F.col("n_name").alias("ticker")), rules).select("ticker", "min_edge", "direction", "min_n_eff")


@query("registered_drivers", "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'SMALL')")
def q_registered(spark, sf):
    reg = spark.createDataFrame([("ECONOMY",), ("LARGE",), ("SMALL",), ("NONE",)], "p_type string")
    return quality.purge_unregistered(table(spark, sf, "part"), reg, "p_type")[0].select("p_partkey")


@query("routing_plan", BETAS + """, h AS (SELECT *, abs(beta) / sum(abs(beta)) OVER (PARTITION BY ticker) AS share FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY share DESC, driver) AS rank FROM h WHERE share >= 0.08)
SELECT driver, term, ticker, round(round(share, 4), 3) AS weight, CASE WHEN beta >= 0 THEN 1 ELSE -1 END AS sign FROM k JOIN (VALUES ('ECONOMY', 'a'), ('ECONOMY', 'b'), ('LARGE', 'c')) t(driver, term) USING (driver) WHERE rank <= 4""")
def q_plan(spark, sf):
    from pyspark.sql import Window

    e = _static_betas(spark, sf).withColumn("share", F.abs("beta") / F.sum(F.abs("beta")).over(Window.partitionBy("ticker"))).withColumn("asof", F.lit("2000-01-01").cast("date"))
    return routing.plan(e, spark.createDataFrame([("ECONOMY", "a"), ("ECONOMY", "b"), ("LARGE", "c")], "driver string, term string")).withColumn("weight", F.round("weight", 3))


@query("combined_signal", f"""WITH {prices_sql()}, {returns_sql()}, l AS (SELECT ticker, date, ret, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM rets), o AS (SELECT * FROM l WHERE prev IS NOT NULL),
z AS (SELECT ticker, date, CASE WHEN stddev_pop(ret) OVER w > 0 THEN (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w ELSE 0 END AS a, CASE WHEN stddev_pop(prev) OVER w > 0 THEN (prev - avg(prev) OVER w) / stddev_pop(prev) OVER w ELSE 0 END AS b FROM o WINDOW w AS (PARTITION BY date))
SELECT ticker, date, {R('(a + b) / sqrt(2.0)')} AS z FROM z""")
def q_combined(spark, sf):
    from pyspark.sql import Window

    r = panel.returns(prices(spark, sf)).withColumn("prev", F.lag("ret").over(Window.partitionBy("ticker").orderBy("date"))).where("prev is not null")
    legs = [panel.zscore_by(r, c).select("ticker", "date", "z") for c in ("ret", "prev")]
    return evaluate.combine_signals(legs).withColumn("z", r6("z"))


@query("event_windows", f"""WITH {BARS}, x AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret, epoch(ts) - epoch(lag(ts) OVER w) AS gap, lag(close) OVER w AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), r AS (SELECT symbol, ts, ret FROM x WHERE gap <= 14400 AND p <> 0),
m AS (SELECT ts, avg(ret) AS m FROM r GROUP BY ts HAVING count(*) >= 3), e AS (SELECT symbol, ts, ret - m AS res FROM r JOIN m USING (ts))
SELECT symbol, ts, {R('CASE WHEN count(res) OVER a = 1 THEN sum(res) OVER a END')} AS cum_1, {R('CASE WHEN count(res) OVER b = 5 THEN sum(res) OVER b END')} AS cum_5 FROM e WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def q_event_windows(spark, sf):
    res = panel.cross_sectional_residual(panel.bar_returns(bars(spark, sf)), "ret", "ts")
    return evaluate.event_windows(res, (1, 5), "symbol").select("symbol", "ts", r6("cum_1").alias("cum_1"), r6("cum_5").alias("cum_5"))
