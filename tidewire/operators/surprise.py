"""Macro and earnings surprises: release dates, betas, implied effects, market proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .asof import asof_join


def roll_weekend(date: Column) -> Column:
    """Saturday and Sunday become Monday."""
    d = F.dayofweek(date)
    return F.date_add(date, F.when(d == 7, 2).when(d == 1, 1).otherwise(0))


def release_date(indicator: Column, ref_month: Column, days: dict[str, int] = config.RELEASE_DAYS, default: int = 10) -> Column:
    """Fixed day (28 at most) of the month after ref_month, rolled off weekends."""
    table = F.create_map(*[F.lit(x) for kv in days.items() for x in kv]) if days else F.create_map(F.lit(""), F.lit(default))
    day = F.least(F.coalesce(table[indicator], F.lit(default)), F.lit(28))
    return roll_weekend(F.date_add(F.trunc(F.add_months(ref_month, 1), "month"), day - 1))


def macro_surprise(consensus: DataFrame, realized: DataFrame, min_respondents: int = 10) -> DataFrame:
    """(indicator, ref_month, projected, median, stddev, n_resp, realized, surprise): realized less the last projected
    median up to the end of the reference month, over its deviation (null where that is 0).

    consensus: (indicator, ref_month, projected, median, stddev, n_resp); realized: (indicator, ref_month, value).
    """
    c = consensus.where((F.col("projected") <= F.last_day("ref_month")) & (F.col("n_resp") >= min_respondents))
    last = c.groupBy("indicator", "ref_month").agg(F.max(F.struct("projected", "median", "stddev", "n_resp")).alias("x")).select("indicator", "ref_month", "x.*")
    r = realized.select("indicator", "ref_month", F.col("value").alias("realized"))
    return last.join(r, ["indicator", "ref_month"]).withColumn("surprise", F.try_divide(F.col("realized") - F.col("median"), F.nullif("stddev", F.lit(0.0))))


def fit_betas(abn: DataFrame, surprises: DataFrame, least: int = 8, tolerance_days: int | None = None) -> DataFrame:
    """(ticker, indicator, beta, n): slope of abnormal return on surprise over release sessions: the first session at or after
    each release date. surprises: (indicator, date, surprise); indicators and pairs under `least` are left out."""
    ok = surprises.where("surprise is not null")
    enough = ok.groupBy("indicator").agg(F.count("*").alias("n_")).where(F.col("n_") >= least).select("indicator")
    events = ok.join(enough, "indicator", "left_semi").select("indicator", F.col("date").alias("event"), "surprise")
    pairs = events.join(abn.select("ticker").distinct())  # every event for every entity: |events| x |entities| rows, both dimensions
    hit = asof_join(pairs, abn.select("ticker", "date", "abn"), ["ticker"], "event", "date", "forward", tolerance=tolerance_days).where("r_abn is not null")
    return hit.groupBy("ticker", "indicator").agg(F.regr_slope("r_abn", "surprise").alias("beta"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("beta").isNotNull())


def implied_effect(betas: DataFrame, surprises: DataFrame, demean: bool = False) -> DataFrame:
    """(ticker, indicator, beta, surprise, implied_pp, direction): beta (less the entities' mean if demean) x the latest surprise."""
    last = surprises.where("surprise is not null").groupBy("indicator").agg(F.max(F.struct("ref_month", "surprise")).alias("x")).select("indicator", F.col("x.ref_month").alias("ref_month"), F.col("x.surprise").alias("surprise"))
    mean = betas.groupBy("indicator").agg(F.avg("beta").alias("m_"))
    j = betas.join(mean, "indicator").join(last, "indicator")
    eff = (F.col("beta") - (F.col("m_") if demean else F.lit(0.0))) * F.col("surprise") * 100
    return j.select("ticker", "indicator", "ref_month", "beta", "surprise", eff.alias("implied_pp"), F.when(eff > 0, "up").when(eff < 0, "down").otherwise("flat").alias("direction"))


def earnings_surprise(actual: DataFrame, consensus: DataFrame) -> DataFrame:
    """actual (ticker, period, metric, actual, released_ts) with consensus, dispersion and surprise: less the last consensus
    strictly before the release, over its dispersion; null without one."""
    j = asof_join(actual, consensus.select("ticker", "period", "metric", "consensus", "dispersion", "asof_ts"), ["ticker", "period", "metric"], "released_ts", "asof_ts", "backward", strict=True)
    return j.select("ticker", "period", "metric", "actual", "released_ts", F.col("r_consensus").alias("consensus"), F.col("r_dispersion").alias("dispersion"),
                    F.try_divide(F.col("actual") - F.col("r_consensus"), F.nullif("r_dispersion", F.lit(0.0))).alias("surprise"))


def earnings_summary(surprises: DataFrame) -> DataFrame:
    """(ticker, period, median_surprise, n_metrics, n_without_consensus) of each entity's latest period."""
    g = surprises.groupBy("ticker", "period").agg(F.max("released_ts").alias("at_"), F.median("surprise").alias("median_surprise"), F.count("surprise").alias("n_metrics"), F.count_if(F.col("consensus").isNull()).alias("n_without_consensus"))
    w = Window.partitionBy("ticker").orderBy(F.col("at_").desc(), F.col("period").desc())
    return g.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_", "at_")


def market_proxy(events: DataFrame, instrument_rets: DataFrame, tolerance_days: int = 5) -> DataFrame:
    """(event, instrument, date, session, proxy): the instrument's return on the event's session over its own deviation.

    events: (event, instrument, date); rets: (instrument, date, ret). One event a session: the earliest."""
    sd = instrument_rets.groupBy("instrument").agg(F.stddev_pop("ret").alias("sd_"))
    j = asof_join(events, instrument_rets.select("instrument", F.col("date").alias("session"), "ret"), ["instrument"], "date", "session", "forward", tolerance=tolerance_days).where("r_session is not null")
    one = j.groupBy("event", "instrument", "r_session").agg(F.min("date").alias("date"), F.first("r_ret").alias("ret"))
    return one.join(sd, "instrument").select("event", "instrument", "date", F.col("r_session").alias("session"), F.try_divide("ret", F.nullif("sd_", F.lit(0.0))).alias("proxy"))
