"""Panels of prices: returns, abnormal returns, residuals, resampling, betas, classic signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str, date: str) -> Window:
    return Window.partitionBy(key).orderBy(date)


def returns(prices: DataFrame, key: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """(key, date, ret): simple returns between an entity's successive dates; none after a zero price."""
    p = F.lag(close).over(_by(key, date))
    return prices.withColumn("prev_", p).where(F.col("prev_").isNotNull() & (F.col("prev_") != 0)).select(key, date, (F.col(close) / F.col("prev_") - 1).alias("ret"))


def market_return(rets: DataFrame, date: str = "date", least: int = 3) -> DataFrame:
    """(date, market): mean over the day's entities, of which there are `least` at least."""
    return rets.groupBy(date).agg(F.avg("ret").alias("market"), F.count("*").alias("n_")).where(F.col("n_") >= least).drop("n_")


def abnormal_returns(rets: DataFrame, benchmark: DataFrame | None = None, key: str = "ticker", date: str = "date", least: int = 3) -> DataFrame:
    """(key, date, abn): return less the benchmark's (date, market), or less the day's mean."""
    m = benchmark if benchmark is not None else market_return(rets, date, least)
    return rets.join(m, date).select(key, date, (F.col("ret") - F.col("market")).alias("abn"))


def cross_sectional_residual(rets: DataFrame, value: str = "ret", at: str = "date", least: int = 3) -> DataFrame:
    """rets with residual: value less the mean of its instant; instants with fewer entities go."""
    m = rets.groupBy(at).agg(F.avg(value).alias("m_"), F.count("*").alias("n_")).where(F.col("n_") >= least)
    return rets.join(m, at).withColumn("residual", F.col(value) - F.col("m_")).drop("m_", "n_")


def bar_returns(bars: DataFrame, key: str = "symbol", ts: str = "ts", close: str = "close", max_gap_hours: float = 4, keep: Column | None = None) -> DataFrame:
    """(key, ts, ret) between successive bars not more than max_gap_hours apart; keep filters bars (a session)."""
    b = bars if keep is None else bars.where(keep)
    w = _by(key, ts)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    x = b.withColumn("gap_", gap).withColumn("prev_", F.lag(close).over(w))
    return x.where((F.col("gap_") <= int(max_gap_hours * 3600)) & (F.col("prev_") != 0)).select(key, ts, (F.col(close) / F.col("prev_") - 1).alias("ret"))


def gaps(prices: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """(key, date, gap, open_close, close_close) of (key, date, open, close)."""
    prev = F.lag("close").over(_by(key, date))
    return prices.withColumn("prev_", prev).select(key, date, F.try_divide("open", "prev_").alias("o_"), F.try_divide("close", "open").alias("c_"), F.try_divide("close", "prev_").alias("p_")).select(
        key, date, (F.col("o_") - 1).alias("gap"), (F.col("c_") - 1).alias("open_close"), (F.col("p_") - 1).alias("close_close"))


def resample_weekly(prices: DataFrame, key: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """(key, iso_year, iso_week, date, close): the last close of each ISO week."""
    g = prices.groupBy(key, F.extract(F.lit("YEAROFWEEK"), F.col(date)).cast("int").alias("iso_year"), F.weekofyear(date).alias("iso_week"))
    return g.agg(F.max(date).alias(date), F.max_by(close, date).alias(close))


def common_dates(series: DataFrame, key: str = "driver", date: str = "date") -> DataFrame:
    """(date): dates on which every key has a row."""
    n = series.select(F.count_distinct(key).alias("all_"))
    return series.groupBy(date).agg(F.count_distinct(key).alias("n_")).join(n, F.col("n_") == F.col("all_")).select(date)


def news_days(sessions: DataFrame, scored: DataFrame, date: str = "date") -> DataFrame:
    """Distinct session dates that have scored news."""
    return sessions.select(date).distinct().join(scored.select(date), date, "left_semi")


def driver_vol(driver_rets: DataFrame, date: str = "date") -> DataFrame:
    """(date, macro_vol): the day's mean absolute driver return."""
    return driver_rets.groupBy(date).agg(F.avg(F.abs("ret")).alias("macro_vol"))


def asymmetry(rets: DataFrame, market: DataFrame, key: str = "ticker", date: str = "date", least: int = 30, last: int | None = None) -> DataFrame:
    """(key, beta_down, beta_up, asymmetry, n_down, n_up): slopes on days the market fell and rose; null under `least`."""
    j = rets.join(market, date)
    if last:
        j = j.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(F.col(date).desc()))).where(F.col("rn_") <= last)
    down, up = F.col("market") < 0, F.col("market") > 0
    slope = lambda c: F.regr_slope(F.when(c, F.col("ret")), F.when(c, F.col("market")))
    a = j.groupBy(key).agg(slope(down).alias("d_"), slope(up).alias("u_"), F.count_if(down).alias("n_down"), F.count_if(up).alias("n_up"))
    d, u = F.when(F.col("n_down") >= least, F.col("d_")), F.when(F.col("n_up") >= least, F.col("u_"))
    return a.select(key, d.alias("beta_down"), u.alias("beta_up"), (d - u).alias("asymmetry"), "n_down", "n_up")


def anomaly_signals(prices: DataFrame, rets: DataFrame, key: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """(key, date, momentum_12_1, reversal_1m, reversal_1d, low_vol_60, vol_20) known at the close of date."""
    w = _by(key, date)
    lag = lambda n: F.lag(close, n).over(w)
    p = prices.select(key, date, (F.try_divide(lag(21), lag(252)) - 1).alias("momentum_12_1"), (-(F.try_divide(F.col(close), lag(21)) - 1)).alias("reversal_1m"))

    def vol(n: int) -> Column:
        s = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("ret").over(s) == n, F.stddev_pop("ret").over(s))

    r = rets.select(key, date, (-F.col("ret")).alias("reversal_1d"), (-vol(60)).alias("low_vol_60"), vol(20).alias("vol_20"))
    return p.join(r, [key, date])


def zscore_by(df: DataFrame, value: str, at: str = "date", out: str = "z") -> DataFrame:
    """df with the value standardized over its instant (population deviation; 0 where that is 0)."""
    s = df.groupBy(at).agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"))
    return df.join(s, at).withColumn(out, F.when(F.col("s_") > 0, (F.col(value) - F.col("m_")) / F.col("s_")).otherwise(0.0)).drop("m_", "s_")
