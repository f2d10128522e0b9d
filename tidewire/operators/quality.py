"""Audits of stored data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import language_covered


def purge_unregistered(series: DataFrame, registry: DataFrame, key: str = "driver") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows of series whose key the registry has, and the others."""
    known = registry.select(key).distinct()
    return series.join(known, key, "left_semi"), series.join(known, key, "left_anti")


def audit(articles: DataFrame, scores: DataFrame, driver_prices: DataFrame, registry: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: n_unclustered, n_uncovered_scores, n_ghost_drivers, n_signals, n_signal_days."""
    a = articles.agg(F.count_if(F.col("cluster_id").isNull()).alias("n_unclustered"))
    s = scores.join(articles.select("article_id", "lang"), "article_id").agg(F.count_if(~language_covered(F.col("lang"))).alias("n_uncovered_scores"))
    d = driver_prices.select("driver").distinct().join(registry.select("driver").distinct(), "driver", "left_anti").agg(F.count("*").alias("n_ghost_drivers"))
    g = signals.agg(F.count("*").alias("n_signals"), F.count_distinct(F.to_date("asof")).alias("n_signal_days"))
    out = a
    for one in (s, d, g):  # each is one row
        out = out.join(F.broadcast(one))
    return out


def bar_coverage(bars: DataFrame, least: int = 100) -> DataFrame:
    """(symbol, interval, n, first, last, usable) of bars (symbol, interval, ts)."""
    return bars.groupBy("symbol", "interval").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("usable", F.col("n") >= least)
