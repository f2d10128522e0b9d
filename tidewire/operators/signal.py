"""Signals: weighted evidence of an entity as of an instant, its best items, macro surprise, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.timeutil import local_date, session_close_utc
from .asof import range_explode


def evidence(scores: DataFrame, mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """scores joined with their mentions and articles, one row an (article, entity)."""
    s = scores.select("article_id", "ticker", "s", "magnitude", "novelty", "event_type")
    m = mentions.where(F.col("ticker") != config.NOBODY).select("article_id", "ticker", "relevance", *[c for c in ("driver", "driver_weight", "driver_sign") if c in mentions.columns])
    for c, kind in (("driver", "string"), ("driver_weight", "double"), ("driver_sign", "int")):
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast(kind))
    return s.join(m, ["article_id", "ticker"]).join(articles.select("article_id", "domain", "title", "url", "published_ts"), "article_id")


def evidence_asof(ev: DataFrame, asofs: DataFrame, weights: DataFrame, window_hours: float = config.WINDOW_HOURS, half_life: float = config.HALF_LIFE_HOURS, default_weight: float = config.DEFAULT_SOURCE_WEIGHT) -> DataFrame:
    """Evidence within window_hours up to each asof (ticker, asof), with s_eff and its weight w (over 1e-6).

    w: source x relevance x novelty x magnitude x decay; routed rows times their driver's share, their sign by its beta.
    """
    j = range_explode(ev, "published_ts", asofs.select("ticker", "asof"), "asof", window_hours, ["ticker"])
    j = j.join(weights.select("domain", F.col("weight").alias("sw_")), "domain", "left")
    age = F.greatest(F.lit(0.0), (F.unix_timestamp("asof") - F.unix_timestamp("published_ts")) / 3600.0)
    w = F.coalesce("sw_", F.lit(default_weight)) * F.col("relevance") * F.col("novelty") * F.col("magnitude") * F.pow(F.lit(0.5), age / half_life)
    routed = F.col("driver").isNotNull()
    w = w * F.when(routed, F.greatest(F.lit(0.0), F.coalesce("driver_weight", F.lit(0.0)))).otherwise(1.0)
    s = F.when(routed & (F.coalesce("driver_sign", F.lit(1)) < 0), -F.col("s")).otherwise(F.col("s"))
    return j.withColumns({"age_h": age, "w": w, "s_eff": s}).where("w > 1e-6").drop("sw_")


def aggregate_signal(weighted: DataFrame, macro: DataFrame | None = None, cap: float = config.SURPRISE_CAP) -> DataFrame:
    """(ticker, asof, z, n_eff, dispersion, n_articles, n_routed), rounded to 4 places.

    macro: (ticker, asof, contribution, weight), of which at most the share `cap` of the total weight counts (none
    without news). The dispersion divides by the weight that includes it.
    """
    e = weighted.groupBy("ticker", "asof").agg(
        F.sum(F.col("s_eff") * F.col("w")).alias("sw"), F.sum("w").alias("w"), F.sum(F.col("s_eff") * F.col("s_eff") * F.col("w")).alias("ssw"),
        F.count("*").alias("n_articles"), F.count("driver").alias("n_routed"))
    if macro is None:
        num, den = F.col("sw"), F.col("w")
    else:
        e = e.join(macro, ["ticker", "asof"], "left")
        mw = F.coalesce("weight", F.lit(0.0))
        top = F.col("w") * cap / (1 - cap)
        scale = F.when(mw > top, top / mw).otherwise(1.0)
        num, den = F.col("sw") + F.coalesce("contribution", F.lit(0.0)) * scale, F.col("w") + mw * scale
    z = num / den
    var = (F.col("ssw") - 2 * z * F.col("sw") + z * z * F.col("w")) / den
    return e.select("ticker", "asof", F.round(z, 4).alias("z"), F.round(den, 4).alias("n_eff"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 4).alias("dispersion"), "n_articles", "n_routed")


def quiet(signals: DataFrame, asofs: DataFrame) -> DataFrame:
    """signals with a row of zeros for each asof without evidence."""
    j = asofs.select("ticker", "asof").join(signals, ["ticker", "asof"], "left")
    return j.select("ticker", "asof", *[F.coalesce(c, F.lit(0).cast(signals.schema[c].dataType)).alias(c) for c in signals.columns if c not in ("ticker", "asof")])


def top_evidence(weighted: DataFrame, k: int = 12) -> DataFrame:
    """The k rows of most weight of each (ticker, asof), with rank."""
    w = Window.partitionBy("ticker", "asof").orderBy(F.col("w").desc(), "article_id")
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def macro_surprise(effects: DataFrame, asofs: DataFrame, weight: float = config.SURPRISE_WEIGHT, half_life_days: float = config.SURPRISE_HALF_LIFE_DAYS) -> DataFrame:
    """(ticker, asof, contribution, weight) of effects (ticker, indicator, implied_pp, release_date): a weight that halves
    every half_life_days, times the effect within -1 and 1. The latest release up to asof of each indicator counts."""
    j = asofs.select("ticker", "asof").join(effects, "ticker").where(F.col("release_date") <= local_date(F.col("asof")))
    last = j.groupBy("ticker", "asof", "indicator").agg(F.max(F.struct("release_date", "implied_pp")).alias("x"))
    age = F.greatest(F.lit(0), F.datediff(local_date(F.col("asof")), F.col("x.release_date")))
    w = F.lit(weight) * F.pow(F.lit(0.5), age / half_life_days)
    eff = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x.implied_pp")))
    return last.withColumns({"w_": w, "c_": eff * w}).groupBy("ticker", "asof").agg(F.sum("c_").alias("contribution"), F.sum("w_").alias("weight"))


def article_weights(ev: DataFrame, weights: DataFrame, default_weight: float = config.DEFAULT_SOURCE_WEIGHT) -> DataFrame:
    """Undecayed weight of each scored article: source x relevance x novelty x magnitude."""
    j = ev.join(weights.select("domain", F.col("weight").alias("sw_")), "domain", "left")
    return j.select("article_id", "ticker", "published_ts", "s", (F.coalesce("sw_", F.lit(default_weight)) * F.col("relevance") * F.col("novelty") * F.col("magnitude")).alias("weight"))


def history_asofs(ev: DataFrame, sessions: DataFrame) -> DataFrame:
    """(ticker, asof, date): the session closes of days that have scored news, for the entities that have a session then.

    sessions: (ticker, date)."""
    days = ev.select(local_date(F.col("published_ts")).alias("date")).distinct()
    return sessions.select("ticker", "date").distinct().join(days, "date", "left_semi").select("ticker", session_close_utc(F.col("date")).alias("asof"), "date")


def rebuild_history(ev: DataFrame, sessions: DataFrame, weights: DataFrame, window_hours: float = config.WINDOW_HOURS) -> DataFrame:
    """Signals at each session close that has live evidence; pairs without news are left out."""
    return aggregate_signal(evidence_asof(ev, history_asofs(ev, sessions), weights, window_hours))
