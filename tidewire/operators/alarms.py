"""Alarms: rules over defaults, gates on edge and evidence, cool-down."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config

FIELDS = {"min_edge": "double", "min_n_eff": "double", "cooldown_min": "int", "require_calibrated": "boolean", "require_novelty": "boolean", "direction": "string"}


def resolve_rules(tickers: DataFrame, rules: DataFrame, defaults: dict = config.ALARM_DEFAULTS) -> DataFrame:
    """(ticker, fields...): the ticker's own rule, else that of '*', its nulls filled by the defaults; no rule, no row."""
    own = rules.where("ticker != '*'")
    star = rules.where("ticker = '*'").select(*[F.col(c).alias("s_" + c) for c in rules.columns])
    j = tickers.select("ticker").distinct().join(own.withColumn("own_", F.lit(True)), "ticker", "left").join(F.broadcast(star.limit(1)), F.lit(True), "left")
    j = j.where("own_ or s_ticker is not null")
    pick = lambda c, kind: F.coalesce(F.when(F.col("own_"), F.col(c)).otherwise(F.col("s_" + c)), F.lit(defaults[c])).cast(kind).alias(c)
    return j.select("ticker", *[pick(c, k) for c, k in FIELDS.items()])


def candidates(signals: DataFrame, rules: DataFrame, scores: DataFrame | None = None, window_hours: int = 36, novel: float = 0.95, in_hours_only: bool = False) -> DataFrame:
    """(ticker, asof, direction, p, base, edge, n_eff, cooldown_min, message) of signals that pass every gate but cool-down.

    scores: (ticker, published_ts, novelty), for the novelty gate: one first report within window_hours up to asof.
    """
    j = signals.join(rules, "ticker")
    j = j.where(~F.col("require_calibrated") | (F.col("calibrated") == 1)).where(F.col("n_eff") >= F.col("min_n_eff"))
    if in_hours_only:
        from ..functions.timeutil import in_session

        j = j.where(in_session(F.col("asof")))
    if scores is not None:
        from .asof import range_explode

        fresh = range_explode(scores.where(F.col("novelty") >= novel).select("ticker", "published_ts"), "published_ts", signals.select("ticker", "asof").distinct(), "asof", window_hours, ["ticker"]).select("ticker", "asof").distinct()
        j = j.where("not require_novelty").unionByName(j.where("require_novelty").join(fresh, ["ticker", "asof"], "left_semi").select(j.columns))
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.col("p_" + d).alias("p"), F.col("base_" + d).alias("base")) for d in ("up", "down")])).alias("x")
    k = j.select("ticker", "asof", "n_eff", "z", "min_edge", "cooldown_min", F.col("direction").alias("want"), sides).select("*", "x.*")
    k = k.where("p is not null and want in (direction, 'both')").withColumn("edge", F.col("p") - F.col("base")).where("edge >= min_edge")
    msg = F.format_string("[%s] %s P=%.0f%% vs base %.0f%% (edge %+.0f p.p.) n_eff=%.1f z=%+.2f", F.upper("direction"), "ticker", F.col("p") * 100, F.col("base") * 100, F.col("edge") * 100, "n_eff", "z")
    return k.select("ticker", "asof", "direction", "p", "base", "edge", "n_eff", "cooldown_min", msg.alias("message"))


def cooldown(alarms: DataFrame) -> DataFrame:
    """Alarms that fire: within cooldown_min of the last fired one of the same (ticker, direction) they don't."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g, last, keep = g.sort_values("asof"), None, []
        for t, wait in zip(g["asof"], g["cooldown_min"], strict=True):
            fire = last is None or (t - last).total_seconds() >= wait * 60
            last = t if fire else last
            keep.append(fire)
        return g[keep]

    return alarms.groupBy("ticker", "direction").applyInPandas(fold, alarms.schema)
