"""Themes: effects by sector and attribute, theme portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effect_matrix(entities: DataFrame, sector_effects: DataFrame, attribute_effects: DataFrame) -> DataFrame:
    """(theme, ticker, effect): sign of the sector's effect and those of the entity's attributes together; 0 says no hypothesis.

    entities: (ticker, sector, attributes array); sector_effects: (theme, sector, effect); attribute_effects: (theme, attribute, effect).
    """
    s = entities.join(sector_effects, "sector").select("theme", "ticker", "effect")
    a = entities.select("ticker", F.explode("attributes").alias("attribute")).join(attribute_effects, "attribute").select("theme", "ticker", "effect")
    return s.unionByName(a).groupBy("theme", "ticker").agg(F.signum(F.sum("effect").cast("double")).cast("int").alias("effect"))


def as_matrix(effects: DataFrame) -> DataFrame:
    """One row a theme, one column an entity."""
    return effects.groupBy("theme").pivot("ticker").agg(F.first("effect"))


def portfolio(abn: DataFrame, signs: DataFrame, value: str = "abn", date: str = "date") -> DataFrame:
    """(theme, date, ret): sum(s r) / sum|s| on dates with at least max(2, half) of the theme's entities. signs: (theme, ticker, effect)."""
    s = signs.where("effect != 0")
    n = s.groupBy("theme").agg(F.count("*").alias("all_"))
    g = abn.join(s, "ticker").groupBy("theme", date).agg((F.sum(F.col("effect") * F.col(value)) / F.sum(F.abs("effect"))).alias("ret"), F.count("*").alias("n_"))
    return g.join(n, "theme").where(F.col("n_") >= F.greatest(F.lit(2.0), F.col("all_") / 2)).select("theme", date, "ret")
