"""Routing of articles to entities through drivers, sectors and themes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import BREAK, norm, whole
from .entity import by_first_word

LAYERS = ("name", "driver", "sector", "theme")  #: of one (url, ticker) the first layer counts


def plan(exposures: DataFrame, topics: DataFrame, k: int = config.TOP_DRIVERS, min_share: float = config.MIN_SHARE) -> DataFrame:
    """(driver, term, ticker, weight, sign): what each entity listens to. topics: (driver, term)."""
    from .exposure import top_drivers

    t = top_drivers(exposures, k, min_share).select("ticker", "driver", F.round("share", 4).alias("weight"), F.when(F.col("beta") >= 0, 1).otherwise(-1).alias("sign"))
    return t.join(topics, "driver").select("driver", "term", "ticker", "weight", "sign")


def match_terms(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """(article_id, topic) of articles whose normal text holds a topic's term as whole words. terms: (topic, term).

    Texts meet terms by the term's first word, and the pattern is tried in the text's own row."""
    t = terms.select("topic", norm(F.col("term")).alias("form")).where("form != ''").withColumn("key", F.regexp_extract("form", "[a-z0-9]+", 0))
    t = t.withColumn("p_", whole(F.col("form"), "[a-z0-9]")).select("key", "topic", "p_")
    a = articles.select("article_id", norm(F.concat_ws(" ", "title", "body")).alias("text_"))
    words = F.concat(F.split("text_", BREAK), F.array(F.lit("")))  # a term without letters and digits is tried on each text
    return by_first_word(a, words, t, F.rlike(F.col("text_"), F.col("p_")), ["article_id", "topic"]).distinct()


def route_articles(articles: DataFrame, listeners: DataFrame, terms: DataFrame) -> DataFrame:
    """(article_id, url, ticker, driver, weight, sign, layer): each matched article goes to all listeners of its topic.

    listeners: (topic, ticker, weight, sign, layer). Matching runs once a topic, before the fan-out."""
    hit = match_terms(articles, terms).join(listeners, "topic")
    return hit.join(articles.select("article_id", "url"), "article_id").select("article_id", "url", "ticker", F.col("topic").alias("driver"), "weight", "sign", "layer")


def sector_listeners(entities: DataFrame, weight: float = config.SECTOR_WEIGHT) -> DataFrame:
    return entities.where("sector is not null").select(F.concat(F.lit("setor:"), "sector").alias("topic"), "ticker", F.lit(weight).alias("weight"), F.lit(1).alias("sign"), F.lit("sector").alias("layer"))


def theme_listeners(effects: DataFrame, weight: float = config.THEME_WEIGHT) -> DataFrame:
    return effects.where("effect != 0").select(F.concat(F.lit("tema:"), "theme").alias("topic"), "ticker", F.lit(weight).alias("weight"), F.col("effect").cast("int").alias("sign"), F.lit("theme").alias("layer"))


def union_layers(*layers: DataFrame) -> DataFrame:
    """Routed rows of all layers; of each (url, ticker) the first layer's, then the heaviest."""
    both = reduce(lambda a, b: a.unionByName(b), layers)
    at = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    w = Window.partitionBy("url", "ticker").orderBy(at, F.col("weight").desc(), "driver", "article_id")
    return both.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def routed_mentions(routed: DataFrame) -> DataFrame:
    """Mentions stamped with their driver; relevance min(1, .4 + weight)."""
    return union_layers(routed).select("article_id", "ticker", F.least(F.lit(1.0), 0.4 + F.col("weight")).alias("relevance"), F.concat(F.lit("driver:"), "driver").alias("matched_alias"),
                                       "driver", F.col("weight").alias("driver_weight"), F.col("sign").alias("driver_sign"))
