"""Learned weights of sources from who reports stories first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIOR, LEAST, MOST = 8, 0.15, 1.0


def cluster_stats(articles: DataFrame, min_cluster: int = 2, window_days: int = 120) -> DataFrame:
    """(domain, n, scoops, lead_min) over clusters of min_cluster articles and more in the last window_days.

    A domain appears once a cluster, at its first article; the lead is the cluster's median time less that, in minutes.
    """
    a = articles.where("cluster_id is not null and domain is not null").select("cluster_id", "domain", F.unix_timestamp("published_ts").alias("ts"))
    newest = articles.agg(F.max(F.unix_timestamp("published_ts")).alias("new_"))
    a = a.join(F.broadcast(newest), F.col("ts") > F.col("new_") - window_days * 86400).drop("new_")
    c = a.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("ts").alias("first"), F.median("ts").alias("mid")).where(F.col("size") >= min_cluster)
    d = a.groupBy("cluster_id", "domain").agg(F.min("ts").alias("ts")).join(c, "cluster_id")
    return d.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("ts") == F.col("first")).alias("scoops"), F.median((F.col("mid") - F.col("ts")) / 60.0).alias("lead_min"))


def fit_weights(stats: DataFrame) -> DataFrame:
    """(domain, n, scoops, lead_min, scoop_shrunk, weight): the scoop rate shrunk to the overall one, over it, with a
    bonus of up to 30 % for three hours of lead, between .15 and 1."""
    total = stats.agg((F.sum("scoops") / F.sum("n")).alias("g"))
    s = stats.join(F.broadcast(total))  # one row
    shrunk = (F.col("scoops") + PRIOR * F.col("g")) / (F.col("n") + PRIOR)
    rel = F.when(F.col("g") > 0, shrunk / F.col("g")).otherwise(1.0)
    bonus = 1 + F.greatest(F.lit(-0.3), F.least(F.lit(0.3), F.col("lead_min") / 180.0))
    w = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), 0.45 * rel * bonus))
    return s.select("domain", "n", "scoops", "lead_min", shrunk.alias("scoop_shrunk"), F.round(w, 4).alias("weight"))
