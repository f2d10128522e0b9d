"""Attention: arousal of a text, effective sources, cascade of a cluster, bursts of an entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import norm, once
from .asof import range_explode, running


def arousal(text: Column, words: dict[str, float] = config.AROUSAL) -> Column:
    """1 - exp(-sum of the weights of the words held / 1.5)."""
    held = lambda t: reduce(lambda a, b: a + b, [F.when(F.contains(t, F.lit(w)), float(x)).otherwise(0.0) for w, x in words.items()])
    return 1 - F.exp(-once(norm(text), held) / 1.5)


def effective_sources(df: DataFrame, by: list[str], domain: str = "domain", where: Column | None = None, out: str = "effective_sources") -> DataFrame:
    """(by..., out): exp of the entropy of the domains' shares (Hill number of order one)."""
    rows = df if where is None else df.where(where)
    c = rows.groupBy(*by, F.coalesce(F.col(domain), F.lit("")).alias("dom_")).agg(F.count("*").alias("c_"))
    # from counts alone: H = ln n - sum(c ln c) / n
    g = c.groupBy(*by).agg(F.sum("c_").alias("n_"), F.sum(F.col("c_") * F.log(F.col("c_").cast("double"))).alias("clc_"))
    return g.select(*by, F.exp(F.log(F.col("n_").cast("double")) - F.col("clc_") / F.col("n_")).alias(out))


def cluster_features(articles: DataFrame, asofs: DataFrame, hours: float = config.CASCADE_HOURS) -> DataFrame:
    """(cluster_id, asof, effective_sources, cascade, copies, repetition, hours_alive, arousal) of articles up to asof.

    articles: cluster_id, published_ts, domain, title (or a column arousal); asofs: (cluster_id, asof), one row each.
    cascade: effective sources within `hours` of the cluster's first article. Instants before that are left out.

    One pass over a cluster's articles and instants in time order. The entropy of the domains' shares follows from the
    number n of articles and the sum of c ln c over the domains' counts, and an article that is its domain's k-th adds
    k ln k - (k - 1) ln (k - 1) to that sum; so running sums are all an instant needs.
    """
    a = articles if "arousal" in articles.columns else articles.withColumn("arousal", arousal(F.col("title")))
    a = a.where("cluster_id is not null and published_ts is not null").select("cluster_id", F.unix_timestamp("published_ts").alias("t_"), F.coalesce("domain", F.lit("")).alias("domain"), "arousal", F.lit(1).cast("long").alias("n_"))
    ranked = running(a, ["cluster_id", "domain"], ["t_"], ["n_"])
    k = F.col("run_n_").cast("double")
    add = k * F.log(k) - F.when(k > 1, (k - 1) * F.log(k - 1)).otherwise(0.0)
    first = a.groupBy("cluster_id").agg(F.min("t_").alias("t0_"))
    early = F.when(F.col("t_") - F.col("t0_") <= int(hours * 3600), 1).otherwise(0).cast("long")
    rows = ranked.join(first, "cluster_id").select("cluster_id", "t_", F.lit(0).alias("o_"), F.lit(None).cast("timestamp").alias("asof"), "n_", add.alias("s_"), early.alias("e_"), (early * add).alias("q_"), "arousal", (-F.col("t_")).alias("m_"))
    none = F.lit(None)
    marks = asofs.where("cluster_id is not null").select("cluster_id", F.unix_timestamp("asof").alias("t_"), F.lit(1).alias("o_"), "asof", none.cast("long").alias("n_"), none.cast("double").alias("s_"), none.cast("long").alias("e_"), none.cast("double").alias("q_"), none.cast("double").alias("arousal"), none.cast("long").alias("m_"))
    run = running(rows.unionByName(marks), ["cluster_id"], ["t_", "o_"], ["n_", "s_", "e_", "q_"], ["arousal", "m_"]).where("o_ = 1 and run_n_ > 0")
    hill = lambda n, s: F.exp(F.log(F.col(n).cast("double")) - F.col(s) / F.col(n))
    got = run.select("cluster_id", "asof", hill("run_n_", "run_s_").alias("effective_sources"), hill("run_e_", "run_q_").alias("cascade"), F.col("run_n_").alias("copies"), ((F.col("t_") + F.col("run_m_")) / 3600.0).alias("hours_alive"), F.col("run_arousal").alias("arousal"))
    return got.withColumn("repetition", 1 - F.col("effective_sources") / F.col("copies"))


def burst(mentions: DataFrame, asofs: DataFrame, window_hours: float = 24, base_days: int = 30) -> DataFrame:
    """(ticker, asof, burst): articles an hour of the last window_hours over those of the last base_days.

    mentions: (ticker, published_ts). 1 where only the window has any, 0 where neither has. A count over a window is the
    difference of the running count at its two ends, which are marked among the mentions.
    """
    m = mentions.where("ticker is not null and published_ts is not null").groupBy("ticker", F.unix_timestamp("published_ts").alias("t_")).agg(F.count("*").alias("n_"))
    ends = F.array(*[F.struct(F.lit(name).alias("e_"), F.lit(s).cast("long").alias("s_")) for name, s in (("now", 0), ("w", int(window_hours * 3600)), ("b", base_days * 86400))])
    every = asofs.select("ticker", "asof").distinct()
    marks = every.select("ticker", "asof", F.explode(ends).alias("x_")).select("ticker", (F.unix_timestamp("asof") - F.col("x_.s_")).alias("t_"), F.lit(1).alias("o_"), F.lit(0).cast("long").alias("n_"), "asof", "x_.e_")
    rows = m.select("ticker", "t_", F.lit(0).alias("o_"), "n_", F.lit(None).cast("timestamp").alias("asof"), F.lit(None).cast("string").alias("e_"))
    run = running(rows.unionByName(marks), ["ticker"], ["t_", "o_"], ["n_"]).where("o_ = 1")
    at = lambda e: F.max(F.when(F.col("e_") == e, F.col("run_n_")))
    g = run.groupBy("ticker", "asof").agg((at("now") - at("w")).alias("w"), (at("now") - at("b")).alias("b"))
    rate = F.try_divide(F.col("w") / F.lit(float(window_hours)), F.col("b") / F.lit(base_days * 24.0))
    return asofs.select("ticker", "asof").join(g, ["ticker", "asof"], "left").select("ticker", "asof", F.coalesce(rate, F.lit(0.0)).alias("burst"))


def panel(mentions: DataFrame, articles: DataFrame, asofs: DataFrame, window_hours: float = config.WINDOW_HOURS) -> DataFrame:
    """(ticker, asof, cascade, effective_sources, repetition, arousal, copies, hours_alive, burst, n) of the live articles.

    mentions: (article_id, ticker, published_ts, cluster_id); an article without a cluster counts as one of its own.
    """
    own = F.coalesce(F.col("cluster_id").cast("string"), F.concat(F.lit("a"), F.col("article_id").cast("string")))
    a = articles.withColumn("cluster_id", own)
    live = range_explode(mentions.withColumn("cluster_id", own), "published_ts", asofs.select("ticker", "asof"), "asof", window_hours, ["ticker"])
    f = cluster_features(a, live.select("cluster_id", "asof").distinct())
    j = live.join(f, ["cluster_id", "asof"])
    g = j.groupBy("ticker", "asof").agg(*[F.max(c).alias(c) for c in ("cascade", "effective_sources", "repetition", "arousal")], F.sum("copies").alias("copies"), F.min("hours_alive").alias("hours_alive"), F.count("*").alias("n"))
    return burst(mentions, asofs).join(g, ["ticker", "asof"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
