"""Near-duplicate stories: greedy chronological clusters as a parent forest, novelty, cluster size."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import content_tokens, figures, same_story, simhash
from ..sources.sinks import written
from .asof import asof_join

#: (first bit, width, radius) of each band of a SimHash: two of them within 12 of 63 bits are within the radius in some band,
#: as the radii and one for each band add up to over 12
BANDS = ((0, 16, 3), (16, 16, 2), (32, 16, 2), (48, 15, 2))


def story_features(articles: DataFrame, with_simhash: bool = True, hash: str = "blake2b") -> DataFrame:
    """(article_id, ts seconds, toks, figs, sig): of the title; the SimHash also sees 400 characters of the body."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, 400))
    sig = simhash(text, hash) if with_simhash else F.lit(None).cast("long")
    return articles.select("article_id", F.unix_timestamp("published_ts").alias("ts"), content_tokens(F.col("title")).alias("toks"), figures(F.col("title")).alias("figs"), sig.alias("sig"))


def _first_of_classes(rows: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], span: int) -> DataFrame:
    """(b, ta, a): for each row the earliest earlier one, not before its time lo, whose class matches its own.

    rows: (article_id, ts, lo, cls), lo within span before ts. Rows of equal features are one class, so copies stand for one
    another: of a class's rows the least id a second is kept, and a class asks once for each lo. meet(late, early), both
    (cls, day), gives the matching classes (b_cls, a_cls, day); a match is then asked for its first row at or after lo.
    """
    day = lambda t: F.floor(t / span)
    early = written(rows.groupBy("cls", "ts").agg(F.min("article_id").alias("a")).withColumn("day", day(F.col("ts"))), "story-times")
    asks = rows.groupBy("cls", "lo").agg(F.max("ts").alias("hi"))
    late = asks.select("cls", "lo", F.explode(F.array_distinct(F.array(day(F.col("lo")), day(F.col("hi"))))).alias("day"))
    met = meet(late.select("cls", "day").distinct(), early.select("cls", "day").distinct())
    asked = late.withColumnRenamed("cls", "b_cls").join(met, ["b_cls", "day"]).select(F.col("a_cls").alias("cls"), "day", "b_cls", "lo")
    near = asof_join(asked, early, ["cls", "day"], "lo", "ts", direction="forward").where("r_ts is not null")
    best = near.groupBy(F.col("b_cls").alias("cls"), "lo").agg(F.min(F.struct(F.col("r_ts").alias("ta"), F.col("r_a").alias("a"))).alias("m"))
    got = rows.join(best, ["cls", "lo"]).where(F.struct(F.col("m.ta"), F.col("m.a")) < F.struct("ts", "article_id"))
    return got.select(F.col("article_id").alias("b"), "m.ta", "m.a")


def _band(sig: Column, k: int) -> Column:
    at, width, _ = BANDS[k]
    return F.shiftrightunsigned(sig, at).bitwiseAND((1 << width) - 1)


def _probes(sig: Column, late: bool) -> Column:
    """Keys of a SimHash: in each band its value with up to one bit flipped (late), or up to the radius less one (early)."""
    def band(k: int, width: int, r: int) -> Column:
        masks = [sum(1 << i for i in c) for n in range((1 if late else r - 1) + 1) for c in combinations(range(width), n)]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: _band(sig, k).bitwiseXOR(m) + (k << 20))

    return F.flatten(F.array(*[band(k, width, r) for k, (_, width, r) in enumerate(BANDS)]))


def near_signatures(late: DataFrame, early: DataFrame) -> DataFrame:
    """(b_cls, a_cls, day) of SimHashes (cls) of a day within HAMMING_MAX bits of each other, each pair once.

    Both sides are dealt by probes: a pair meets where a band of it differs in no more than the band's radius, one bit of
    which the late side flips and the rest the early side. Of the bands and probes where it meets, the first such band counts
    and the probe with the lowest differing bit flipped. So rows are dealt in proportion to the SimHashes. Spark judges an
    exploded side by the table it comes from, 187 times too small, and would send it to the driver to broadcast it: both are sorted.
    """
    a = early.select(F.col("cls").alias("a_cls"), "day", F.explode(_probes(F.col("cls"), False)).alias("key"))
    b = late.select(F.col("cls").alias("b_cls"), "day", F.explode(_probes(F.col("cls"), True)).alias("key"))
    apart = F.col("a_cls").bitwiseXOR(F.col("b_cls"))
    first = F.coalesce(*[F.when(F.bit_count(_band(apart, k)) <= r, F.lit(k)) for k, (_, _, r) in enumerate(BANDS)])
    own = F.coalesce(*[F.when(F.shiftright("key", 20) == k, _band(F.col("b_cls"), k).bitwiseXOR(_band(apart, k).bitwiseAND(-_band(apart, k)))) for k in range(len(BANDS))])
    once = (first == F.shiftright("key", 20)) & (F.col("key").bitwiseAND((1 << 20) - 1) == own)
    met = b.hint("merge").join(a.hint("merge"), ["day", "key"]).where((F.col("a_cls") != F.col("b_cls")) & (F.bit_count(apart) <= config.HAMMING_MAX) & once)
    same = late.join(early, ["cls", "day"]).select(F.col("cls").alias("b_cls"), F.col("cls").alias("a_cls"), "day")
    return met.select("b_cls", "a_cls", "day").unionByName(same)


def _first_near(rows: DataFrame, span: int) -> DataFrame:
    """(b, ta, a): for each row the earliest earlier one, not before its time lo, within HAMMING_MAX bits of its SimHash.

    rows: (article_id, ts, sig, lo)."""
    return _first_of_classes(rows.select("article_id", "ts", "lo", F.col("sig").alias("cls")), near_signatures, span)


def _keys(f: DataFrame) -> DataFrame:
    """(cls, key, n): such that any two titles that match by their tokens or figures share a key; n counts tokens.

    Rare tokens (the prefix filter of Jaccard >= .55 over tokens ordered by their frequency) and figures.
    """
    tok = f.select("cls", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    freq = tok.groupBy("tok").agg(F.count("*").alias("df"))
    ranked = tok.join(freq, "tok").withColumn("k", F.row_number().over(Window.partitionBy("cls").orderBy("df", "tok")))
    rare = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * config.JACCARD_MIN - 1e-9) + 1).select("cls", F.concat(F.lit("t"), "tok").alias("key"), "n")
    figs = f.select("cls", F.explode("figs").alias("x"), F.size("toks").alias("n")).select("cls", F.concat(F.lit("f"), F.col("x").cast("string")).alias("key"), "n")
    return rare.unionByName(figs)


def _first_alike(rows: DataFrame, span: int) -> DataFrame:
    """(b, ta, a): for each row the earliest earlier one, not before its time lo, that is the same story by tokens or figures.

    rows: (article_id, ts, toks, figs, lo)."""
    named = rows.withColumn("cls", F.md5(F.to_json(F.struct(F.array_sort("toks").alias("t"), F.col("figs").alias("f")))))
    titles = written(named.groupBy("cls").agg(F.first("toks").alias("toks"), F.first("figs").alias("figs")).where("size(toks) > 0"), "story-titles")
    keys = written(_keys(titles), "story-keys")

    def meet(late: DataFrame, early: DataFrame) -> DataFrame:
        side = lambda d, p: d.join(keys, "cls").select("day", "key", F.col("cls").alias(p + "cls"), F.col("n").alias(p + "n"))
        size = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.when(F.col("key").startswith("t"), config.JACCARD_MIN).otherwise(config.JACCARD_WITH_FIGURE) - 1e-9
        pairs = side(late, "b_").join(side(early, "a_"), ["day", "key"]).where(size).select("b_cls", "a_cls", "day").distinct()
        of = lambda p: titles.select(*[F.col(c).alias(p + c) for c in ("cls", "toks", "figs")])
        none = F.lit(None).cast("long")
        return pairs.join(of("a_"), "a_cls").join(of("b_"), "b_cls").where(same_story(F.col("a_toks"), F.col("b_toks"), none, none, F.col("a_figs"), F.col("b_figs"))).select("b_cls", "a_cls", "day")

    return _first_of_classes(named.select("article_id", "ts", "lo", "cls"), meet, span)


def parents(articles: DataFrame, window_hours: float = 48, step_hours: float | None = None, use_simhash: bool = True, hash: str = "blake2b") -> DataFrame:
    """(article_id, ts, parent): the earliest earlier article (ties by id) within window_hours that is the same story.

    With step_hours, articles are seen through windows of that step that end at the first time + window + k * step:
    one looks back to the start of the first window that shows it. Articles without a time or id have no parent.
    """
    span = int(window_hours * 3600)
    f = written(story_features(articles, use_simhash, hash), "stories")
    lo = F.col("ts") - (span - 1)
    if step_hours:
        step, t0 = int(step_hours * 3600), f.agg(F.min("ts")).first()[0] or 0
        start = F.lit(t0) + F.ceil(F.greatest(F.lit(0), F.col("ts") - t0 - span) / step) * step
        lo = F.when(start == t0, F.lit(t0)).otherwise(start + 1)
    seen = f.withColumn("lo", lo.cast("long")).where("ts is not null and article_id is not null")
    same = _first_alike(seen.select("article_id", "ts", "toks", "figs", "lo"), span)
    if use_simhash:
        same = same.unionByName(_first_near(seen.where("sig is not null").select("article_id", "ts", "sig", "lo"), span))
    best = same.groupBy("b").agg(F.min(F.struct("ta", "a")).alias("m")).select(F.col("b").alias("article_id"), F.col("m.a").alias("parent"))
    return f.select("article_id", "ts").join(best, "article_id", "left")


def cluster(articles: DataFrame, window_hours: float = 48, step_hours: float | None = None, use_simhash: bool = True) -> DataFrame:
    """(article_id, cluster_id): cluster_id is the id of the cluster's first article.

    An article joins the cluster of the earliest earlier article within the window that is the same story. That is
    the root of the chain of parents, found by pointer jumping: log(depth) joins, each a written table.
    """
    p = written(parents(articles, window_hours, step_hours, use_simhash).select("article_id", F.coalesce("parent", "article_id").alias("root")), "roots")
    while True:
        up = p.select(F.col("article_id").alias("root"), F.col("root").alias("up"))
        nxt = written(p.join(up, "root").select("article_id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        p = nxt.select("article_id", "root")
        if nxt.where("moved").isEmpty():
            return p.withColumnRenamed("root", "cluster_id")


def cluster_history(articles: DataFrame, window_hours: float = 48, step_hours: float = 24, parity: bool = False) -> DataFrame:
    """Clusters of a whole history seen through overlapping windows: an article looks back to the start of the first
    window that shows it, between window - step and window hours. parity leaves spans shorter than
    window - step, and the very first timestamp, without a cluster."""
    t0 = articles.agg(F.min(F.unix_timestamp("published_ts")).alias("t0"), F.max(F.unix_timestamp("published_ts")).alias("t1")).first()
    got = cluster(articles, window_hours, step_hours)
    if parity and t0["t0"] is not None:
        short = t0["t1"] - t0["t0"] < (window_hours - step_hours) * 3600
        got = got.join(articles.select("article_id", F.unix_timestamp("published_ts").alias("ts")), "article_id")
        got = got.select("article_id", F.when(F.lit(not short) & (F.col("ts") > t0["t0"]), F.col("cluster_id")).alias("cluster_id"))
    return got


def novelty(clustered: DataFrame) -> DataFrame:
    """clustered (article_id, cluster_id, published_ts) with novelty 1/sqrt(1 + earlier articles of the cluster) and
    cluster_size; ties share, and without a cluster both are 1."""
    spread = clustered.withColumn("alone_", F.when(F.col("cluster_id").isNull(), F.monotonically_increasing_id()))  # each row without a cluster is by itself
    w = Window.partitionBy("cluster_id", "alone_")
    return spread.withColumn("novelty", 1 / F.sqrt(F.rank().over(w.orderBy("published_ts")))).withColumn("cluster_size", F.count("*").over(w)).drop("alone_")
