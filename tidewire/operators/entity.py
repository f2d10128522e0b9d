"""Entity linking: gazetteer of aliases, mentions with relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import BREAK, norm, whole

CODE = r"^[A-Z]{4}[0-9]{1,2}$"
SMALL = 200_000  #: so many terms, of a few hundred bytes each, are broadcast
FEW = 1_000  #: so many keys of terms are a constant of the plan, by which a text's words are sifted before it is repeated for each


def gazetteer(entities: DataFrame, ambiguous: list[str] = config.AMBIGUOUS_ALIASES) -> DataFrame:
    """(ticker, rank, alias, form, first, cased, pattern) of entities (ticker, aliases array).

    Codes match raw text with their case; other aliases match the normal form, have three characters at least and
    are not ambiguous. first: the alias's first run of letters and digits, by which texts are joined.
    """
    a = entities.select("ticker", F.posexplode("aliases").alias("rank", "alias")).withColumn("alias", F.trim("alias"))
    cased = F.col("alias").rlike(CODE)
    a = a.withColumn("cased", cased).withColumn("form", F.when(cased, F.col("alias")).otherwise(norm(F.col("alias"))))
    a = a.where(F.col("cased") | ((F.length("form") >= 3) & ~F.col("form").isin(ambiguous)))
    edge = F.when(F.col("cased"), "[A-Za-z0-9]").otherwise("[a-z0-9]")
    return a.withColumn("first", F.regexp_extract("form", "[A-Za-z0-9]+", 0)).withColumn("pattern", whole(F.col("form"), edge))


def word_hits(text_norm: Column, words: list[str]) -> Column:
    """Number of the words that the text holds."""
    return F.size(F.array_intersect(F.split(text_norm, " "), F.array(*[F.lit(w) for w in words])))


def relevance_of(hits: Column, noise: Column, in_title: Column, n_tickers: Column) -> Column:
    """0..1 from the counts of market and noise words, a mention in the title and the number of entities mentioned."""
    r = 0.20 + F.when(in_title, 0.35).otherwise(0.0) + F.least(hits, F.lit(6)) * 0.09 - noise * 0.30
    r = r * F.when(n_tickers > 3, 0.55).when(n_tickers == 3, 0.75).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))


def relevance(text_norm: Column, in_title: Column, n_tickers: Column, market=config.MARKET_WORDS, noise=config.NOISE_WORDS) -> Column:
    return relevance_of(word_hits(text_norm, market), word_hits(text_norm, noise), in_title, n_tickers)


def by_first_word(texts: DataFrame, words: Column, terms: DataFrame, verify: Column, keep: list[str]) -> DataFrame:
    """Pairs of texts (article_id, ...) and terms (key, ...) that share a key and hold verify; keep are the columns asked for.

    words is the array of a text's keys, repeats included. Up to SMALL terms, counted, are broadcast by key: a text's words are looked up and the pattern is
    tried in the text's own row, so texts don't move. More terms meet ids and words by a hash join, and the texts join again.
    """
    few = [r[0] for r in terms.where("key is not null").select("key").distinct().limit(FEW + 1).collect()]
    if 0 < len(few) <= FEW:
        words = F.array_intersect(words, F.array(*[F.lit(k) for k in few]))
    else:
        words = F.array_distinct(words)
    if terms.count() <= SMALL:
        # its words are one column of a text's row while they are looked up; what does not match goes nowhere
        return texts.withColumn("key", F.explode(words)).join(F.broadcast(terms), "key").where(verify).select(keep)
    pairs = texts.select("article_id", F.explode(words).alias("key")).join(terms, "key").drop("key")
    return pairs.join(texts, "article_id").where(verify).select(keep)


def link_mentions(articles: DataFrame, gaz: DataFrame, market=config.MARKET_WORDS, noise=config.NOISE_WORDS, code_chars: int | None = None) -> DataFrame:
    """(article_id, ticker, relevance, matched_alias) of articles (article_id, title, body).

    The first alias in listed order wins, title before body for each. An article without any gets one row with the
    ticker __none__: every text also has the empty word, which is that row's. One scan and one shuffle, of what was found.
    code_chars: codes are looked for in so many first characters of a body only, as the reference does; by default in all of it.
    """
    raw = F.coalesce("body", F.lit(""))
    a = articles.select("article_id", F.coalesce("title", F.lit("")).alias("rt"), (raw if code_chars is None else F.substring(raw, 1, code_chars)).alias("rb"), norm(F.col("title")).alias("nt"), norm(F.col("body")).alias("nb"))
    full = F.trim(F.concat_ws(" ", "nt", "nb"))
    a = a.withColumns({"hits": word_hits(full, market), "noise": word_hits(full, noise)})
    # keys of names are lower case and codes have capitals, so neither is taken for the other; a code's letters come first in its pattern, as in `whole`
    names = F.split(F.concat_ws(" ", "nt", "nb"), BREAK)
    codes = F.regexp_extract_all(F.concat_ws(" ", "rt", "rb"), F.lit(f"{CODE[1:-1]}(?![A-Za-z0-9])(?<![A-Za-z0-9]{CODE[1:-1]})"), F.lit(0))
    words = F.concat(names, codes, F.array(F.lit("")))
    key = gaz.select(F.col("first").alias("key"), "ticker", "rank", "alias", "cased", "pattern")
    nobody = gaz.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(config.NOBODY).alias("ticker"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("cased"), F.lit("").alias("pattern"))
    title = F.rlike(F.when(F.col("cased"), F.col("rt")).otherwise(F.col("nt")), F.col("pattern"))
    body = F.rlike(F.when(F.col("cased"), F.col("rb")).otherwise(F.col("nb")), F.col("pattern"))
    # a pattern is tried once on the title and, for the order of aliases, once more where it was found
    hit = by_first_word(a, words, key.unionByName(nobody), (F.col("pattern") == "") | title | body, ["article_id", "ticker", "rank", (~title).alias("later"), "alias", "hits", "noise"]).repartition("article_id")
    best = hit.groupBy("article_id", "ticker").agg(F.min(F.struct("rank", "later", "alias")).alias("b"), F.max("hits").alias("hits"), F.max("noise").alias("noise"))
    someone = F.col("ticker") != config.NOBODY
    found = best.withColumn("n", F.count_if(someone).over(Window.partitionBy("article_id"))).where(someone | (F.col("n") == 0))
    rel = F.when(someone, relevance_of(F.col("hits"), F.col("noise"), ~F.col("b.later"), F.col("n"))).otherwise(0.0)
    return found.select("article_id", "ticker", rel.alias("relevance"), F.col("b.alias").alias("matched_alias"))


def entities_from(spark: SparkSession, watchlist: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(t, a) for t, a in watchlist.items()], "ticker string, aliases array<string>")
