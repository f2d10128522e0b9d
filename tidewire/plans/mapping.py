"""Roles that the driver's tables play for the jobs, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators.dedupe import cluster

START, SPAN = 1_700_000_000, 2_592_000  #: publication times lie within 30 days from here
SENTENCE = "^[^.!?]*[.!?]?"  #: documents have no headline; their first sentence stands for it


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files have fewer splits than two a core, as heavy work on texts would wait for a few tasks;
    larger tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def R(expr: str) -> str:
    """SQL: six places, without a negative zero."""
    return f"(round({expr}, 6) + 0.0)"


def articles(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.lit(START) + (F.col("doc_id") * 7919) % SPAN
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("article_id"), F.concat(F.lit("http://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.regexp_extract("text", SENTENCE, 0).alias("title"), F.col("text").alias("body"),
        F.col("source").alias("domain"), "lang", F.timestamp_seconds(ts).alias("published_ts"), F.timestamp_seconds(ts + F.col("doc_id") % 7 * 60).alias("ingested_ts"), F.lit("rss").alias("source"))


ARTICLES = f"""articles AS (SELECT doc_id AS article_id, regexp_extract(text, '{SENTENCE}') AS title, text AS body, source AS domain, lang,
  {START} + (doc_id * 7919) % {SPAN} AS ts, {START} + (doc_id * 7919) % {SPAN} + doc_id % 7 * 60 AS its FROM documents)"""


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """articles with cluster_id, the first article of the story: by the words and figures of titles, within 48 hours. Texts under 40
    characters have none. The clusters are written; who reads the result more than once should not call this again."""
    a = articles(spark, sf)
    return a.join(cluster(a.where(F.length("body") >= 40), 48, use_simhash=False), "article_id", "left")


def norm_sql(expr: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({expr}, ''))), '[^a-z0-9%+\-.\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def content_sql(expr: str) -> str:
    stop = ", ".join(f"'{w}'" for w in config.STOP_WORDS)
    return f"list_sort(list_distinct(list_filter(string_split({norm_sql(expr)}, ' '), lambda t: length(t) > 2 AND NOT list_contains([{stop}], t))))"


def figures_sql(low: str) -> str:
    """Sorted distinct figures of a text that is lower case without accents."""
    mags = "|".join(config.MAGNITUDES)
    of = ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in config.MAGNITUDES.items())
    found = [f"regexp_extract_all({low}, '(\\d+(?:[.,]\\d+)?)\\s*({mags})\\b', {i})" for i in (1, 2)]
    values = f"list_transform(list_zip({found[0]}, {found[1]}), lambda p: CAST(replace(p[1], ',', '.') AS DOUBLE) * MAP {{{of}}}[p[2]])"
    return f"list_sort(list_distinct(list_transform(list_filter({values}, lambda a: a >= 1e6), lambda a: CAST(round(a / pow(10.0, floor(log10(a)) - 3)) AS BIGINT) * CAST(pow(10, floor(log10(a)) - 3) AS BIGINT))))"


#: For a recursive WITH: each text joins the earliest earlier one within 48 hours that is the same story, and so on to the story's first.
CLUSTERED = ARTICLES + f""", stories AS (SELECT article_id, ts, {content_sql('title')} AS k, {figures_sql("lower(strip_accents(title))")} AS f FROM articles WHERE length(body) >= 40),
story_pairs AS (SELECT b.article_id AS b, a.article_id AS a, a.ts, a.f AS fa, b.f AS fb, CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))::DOUBLE END AS j
  FROM stories a JOIN stories b ON b.ts - a.ts < 172800 AND (a.ts < b.ts OR a.ts = b.ts AND a.article_id < b.article_id)),
story_parents AS (SELECT b, arg_min(a, {{'ts': ts, 'a': a}}) AS a FROM story_pairs WHERE j >= {config.JACCARD_MIN}::DOUBLE OR list_has_any(fa, fb) AND j >= {config.JACCARD_WITH_FIGURE}::DOUBLE GROUP BY b),
story_roots(article_id, root) AS (SELECT article_id, article_id FROM stories WHERE article_id NOT IN (SELECT b FROM story_parents) UNION ALL SELECT p.b, r.root FROM story_parents p JOIN story_roots r ON p.a = r.article_id),
clustered AS (SELECT articles.*, root AS cluster_id FROM articles LEFT JOIN story_roots USING (article_id))"""


def prices(spark: SparkSession, sf: str, key: str = "p_brand", name: str = "ticker") -> DataFrame:
    """Mean unit price of a brand (or type) a ship date: from sums in cents, so that no order of adding shows."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    cents, n = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")), F.sum(F.col("l_quantity").cast("long"))
    return li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col(key).alias(name), F.to_date("l_shipdate").alias("date")).agg((cents.cast("double") / n.cast("double") / 100.0).alias("close"))


def prices_sql(key: str = "p_brand", name: str = "ticker", cte: str = "prices") -> str:
    return f"""{cte} AS (SELECT {key} AS {name}, CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100.0 AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def returns_sql(src: str = "prices", name: str = "ticker", cte: str = "rets") -> str:
    return f"""{cte} AS (SELECT {name}, date, close / prev - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY {name} ORDER BY date) AS prev FROM {src}) WHERE prev IS NOT NULL AND prev <> 0)"""


ABN = prices_sql() + ", " + returns_sql() + """, market AS (SELECT date, avg(ret) AS market FROM rets GROUP BY date HAVING count(*) >= 3),
abn AS (SELECT ticker, date, ret - market AS abn FROM rets JOIN market USING (date))"""


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly mean value of each type of event, from sums in thousandths."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")).agg((F.sum(F.round(F.col("value") * 1000).cast("long")).cast("double") / F.count("*") / 1000.0).alias("close"))


BARS = "bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000.0 AS close FROM events GROUP BY ALL)"
