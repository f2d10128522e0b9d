"""Trading time: local dates, session closes, repair of implausible timestamps, offsets of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def local_date(ts: Column, zone: str = config.ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_hour(ts: Column, zone: str = config.ZONE) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))


def in_session(ts: Column, zone: str = config.ZONE, hours: tuple[int, int] = config.SESSION_HOURS) -> Column:
    return local_hour(ts, zone).between(hours[0], hours[1] - 1)


def session_close_utc(date: Column, zone: str = config.ZONE, hour: int = config.SESSION_HOURS[1]) -> Column:
    """Instant (UTC) of the local session close; summer time follows the zone's history."""
    return F.to_utc_timestamp(F.to_timestamp_ntz(F.concat_ws(" ", date.cast("string"), F.lit(f"{hour:02d}:00:00"))).cast("timestamp"), zone)


def suspect_reason(ts: Column, now: Column) -> Column:
    """'future' over an hour ahead, 'ancient' before 2000, 'missing' for null, else null."""
    return F.when(ts.isNull(), "missing").when(ts > now + F.expr("INTERVAL 1 HOUR"), "future").when(ts < F.lit("2000-01-01").cast("timestamp"), "ancient")


def repair_timestamps(articles: DataFrame, published: str = "published_ts", collected: str = "ingested_ts") -> DataFrame:
    """Implausible publication times become the collection time; the column suspect tells why. No row is dropped."""
    why = suspect_reason(F.col(published), F.col(collected))
    return articles.withColumn("suspect", why).withColumn(published, F.when(F.col("suspect").isNull(), F.col(published)).otherwise(F.col(collected)))


def diagnose_offsets(articles: DataFrame, now: Column | None = None, days: int = 30, least: int = 12) -> DataFrame:
    """Per domain: n, p10 of (collected - published) seconds, offset_s, verdict ('wrong', 'suspicion', 'ok').

    p10 is the value at index int(.1 (n - 1)). A tenth percentile under -600 s and within a quarter hour of a
    whole number of hours is a wrong zone; the domains that are near but under three quarters of an hour stay ok.
    """
    rows = articles.where(F.col("domain").isNotNull()).select("domain", (F.unix_timestamp("ingested_ts") - F.unix_timestamp("published_ts")).alias("lag"), "ingested_ts")
    if now is not None:
        rows = rows.where(F.col("ingested_ts") > now - F.make_dt_interval(F.lit(days)))
    # how often each lag occurs, so that no domain's rows need to stand together
    counts = rows.groupBy("domain", "lag").agg(F.count("*").alias("c"))
    total = counts.groupBy("domain").agg(F.sum("c").alias("n"))
    from pyspark.sql import Window

    upto = F.sum("c").over(Window.partitionBy("domain").orderBy("lag"))
    at = counts.withColumn("upto", upto).join(total, "domain").where(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(0.1)))
    p10 = at.groupBy("domain").agg(F.min("lag").alias("p10_s"), F.first("n").alias("n")).where(F.col("n") >= least)
    hours = F.col("p10_s") / 3600.0
    whole = F.round(hours)
    near = (F.abs(hours - whole) <= 0.25) & (whole != 0)
    verdict = F.when((F.col("p10_s") < -600) & near, "wrong").when((F.abs(hours) >= 0.75) & near, "suspicion").otherwise("ok")
    return p10.select("domain", "n", "p10_s", verdict.alias("verdict"), F.when(verdict != "ok", (whole * 3600).cast("long")).otherwise(F.lit(0).cast("long")).alias("offset_s"))


def apply_offsets(articles: DataFrame, offsets: DataFrame, conclusive_only: bool = True) -> DataFrame:
    """Publication times moved by their domain's offset (a row a domain)."""
    use = offsets.where("verdict = 'wrong'" if conclusive_only else "verdict != 'ok'").select("domain", "offset_s")
    moved = F.timestamp_seconds(F.unix_timestamp("published_ts") + F.coalesce("offset_s", F.lit(0)))
    return articles.join(use, "domain", "left").withColumn("published_ts", F.when(F.col("offset_s").isNull(), F.col("published_ts")).otherwise(moved)).drop("offset_s")
