"""Rule calendars of scheduled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .surprise import roll_weekend


def rule_date(rule: Column, month: Column) -> Column:
    """Date of a rule (first_friday, day1, day12) in the month, rolled off weekends."""
    first = F.trunc(month, "month")
    friday = F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 0)
    return roll_weekend(F.when(rule == "first_friday", friday).when(rule == "day1", first).otherwise(F.date_add(first, 11)))


def rule_dates(spark: SparkSession, start: str, end: str, rules: dict[str, tuple[str, str]] = config.EVENT_RULES) -> DataFrame:
    """(event, instrument, date) of every month that touches start..end."""
    r = spark.createDataFrame([(e, i, x) for e, (i, x) in rules.items()], "event string, instrument string, rule string")
    months = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month")
    return r.select("*", months).select("event", "instrument", rule_date(F.col("rule"), F.col("month")).alias("date"))


def risk_flag(date: Column, rule: str = "first_friday") -> Column:
    """1.0 on the rule's date of the month: known before, without direction."""
    return F.when(rule_date(F.lit(rule), date) == date, 1.0).otherwise(0.0)


def agenda(dates: DataFrame, start: str, days: int = 7) -> DataFrame:
    d = F.lit(start).cast("date")
    return dates.where(F.col("date").between(d, F.date_add(d, days)))


def pre_event_context(exposures: DataFrame, dates: DataFrame, today: str, days: int = 7) -> DataFrame:
    """(ticker, event, date, driver, share, context): exposure share x urgency, 1 on the day and .7 before."""
    up = agenda(dates, today, days)
    urgency = F.when(F.col("date") == F.lit(today).cast("date"), 1.0).otherwise(0.7)
    return exposures.join(up, F.col("driver") == F.col("instrument")).select("ticker", "event", "date", "driver", "share", (F.col("share") * urgency).alias("context"))
