"""Streaming counterparts of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timeutil import apply_offsets, repair_timestamps
from ..operators.score import language_covered, run_scorer


def repair_then_watermark(articles: DataFrame, offsets: DataFrame | None = None, delay: str = "2 hours") -> DataFrame:
    """Timestamps repaired (the source's offset, then implausible ones) before the watermark; column late_s is the lateness.
    offsets has a row a source; whether it is broadcast is left to its size."""
    a = apply_offsets(articles, offsets) if offsets is not None else articles
    a = repair_timestamps(a)
    return a.withColumn("late_s", F.unix_timestamp("ingested_ts") - F.unix_timestamp("published_ts")).withWatermark("published_ts", delay)


def ingest_articles(articles: DataFrame, delay: str = "2 hours", offsets: DataFrame | None = None) -> DataFrame:
    """Each url once within the watermark."""
    return repair_then_watermark(articles, offsets, delay).dropDuplicatesWithinWatermark(["url"])


def _once(rows: DataFrame, key: list[str] | None, delay: str) -> DataFrame:
    """rows with the watermark of a stream; with key, rows that repeat it (within the watermark) count once."""
    if not rows.isStreaming:
        return rows.dropDuplicates(key) if key else rows
    late = rows.withWatermark("published_ts", delay)
    return late.dropDuplicatesWithinWatermark(key) if key else late


def windowed_attention(mentions: DataFrame, width: str = "24 hours", slide: str | None = "1 hour", delay: str = "2 hours", key: list[str] | None = None) -> DataFrame:
    """(ticker, start, end, n) over tumbling (slide None) or sliding windows of mentions (ticker, published_ts).

    As a stream, a window comes out once the watermark has passed its end; rows later than that are dropped. With key, repeated
    deliveries count once.
    """
    w = F.window("published_ts", width, slide) if slide else F.window("published_ts", width)
    return _once(mentions, key, delay).groupBy(w, "ticker").agg(F.count("*").alias("n")).select("ticker", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def story_sessions(articles: DataFrame, gap: str = "2 hours", delay: str = "2 hours", key: list[str] | None = None) -> DataFrame:
    """(cluster_id, start, end, n): bursts of a story, parted by silences of `gap`. As a stream, late rows may join two bursts until the
    watermark has passed both; with key, repeated deliveries count once."""
    return _once(articles, key, delay).groupBy(F.session_window("published_ts", gap), "cluster_id").agg(F.count("*").alias("n")).select("cluster_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def score_stream(articles: DataFrame, weights: DataFrame, scorer: str = "lexicon", **options) -> DataFrame:
    """Covered articles scored, with the weight of their source: a stream-static join. weights has a row a domain; a stream
    keeps the weights it was planned with, see score_batches."""
    a = articles.where(language_covered(F.col("lang"), scorer))
    return run_scorer(a, scorer, **options).join(weights.select("domain", F.col("weight").alias("source_weight")), "domain", "left")


def score_batches(articles: DataFrame, weights_of: Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None], scorer: str = "lexicon", **options) -> DataStreamWriter:
    """A writer (to be started with a checkpoint) that scores each micro-batch with the weights as they are then: weights_of is
    asked anew each time. sink gets the scored rows and the batch's number; a batch that is run again after a failure has
    the same number, so a sink that replaces a number's rows (sinks.batches) makes the result exact."""
    def one(batch: DataFrame, number: int) -> None:
        sink(score_stream(batch, weights_of(batch.sparkSession), scorer, **options), number)

    return articles.writeStream.foreachBatch(one)


def cooldown(alarms: DataFrame) -> DataFrame:
    """Alarms (ticker, direction, asof, cooldown_min, ...) that fire; the last fired time of each (ticker, direction) is state."""
    schema = alarms.schema

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        g = pd.concat(list(batches)).sort_values("asof")
        keep = []
        for t, wait in zip(g["asof"], g["cooldown_min"], strict=True):
            fire = last is None or (t - last).total_seconds() >= wait * 60
            last = t if fire else last
            keep.append(fire)
        if last is not None:
            state.update((int(last.value // 1000),))
        yield g[keep]

    return alarms.groupBy("ticker", "direction").applyInPandasWithState(fold, schema, "last long", "append", GroupStateTimeout.NoTimeout)
