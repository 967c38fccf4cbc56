"""Scoring a stream of posts: dedup, enrich, score, threshold, and an idempotent sink; counters beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.operators.lookups import exists_flag
from lumenframe.sources.sinks import deletion_requests, insert_ignore

Scorer = Callable[[DataFrame], DataFrame]


def deduplicated(source: DataFrame, key: str, time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Each key once. With a time column and a watermark, state is dropped after it, and so are rows that come later than that;
    without, no row is lost and state grows with the keys."""
    if time and watermark:
        return source.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])
    return source.dropDuplicates([key])


def scored(source: DataFrame, static: DataFrame | None, key: str, scorer: Scorer, threshold: float) -> DataFrame:
    """Rows with their entity (those without one vanish) whose score lies above the threshold."""
    joined = source if static is None else source.join(static, key)
    return scorer(joined).filter(F.col("score") > threshold)


def score_stream(source: DataFrame, static: DataFrame | None, scorer: Scorer, threshold: float, key: str, sink: str, checkpoint: str, time: str | None = None, watermark: str | None = None, deleted: DataFrame | None = None, requests: str | None = None, realtime_delete: bool = False, available_now: bool = True) -> StreamingQuery:
    """Starts the stream. Every micro-batch is appended to the Parquet table at `sink`, unless its key is there, so that a batch which is
    run again adds nothing. deleted: a table of keys that become a flag. requests: where deletion requests go, if that is enabled."""
    rows = scored(deduplicated(source, key, time, watermark), static, key, scorer, threshold)

    def write(batch: DataFrame, _: int) -> None:
        out = batch if deleted is None else exists_flag(batch, deleted, key, "is_deleted")
        out = out.persist()
        try:
            insert_ignore(out, sink, [key])
            if requests:
                deletion_requests(out, requests, realtime_delete)
        finally:
            out.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def running_counters(source: DataFrame, hit: str) -> DataFrame:
    """hits, seen and ratio since the start, for the complete output mode."""
    counted = source.agg(F.count_if(F.expr(hit)).alias("hits"), F.count("*").alias("seen"))
    return counted.withColumn("ratio", F.col("hits") / F.col("seen"))


def windowed_counts(source: DataFrame, time: str, window: str, watermark: str, by: list[str]) -> DataFrame:
    return source.withWatermark(time, watermark).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
