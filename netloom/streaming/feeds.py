"""Streams over job events, URL candidates, requests and conversation turns.

Event times are zoned timestamps.  Every expiry of the service becomes a
watermark or a state lifetime.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.crawl import url_key
from netloom.operators.sessions import TURNS

# Requests allowed per 60 seconds by mode, and for other modes.
RATE_POINTS = {
    "crawl": 15, "scrape": 100, "search": 100, "map": 100, "extract": 100, "preview": 25,
    "extractStatus": 25000, "crawlStatus": 25000, "extractAgentPreview": 10,
    "scrapeAgentPreview": 10, "browser": 20, "browserExecute": 1000,
}
DEFAULT_POINTS = 500


def document_feed(job_events: DataFrame, keep: str = "24 hours") -> DataFrame:
    """Each job once, when it completes: catch-up and live in one stream."""
    done = job_events.where("action = 'completed'").withWatermark("ts", keep)
    return done.dropDuplicatesWithinWatermark(["job_id"])


def feed_done(job_events: DataFrame) -> DataFrame:
    """Batch question behind the feed's end: are all known jobs done, per owner."""
    jobs = job_events.groupBy("owner_id", "job_id").agg(
        F.bool_or(F.col("action").isin("completed", "failed")).alias("_done"))
    return jobs.groupBy("owner_id").agg(F.bool_and("_done").alias("done"))


def claim_urls_stream(candidates: DataFrame, keep: str = "24 hours", similar: bool = False,
                      ignore_query: bool = False) -> DataFrame:
    """Each URL key once per crawl within its lifetime."""
    keyed = candidates.withColumn("key", url_key("url", ignore_query, similar))
    return keyed.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["crawl_id", "key"])


def rate_points(mode) -> Column:
    """Points of a mode; search and scrape never go below 100."""
    m, out = (F.col(mode) if isinstance(mode, str) else mode), None
    for name, points in RATE_POINTS.items():
        out = F.when(m == name, points) if out is None else out.when(m == name, points)
    return out.otherwise(DEFAULT_POINTS)


def rate_limit(requests: DataFrame, points: Column | None = None,
               window: str = "60 seconds") -> DataFrame:
    """Batch form: adds ``allowed`` to each request (``key, mode, ts, request_id``).

    A fixed window bounds each group in time.
    """
    limit = points if points is not None else rate_points("mode")
    tagged = requests.withColumn("_w", F.window("ts", window)["start"])
    order = Window.partitionBy("key", "mode", "_w").orderBy("ts", "request_id")
    return tagged.withColumn("allowed", F.row_number().over(order) <= limit).drop("_w")


def rate_limit_stream(requests: DataFrame, points: Column | None = None,
                      window: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Requests and allowed requests per key, mode and window."""
    limit = points if points is not None else rate_points("mode")
    counts = requests.withWatermark("ts", late).groupBy(
        "key", "mode", F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"))
    return counts.select("key", "mode", F.col("w.start").alias("window_start"), "requests",
                         F.least("requests", limit.cast("bigint")).alias("allowed"))


def last_success(job_events: DataFrame, now: Column | None = None, keep: str = "24 hours") -> DataFrame:
    """Latest success per owner; with ``now``, only those younger than ``keep``.

    For batch tables; of a stream see ``stateful.last_success_stream``.
    """
    latest = job_events.where("action = 'completed'").groupBy("owner_id").agg(F.max("ts").alias("last_success"))
    if now is None:
        return latest
    return latest.where(F.col("last_success") > now - F.expr(f"interval {keep}"))


def suggestion_stream(exchanges: DataFrame, extractor: Callable[[DataFrame], DataFrame],
                      pending_path: str, checkpoint: str, now: Column | None = None,
                      min_confidence: float = 0.7, batch_size: int = 20, **trigger):
    """Starts the extraction of suggestions from new exchanges.

    ``extractor`` maps a table ``batch_id, exchange_id, user_message,
    assistant_message`` to answers ``batch_id, raw``.  A micro-batch writes its
    pending rows to a folder of its own that a retry overwrites, so each
    exchange counts once.  Batches hold neighbours of one session.
    """
    from netloom.operators.memory import parse_suggestions

    when = now if now is not None else F.unix_timestamp()

    def handle(batch: DataFrame, epoch: int) -> None:
        grouped = batch.select(
            (F.col("session_id") * TURNS + F.floor((F.col("sequence") - 1) / batch_size)).alias("batch_id"),
            F.col("id").alias("exchange_id"), "user_message", "assistant_message")
        answers = extractor(grouped)
        found = parse_suggestions(answers, grouped.select("batch_id", "exchange_id"))
        pending = found.where(F.col("confidence") >= min_confidence).select(
            "source_exchange_id", "content", "target", "confidence",
            when.alias("created_at"), F.lit("pending").alias("status"))
        pending.write.mode("overwrite").parquet(f"{pending_path}/epoch={epoch}")

    trigger = trigger or {"processingTime": "30 minutes"}
    return (exchanges.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
            .foreachBatch(handle).start())
