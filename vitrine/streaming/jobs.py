"""Structured Streaming versions of the incremental steps; each equals its batch rule on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators import hiring, keyed
from vitrine.sinks import tables
from vitrine.streaming import consecutive

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_intake(pages: DataFrame, checkpoint: str, out: str, delay: str = "2 days") -> StreamingQuery:
    """Append one row per (url, scan day): repeats within the delay are dropped by the state store."""
    once = (
        pages.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
        .withWatermark("fetched_at", delay)
        .withColumn("scan_day", F.to_date("fetched_at"))
        .dropDuplicatesWithinWatermark(["url", "scan_day"])
    )
    return (
        once.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .option("path", out)
        .start()
    )


def post_sightings(posts: DataFrame, checkpoint: str, table: str, buckets: int = tables.BUCKETS) -> StreamingQuery:
    """Merge each micro-batch into the recorded posts: first sighting kept, last one shown.

    Only the buckets that a batch has posts of are read and written, and a replayed batch changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        tables.merge_touched(batch, table, hiring.POST_KEY, hiring.merge_posts, batch_id, buckets)

    return posts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def post_months(posts: DataFrame, checkpoint: str, table: str, buckets: int = 8) -> StreamingQuery:
    """Posts per first-seen calendar month, kept up to date: each batch replaces the months it changed."""
    counts = posts.groupBy(F.date_format("first_seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))

    def replace(batch: DataFrame, batch_id: int) -> None:
        tables.merge_touched(batch, table, ["month"], lambda old, new: keyed.upsert_replace(old, new, ["month"], ["n"]), batch_id, buckets)

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


ALERTS = "domain string, prior_scan_date date, scan_date date"


def conversion_alerts(states: DataFrame, checkpoint: str, out: str, delay: str = "60 days") -> StreamingQuery:
    """Append an alert when a store's verified flag goes from false to true between consecutive scans.

    `states` has domain, scan_seq (1, 2, ... per scan), scan_date, verified; a store missing from a scan has no row
    for it. Scans may come in any order within `delay`, later ones are dropped; a repeated scan changes nothing.
    State per store is one block of consecutive scans and one more for each gap that a late scan can still fill.
    """
    spark = states.sparkSession
    timed = states.where("scan_seq IS NOT NULL AND scan_date IS NOT NULL").withColumn("scanned_at", F.col("scan_date").cast("timestamp"))
    alerts = (
        timed.withWatermark("scanned_at", delay)
        .groupBy("domain")
        .transformWithState(consecutive.Conversions(), ALERTS, outputMode="Append", timeMode="EventTime")
    )
    usual = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)  # typed state needs it; a query keeps the setting that it starts with
    try:
        return (
            alerts.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .format("parquet")
            .option("path", out)
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, usual)
