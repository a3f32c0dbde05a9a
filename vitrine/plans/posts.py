"""The hiring job: board feeds to recorded posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.operators import hiring
from vitrine.sinks import tables


def matched_sightings(payloads: DataFrame, boards: DataFrame, seen_at: str, terms: list[str] = hiring.TERMS) -> DataFrame:
    """Board bodies seen at one time to post rows with their store; posts without a term are left out."""
    found = hiring.matching_posts(hiring.parse_boards(payloads), terms)
    seen = F.lit(seen_at).cast("timestamp")
    placed = hiring.attach_stores(found.withColumn("domain", F.lit(None).cast("string")), boards)
    return placed.select(
        *hiring.POST_KEY,
        "domain",
        "title",
        "posted_at",
        seen.alias("first_seen_at"),
        seen.alias("last_seen_at"),
        "matched_terms",
        F.col("url").alias("source_url"),
    )


def record_posts(payloads: DataFrame, boards: DataFrame, seen_at: str, table: str, terms: list[str] = hiring.TERMS) -> DataFrame:
    """Merge the matching posts of one fetch into the posts table and return its new state."""
    spark = payloads.sparkSession
    batch = matched_sightings(payloads, boards, seen_at, terms)
    old = tables.current(spark, table)
    tables.publish(hiring.merge_posts(batch.limit(0) if old is None else old, batch), table)
    return tables.current(spark, table)
