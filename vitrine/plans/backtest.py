"""The backtest job: label events and archived snapshots to coverage, prevalence and earliest offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from vitrine.operators import controls, extraction, matching
from vitrine.session import materialize
from vitrine.sources.dictionaries import Dictionaries, load_all

SNAPSHOT = ["domain", "timestamp"]


@dataclass
class Backtest:
    rows: DataFrame
    coverage: DataFrame
    prevalence: DataFrame
    earliest: DataFrame


def replay(snapshots: DataFrame, dictionaries: Dictionaries | None = None) -> DataFrame:
    """Match archived snapshots (domain, timestamp, status, html) with the same dictionaries as live pages."""
    known = dictionaries or load_all()
    readable = snapshots.where((F.col("status") == 200) & F.col("html").isNotNull()).withColumn("page_ord", F.lit(0))
    hosts = extraction.external_hosts(F.col("hreflang_alternates"), F.col("domain"))
    facts = matching.with_lower(extraction.extract(readable)).select(
        *SNAPSHOT,
        "page_ord",
        matching.page_hits(known.apps).alias("app_hits"),
        matching.page_hits(known.fingerprints).alias("fingerprint_hits"),
        hosts.alias("external_hosts"),
    )
    seen = materialize(facts, "snapshot_facts")
    apps = matching.first_matches(seen, "app_hits", SNAPSHOT)
    marks = matching.fingerprint_matches(seen, "fingerprint_hits", known.fingerprints, SNAPSHOT)
    return controls.snapshot_hits(snapshots, apps, marks)


def run_backtest(
    migrators: DataFrame,
    negatives: DataFrame,
    sizes: DataFrame,
    archive_index: DataFrame,
    snapshots: DataFrame,
    offsets: tuple[int, ...] = controls.OFFSETS,
    tolerance_days: int = controls.TOLERANCE_DAYS,
    control_group: int = controls.CONTROL_GROUP,
    dictionaries: Dictionaries | None = None,
) -> Backtest:
    """Plans, grid, as-of pick, replay and summaries. Without migrators every result is empty and coverage NULL.

    Only snapshots the grid picked are replayed.
    """
    chosen = controls.matched_controls(negatives, migrators, sizes, control_group)
    planned = controls.plans(migrators, chosen, controls.reference_month(migrators))
    some = migrators.agg(F.count(F.lit(1)) > 0).scalar()
    wanted = controls.grid(planned.where(some), offsets)
    picked = controls.pick_snapshots(wanted, archive_index, tolerance_days)
    needed = picked.where(F.col("timestamp").isNotNull()).select(*SNAPSHOT).distinct()
    hits = replay(snapshots.join(needed, SNAPSHOT, "left_semi"), dictionaries)
    rows = controls.backtest_rows(picked, hits)
    return Backtest(rows, controls.coverage(rows), controls.prevalence(rows, offsets), controls.earliest_offsets(rows))
