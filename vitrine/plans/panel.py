"""The panel job: pick a new frozen panel from the latest scan in the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.operators import panel
from vitrine.sinks import tables


class PanelError(ValueError):
    """There is nothing to build a panel from."""


def eligible_at_latest_scan(spark: SparkSession, warehouse: str, positives: DataFrame) -> DataFrame:
    """Candidates of the newest scan (its date, then its panel version): platform stores with a feed, unlabelled as positive, without fingerprint."""
    stores = tables.read_scan_table(spark, warehouse, "stores")
    newest = stores.agg(F.max(F.struct("scan_date", "panel_version"))).first()[0]
    if newest is None:
        raise PanelError("the warehouse holds no scan yet")
    at = (F.col("scan_date") == F.lit(newest.scan_date)) & (F.col("panel_version") == F.lit(newest.panel_version))
    catalog = tables.read_scan_table(spark, warehouse, "catalog_snapshots").where(at)
    marked = tables.read_scan_table(spark, warehouse, "fingerprint_matches").where(at)
    return panel.eligible(stores.where(at), catalog, positives, marked)


def build_panel(
    spark: SparkSession,
    warehouse: str,
    positives: DataFrame,
    version: str,
    added_at: str,
    size: int = panel.PANEL_SIZE,
    seed: int = panel.PANEL_SEED,
) -> DataFrame:
    """Select, freeze and return the panel of a new version; an existing version is refused before any work."""
    path = f"{warehouse}/panel"
    if tables.exists(spark, f"{path}/panel_version={version}"):
        raise tables.FrozenPanel(f"panel version {version} exists and panels are frozen; choose a new version")
    candidates = eligible_at_latest_scan(spark, warehouse, positives)
    if candidates.isEmpty():
        raise PanelError("no store at the latest scan is eligible")
    chosen = panel.select_panel(candidates, size, seed).select("domain", F.lit(added_at).cast("timestamp").alias("added_at"))
    tables.freeze_panel(chosen, path, version)
    return spark.read.parquet(path).where(F.col("panel_version") == version)
