"""The index job: every scan of a panel version to one row of the time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.operators import hiring, series
from vitrine.operators.score import THRESHOLDS
from vitrine.sinks import tables


def compute_index(
    spark: SparkSession,
    warehouse: str,
    version: str,
    panel: DataFrame | None = None,
    posts: DataFrame | None = None,
    threshold: float = THRESHOLDS["score"],
) -> DataFrame:
    """Index rows of a version from the scan tables; all scans in one grouped plan, the version pruned at the scan."""
    mine = F.col("panel_version") == version
    # A scan in which every home page failed has outcomes but no feature rows; it still gets its row.
    scans = tables.read_scan_table(spark, warehouse, "outcomes").where(mine).select(*series.SCAN).distinct()
    features = tables.read_scan_table(spark, warehouse, "features").where(mine).select(
        "domain", *series.SCAN, "score", "workaround_app_count", F.col("components.high_growth.active").alias("high_growth_active")
    )
    marks = tables.read_scan_table(spark, warehouse, "fingerprint_matches").where(mine).select("domain", *series.SCAN, "verified")
    monthly = None
    if posts is not None:
        monthly = hiring.monthly_counts(posts).where(F.col("basis") == "first_seen").select("month", "n")
    return series.index_series(scans, features, marks, panel, monthly, threshold)


def run_index(spark: SparkSession, warehouse: str, version: str, computed_at: str, **options) -> DataFrame:
    """Compute, store (replacing the version's rows) and return the series."""
    path = f"{warehouse}/index_values"
    rows = compute_index(spark, warehouse, version, **options).withColumn("computed_at", F.lit(computed_at).cast("timestamp"))
    tables.replace_scan(rows, path)
    return spark.read.parquet(path).where(F.col("panel_version") == version)
