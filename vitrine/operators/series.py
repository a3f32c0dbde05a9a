"""The index time series of a panel: prior scan, conversions, attrition, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitrine.functions import dates, values
from vitrine.operators.score import THRESHOLDS

SCAN = ["scan_date", "panel_version"]


def with_prior_scan(scans: DataFrame) -> DataFrame:
    """Scans with the date of the scan before, in version order. One row per scan: a short dimension table."""
    one = scans.select(*SCAN).distinct()
    before = F.lag("scan_date").over(Window.partitionBy("panel_version").orderBy("scan_date"))
    return one.withColumn("prior_scan_date", before)


def fingerprint_stores(fingerprints: DataFrame, verified_only: bool = False) -> DataFrame:
    """Stores with any fingerprint per scan, or with a verified one."""
    picked = fingerprints.where("verified") if verified_only else fingerprints
    return picked.select("domain", *SCAN).distinct()


def transitions(scans: DataFrame, features: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Stores that were self-serve at the prior scan, one row per scan and store, with `present` and `converted`.

    Self-serve here means no verified fingerprint. A store without a feature row at the scan is attrition,
    never a conversion. Both joins run on (version, date, domain), unique per scan, so no store piles up.
    """
    steps = with_prior_scan(scans).where(F.col("prior_scan_date").isNotNull())
    rows = features.select("domain", *SCAN)
    verified = fingerprint_stores(fingerprints, verified_only=True)
    prior = rows.join(verified, ["domain", *SCAN], "left_anti").withColumnRenamed("scan_date", "prior_scan_date")
    moved = prior.join(steps, ["panel_version", "prior_scan_date"])
    now = rows.withColumn("present", F.lit(True))
    won = verified.withColumn("verified_now", F.lit(True))
    keys = ["domain", *SCAN]
    joined = moved.join(now, keys, "left").join(won, keys, "left")
    present = F.coalesce("present", F.lit(False))
    return joined.select(
        "domain",
        *SCAN,
        "prior_scan_date",
        present.alias("present"),
        (present & F.coalesce("verified_now", F.lit(False))).alias("converted"),
    )


def conversion_counts(moved: DataFrame) -> DataFrame:
    """n_converted, n_prior_selfserve (present in both) and n_attrition per scan."""
    return moved.groupBy(*SCAN).agg(
        F.count_if("converted").alias("n_converted"),
        F.count_if("present").alias("n_prior_selfserve"),
        F.count_if(~F.col("present")).alias("n_attrition"),
    )


def index_series(
    scans: DataFrame,
    features: DataFrame,
    fingerprints: DataFrame,
    panel: DataFrame | None = None,
    monthly_posts: DataFrame | None = None,
    threshold: float = THRESHOLDS["score"],
) -> DataFrame:
    """One row per scan: panel sizes, three shares over self-serve stores, conversion since the prior scan.

    `features` has domain, scan_date, panel_version, score, workaround_app_count, high_growth_active;
    `panel` the panel's domains (none or empty: no filter); `monthly_posts` (month, n). Shares are NULL
    over an empty set. Self-serve for the shares means no fingerprint at all, verified or not; conversions
    look at verified ones and are not restricted to the panel.
    """
    members = features
    panel_n = F.lit(0).cast("long")
    if panel is not None:
        listed = panel.select("domain").distinct()
        size = listed.agg(F.count(F.lit(1)).alias("n")).scalar()
        tagged = features.join(listed.withColumn("_member", F.lit(True)), "domain", "left")
        members = tagged.where(F.col("_member").isNotNull() | (size == 0)).drop("_member")
        panel_n = listed.agg(F.count(F.lit(1)).alias("n")).scalar()
    marked = fingerprint_stores(fingerprints).withColumn("_marked", F.lit(True))
    flagged = members.join(marked, ["domain", *SCAN], "left")
    self_serve = F.col("_marked").isNull()

    def share(test):
        return F.avg(F.when(self_serve, F.when(test, 1.0).otherwise(0.0)))

    shares = flagged.groupBy(*SCAN).agg(
        F.count(F.lit(1)).alias("_scanned"),
        share(F.col("score") >= threshold).alias("share_at_threshold"),
        share(F.col("workaround_app_count") > 0).alias("share_workaround_any"),
        share(F.col("high_growth_active")).alias("share_high_growth"),
    )
    steps = with_prior_scan(scans)
    moved = conversion_counts(transitions(scans, features, fingerprints))
    month = dates.month_text(F.col("scan_date"))
    joined = steps.join(shares, SCAN, "left").join(moved, SCAN, "left").withColumn("month", month)
    if monthly_posts is not None:
        joined = joined.join(monthly_posts.select("month", F.col("n").alias("_posts")), "month", "left")
    else:
        joined = joined.withColumn("_posts", F.lit(0))
    first = F.col("prior_scan_date").isNull()
    scanned = F.coalesce("_scanned", F.lit(0))
    known = joined.withColumn("_panel", panel_n)
    return known.select(
        *SCAN,
        F.when(F.col("_panel") > 0, F.col("_panel")).otherwise(scanned).alias("panel_n"),
        scanned.alias("panel_n_scanned"),
        "share_at_threshold",
        "share_workaround_any",
        "share_high_growth",
        F.when(~first, values.ratio(F.col("n_converted"), F.col("n_prior_selfserve"))).alias("share_converted_since_prior"),
        F.when(~first, F.coalesce("n_converted", F.lit(0))).alias("n_converted"),
        F.when(~first, F.coalesce("n_prior_selfserve", F.lit(0))).alias("n_prior_selfserve"),
        F.coalesce("_posts", F.lit(0)).cast("long").alias("hiring_posts_month"),
    )


def share_at_threshold(scored: DataFrame, threshold: float = THRESHOLDS["score"], by: list[str] | None = None) -> DataFrame:
    """Stores, stores at or above the threshold, and their share."""
    at = F.col("score") >= threshold
    counts = scored.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("stores"), F.count_if(at).alias("at_threshold"))
    return counts.withColumn("share_at_threshold", values.ratio(F.col("at_threshold"), F.col("stores")))
