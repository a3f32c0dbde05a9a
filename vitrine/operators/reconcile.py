"""Reconciliation of the index against disclosed company figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import dates, values

# Metric names of the disclosure table.
TOTAL_MRR = "total_mrr_usd_m"
PLUS_SHARE = "plus_share_of_mrr_pct"
ADVANCED_PRICE = "advanced_list_price_usd_monthly"
PLUS_PRICE = "plus_list_price_usd_monthly"
BASE = "selfserve_merchant_count"
REQUIRED = [TOTAL_MRR, PLUS_SHARE, ADVANCED_PRICE, PLUS_PRICE]


class ReconcileError(ValueError):
    """Disclosures are empty, unreadable or incomplete."""


def _first_listed(disclosures: DataFrame) -> Column:
    """Order that prefers the row listed first, where the table knows its file lines."""
    return -F.col("line") if "line" in disclosures.columns else -F.col("value")


def latest_by_metric(disclosures: DataFrame) -> DataFrame:
    """The row of the greatest quarter per metric; of repeated ones the first listed."""
    rest = ["quarter", "value", "unit", "source_url", "page_ref"]
    present = [c for c in rest if c in disclosures.columns]
    picked = disclosures.groupBy("metric").agg(
        F.max_by(F.struct(*present), F.struct("quarter", _first_listed(disclosures))).alias("r")
    )
    return picked.select("metric", "r.*")


def missing_metrics(disclosures: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Required metrics that no row discloses."""
    wanted = disclosures.sparkSession.createDataFrame([(m,) for m in required], "metric string")
    return wanted.join(disclosures.select("metric").distinct(), "metric", "left_anti")


def citations(disclosures: DataFrame) -> DataFrame:
    """Latest value per metric with its unit and where it was disclosed."""
    return latest_by_metric(disclosures).select(
        "metric",
        F.format_string(
            "%s %s (%s, %s, %s)", F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""), "unit", "quarter", "source_url", "page_ref"
        ).alias("citation"),
    )


def year_on_year(disclosures: DataFrame, metric: str) -> DataFrame:
    """Each quarter of a metric with the value of the same quarter a year before, NULL when not disclosed."""
    own = disclosures.where(F.col("metric") == metric).select("quarter", "value")
    prior = own.select(F.col("quarter").alias("prior_quarter"), F.col("value").alias("prior_value"))
    joined = own.withColumn("prior_quarter", dates.prior_year_quarter(F.col("quarter"))).join(prior, "prior_quarter", "left")
    return joined.select("quarter", "value", "prior_quarter", "prior_value")


def reconcile(disclosures: DataFrame, share_at_threshold: float | None = None, assumed_base: int | None = None) -> DataFrame:
    """One row: price delta, upgrades per percentage point, implied annual upgrades, flagged stores, required rate.

    The year-ago share is looked up at the quarter before the total's own quarter. A disclosed merchant
    base beats the assumed one. The required rate needs a positive number of flagged stores.
    """
    newest = latest_by_metric(disclosures)
    wide = newest.groupBy().agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in [*REQUIRED, BASE]],
        F.max(F.when(F.col("metric") == TOTAL_MRR, F.col("quarter"))).alias("quarter"),
    )
    ago = disclosures.where(F.col("metric") == PLUS_SHARE).groupBy("quarter").agg(
        F.max_by("value", _first_listed(disclosures)).alias("_share_ago")
    )
    dated = wide.withColumn("prior_quarter", dates.prior_year_quarter(F.col("quarter")))
    joined = dated.join(ago.withColumnRenamed("quarter", "prior_quarter"), "prior_quarter", "left")
    total = F.col(TOTAL_MRR) * 1_000_000
    delta = F.col(PLUS_PRICE) - F.col(ADVANCED_PRICE)
    base = F.coalesce(F.col(BASE).cast("bigint"), F.lit(assumed_base).cast("bigint"))
    first = joined.select(
        "prior_quarter",
        delta.alias("monthly_delta_usd"),
        F.try_divide(total * 0.01, delta).alias("upgrades_for_1pp_of_mrr"),
        F.try_divide((F.col(PLUS_SHARE) - F.col("_share_ago")) / 100 * total, delta).alias("implied_annual_upgrades"),
        (F.lit(share_at_threshold).cast("double") * base).alias("flagged_stores_implied"),
    )
    flagged = F.col("flagged_stores_implied")
    rate = F.when(flagged > 0, values.ratio(F.col("implied_annual_upgrades"), flagged))
    return first.withColumn("required_upgrade_rate_among_flagged", rate)


def checked_reconcile(disclosures: DataFrame, share_at_threshold: float | None = None, assumed_base: int | None = None) -> DataFrame:
    """`reconcile` after the completeness check; raises with the missing metrics named."""
    if disclosures.isEmpty():
        raise ReconcileError(f"no disclosures; required metrics: {', '.join(REQUIRED)}")
    missing = sorted(r.metric for r in missing_metrics(disclosures).collect())
    if missing:
        raise ReconcileError(f"missing required metrics: {', '.join(missing)}")
    return reconcile(disclosures, share_at_threshold, assumed_base)


def report_rows(summary: DataFrame) -> DataFrame:
    """(metric, value) rows of the reconciliation, undefined figures left out."""
    figures = [c for c in summary.columns if c != "prior_quarter"]
    return summary.select(figures).unpivot([], figures, "metric", "value").where(F.col("value").isNotNull())
