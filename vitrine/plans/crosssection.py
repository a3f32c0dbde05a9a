"""The evaluation job: a scored scan against the label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.operators import evaluation, score
from vitrine.session import materialize


def scan_of(features: DataFrame, scan_date: str | None = None) -> DataFrame:
    """Feature rows of one scan, the latest when no date is asked for; of several panel versions on a day the greatest."""
    day = F.lit(scan_date).cast("date") if scan_date is not None else features.agg(F.max("scan_date")).scalar()
    found = features.where(F.col("scan_date") == day)
    if "panel_version" not in features.columns:
        return found
    return found.where(F.col("panel_version") == found.agg(F.max("panel_version")).scalar())


def run_crosssection(
    features: DataFrame,
    positives: DataFrame,
    negatives: DataFrame,
    threshold: float = score.THRESHOLDS["score"],
    scan_date: str | None = None,
    resamples: int = evaluation.BOOTSTRAP_RESAMPLES,
) -> tuple[DataFrame, DataFrame]:
    """(score table, metric rows). With no scan or one class missing, the metrics are the class counts alone.

    The labelled rows are written to the shared folder once; every metric reads that narrow table.
    """
    labelled = evaluation.scored_labels(positives, negatives, scan_of(features, scan_date))
    inputs = [c for c in evaluation.NUMERIC_FEATURES if c in labelled.columns]
    rows = materialize(labelled.select("domain", "y", "score", *inputs), "scored_labels")
    spark = features.sparkSession
    table = evaluation.score_table(rows)
    classes = evaluation.base_rate(rows).first()
    metrics: dict[str, object] = {"positives": classes.positives, "negatives": classes.negatives}
    if not classes.positives or not classes.negatives:
        return table, evaluation.metric_rows(spark, metrics)
    metrics["base_rate"] = classes.base_rate
    metrics["auc"] = evaluation.auc(rows).first()["auc"]
    interval = evaluation.bootstrap_interval(rows, "domain", resamples=resamples).first()
    metrics["ci_low"], metrics["ci_high"] = interval.ci_low, interval.ci_high
    top = evaluation.precision_recall_top(rows, "domain").first()
    metrics["precision_top_decile"], metrics["recall_top_decile"] = top.precision, top.recall
    at = evaluation.precision_recall_at(rows, threshold).first()
    metrics["precision_at_threshold"], metrics["recall_at_threshold"], metrics["flagged"] = at.precision, at.recall, at.flagged
    for r in evaluation.single_feature_aucs(rows, ["product_count", "workaround_app_count"]).collect():
        metrics[f"auc_{r.feature}"] = r.auc
    for r in evaluation.size_bucket_aucs(rows, "product_count").collect():
        metrics[f"auc_{r.name}"] = r.auc
    diagnostic = evaluation.logistic_diagnostic(rows, "domain", inputs)
    metrics.update({f"logistic_{k}" if k != "coefficients" else "coefficient": v for k, v in diagnostic.items()})
    return table, evaluation.metric_rows(spark, metrics)
