"""Nearest-date (as-of) lookup within a tolerance.

Facts are first reduced to one row per key and day, which keeps the answer and removes any pile-up: a key
then has at most one row per calendar day. The range join runs on (key, month bucket), where a target
looks into the few buckets its tolerance reaches, so no task sees all days of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _month_number(day):
    return F.year(day) * 12 + F.month(day)


def nearest(
    targets: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    target_day: str,
    fact_day: str,
    fact_order: str,
    tolerance_days: int,
) -> DataFrame:
    """Add to each target the `fact_order` value of the nearest fact and its `distance` in days; NULL when none is near.

    Distances up to and including the tolerance count; of equally near facts the smallest `fact_order` wins.
    """
    keys = list(keys)
    daily = (
        facts.where(F.col(fact_day).isNotNull())
        .groupBy(*keys, F.col(fact_day).alias("_fact_day"))
        .agg(F.min(fact_order).alias("_fact"))
        .withColumn("_bucket", _month_number(F.col("_fact_day")))
    )
    wanted = targets.select(*keys, target_day).distinct()
    reach = F.sequence(
        _month_number(F.date_sub(target_day, tolerance_days)), _month_number(F.date_add(target_day, tolerance_days))
    )
    spread = wanted.where(F.col(target_day).isNotNull()).withColumn("_bucket", F.explode(reach))
    distance = F.abs(F.date_diff(F.col("_fact_day"), F.col(target_day)))
    near = spread.join(daily, [*keys, "_bucket"]).withColumn("distance", distance).where(F.col("distance") <= tolerance_days)
    best = near.groupBy(*keys, target_day).agg(F.min(F.struct("distance", "_fact")).alias("_best"))
    return targets.join(
        best.select(*keys, target_day, F.col("_best._fact").alias(fact_order), F.col("_best.distance").alias("distance")),
        [*keys, target_day],
        "left",
    )
