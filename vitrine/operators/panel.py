"""The frozen stratified panel: eligibility, size strata, seeded selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitrine.functions import values
from vitrine.operators import ordering

PANEL_SEED = 7
PANEL_SIZE = 750
_SALTS = 64


def eligible(stores: DataFrame, catalog: DataFrame, positives: DataFrame, fingerprinted: DataFrame) -> DataFrame:
    """Platform stores with an available feed at the scan, not labelled positive and without any fingerprint.

    Returns (domain, product_count).
    """
    on_platform = stores.where(F.col("is_platform")).select("domain")
    with_feed = catalog.where(F.col("products_json_available")).select("domain", "product_count")
    return (
        on_platform.join(with_feed, "domain")
        .join(positives.select("domain"), "domain", "left_anti")
        .join(fingerprinted.select("domain"), "domain", "left_anti")
    )


def stratum_edges(candidates: DataFrame, size: str = "product_count") -> DataFrame:
    """One row (n, q1, q2, q3): sizes at positions n//4, n//2 and 3n//4 of the sorted known sizes."""
    n = F.col("n")
    at = {"q1": (0.25, F.floor(n / 4)), "q2": (0.5, F.floor(n / 2)), "q3": (0.75, F.floor(n * 3 / 4))}
    return ordering.value_at_positions(candidates, size, at)


def with_stratum(candidates: DataFrame, size: str = "product_count") -> DataFrame:
    """Add `stratum` 0 to 3 by size; an edge value goes down, an unknown size to 0. All 0 with fewer than four known sizes."""
    edges = stratum_edges(candidates, size).select(F.struct("n", "q1", "q2", "q3").alias("e"))
    with_edges = candidates.withColumn("_e", edges.scalar())
    value = F.col(size)
    stratum = (
        F.when((F.coalesce("_e.n", F.lit(0)) < 4) | value.isNull() | (value <= F.col("_e.q1")), 0)
        .when(value <= F.col("_e.q2"), 1)
        .when(value <= F.col("_e.q3"), 2)
        .otherwise(3)
    )
    return with_edges.withColumn("stratum", stratum).drop("_e")


def select_panel(
    candidates: DataFrame,
    size: int = PANEL_SIZE,
    seed: int = PANEL_SEED,
    key: str = "domain",
    size_column: str = "product_count",
) -> DataFrame:
    """`size` stores: the first max(1, size // 4) of each stratum in seeded order, topped up from the rest.

    Ranking runs per (stratum, salt) first and only the leaders meet per stratum, so no task orders a
    whole stratum. Returns (key, size_column, stratum, place) with `place` 1 to `size`.
    """
    strata = with_stratum(candidates, size_column).select(key, size_column, "stratum")
    hashed = strata.withColumn("_hash", values.seeded_order(seed, F.col(key)))
    per_stratum = max(1, size // 4)
    salted = hashed.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(_SALTS)))
    first_round = F.row_number().over(Window.partitionBy("stratum", "_salt").orderBy("_hash"))
    leaders = salted.withColumn("_r", first_round).where(F.col("_r") <= size)
    # At most _SALTS * size rows per stratum from here on.
    in_stratum = F.row_number().over(Window.partitionBy("stratum").orderBy("_hash"))
    ranked = leaders.withColumn("_in_stratum", in_stratum).where(F.col("_in_stratum") <= size)
    chosen_first = (F.col("_in_stratum") > per_stratum).cast("int")
    # Stratified picks come first in stratum order, then the remainder in seeded order: at most 4 * size rows.
    order = [chosen_first, F.when(chosen_first == 0, F.col("stratum")), F.col("_hash")]
    place = F.row_number().over(Window.orderBy(*order))
    return ranked.withColumn("place", place).where(F.col("place") <= size).select(key, size_column, "stratum", "place")
