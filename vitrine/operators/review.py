"""Tabulation of a hand-reviewed export of flagged negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The reviewer's vocabulary.
CATEGORIES = [
    "legitimate_ceiling_case",
    "possibly_plus_mislabeled",
    "volume_only_legit",
    "volume_only_dropship",
    "new_store_zero_base",
    "score_zero_not_flagged",
    "unknown",
]
NOT_FLAGGED = "score_zero_not_flagged"


def unknown_categories(reviewed: DataFrame) -> DataFrame:
    """Categories outside the vocabulary, with the number of rows that use them."""
    named = reviewed.select(F.trim(F.coalesce("reviewer_category", F.lit(""))).alias("category"))
    return named.where(~F.col("category").isin(CATEGORIES)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def tabulate(reviewed: DataFrame, categories: list[str] = CATEGORIES, excluded: str = NOT_FLAGGED) -> DataFrame:
    """Per category: rows, flagged rows (score above 0), and the share of flagged rows; every category is listed.

    The share's denominator leaves out the excluded category, whose own share is NULL; it is 0 when the
    denominator is 0.
    """
    spark = reviewed.sparkSession
    vocabulary = spark.createDataFrame([(c,) for c in categories], "category string")
    counts = reviewed.groupBy(F.trim("reviewer_category").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("flagged")
    )
    listed = vocabulary.join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flagged", F.lit(0)).alias("flagged")
    )
    denominator = listed.where(F.col("category") != excluded).agg(F.sum("flagged")).scalar()
    share = F.coalesce(F.try_divide(F.col("flagged").cast("double"), denominator.cast("double")), F.lit(0.0))
    return listed.withColumn("flagged_share", F.when(F.col("category") != excluded, share))
