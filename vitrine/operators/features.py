"""The feature row of a store and scan: app counts, catalog growth, reviews, page facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.functions import values
from vitrine.operators import reviews

# Capability flags of the feature row. `staff_permissions` counts but has no flag.
CAPABILITY_FLAGS = {
    "b2b_wholesale": "workaround_b2b",
    "multistore_sync": "workaround_multistore",
    "launch_scheduling": "workaround_launch",
    "discount_logic": "workaround_discount",
    "sso_login": "workaround_sso",
    "international_markets": "workaround_intl",
}
UNCOUNTED_CAPABILITY = "checkout_customization"
VERIFIED_CAPABILITIES = [*CAPABILITY_FLAGS, "staff_permissions"]


def app_features(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct apps and capabilities, verified matches, flags, and per capability whether any match is verified.

    One aggregation; the map is built from a fixed set of per-capability results, never from gathered rows.
    """
    counted = matches.where(~F.coalesce(F.col("capability") == UNCOUNTED_CAPABILITY, F.lit(False)))
    capability = F.col("capability")
    intl = capability == "international_markets"
    grouped = counted.groupBy(*keys).agg(
        F.count_distinct("key").alias("workaround_app_count"),
        F.count_distinct(F.when(intl, F.col("key"))).alias("workaround_intl_app_count"),
        F.count_if("verified").alias("workaround_verified_count"),
        *[F.bool_or(F.when(capability == c, F.col("verified"))).alias(f"_v_{c}") for c in VERIFIED_CAPABILITIES],
    )
    seen = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_v_{c}").isNotNull(), F.struct(F.lit(c).alias("key"), F.col(f"_v_{c}").alias("value")))
                for c in VERIFIED_CAPABILITIES
            ]
        )
    )
    return grouped.select(
        *keys,
        "workaround_app_count",
        F.size(seen).cast("long").alias("workaround_capability_count"),
        *[F.col(f"_v_{c}").isNotNull().cast("int").alias(flag) for c, flag in CAPABILITY_FLAGS.items()],
        "workaround_intl_app_count",
        "workaround_verified_count",
        F.map_from_entries(seen).alias("capability_verified"),
    )


def catalog_features(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog columns of the feature row; all NULL when the feed is unavailable."""
    has = F.coalesce("products_json_available", F.lit(False))
    growth = values.growth(F.col("products_created_last_365d"), F.col("products_created_prior_365d"))
    picks = {
        "product_count": F.col("product_count"),
        "catalog_growth_yoy": growth,
        "products_last_90d": F.col("products_created_last_90d"),
        "variant_count": F.col("variant_count"),
        "vendor_count": F.col("vendor_count"),
        "available_share": F.col("available_share"),
        "median_price": F.col("median_price"),
    }
    return catalog.select(
        *keys, *[F.when(has, c).alias(n) for n, c in picks.items()], has.cast("int").alias("products_json_available")
    )


def build_features(stores: DataFrame, matches: DataFrame, catalog: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """One feature row per scanned store. `stores` holds the keys, hreflang_alt_count and theme_name.

    Fingerprints are not an input. All four sides are already one row per key, so the joins move
    store-level rows only.
    """
    joined = (
        stores.join(app_features(matches, keys), keys, "left")
        .join(catalog_features(catalog, keys), keys, "left")
        .join(reviews.rollup(readings, keys), keys, "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        *keys,
        zero("workaround_app_count"),
        zero("workaround_capability_count"),
        *[zero(flag) for flag in CAPABILITY_FLAGS.values()],
        zero("workaround_intl_app_count"),
        zero("workaround_verified_count"),
        F.coalesce("capability_verified", F.create_map().cast("map<string,boolean>")).alias("capability_verified"),
        "product_count",
        "catalog_growth_yoy",
        "products_last_90d",
        "variant_count",
        "vendor_count",
        "available_share",
        "median_price",
        "review_count_max",
        zero("review_vendor_count"),
        zero("has_reviews_vendor"),
        zero("hreflang_alt_count"),
        "theme_name",
        zero("products_json_available"),
    )


def leaked_names(features: DataFrame, fingerprint_keys: list[str]) -> list[str]:
    """Fingerprint keys that appear among the feature columns (nested ones too); must be empty."""
    from pyspark.sql import types as T

    def names(t: T.DataType) -> list[str]:
        if isinstance(t, T.StructType):
            return [f.name for f in t.fields] + [n for f in t.fields for n in names(f.dataType)]
        if isinstance(t, T.ArrayType):
            return names(t.elementType)
        if isinstance(t, T.MapType):
            return names(t.valueType)
        return []

    return sorted(set(names(features.schema)) & set(fingerprint_keys))
