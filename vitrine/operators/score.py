"""The transparent additive score: nine components, each with its contribution, weight and reason."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# Published weights and thresholds.
WEIGHTS = {
    "workaround_b2b": 3.0,
    "workaround_multistore": 3.0,
    "workaround_launch": 1.0,
    "workaround_discount": 1.5,
    "workaround_sso": 1.5,
    "workaround_intl": 1.0,
    "high_growth": 2.0,
    "large_catalog": 1.0,
    "review_scale_1k": 1.0,
    "review_scale_5k": 2.0,
}
THRESHOLDS = {
    "score": 3.0,
    "high_growth_yoy": 0.5,
    "high_growth_last_90d": 20,
    "large_catalog_products": 500,
    "review_scale_1k": 1000,
    "review_scale_5k": 5000,
    "intl_min_apps": 2,
}
NOTE_NULL = "null_input"
NOTE_UNVERIFIED = "unverified_half_weight"

CAPABILITY_COMPONENTS = {
    "workaround_b2b": "b2b_wholesale",
    "workaround_multistore": "multistore_sync",
    "workaround_launch": "launch_scheduling",
    "workaround_discount": "discount_logic",
    "workaround_sso": "sso_login",
    "workaround_intl": "international_markets",
}
COMPONENTS = [*CAPABILITY_COMPONENTS, "high_growth", "large_catalog", "review_scale"]


@dataclass(frozen=True)
class ScoreSettings:
    """Weights and thresholds; a weight left out counts 0, except the two review steps."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    unverified_multiplier: float = 0.5

    def weight(self, name: str, default: float = 0.0) -> float:
        return float(self.weights.get(name, default))

    def threshold(self, name: str) -> float:
        return float(self.thresholds.get(name, THRESHOLDS[name]))


def _component(active: Column, weight: Column | float, multiplier: float, verified: Column | None = None, note: Column | None = None) -> Column:
    weight = F.lit(weight) if isinstance(weight, float) else weight
    halved = active & (verified == F.lit(False)) if verified is not None else F.lit(False)
    halved = F.coalesce(halved, F.lit(False))
    return F.struct(
        F.when(halved, weight * multiplier).when(active, weight).otherwise(0.0).alias("contribution"),
        weight.alias("weight"),
        active.alias("active"),
        (verified if verified is not None else F.lit(None).cast("boolean")).alias("verified"),
        F.when(halved, NOTE_UNVERIFIED).otherwise(note if note is not None else F.lit(None).cast("string")).alias("note"),
    )


def components(settings: ScoreSettings = ScoreSettings()) -> dict[str, Column]:
    """The nine components as struct columns over the feature columns."""
    half = settings.unverified_multiplier
    out: dict[str, Column] = {}
    for name, capability in CAPABILITY_COMPONENTS.items():
        active = F.coalesce(F.col(name) == 1, F.lit(False))
        if name == "workaround_intl":
            apps = F.coalesce(F.col("workaround_intl_app_count"), F.lit(0))
            active = active & (apps >= int(settings.threshold("intl_min_apps")))
        verified = F.when(active, F.element_at("capability_verified", F.lit(capability)))
        out[name] = _component(active, settings.weight(name), half, verified)

    growth, recent = F.col("catalog_growth_yoy"), F.col("products_last_90d")
    fast = (growth >= settings.threshold("high_growth_yoy")) & (recent >= settings.threshold("high_growth_last_90d"))
    unknown = growth.isNull() | recent.isNull()
    out["high_growth"] = _component(
        ~unknown & F.coalesce(fast, F.lit(False)), settings.weight("high_growth"), half, note=F.when(unknown, NOTE_NULL)
    )
    products = F.col("product_count")
    large = F.coalesce(products >= settings.threshold("large_catalog_products"), F.lit(False))
    out["large_catalog"] = _component(large, settings.weight("large_catalog"), half, note=F.when(products.isNull(), NOTE_NULL))

    reviews = F.col("review_count_max")
    at_5k = F.coalesce(reviews >= settings.threshold("review_scale_5k"), F.lit(False))
    at_1k = F.coalesce(reviews >= settings.threshold("review_scale_1k"), F.lit(False))
    # Without a count the stated weight is the larger step (0 when not configured); a small count states the smaller step.
    weight = (
        F.when(reviews.isNull(), settings.weight("review_scale_5k"))
        .when(at_5k, settings.weight("review_scale_5k", 2.0))
        .otherwise(settings.weight("review_scale_1k", 1.0))
    )
    out["review_scale"] = _component(at_5k | at_1k, weight, half, note=F.when(reviews.isNull(), NOTE_NULL))
    return out


def with_score(features: DataFrame, settings: ScoreSettings = ScoreSettings()) -> DataFrame:
    """Add `components` (a struct of nine component structs) and `score`, their sum."""
    parts = components(settings)
    nested = features.withColumn("components", F.struct(*[c.alias(n) for n, c in parts.items()]))
    total = sum((F.col(f"components.{n}.contribution") for n in COMPONENTS[1:]), F.col(f"components.{COMPONENTS[0]}.contribution"))
    return nested.withColumn("score", total)


def component_rows(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per store and component: keys, component, contribution, weight, active, verified, note."""
    listed = F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"components.{n}").alias("c")) for n in COMPONENTS])
    return scored.select(*keys, F.explode(listed).alias("r")).select(*keys, "r.component", "r.c.*")


def broken_totals(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose components do not add up to the total; must be empty."""
    parts = component_rows(scored, keys).groupBy(*keys).agg(F.sum("contribution").alias("parts"))
    return scored.select(*keys, "score").join(parts, keys).where(F.abs(F.col("score") - F.col("parts")) > 1e-9)
