"""Product-feed pages to catalog aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import dates, values
from vitrine.operators import ordering
from vitrine.session import materialize

UNAVAILABLE = "not_available"


PRODUCTS = "array<struct<created_at:string,vendor:string,variants:array<struct<price:string,available:variant>>>>"


def parse_feed(pages: DataFrame) -> DataFrame:
    """Read feed bodies without failing: adds `listed`, the page's product entries (NULL for a bad page), and `products`.

    Bad is a skipped page, any status but 200, text that is no JSON, or JSON without a product list. Entries
    that are no objects count as listed but carry no product.
    """
    ok = (F.col("status") == 200) & F.col("skip_reason").isNull() & F.col("body").isNotNull()
    parsed = pages.withColumn("_payload", F.when(ok, F.try_parse_json("body")))
    typed = F.try_variant_get("_payload", "$.products", PRODUCTS)

    def variant(v: Column) -> Column:
        """A present `available` counts by its kind: text unless empty, numbers unless zero, null never; an absent one is skipped."""
        stated = v["available"]
        kind = F.schema_of_variant(stated)
        truth = (
            F.when(F.is_variant_null(stated), False)
            .when(kind == "BOOLEAN", F.try_variant_get(stated, "$", "boolean"))
            .when(kind == "STRING", F.try_variant_get(stated, "$", "string") != "")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(stated).isin("[]", "{}"))
            .otherwise(F.coalesce(F.try_variant_get(stated, "$", "double") != 0, F.lit(True)))
        )
        return F.struct(v["price"].alias("price"), F.when(stated.isNotNull(), truth).alias("available"))

    def product(p: Column) -> Column:
        variants = F.transform(F.filter(p["variants"], lambda v: v.isNotNull()), variant)
        return F.struct(p["created_at"].alias("created_at"), p["vendor"].alias("vendor"), variants.alias("variants"))

    return (
        parsed.withColumn("_typed", typed)
        .withColumn("listed", F.when(F.col("_typed").isNotNull(), F.size("_typed")))
        .withColumn("products", F.transform(F.filter("_typed", lambda p: p.isNotNull()), product))
        .drop("_payload", "_typed")
    )


#: More pages than any feed has.
MANY_PAGES = 1 << 40


def walk(parsed: DataFrame, keys: list[str], max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Follow each store's feed from page 1 until a bad page, an empty page or, if given, `max_pages`.

    Returns (summary, pages kept). The summary has products_json_available, skip_reason, pages_fetched and
    truncated: a bad first page makes the feed unavailable; a later bad page or a full last page truncates
    it; an empty page ends it and counts as fetched. A missing page number counts as a bad page.
    """
    last = MANY_PAGES if max_pages is None else max_pages
    numbered = parsed.where((F.col("page") >= 1) & (F.col("page") <= last)).select(
        *keys, F.col("page").cast("long").alias("page"), "skip_reason", "products", F.coalesce("listed", F.lit(-1)).alias("listed")
    )
    page = F.col("page")
    ends = numbered.groupBy(*keys).agg(
        F.min(F.when(F.col("listed") < 1, page)).alias("stop"),
        F.min_by("listed", F.when(F.col("listed") < 1, page)).alias("stop_listed"),
        F.min_by("skip_reason", F.when(F.col("listed") < 1, page)).alias("stop_reason"),
        F.array_sort(F.collect_set("page")).alias("have"),
    )
    # Sorted page numbers equal their place up to the first missing one.
    gap = F.size(F.filter("have", lambda p, i: p == i + 1)) + 1
    none = F.lit(last + 1)
    at = ends.withColumn("gap", gap.cast("long")).withColumn("stop_at", F.least(F.coalesce("stop", none), "gap"))
    by_gap = F.col("gap") < F.coalesce("stop", none)
    full = F.col("stop_at") > last
    empty_end = ~by_gap & (F.col("stop_listed") == 0)
    summary = at.select(
        *keys,
        "stop_at",
        ((F.col("stop_at") > 1) | F.coalesce(empty_end, F.lit(False))).alias("products_json_available"),
        F.when(
            (F.col("stop_at") == 1) & ~F.coalesce(empty_end, F.lit(False)),
            F.coalesce(F.when(~by_gap, F.col("stop_reason")), F.lit(UNAVAILABLE)),
        ).alias("skip_reason"),
        (F.col("stop_at") - 1 + F.when(empty_end & ~full, 1).otherwise(0)).cast("long").alias("pages_fetched"),
        (full | ~F.coalesce(empty_end, F.lit(False))).alias("truncated"),
    )
    available = F.col("products_json_available")
    shaped = summary.select(
        *keys,
        "products_json_available",
        "skip_reason",
        F.when(available, F.col("pages_fetched")).alias("pages_fetched"),
        F.when(available, F.col("truncated")).alias("truncated"),
        "stop_at",
    )
    kept = numbered.join(shaped.where(available).select(*keys, "stop_at"), keys).where(page < F.col("stop_at"))
    return shaped.drop("stop_at"), kept.select(*keys, "page", "products")


def products_of(kept_pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per product: keys, created_at, vendor, variants."""
    return kept_pages.select(*keys, F.explode("products").alias("p")).select(*keys, "p.*")


def windows(created: Column, scan_date: Column) -> list[Column]:
    """Counts of products created in the last 90 and 365 days and in the 365 days before; no upper bound on dates."""
    d90, d365, d730 = (F.date_sub(scan_date, n) for n in (90, 365, 730))
    return [
        F.count_if(created >= d90).alias("products_created_last_90d"),
        F.count_if(created >= d365).alias("products_created_last_365d"),
        F.count_if((created >= d730) & (created < d365)).alias("products_created_prior_365d"),
    ]


def product_aggregates(products: DataFrame, keys: list[str], scan_date: Column) -> DataFrame:
    """Count, first and last creation day, window counts and distinct vendors per store."""
    dated = products.withColumn("_created", dates.iso_day(F.col("created_at")))
    created = F.col("_created")
    return dated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("product_count"),
        F.min(created).alias("earliest_created_at"),
        F.max(created).alias("latest_created_at"),
        *windows(created, scan_date),
        F.count_distinct(F.nullif("vendor", F.lit(""))).alias("vendor_count"),
    )


def variant_aggregates(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Variant count, share available among variants that say so, exact median price: from (keys, price, available)."""
    priced = variants.withColumn("_price", values.price(F.col("price").cast("string")))
    shares = [F.count(F.lit(1)).alias("variant_count"), F.avg(F.col("available").cast("int")).alias("available_share")]
    medians = ordering.exact_percentiles(priced, "_price", {"median_price": 0.5}, keys)
    return priced.groupBy(*keys).agg(*shares).join(medians, keys, "left")


CATALOG_FIELDS = (
    "product_count",
    "earliest_created_at",
    "latest_created_at",
    "products_created_last_90d",
    "products_created_last_365d",
    "products_created_prior_365d",
    "variant_count",
    "vendor_count",
    "available_share",
    "median_price",
)


def catalog_snapshots(feed_pages: DataFrame, keys: list[str], scan_date: str = "scan_date", max_pages: int | None = None) -> DataFrame:
    """Feed pages to one catalog row per store and scan. Bodies are parsed once, into a table in the shared folder.

    Every aggregate is NULL when the feed is unavailable; an available feed without products counts 0.
    The currency is never stated by the feed and stays NULL.
    """
    slim = parse_feed(feed_pages).select(*keys, "page", "skip_reason", "listed", "products")
    summary, kept = walk(materialize(slim, "feed_pages"), keys, max_pages)
    products = products_of(kept, keys)
    by_product = product_aggregates(products, keys, F.col(scan_date))
    variants = products.select(*keys, F.explode("variants").alias("v")).select(*keys, "v.price", "v.available")
    by_variant = variant_aggregates(variants, keys)
    joined = summary.join(by_product, keys, "left").join(by_variant, keys, "left")
    counts = {"product_count", "products_created_last_90d", "products_created_last_365d", "products_created_prior_365d", "variant_count", "vendor_count"}
    return joined.select(
        *keys,
        "products_json_available",
        "skip_reason",
        "pages_fetched",
        "truncated",
        *[
            (F.when(F.col("products_json_available"), F.coalesce(c, F.lit(0))) if c in counts else F.col(c)).alias(c)
            for c in CATALOG_FIELDS
        ],
        F.lit(None).cast("string").alias("currency"),
    )
