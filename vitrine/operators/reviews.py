"""Review-count readings per vendor, taken only from text and addresses that a page literally contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import values
from vitrine.operators import extraction
from vitrine.sources.dictionaries import ReviewVendor

# How a count was read.
METHOD_HTML = "html_widget"
METHOD_ENDPOINT = "json_endpoint_referenced_in_page"
METHOD_NONE = "not_available"
NO_VENDOR = "none"


def count_in(text: Column, patterns: tuple[str, ...], lowered: Column | None = None) -> Column:
    """First pattern that yields a number, in pattern order; NULL when none does."""
    low = F.lower(text) if lowered is None else lowered
    tries = [
        F.when(values.may_match(low, p), values.digit_count(F.regexp_extract(text, f"(?i){p}", 1))) for p in patterns
    ]
    return F.coalesce(*tries) if tries else F.lit(None).cast("bigint")


def _detected(vendor: ReviewVendor, hosts: Column, html: Column, lowered: Column) -> Column:
    def seen(pattern: str) -> Column:
        on_host = F.exists(hosts, lambda h: h.rlike(f"(?i){pattern}"))
        return (values.may_match(lowered, pattern) & html.rlike(f"(?i){pattern}")) | on_host

    out = F.lit(False)
    for p in vendor.detect:
        out = out | F.coalesce(seen(p), F.lit(False))
    return out


def _endpoint(vendor: ReviewVendor, html: Column) -> Column:
    """The full literal endpoint address in the page, NULL when the match is not a complete http address."""
    if not vendor.endpoint:
        return F.lit(None).cast("string")
    found = F.regexp_extract(html, f"(?i){vendor.endpoint}", 0)
    return F.when(found.startswith("http"), found)


READING = "array<struct<vendor:string,detected:boolean,review_count:bigint,endpoint:string>>"


def page_readings(vendors: list[ReviewVendor], lowered: str = "html_lower") -> Column:
    """What one extracted page, carrying its lower-cased text, says about each vendor; silent vendors are left out."""
    low = F.col(lowered)
    hosts = F.transform(extraction.asset_urls(F.col("script_srcs"), F.col("link_hrefs")), lambda a: a["host"])
    readings = [
        F.struct(
            F.lit(v.vendor).alias("vendor"),
            _detected(v, hosts, F.col("html"), low).alias("detected"),
            count_in(F.col("html"), v.count, low).alias("review_count"),
            _endpoint(v, F.col("html")).alias("endpoint"),
        )
        for v in vendors
    ]
    useful = F.filter(
        F.array(*readings), lambda r: r["detected"] | r["review_count"].isNotNull() | r["endpoint"].isNotNull()
    )
    return useful.cast(READING)


def read_reviews(
    extracted: DataFrame,
    vendors: list[ReviewVendor],
    keys: list[str],
    responses: DataFrame | None = None,
    page_ord: str = "page_ord",
) -> DataFrame:
    """Readings per store over extracted pages; see `store_readings`."""
    shaped = extracted.withColumn("html_lower", F.lower("html")).withColumn("_readings", page_readings(vendors))
    return store_readings(shaped, "_readings", vendors, keys, responses, page_ord)


def store_readings(
    pages: DataFrame,
    readings: str,
    vendors: list[ReviewVendor],
    keys: list[str],
    responses: DataFrame | None = None,
    page_ord: str = "page_ord",
) -> DataFrame:
    """One reading per detected vendor and store, or a single `none` reading: keys, vendor, review_count, source_url, method.

    The count is the first one found in page order. Where pages show none, the first literal endpoint
    address is looked up in `responses` (url, status, body), the archived answers; nothing is fetched.
    """
    rows = pages.select(*keys, page_ord, "url", F.explode_outer(readings).alias("r"))
    grouped = rows.groupBy(*keys, F.col("r.vendor").alias("vendor")).agg(
        F.bool_or(F.coalesce("r.detected", F.lit(False))).alias("detected"),
        F.min_by(
            F.when(F.col("r.review_count").isNotNull(), F.struct("r.review_count", "url")),
            F.when(F.col("r.review_count").isNotNull(), F.col(page_ord)),
        ).alias("read"),
        F.min_by("r.endpoint", F.when(F.col("r.endpoint").isNotNull(), F.col(page_ord))).alias("endpoint"),
    )
    found = grouped.where("detected").select(*keys, "vendor", "read", "endpoint")

    if responses is not None and any(v.endpoint for v in vendors):
        answers = responses.where((F.col("status") == 200) & F.col("body").isNotNull()).select(
            F.col("url").alias("endpoint"), "body"
        )
        wanted = found.where(F.col("read").isNull() & F.col("endpoint").isNotNull()).select("endpoint").distinct()
        bodies = answers.join(wanted, "endpoint", "left_semi")
        counted = bodies.groupBy("endpoint").agg(F.first("body").alias("body")).select(
            "endpoint", *[count_in(F.col("body"), v.count).alias(f"_n_{i}") for i, v in enumerate(vendors)]
        )
        joined = found.join(counted, "endpoint", "left")
        answered = F.coalesce(*[F.when(F.col("vendor") == v.vendor, F.col(f"_n_{i}")) for i, v in enumerate(vendors)])
        final = joined.withColumn("_answer", F.when(F.col("read").isNull(), answered))
    else:
        final = found.withColumn("_answer", F.lit(None).cast("bigint"))

    read = final.select(
        *keys,
        "vendor",
        F.coalesce("read.review_count", "_answer").alias("review_count"),
        F.coalesce("read.url", F.when(F.col("_answer").isNotNull(), F.col("endpoint"))).alias("source_url"),
        F.when(F.col("read").isNotNull(), METHOD_HTML)
        .when(F.col("_answer").isNotNull(), METHOD_ENDPOINT)
        .otherwise(METHOD_NONE)
        .alias("method"),
    )
    stores = grouped.groupBy(*keys).agg(F.bool_or("detected").alias("any_vendor"))
    empty = stores.where(~F.col("any_vendor")).select(
        *keys,
        F.lit(NO_VENDOR).alias("vendor"),
        F.lit(None).cast("bigint").alias("review_count"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(METHOD_NONE).alias("method"),
    )
    return read.unionByName(empty)


def rollup(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Largest count over vendors, number of vendors, any-vendor flag."""
    seen = F.when(F.col("vendor") != NO_VENDOR, F.col("vendor"))
    return (
        readings.groupBy(*keys)
        .agg(F.max("review_count").alias("review_count_max"), F.count_distinct(seen).alias("review_vendor_count"))
        .withColumn("has_reviews_vendor", (F.col("review_vendor_count") > 0).cast("int"))
    )
