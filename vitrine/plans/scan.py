"""The scan job: archived pages and product feeds to matches, catalog, reviews, features and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from vitrine.operators import catalog, extraction, features, intake, matching, reviews, score
from vitrine.session import materialize, spread
from vitrine.sinks import tables
from vitrine.sources.dictionaries import Dictionaries, load_all

KEYS = ["domain", "scan_date", "panel_version"]


@dataclass
class ScanTables:
    """The tables one scan produces, all lazy until written."""

    stores: DataFrame
    outcomes: DataFrame
    assets: DataFrame
    app_matches: DataFrame
    fingerprint_matches: DataFrame
    catalog_snapshots: DataFrame
    review_snapshots: DataFrame
    features: DataFrame


def page_facts(pages: DataFrame, known: Dictionaries) -> DataFrame:
    """Everything the scan needs from a page, read in one pass over its HTML; the HTML itself is left behind."""
    good = pages.where(intake.usable(F.col("status"), F.col("html")) & F.col("skip_reason").isNull())
    seen = matching.with_lower(extraction.with_verdict(extraction.extract(spread(good))))
    link = extraction.collection_link(F.col("anchors"), F.col("url"))
    return seen.select(
        *KEYS,
        "page_ord",
        "page_role",
        "url",
        "script_srcs",
        "link_hrefs",
        "meta",
        "platform_domain",
        "theme_name",
        "evidence",
        "is_platform",
        F.size("hreflang_alternates").cast("long").alias("hreflang_alt_count"),
        link["branch"].alias("collection_branch"),
        extraction.external_hosts(F.col("hreflang_alternates"), F.col("domain")).alias("external_hosts"),
        matching.page_hits(known.apps).alias("app_hits"),
        matching.page_hits(known.fingerprints).alias("fingerprint_hits"),
        reviews.page_readings(known.vendors).alias("readings"),
    )


def store_verdicts(facts: DataFrame) -> DataFrame:
    """One row per store and scan from its home page: is_platform, platform_domain, evidence, theme, link branch."""
    homes = facts.where(F.col("page_role") == "home")
    kept = F.struct(
        "is_platform",
        "platform_domain",
        F.array_join("evidence", "; ").alias("evidence"),
        "theme_name",
        "hreflang_alt_count",
        "collection_branch",
    )
    return homes.groupBy(*KEYS).agg(F.min_by(kept, "page_ord").alias("f")).select(*KEYS, "f.*")


def build_scan(
    pages: DataFrame,
    feed_pages: DataFrame,
    dictionaries: Dictionaries | None = None,
    settings: score.ScoreSettings = score.ScoreSettings(),
    responses: DataFrame | None = None,
    max_pages: int | None = None,
) -> ScanTables:
    """Compose the scan. Stores that fail the platform verdict stop after it, as do stores without a home page.

    `pages` follows the pages schema plus panel_version; `feed_pages` has the keys, page, status,
    skip_reason and body. The page facts are written to the shared folder once; all page-level steps read
    them, so the HTML is scanned a single time.
    """
    known = dictionaries or load_all()
    facts = materialize(page_facts(pages, known), "page_facts")
    verdicts = store_verdicts(facts)
    on_platform = verdicts.where("is_platform").select(*KEYS)
    mine = facts.where(F.col("page_role").isin("home", "collection", "product")).join(on_platform, KEYS, "left_semi")

    apps = matching.first_matches(mine, "app_hits", KEYS)
    marks = matching.fingerprint_matches(mine, "fingerprint_hits", known.fingerprints, KEYS)
    readings = reviews.store_readings(mine, "readings", known.vendors, KEYS, responses)
    feed = feed_pages.join(on_platform, KEYS, "left_semi")
    snapshots = catalog.catalog_snapshots(feed, KEYS, max_pages=max_pages)
    stores = verdicts.where("is_platform").select(*KEYS, "hreflang_alt_count", "theme_name", "collection_branch")
    built = features.build_features(stores, apps, snapshots, readings, KEYS)
    marked = marks.groupBy(*KEYS).agg(F.lit(True).alias("fingerprint_any"))
    scored = (
        score.with_score(built, settings)
        .join(marked, KEYS, "left")
        .withColumn("fingerprint_any", F.coalesce("fingerprint_any", F.lit(False)))
        .join(stores.select(*KEYS, "collection_branch"), KEYS, "left")
    )
    homes = pages.where(F.col("page_role") == "home").groupBy(*KEYS).agg(
        F.min_by(F.struct("status", "skip_reason", F.when(F.col("html").isNotNull(), "").alias("html")), "page_ord").alias("h")
    ).select(*KEYS, "h.*")
    states = homes.join(verdicts.select(*KEYS, "is_platform"), KEYS, "left").withColumn("error", F.lit(None).cast("string"))
    return ScanTables(
        stores=verdicts,
        outcomes=intake.outcomes(states, KEYS),
        assets=extraction.asset_rows(mine, [*KEYS, "url"]),
        app_matches=apps,
        fingerprint_matches=marks,
        catalog_snapshots=snapshots,
        review_snapshots=readings,
        features=scored,
    )


def write_scan(built: ScanTables, warehouse: str) -> None:
    """Write every table of the scan, replacing the scan's own partitions only."""
    scans = [tuple(r) for r in built.outcomes.select("scan_date", "panel_version").distinct().collect()]
    for name, df in vars(built).items():
        tables.replace_scan(df, f"{warehouse.rstrip('/')}/{name}", scans=scans)
