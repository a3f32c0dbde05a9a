"""Table schemas as DDL text, one per table of the data model. Keys are natural keys, never row ids."""

from __future__ import annotations

PAGES = (
    "domain string, scan_date date, page_ord long, page_role string, url string, status int, skip_reason string, "
    "headers map<string,string>, html string, fetched_at timestamp"
)

# Field order of a feature row; the map tells per capability whether a verified signature matched.
FEATURES = (
    "workaround_app_count long, workaround_capability_count long, workaround_b2b int, workaround_multistore int, "
    "workaround_launch int, workaround_discount int, workaround_sso int, workaround_intl int, "
    "workaround_intl_app_count long, workaround_verified_count long, capability_verified map<string,boolean>, "
    "product_count long, catalog_growth_yoy double, products_last_90d long, variant_count long, vendor_count long, "
    "available_share double, median_price double, review_count_max long, review_vendor_count long, "
    "has_reviews_vendor int, hreflang_alt_count long, theme_name string, products_json_available int"
)

ARCHIVE_INDEX = "domain string, timestamp string, status string, mimetype string, digest string"

POSTINGS = (
    "board string, company_slug string, external_id string, title string, description_text string, "
    "posted_at string, url string"
)

HIRING_POSTS = (
    "board string, company_slug string, external_id string, domain string, title string, posted_at string, "
    "first_seen_at timestamp, last_seen_at timestamp, matched_terms array<string>, source_url string"
)

DISCLOSURES = "quarter string, metric string, value double, unit string, source_url string, page_ref string"

LABELS = (
    "domain string, label_set string, label_value string, source_url string, source_type string, quote string, "
    "added_by string, added_at string"
)

PANEL = "domain string, added_at timestamp, panel_version string"

_SCAN = "scan_date date, panel_version string"
_COMPONENT = "struct<contribution:double,weight:double,active:boolean,verified:boolean,note:string>"
_COMPONENTS = ",".join(
    f"{name}:{_COMPONENT}"
    for name in (
        "workaround_b2b",
        "workaround_multistore",
        "workaround_launch",
        "workaround_discount",
        "workaround_sso",
        "workaround_intl",
        "high_growth",
        "large_catalog",
        "review_scale",
    )
)
_MATCH = "domain string, key string, capability string, matched_on string, pattern string, verified boolean"

# The tables a scan writes, partitioned by scan_date and panel_version.
SCAN_TABLES = {
    "stores": (
        "domain string, is_platform boolean, platform_domain string, evidence string, theme_name string, "
        f"hreflang_alt_count long, collection_branch string, {_SCAN}"
    ),
    "outcomes": f"domain string, outcome string, {_SCAN}",
    "assets": f"domain string, url string, asset_ord int, asset_type string, value string, host string, {_SCAN}",
    "app_matches": f"{_MATCH}, {_SCAN}",
    "fingerprint_matches": f"{_MATCH}, {_SCAN}",
    "catalog_snapshots": (
        "domain string, products_json_available boolean, skip_reason string, pages_fetched long, truncated boolean, "
        "product_count long, earliest_created_at date, latest_created_at date, products_created_last_90d long, "
        "products_created_last_365d long, products_created_prior_365d long, variant_count long, vendor_count long, "
        f"available_share double, median_price double, currency string, {_SCAN}"
    ),
    "review_snapshots": f"domain string, vendor string, review_count long, source_url string, method string, {_SCAN}",
    "features": (
        f"domain string, {FEATURES}, components struct<{_COMPONENTS}>, score double, fingerprint_any boolean, "
        f"collection_branch string, {_SCAN}"
    ),
}
