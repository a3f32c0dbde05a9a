"""Queries over pages: URL functions, extraction, matching, reviews, frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import markup, urls, values
from vitrine.operators import extraction, features, hiring, intake, keyed, matching, reviews, series
from vitrine.session import spread
from vitrine.sources import dictionaries
from workload.base import (
    DOMAIN_SQL,
    PAGE_DAY,
    SF,
    TAGS,
    attr_sql,
    host_sql,
    query,
    storefront_pages,
    table,
)

KEYS = ["domain", "scan_date"]


def extracted(spark, sf):
    return extraction.extract(spread(storefront_pages(spark, sf)))


# ---- URL functions ----------------------------------------------------------------------------------

_VARIANT_URL = (
    "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@') "
    "WHEN 2 THEN regexp_replace(url, '://([^/?#]*)', '://{group}:8443') ELSE upper(url) END"
)


@query(
    "url_host",
    f"""SELECT page_id, {host_sql('u')} AS host FROM
        (SELECT page_id, {_VARIANT_URL.replace('{group}', chr(92) + '1')} AS u FROM pages)""",
)
def url_host(spark, sf):
    shaped = F.expr(_VARIANT_URL.replace("{group}", "$1"))
    return table(spark, sf, "pages").select("page_id", urls.host_of(shaped).alias("host"))


@query(
    "domain_normalize",
    r"""WITH a AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '  ' || upper(url) || ' ' WHEN 2 THEN regexp_replace(url, '^[a-z]+://', '')
          WHEN 3 THEN replace(url, '://', '://me@') ELSE 'no dots here ' || page_id END AS raw FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(raw)), '^[a-z][a-z0-9+.-]*://', ''),
          '^([^/?#]*)', 1), '^.*@', ''), ':.*$', ''), '^www\.', ''), '\.+$', '') AS d FROM a)
        SELECT page_id, CASE WHEN contains(d, '.') AND NOT contains(d, ' ') THEN d END AS domain FROM b""",
)
def domain_normalize(spark, sf):
    raw = F.expr(
        "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '  ' || upper(url) || ' ' WHEN 2 THEN regexp_replace(url, '^[a-z]+://', '') "
        "WHEN 3 THEN replace(url, '://', '://me@') ELSE 'no dots here ' || page_id END"
    )
    return table(spark, sf, "pages").select("page_id", urls.normalize_domain(raw).alias("domain"))


@query("domain_keep_first", f"SELECT {DOMAIN_SQL} AS domain, min(page_id) AS first_page FROM pages GROUP BY 1")
def domain_keep_first(spark, sf):
    named = table(spark, sf, "pages").select(urls.normalize_domain(F.col("url")).alias("domain"), F.col("page_id").alias("first_page"))
    return keyed.distinct_in_order(named, "domain", "first_page")


@query(
    "url_validity",
    """SELECT page_id, regexp_matches(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp') ELSE '//' || url END,
       '(?i)^https?://[^/?#]+') AS valid FROM pages""",
)
def url_validity(spark, sf):
    shaped = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp') ELSE '//' || url END")
    return table(spark, sf, "pages").select("page_id", urls.is_http_url(shaped).alias("valid"))


@query("page_hash", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def page_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@query(
    "url_builders",
    f"""WITH d AS (SELECT DISTINCT {DOMAIN_SQL} AS domain FROM pages)
        SELECT domain, 'https://web.archive.org/cdx/search/cdx?url=' || domain || '&output=json&fl=timestamp,statuscode,mimetype,digest&filter=statuscode:200&filter=mimetype:text/html&from=202401&to=202609&collapse=digest' AS query_url,
          'https://web.archive.org/web/20250614120000id_/https://' || domain || '/' AS replay_url,
          'https://api.lever.co/v0/postings/' || split_part(domain, '.', 1) || '?mode=json' AS board_url FROM d""",
)
def url_builders(spark, sf):
    domains = table(spark, sf, "pages").select(urls.normalize_domain(F.col("url")).alias("domain")).distinct()
    return domains.select(
        "domain",
        urls.archive_query_url(F.col("domain"), F.lit("2024-01"), F.lit("2026-09")).alias("query_url"),
        urls.archive_replay_url(F.lit("20250614120000"), F.col("domain")).alias("replay_url"),
        urls.board_url(F.lit("lever"), F.split_part("domain", F.lit("."), F.lit(1))).alias("board_url"),
    )


# ---- extraction -------------------------------------------------------------------------------------

_TAG_CTES = f"WITH {SF}, {TAGS}"


def _listed(spark, sf, column, *parts):
    rows = values.exploded(extracted(spark, sf), ["page_ord"], column, "item", "ord")
    return rows.select("page_ord", (F.col("ord") + 1).cast("long").alias("ord"), *parts)


def _listed_sql(where: str, value: str) -> str:
    return f"""{_TAG_CTES}, v AS (SELECT page_ord, pos, {value} FROM tags WHERE {where})
      SELECT page_ord, row_number() OVER (PARTITION BY page_ord ORDER BY pos) AS ord, * EXCLUDE (page_ord, pos) FROM v"""


_SRC = f"trim({attr_sql('tag', 'src')})"
_IS_SCRIPT = "regexp_matches(tag, '(?i)^<script')"
_BODY = r"""regexp_replace(regexp_replace(tag, '(?is)^<script(?:[^>"'']|"[^"]*"|''[^'']*'')*>', ''), '(?is)</script\s*>$', '')"""


@query("page_script_srcs", _listed_sql(f"{_IS_SCRIPT} AND coalesce({_SRC}, '') <> ''", f"{_SRC} AS src"))
def page_script_srcs(spark, sf):
    return _listed(spark, sf, "script_srcs", F.col("item").alias("src"))


@query(
    "page_links",
    _listed_sql("regexp_matches(tag, '(?i)^<link') AND coalesce(" + attr_sql("tag", "href") + ", '') <> ''", f"{attr_sql('tag', 'href')} AS href"),
)
def page_links(spark, sf):
    return _listed(spark, sf, "link_hrefs", F.col("item").alias("href"))


@query(
    "page_hreflang",
    _listed_sql(
        f"regexp_matches(tag, '(?i)^<link') AND {attr_sql('tag', 'rel')} = 'alternate' AND {attr_sql('tag', 'hreflang')} IS NOT NULL",
        f"{attr_sql('tag', 'hreflang')} AS lang, {attr_sql('tag', 'href')} AS href",
    ),
)
def page_hreflang(spark, sf):
    return _listed(spark, sf, "hreflang_alternates", F.col("item.lang").alias("lang"), F.col("item.href").alias("href"))


_META_KEY = f"coalesce({attr_sql('tag', 'name')}, {attr_sql('tag', 'property')})"


@query(
    "page_meta",
    _listed_sql(
        f"regexp_matches(tag, '(?i)^<meta') AND {_META_KEY} IS NOT NULL AND {attr_sql('tag', 'content')} IS NOT NULL",
        f"{_META_KEY} AS key, {attr_sql('tag', 'content')} AS value",
    ),
)
def page_meta(spark, sf):
    return _listed(spark, sf, "meta", F.col("item.key").alias("key"), F.col("item.value").alias("value"))


@query("page_anchors", _listed_sql(f"regexp_matches(tag, '(?i)^<a') AND {attr_sql('tag', 'href')} IS NOT NULL", f"{attr_sql('tag', 'href')} AS href"))
def page_anchors(spark, sf):
    return _listed(spark, sf, "anchors", F.col("item").alias("href"))


INLINE = f"""inline AS (
  SELECT p.page_ord, coalesce(s.script, '') AS script FROM sf p LEFT JOIN (
    SELECT page_ord, string_agg(body, chr(10) ORDER BY pos) AS script FROM (
      SELECT page_ord, pos, {_BODY} AS body FROM tags
      WHERE {_IS_SCRIPT} AND coalesce({_SRC}, '') = '' AND coalesce({attr_sql('tag', 'type')}, '') NOT LIKE '%ld+json%')
    WHERE body <> '' GROUP BY page_ord) s ON s.page_ord = p.page_ord)"""


@query("page_inline_script", f"{_TAG_CTES}, {INLINE} SELECT page_ord, md5(script) AS script_md5, length(script) AS chars FROM inline")
def page_inline_script(spark, sf):
    text = F.col("inline_script_text")
    return extracted(spark, sf).select("page_ord", F.md5(text).alias("script_md5"), F.length(text).cast("long").alias("chars"))


@query(
    "page_jsonld",
    _listed_sql(
        f"{_IS_SCRIPT} AND {attr_sql('tag', 'type')} LIKE '%ld+json%' AND json_valid({_BODY})",
        f"CAST(json_extract_string({_BODY}, '$.page') AS BIGINT) AS page, json_extract_string({_BODY}, '$.\"@type\"') AS kind",
    ),
)
def page_jsonld(spark, sf):
    block = F.parse_json("item")
    return _listed(
        spark, sf, "jsonld", F.variant_get(block, "$.page", "bigint").alias("page"), F.variant_get(block, "$['@type']", "string").alias("kind")
    )


_BLOB = r"regexp_extract(script, '(?s)Shopify\.theme\s*=\s*(\{.*?\})', 1)"
THEME = f"""theme AS (
  SELECT page_ord, nullif(regexp_extract(script, '([a-z0-9-]+[.]myshopify[.]com)', 1), '') AS platform_domain,
         nullif(regexp_extract({_BLOB}, '"name"\\s*:\\s*"([^"]*)"', 1), '') AS theme_name,
         TRY_CAST(regexp_extract({_BLOB}, '"id"\\s*:\\s*(\\d+)', 1) AS BIGINT) AS theme_id, script
  FROM inline)"""


@query("theme_info", f"{_TAG_CTES}, {INLINE}, {THEME} SELECT page_ord, platform_domain, theme_name, theme_id FROM theme")
def theme_info(spark, sf):
    return extracted(spark, sf).select("page_ord", "platform_domain", "theme_name", "theme_id")


_ASSET_URL = f"""urls AS (
  SELECT page_ord, domain, row_number() OVER (PARTITION BY page_ord ORDER BY kind, pos) AS url_ord, kind, u, CASE WHEN contains(u, '//') THEN {host_sql('u')} END AS host FROM (
    SELECT page_ord, domain, pos, 0 AS kind, {_SRC} AS u FROM tags WHERE {_IS_SCRIPT} AND coalesce({_SRC}, '') <> ''
    UNION ALL
    SELECT page_ord, domain, pos, 1, {attr_sql('tag', 'href')} FROM tags WHERE regexp_matches(tag, '(?i)^<link') AND coalesce({attr_sql('tag', 'href')}, '') <> ''))"""

EVIDENCE = f"""verdict AS (
  SELECT p.page_ord, p.domain, p.page_role,
    CASE WHEN EXISTS (SELECT 1 FROM urls u WHERE u.page_ord = p.page_ord AND u.host = 'cdn.shopify.com') THEN 1 ELSE 0 END
    + CASE WHEN contains(t.script, 'window.Shopify') OR contains(t.script, 'Shopify.theme') THEN 1 ELSE 0 END
    + CASE WHEN p.has_header THEN 1 ELSE 0 END
    + CASE WHEN contains(p.html, '/cdn/shop/') THEN 1 ELSE 0 END
    + CASE WHEN contains(p.html, 'shopify-section') THEN 1 ELSE 0 END
    + CASE WHEN t.platform_domain IS NOT NULL THEN 1 ELSE 0 END AS kinds
  FROM sf p JOIN theme t ON t.page_ord = p.page_ord)"""

PAGE_CTES = f"{_TAG_CTES}, {INLINE}, {THEME}, {_ASSET_URL}, {EVIDENCE}"


@query("platform_evidence", f"{PAGE_CTES} SELECT page_ord, CAST(kinds AS BIGINT) AS kinds, kinds >= 2 AS is_platform FROM verdict")
def platform_evidence(spark, sf):
    seen = extraction.with_verdict(extracted(spark, sf))
    return seen.select("page_ord", F.size("evidence").cast("long").alias("kinds"), "is_platform")


@query(
    "page_assets",
    f"""{PAGE_CTES}, a AS (
          SELECT page_ord, CASE kind WHEN 0 THEN 'script_src' ELSE 'link_href' END AS asset_type, u AS value, host FROM urls
          UNION ALL SELECT page_ord, 'inline_script_marker', platform_domain, NULL FROM theme WHERE platform_domain IS NOT NULL
          UNION ALL SELECT page_ord, 'meta', ({_META_KEY} || '=' || {attr_sql('tag', 'content')}), NULL FROM tags
            WHERE regexp_matches(tag, '(?i)^<meta') AND {_META_KEY} IS NOT NULL AND {attr_sql('tag', 'content')} IS NOT NULL)
        SELECT page_ord, asset_type, value, host FROM a""",
)
def page_assets(spark, sf):
    return extraction.asset_rows(extracted(spark, sf), ["page_ord"]).drop("asset_ord")


_CTE_ANCHORS = f"anchors AS (SELECT page_ord, url, pos, {attr_sql('tag', 'href')} AS href FROM tags WHERE regexp_matches(tag, '(?i)^<a') AND {attr_sql('tag', 'href')} IS NOT NULL)"
_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(
    "first_anchor",
    f"""{_TAG_CTES}, {_CTE_ANCHORS},
        c AS (SELECT page_ord, arg_min(href, pos) AS href FROM anchors WHERE contains(href, '/collections/') AND NOT regexp_matches(href, '/collections/all/*$') GROUP BY 1),
        p AS (SELECT page_ord, arg_min(href, pos) AS href FROM anchors WHERE regexp_matches(href, '/products/[^/?#]+') GROUP BY 1)
        SELECT s.page_ord, {_ROOT.replace('url', 's.url')} || coalesce(c.href, '/collections/all') AS collection_url,
          CASE WHEN c.href IS NULL THEN 'collections_all_fallback' ELSE 'nav_link' END AS branch,
          {_ROOT.replace('url', 's.url')} || CASE WHEN regexp_matches(s.url, '^[a-z]+://[^/?#]*/[^/?#]*/[^/?#]*/') THEN '/' || regexp_extract(s.url, '^[a-z]+://[^/?#]*/([^/?#]*)/', 1) ELSE '' END || regexp_replace(p.href, '^[.][.]', '') AS product_url
        FROM sf s LEFT JOIN c ON c.page_ord = s.page_ord LEFT JOIN p ON p.page_ord = s.page_ord""",
)
def first_anchor(spark, sf):
    seen = extracted(spark, sf)
    link = extraction.collection_link(F.col("anchors"), F.col("url"))
    return seen.select(
        "page_ord",
        link["url"].alias("collection_url"),
        link["branch"].alias("branch"),
        extraction.product_link(F.col("anchors"), F.col("url")).alias("product_url"),
    )


@query(
    "resolve_links",
    f"""WITH {SF}, {TAGS}, {_CTE_ANCHORS}
        SELECT page_ord, pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN {_ROOT} || href
          WHEN starts_with(href, '../') THEN {_ROOT} || '/' || array_to_string(list_concat(folders[1:greatest(len(folders) - 1, 0)], [substr(href, 4)]), '/') END AS resolved
        FROM (SELECT *, list_filter(CASE WHEN path[-1] <> '' THEN path[1:len(path) - 1] ELSE path END, lambda x: x <> '') AS folders
          FROM (SELECT page_ord, url, row_number() OVER (PARTITION BY page_ord ORDER BY pos) AS pos, href, string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path FROM anchors))""",
)
def resolve_links(spark, sf):
    rows = values.exploded(extracted(spark, sf), ["page_ord", "url"], "anchors", "href", "pos")
    return rows.select("page_ord", (F.col("pos") + 1).cast("long").alias("pos"), urls.resolve_url(F.col("url"), F.col("href")).alias("resolved"))


@query(
    "visible_text",
    r"""WITH a AS (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(html, '(?is)<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>', '<x>', 'g'), '<[/!?A-Za-z][^>]*>')) AS n,
                generate_subscripts(regexp_split_to_array(regexp_replace(html, '(?is)<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>', '<x>', 'g'), '<[/!?A-Za-z][^>]*>'), 1) AS i FROM pages),
        b AS (SELECT page_id, i, regexp_replace(replace(replace(replace(replace(replace(replace(n, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS n FROM a)
        SELECT page_id, md5(string_agg(n, ' ' ORDER BY i)) AS text_md5 FROM b WHERE n <> '' GROUP BY page_id""",
)
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(markup.visible_text(F.col("html"))).alias("text_md5"))


# ---- matching ---------------------------------------------------------------------------------------

_APPS = dictionaries.load_apps()
_MARKS = dictionaries.load_fingerprints()
_VENDORS = dictionaries.load_vendors()


def _values(entries) -> str:
    """Dictionary rows as a VALUES list for the twin SQL."""
    rows = []
    for e in entries:
        for kind_ord, kind in enumerate(dictionaries.PATTERN_KINDS):
            for j, p in enumerate(getattr(e, kind)):
                quoted = p.replace("'", "''")
                rows.append(f"('{e.key}', '{e.capability}', {e.verified}, '{kind}', {kind_ord}, {j}, '{quoted}')")
    return "(VALUES " + ", ".join(rows) + ") AS d(key, capability, verified, kind, kind_ord, pattern_ord, pattern)"


def match_cte(name: str, entries, pages: str = "sf") -> str:
    return f"""{name}_hits AS (
      SELECT u.domain, d.*, 0 AS stage, u.page_ord, u.url_ord, u.u AS matched FROM urls u JOIN {_values(entries)}
        ON contains(u.u, '//') AND ((d.kind = 'script_host' AND regexp_matches(u.host, '(?i)' || d.pattern)) OR (d.kind = 'script_src' AND regexp_matches(u.u, '(?i)' || d.pattern)))
      UNION ALL
      SELECT p.domain, d.*, 1, p.page_ord, 0, regexp_extract(p.html, '(?i)' || d.pattern, 0) FROM {pages} p JOIN {_values(entries)}
        ON d.kind = 'dom_marker' AND regexp_matches(p.html, '(?i)' || d.pattern)),
    {name} AS (SELECT domain, key, capability, verified, pattern, matched AS matched_on FROM (
      SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY stage, page_ord, url_ord, CASE kind WHEN 'script_src' THEN 1 ELSE 0 END, pattern_ord) AS rn FROM {name}_hits) WHERE rn = 1)"""


HREFLANG = f"""ext AS (
  SELECT DISTINCT domain, host FROM (SELECT domain, {host_sql(attr_sql('tag', 'href'))} AS host FROM tags
    WHERE regexp_matches(tag, '(?i)^<link') AND {attr_sql('tag', 'rel')} = 'alternate' AND {attr_sql('tag', 'hreflang')} IS NOT NULL AND contains({attr_sql('tag', 'href')}, '//'))
  WHERE host <> '' AND NOT ends_with(host, domain)),
hreflang AS (SELECT domain, count(*) AS hosts, string_agg(host, ';' ORDER BY host) AS matched_on FROM ext GROUP BY 1 HAVING count(*) >= 2)"""


@query("signature_match", f"{PAGE_CTES}, {match_cte('apps', _APPS)} SELECT domain, key, capability, verified, pattern, matched_on FROM apps")
def signature_match(spark, sf):
    return matching.match_signatures(extracted(spark, sf), _APPS, KEYS).drop("scan_date")


@query(
    "fingerprint_match",
    f"""{PAGE_CTES}, {match_cte('marks', _MARKS)}, {HREFLANG}
        SELECT domain, key, verified, pattern, matched_on FROM marks UNION ALL
        SELECT domain, 'expansion_store_hreflang', FALSE, 'hreflang alternates on >= 2 external hosts', matched_on FROM hreflang""",
)
def fingerprint_match(spark, sf):
    return matching.match_fingerprints(extracted(spark, sf), _MARKS, KEYS).drop("scan_date", "capability")


@query("hreflang_external", f"{_TAG_CTES}, {HREFLANG} SELECT domain, host FROM ext")
def hreflang_external(spark, sf):
    hosts = extraction.external_hosts(F.col("hreflang_alternates"), F.col("domain"))
    return values.exploded(extracted(spark, sf), ["domain"], hosts, "host").distinct()


@query(
    "fingerprint_stores",
    f"""{PAGE_CTES}, {match_cte('marks', _MARKS)} SELECT DISTINCT domain FROM marks WHERE verified""",
)
def fingerprint_stores(spark, sf):
    marks = matching.match_fingerprints(extracted(spark, sf), _MARKS, KEYS).withColumn("panel_version", F.lit("v1"))
    return series.fingerprint_stores(marks, verified_only=True).select("domain")


def _review_sql(pages: str) -> str:
    per_vendor = []
    for v in _VENDORS:
        q = [p.replace("'", "''") for p in v.count]
        d = [p.replace("'", "''") for p in v.detect]
        count = "coalesce(" + ", ".join(f"TRY_CAST(replace(regexp_extract(p.html, '(?i){c}', 1), ',', '') AS BIGINT)" for c in q) + ", NULL)"
        text = " OR ".join(f"regexp_matches(p.html, '(?i){x}')" for x in d)
        host = " OR ".join(f"regexp_matches(u.host, '(?i){x}')" for x in d)
        per_vendor.append(
            f"""SELECT p.domain, p.page_ord, p.url, '{v.vendor}' AS vendor, {count} AS n,
                ({text} OR EXISTS (SELECT 1 FROM urls u WHERE u.page_ord = p.page_ord AND ({host}))) AS hit FROM {pages} p"""
        )
    return f"""readings AS ({' UNION ALL '.join(per_vendor)}),
    by_vendor AS (SELECT domain, vendor, bool_or(hit) AS hit, arg_min(n, page_ord) FILTER (n IS NOT NULL) AS review_count,
        arg_min(url, page_ord) FILTER (n IS NOT NULL) AS source_url FROM readings GROUP BY 1, 2),
    reviews AS (SELECT domain, vendor, review_count, source_url, CASE WHEN review_count IS NULL THEN 'not_available' ELSE 'html_widget' END AS method FROM by_vendor WHERE hit
        UNION ALL SELECT domain, 'none', NULL, NULL, 'not_available' FROM by_vendor GROUP BY domain HAVING NOT bool_or(hit))"""


REVIEWS = _review_sql("sf")


@query("review_vendor_counts", f"{PAGE_CTES}, {REVIEWS} SELECT domain, vendor, review_count, source_url, method FROM reviews")
def review_vendor_counts(spark, sf):
    return reviews.read_reviews(extracted(spark, sf), _VENDORS, KEYS).drop("scan_date")


@query(
    "review_rollup",
    f"""{PAGE_CTES}, {REVIEWS} SELECT domain, max(review_count) AS review_count_max, count(DISTINCT CASE WHEN vendor <> 'none' THEN vendor END) AS review_vendor_count,
        CAST(count(DISTINCT CASE WHEN vendor <> 'none' THEN vendor END) > 0 AS INTEGER) AS has_reviews_vendor FROM reviews GROUP BY 1""",
)
def review_rollup(spark, sf):
    return reviews.rollup(reviews.read_reviews(extracted(spark, sf), _VENDORS, KEYS), ["domain"])


@query(
    "review_endpoint",
    f"""WITH p AS (SELECT page_id, {DOMAIN_SQL} AS domain, 'https://api.vendor.example/count/' || page_id AS endpoint, page_id % 3 AS variant FROM pages),
        v AS (SELECT domain, arg_min(endpoint, page_id) FILTER (variant = 0) AS endpoint FROM p GROUP BY 1),
        b AS (SELECT 'https://api.vendor.example/count/' || page_id AS endpoint, length(url) AS n FROM pages WHERE page_id % 4 <> 1)
        SELECT v.domain, 'acme' AS vendor, b.n AS review_count, CASE WHEN b.n IS NOT NULL THEN v.endpoint END AS source_url,
          CASE WHEN b.n IS NOT NULL THEN 'json_endpoint_referenced_in_page' ELSE 'not_available' END AS method
        FROM v LEFT JOIN b ON b.endpoint = v.endpoint""",
)
def review_endpoint(spark, sf):
    pages = storefront_pages(spark, sf)
    i = F.col("page_ord")
    address = F.concat(F.lit("api.vendor.example/count/"), i.cast("string"))
    shown = F.when(i % 3 == 0, F.concat(F.lit('<i data-acme="https://'), address, F.lit('"></i>'))).otherwise(
        F.concat(F.lit('<i data-acme="1" class="'), address, F.lit('"></i>'))
    )
    seen = extraction.extract(pages.withColumn("html", F.concat(shown, F.col("html"))))
    answers = pages.select(
        F.concat(F.lit("https://api.vendor.example/count/"), i.cast("string")).alias("url"),
        F.when(i % 4 == 1, 503).otherwise(200).alias("status"),
        F.concat(F.lit('{"total": "'), F.length("url").cast("string"), F.lit('"}')).alias("body"),
    )
    vendor = dictionaries.ReviewVendor(
        "acme", detect=("data-acme",), count=(r'"total": "([0-9,]+)"',), endpoint=r"(?:https://)?api\.vendor\.example/count/[0-9]+"
    )
    return reviews.read_reviews(seen, [vendor], KEYS, answers).drop("scan_date")


@query(
    "feature_apps",
    f"""{PAGE_CTES}, {match_cte('apps', _APPS)}
        SELECT domain, count(DISTINCT key) AS app_count, count(DISTINCT capability) AS capability_count, count(*) FILTER (verified) AS verified_count,
          count(DISTINCT key) FILTER (capability = 'international_markets') AS intl_app_count,
          CAST(bool_or(capability = 'b2b_wholesale') AS INTEGER) AS b2b, CAST(bool_or(capability = 'sso_login') AS INTEGER) AS sso,
          bool_or(verified) FILTER (capability = 'international_markets') AS intl_verified
        FROM apps GROUP BY 1""",
)
def feature_apps(spark, sf):
    built = features.app_features(matching.match_signatures(extracted(spark, sf), _APPS, KEYS), ["domain"])
    return built.select(
        "domain",
        F.col("workaround_app_count").alias("app_count"),
        F.col("workaround_capability_count").alias("capability_count"),
        F.col("workaround_verified_count").alias("verified_count"),
        F.col("workaround_intl_app_count").alias("intl_app_count"),
        F.col("workaround_b2b").alias("b2b"),
        F.col("workaround_sso").alias("sso"),
        F.element_at("capability_verified", F.lit("international_markets")).alias("intl_verified"),
    )


@query(
    "candidate_domains",
    f"""{PAGE_CTES}, {_CTE_ANCHORS},
        ab AS (SELECT url AS page_url, pos, regexp_replace(regexp_extract(lower(href), '^https?://([^/?#]*)', 1), '^www[.]', '') AS domain, {DOMAIN_SQL} AS own FROM anchors WHERE regexp_matches(href, '^https?://')),
        f AS (SELECT page_url, domain, min(pos) AS pos FROM ab WHERE domain <> own AND contains(domain, '.') GROUP BY 1, 2),
        good AS (SELECT 'partner' || (page_ord % 29) || '.example.net' AS domain, max(kinds) AS kinds FROM verdict WHERE kinds >= 2 GROUP BY 1)
        SELECT page_url, domain, CAST(kinds AS BIGINT) AS kinds FROM f JOIN good USING (domain)""",
)
def candidate_domains(spark, sf):
    seen = extraction.with_verdict(extracted(spark, sf))
    partner = F.concat(F.lit("partner"), (F.col("page_ord") % 29).cast("string"), F.lit(".example.net"))
    good = seen.where("is_platform").groupBy(partner.alias("domain")).agg(F.max(F.size("evidence")).cast("long").alias("evidence"))
    listings = seen.select(F.col("url").alias("page_url"), "anchors")
    return extraction.candidate_domains(listings, good).select("page_url", "domain", F.col("evidence").alias("kinds"))


@query(
    "board_links",
    f"""WITH {SF}, s AS (SELECT page_ord, 'greenhouse' AS board, unnest(regexp_extract_all(html, '(?i)boards[.]greenhouse[.]io/([A-Za-z0-9_-]+)', 1)) AS slug FROM sf
          UNION ALL SELECT page_ord, 'lever', unnest(regexp_extract_all(html, '(?i)jobs[.]lever[.]co/([A-Za-z0-9_-]+)', 1)) FROM sf
          UNION ALL SELECT page_ord, 'ashby', unnest(regexp_extract_all(html, '(?i)jobs[.]ashbyhq[.]com/([A-Za-z0-9_-]+)', 1)) FROM sf)
        SELECT DISTINCT page_ord, board, slug FROM s WHERE lower(slug) NOT IN ('embed', 'job', 'jobs')""",
)
def board_links(spark, sf):
    found = values.exploded(storefront_pages(spark, sf), ["page_ord"], hiring.board_slugs(F.col("html")), "b")
    return found.select("page_ord", "b.board", "b.slug")


_CAREERS = "CASE page_ord % 4 WHEN 0 THEN '/' WHEN 1 THEN '/careers' WHEN 2 THEN '/pages/jobs' ELSE '/about' END"
BOARDS = f"""found AS (SELECT domain, page_ord, 'https://' || domain || {_CAREERS} AS u, unnest(regexp_extract_all(html, '(?i)boards[.]greenhouse[.]io/([A-Za-z0-9_-]+)', 1)) AS slug
    FROM sf WHERE page_ord % 4 <> 3),
  boards AS (SELECT 'greenhouse' AS board, slug AS company_slug, arg_min(domain, page_ord) AS domain, arg_min(u, page_ord) AS discovered_from_url FROM found GROUP BY slug)"""


def found_boards(spark, sf):
    shaped = storefront_pages(spark, sf).withColumn("url", F.concat(F.lit("https://"), F.col("domain"), F.expr(_CAREERS)))
    return hiring.discover_boards(shaped)


@query("board_discovery", f"WITH {SF}, {BOARDS} SELECT board, company_slug, domain, discovered_from_url FROM boards")
def board_discovery(spark, sf):
    return found_boards(spark, sf)


@query(
    "board_coverage",
    f"""WITH {SF}, {BOARDS} SELECT count(DISTINCT sf.domain) AS stores, count(DISTINCT boards.domain) AS stores_with_board,
        round(count(DISTINCT boards.domain) / count(DISTINCT sf.domain), 6) AS coverage FROM sf LEFT JOIN boards ON boards.domain = sf.domain""",
)
def board_coverage(spark, sf):
    out = hiring.board_coverage(storefront_pages(spark, sf).select("domain"), found_boards(spark, sf))
    return out.withColumn("coverage", F.round("coverage", 6))


# ---- fetch log and frontier -------------------------------------------------------------------------


@query(
    "page_usable",
    "SELECT page_id, page_id % 7 <> 3 AND page_id % 5 <> 2 AS usable FROM pages",
)
def page_usable(spark, sf):
    rows = table(spark, sf, "pages")
    status = F.when(F.col("page_id") % 7 != 3, 200).otherwise(404)
    body = F.when(F.col("page_id") % 5 != 2, F.col("html"))
    return rows.select("page_id", intake.usable(status, body).alias("usable"))


_HOMES = f"""{PAGE_CTES}, homes AS (SELECT page_ord, CASE WHEN page_ord % 17 = 3 THEN 'exception' WHEN page_ord % 7 = 2 THEN 'home_failed' WHEN kinds < 2 THEN 'not_platform' ELSE 'scanned' END AS outcome FROM verdict)"""


def _outcomes(spark, sf):
    seen = extraction.with_verdict(extracted(spark, sf))
    i = F.col("page_ord")
    shaped = seen.withColumn("status", F.when(i % 7 == 2, 503).otherwise(200)).withColumn("error", F.when(i % 17 == 3, F.lit("boom")))
    return intake.outcomes(shaped, ["page_ord"])


@query("store_outcomes", f"{_HOMES} SELECT page_ord, outcome FROM homes")
def store_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query(
    "run_statistics",
    f"""{_HOMES} SELECT count(*) FILTER (outcome = 'scanned') AS scanned, count(*) FILTER (outcome = 'home_failed') AS skipped,
        count(*) FILTER (outcome = 'not_platform') AS not_platform, count(*) FILTER (outcome = 'exception') AS failures FROM homes""",
)
def run_statistics(spark, sf):
    return intake.outcome_counts(_outcomes(spark, sf))


def _log(spark, sf, every: int = 1):
    rows = table(spark, sf, "pages").where(F.col("page_id") % every == 0)
    i = F.col("page_id")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    day = F.date_add(F.lit(PAGE_DAY).cast("date"), (i % 3).cast("int"))
    return rows.select(
        day.alias("scan_date"),
        F.lit("v1").alias("panel_version"),
        bare.alias("url"),
        F.when(i % 6 == 0, 404).otherwise(200).alias("status"),
        F.when(i % 10 != 0, F.col("html")).alias("html"),
        F.date_add(day, (i % 2).cast("int")).cast("timestamp").alias("fetched_at"),
        i.alias("fetch_ord"),
    )


_LOG = f"""log AS (SELECT DATE '{PAGE_DAY}' + CAST(page_id % 3 AS INTEGER) AS scan_date, regexp_replace(url, '[?#].*$', '') AS url,
    CASE WHEN page_id % 6 = 0 THEN 404 ELSE 200 END AS status, page_id % 10 <> 0 AS has_body, page_id FROM pages)"""


@query(
    "frontier_dedupe",
    f"""WITH {_LOG}, half AS (SELECT * FROM log WHERE page_id % 2 = 0), f AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url, DATE '{PAGE_DAY}' + CAST(page_id % 3 AS INTEGER) AS scan_date FROM pages)
        SELECT url, scan_date FROM f WHERE NOT EXISTS (SELECT 1 FROM half WHERE half.url = f.url AND half.scan_date = f.scan_date)""",
)
def frontier_dedupe(spark, sf):
    day = F.date_add(F.lit(PAGE_DAY).cast("date"), (F.col("page_id") % 3).cast("int"))
    frontier = table(spark, sf, "pages").select(
        day.alias("scan_date"), F.lit("v1").alias("panel_version"), F.regexp_replace("url", r"[?#].*$", "").alias("url")
    )
    return intake.frontier_dedupe(frontier.distinct(), _log(spark, sf, 2)).select("url", "scan_date")


@query(
    "latest_fetch",
    f"""WITH {_LOG} SELECT scan_date, url, max(page_id) AS fetch_ord, arg_max(status, page_id) AS status FROM log GROUP BY 1, 2""",
)
def latest_fetch(spark, sf):
    return intake.latest_fetch(_log(spark, sf)).select("scan_date", "url", "fetch_ord", "status")


@query(
    "cached_bodies",
    f"""WITH {_LOG} SELECT url, scan_date + CAST(page_id % 2 AS INTEGER) AS fetched_on, max(page_id) AS fetch_ord FROM log WHERE status = 200 AND has_body GROUP BY 1, 2""",
)
def cached_bodies(spark, sf):
    return intake.cached_bodies(_log(spark, sf)).select("url", "fetched_on", "fetch_ord")


@query(
    "frontier_admission",
    f"""WITH p AS (SELECT page_id, url, {host_sql('url')} AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM pages),
        r AS (SELECT host, length(host) % 3 AS kind FROM (SELECT DISTINCT host FROM p))
        SELECT page_id, CASE kind WHEN 0 THEN TRUE WHEN 1 THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en') ELSE NOT starts_with(path, '/fr') END AS allowed,
          CASE WHEN kind = 0 THEN 'robots_unreachable' WHEN kind = 1 AND starts_with(path, '/en') AND NOT starts_with(path, '/en/1') THEN 'robots_disallow'
               WHEN kind = 2 AND starts_with(path, '/fr') THEN 'robots_disallow' END AS reason,
          CASE WHEN kind = 1 THEN CAST(5.0 AS DOUBLE) END AS crawl_delay
        FROM p JOIN r USING (host)""",
)
def frontier_admission(spark, sf):
    frontier = table(spark, sf, "pages").select("page_id", "url")
    hosts = frontier.select(urls.host_of(F.col("url")).alias("host")).distinct()
    kind = F.length("host") % 3
    robots = hosts.select(
        "host",
        F.when(kind == 0, 500).otherwise(200).alias("status"),
        F.when(kind == 1, F.lit("# rules\nUser-agent: *\nAllow: /en/1\nDisallow: /en\nCrawl-delay: 5\n"))
        .otherwise(F.lit("User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nDisallow: /fr # french\nAllow: /\n"))
        .alias("body"),
    )
    rules = intake.robots_rules(robots, agent="researchbot/1.0")
    reachable = robots.where(F.col("status") == 200)
    return intake.admit(frontier, rules, reachable).select("page_id", "allowed", "reason", "crawl_delay")
