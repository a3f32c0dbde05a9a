"""Registry and role mapping shared by the query modules.

The driver's tables play the library's roles: a customer is a store, an order a product, a line item a
variant, an ISO week of events a scan, a purchase a fingerprint hit (verified from 100 up), a document's
quality its label. Storefront pages are derived row by row from `pages`: markup of every kind the
extractors read is put in front of the page's own HTML, so the work grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.functions import urls
from vitrine.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SCAN_DAY = "2001-08-01"
PAGE_DAY = "2026-09-08"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when it can be said in SQL, its twin."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, name: str):
    """A double rounded for comparison."""
    return F.round(column, 6).alias(name)


# ---- storefront pages -------------------------------------------------------------------------------

# One expression both engines read: SQL without backslashes.
STOREFRONT_HTML = """
'<html><head><meta name="generator" content="shop &amp; co ' || CAST(page_id AS STRING) || '">'
|| '<meta property="og:type" content="website"><meta charset="utf-8">'
|| '<!-- <script src="https://commented.example/x.js"></script><a href="/collections/commented">x</a> -->'
|| CASE WHEN page_id % 2 = 0 THEN '<script src="https://cdn.shopify.com/s/files/1/t' || CAST(page_id % 17 AS STRING) || '.js"></script>' ELSE '<script src=''/assets/local.js''></script>' END
|| CASE WHEN page_id % 5 = 0 THEN '<script async src="https://cdn.sparklayer.io/spark-' || CAST(page_id AS STRING) || '.js"></script>' ELSE '' END
|| CASE WHEN page_id % 7 = 0 THEN '<SCRIPT SRC=https://CDN.weglot.com/weglot.min.js?v=' || CAST(page_id AS STRING) || '></SCRIPT>' ELSE '' END
|| CASE WHEN page_id % 11 = 0 THEN '<script src="//cdn.shopify.com/extensions/ab' || CAST(page_id AS STRING) || '/wholesale-gorilla-45/assets/wsg.js"></script>' ELSE '' END
|| CASE WHEN page_id % 4 = 0 THEN '<link rel="stylesheet" href="https://judge.me/style.css"><link rel="alternate" hreflang="fr" href="https://fr' || CAST(page_id % 3 AS STRING) || '.example.org/fr">' ELSE '' END
|| '<link rel="alternate" hreflang="de" href="https://de' || CAST(page_id % 5 AS STRING) || '.shop.example/de"><link rel="alternate" hreflang="x-default" href="/home">'
|| '<script>window.Shopify = window.Shopify || {}; Shopify.theme = {"name":"Theme ' || CAST(page_id % 9 AS STRING) || '","id":' || CAST(page_id * 10 + 7 AS STRING) || CASE WHEN page_id % 8 = 0 THEN ',"nested":{"a":1}' ELSE '' END || '};'
|| CASE WHEN page_id % 3 = 0 THEN 'var shop = "store-' || CAST(page_id AS STRING) || '.myshopify.com";' ELSE '' END || '</script>'
|| '<script type="application/ld+json">{"@type":"Product","page":' || CAST(page_id AS STRING) || CASE WHEN page_id % 6 = 0 THEN '' ELSE '}' END || '</script>'
|| CASE WHEN page_id % 9 = 0 THEN '<script>var transcy_currencyDefault = "EUR"; var fields = "app.customerfields.com";</script>' ELSE '' END
|| CASE WHEN page_id % 13 = 0 THEN '<a href="https://id.shop.example/account/login/multipass/t' || CAST(page_id AS STRING) || '">in</a>' ELSE '' END
|| CASE WHEN page_id % 19 = 0 THEN '<p>Proudly on Shopify  Plus</p>' ELSE '' END
|| '</head><body class="' || CASE WHEN page_id % 10 < 4 THEN 'shopify-section' ELSE 'page' END || '">'
|| '<a href="/collections/all">All</a>' || CASE WHEN page_id % 6 = 1 THEN '' ELSE '<a class="nav" href="/collections/c' || CAST(page_id % 21 AS STRING) || '?a=1&amp;b=2">C</a>' END
|| '<a href="../products/p' || CAST(page_id AS STRING) || '">P</a><a href="https://boards.greenhouse.io/acme' || CAST(page_id % 23 AS STRING) || '/jobs/1">jobs</a><a href="https://jobs.lever.co/jobs">l</a>'
|| '<a href="https://www.partner' || CAST(page_id % 29 AS STRING) || '.example.net/x">partner</a>'
|| CASE WHEN page_id % 4 = 1 THEN '<span class="jdgm-prev-badge__text">1,' || CAST(100 + page_id % 900 AS STRING) || ' reviews</span>' ELSE '' END
|| CASE WHEN page_id % 12 = 3 THEN '<div class="loox-rating" data-count="' || CAST(page_id * 3 AS STRING) || '"></div><script src="https://loox.io/w.js"></script>' ELSE '' END
|| CASE WHEN page_id % 20 = 5 THEN '<div data-oke-widget="1"></div>' ELSE '' END
|| html
"""

DOMAIN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), "
    "':.*$', ''), '^www[.]', '')"
)
ROLE_SQL = "CASE page_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'collection' ELSE 'product' END"

SF = f"""sf AS (
  SELECT page_id AS page_ord, url, {DOMAIN_SQL} AS domain, {ROLE_SQL} AS page_role, html AS raw_html,
         page_id % 10 = 0 AS has_header, {STOREFRONT_HTML} AS html
  FROM pages)"""

# Scripts (with bodies) and open tags in order; comments and styles are consumed by the same scan.
TAGS = r"""tags AS (
  SELECT page_ord, url, domain, pos, tag FROM (
    SELECT page_ord, url, domain, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (
      SELECT page_ord, url, domain, regexp_extract_all(html,
        '(?is)<!--.*?-->|<(?:script|style)(?:[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*)?>.*?</(?:script|style)\s*>|<(?:a|link|meta)(?:[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*)?>', 0) AS t
      FROM sf))
  WHERE NOT starts_with(tag, '<!') AND NOT regexp_matches(tag, '(?i)^<style'))"""


def attr_sql(tag: str, name: str) -> str:
    """An attribute of an open tag in the twin SQL, NULL when absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    head = f"regexp_extract({tag}, '(?is)^<[a-z]+(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>', 0)"
    parts = " || ".join(f"regexp_extract({head}, '{pattern}', {i})" for i in (1, 2, 3))
    value = f"({parts})"
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        value = f"replace({value}, '{ref}', '{char}')"
    return f"CASE WHEN regexp_matches({head}, '{pattern}') THEN {value} END"


def host_sql(url: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':.*$', '')"
    )


def storefront_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storefront pages in the pages schema, plus panel_version."""
    role = F.expr(ROLE_SQL)
    header = F.create_map(F.lit("X-ShopId"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        urls.normalize_domain(F.col("url")).alias("domain"),
        F.lit(PAGE_DAY).cast("date").alias("scan_date"),
        F.lit("v1").alias("panel_version"),
        F.col("page_id").alias("page_ord"),
        role.alias("page_role"),
        "url",
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("skip_reason"),
        F.when(F.col("page_id") % 10 == 0, header).otherwise(F.create_map().cast("map<string,string>")).alias("headers"),
        F.expr(STOREFRONT_HTML).alias("html"),
        F.lit(f"{PAGE_DAY} 00:00:00").cast("timestamp").alias("fetched_at"),
    )


# ---- stores, products, variants ---------------------------------------------------------------------


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as products: domain, created_at (ISO text), vendor."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:00:00+02:00")).alias("created_at"),
        F.col("o_orderpriority").alias("vendor"),
        "o_orderkey",
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as variants of their order's store: domain, price, available, supplier."""
    owner = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_suppkey", "l_linestatus")
    return lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_returnflag") == "N").alias("available"),
        F.col("l_suppkey").alias("supplier"),
        (F.col("l_linestatus") == "O").alias("open_line"),
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, y, score (length), size (words)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), "toxic")
    return docs.join(labels, "doc_id").withColumn("score", F.col("n_chars"))


def event_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weeks of events as scans of one panel: (scans, feature rows, fingerprint hits)."""
    week = F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp")))
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"),
        week.alias("scan_date"),
        F.lit("v1").alias("panel_version"),
        "event_type",
        "value",
    )
    keys = ["domain", "scan_date", "panel_version"]
    features = ev.groupBy(*keys).agg(
        F.round(F.sum("value"), 2).alias("score"),
        F.count_if(F.col("event_type") == "error").alias("workaround_app_count"),
        (F.count(F.lit(1)) >= 15).alias("high_growth_active"),
    )
    hits = ev.where(F.col("event_type") == "purchase").select(*keys, (F.col("value") >= 100).alias("verified"))
    scans = ev.select("scan_date", "panel_version").distinct()
    return scans, features, hits


EVENT_SCANS = """ev AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS domain, CAST(date_trunc('week', ts) AS DATE) AS scan_date, event_type, value FROM events),
feats AS (
  SELECT domain, scan_date, round(sum(value), 2) AS score, count(*) FILTER (event_type = 'error') AS workaround_app_count,
         count(*) >= 15 AS high_growth_active FROM ev GROUP BY 1, 2),
hits AS (SELECT domain, scan_date, value >= 100 AS verified FROM ev WHERE event_type = 'purchase'),
scans AS (SELECT scan_date, lag(scan_date) OVER (ORDER BY scan_date) AS prior_scan_date FROM (SELECT DISTINCT scan_date FROM ev))"""
