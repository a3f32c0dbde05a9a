"""Whole jobs over the driver's tables: the scan from pages to scores, snapshot replay, and the streaming steps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.operators import extraction
from vitrine.plans import backtest as backtest_plan
from vitrine.plans import crosssection, scan
from vitrine.session import materialize, shared_dir
from vitrine.sinks import tables
from vitrine.streaming import jobs
from workload.base import PAGE_DAY, query, r6, storefront_pages, table
from workload.label_queries import POSTS, sightings
from workload.pages_queries import _APPS, _MARKS, HREFLANG, PAGE_CTES, _review_sql, match_cte


def feed_of(pages):
    """Every third page as a one-product feed page of its store, all numbered 1."""
    i = F.col("page_ord")
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.date_format(F.date_sub(F.lit(PAGE_DAY).cast("date"), (i % 900).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("created_at"),
                    F.concat(F.lit("v"), (i % 4).cast("string")).alias("vendor"),
                    F.array(F.struct((i % 50).cast("string").alias("price"), (i % 2 == 0).alias("available"))).alias("variants"),
                )
            ).alias("products")
        )
    )
    return pages.select(
        "domain", "scan_date", "panel_version", F.lit(1).alias("page"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("skip_reason"), body.alias("body")
    )


def built_scan(spark, sf):
    pages = storefront_pages(spark, sf)
    return scan.build_scan(pages, feed_of(pages))


# Stores that pass the verdict on their first home page, and everything the scan derives for them.
_SCAN = f"""{PAGE_CTES},
  home AS (SELECT domain, arg_min(page_ord, page_ord) AS page_ord FROM sf WHERE page_role = 'home' GROUP BY 1),
  good AS (SELECT h.domain, h.page_ord FROM home h JOIN verdict v ON v.page_ord = h.page_ord WHERE v.kinds >= 2),
  sfg AS (SELECT sf.* FROM sf SEMI JOIN good USING (domain)),
  {match_cte('apps0', _APPS, 'sfg')}, apps AS (SELECT * FROM apps0 SEMI JOIN good USING (domain)),
  {match_cte('marks0', _MARKS, 'sfg')}, {HREFLANG},
  marks AS (SELECT domain FROM marks0 SEMI JOIN good USING (domain) UNION SELECT domain FROM hreflang SEMI JOIN good USING (domain)),
  {_review_sql('sfg')},
  rv AS (SELECT domain, max(review_count) AS review_count_max, count(*) FILTER (vendor <> 'none') AS review_vendor_count FROM reviews GROUP BY 1),
  feed AS (SELECT domain, DATE '{PAGE_DAY}' - CAST(page_ord % 900 AS INTEGER) AS created, page_ord % 50 AS price, page_ord % 2 = 0 AS available, page_ord % 4 AS vendor FROM sfg),
  cat AS (SELECT domain, count(*) AS product_count, count(*) FILTER (created >= DATE '{PAGE_DAY}' - 365) AS last365,
      count(*) FILTER (created < DATE '{PAGE_DAY}' - 365 AND created >= DATE '{PAGE_DAY}' - 730) AS prior365, count(*) FILTER (created >= DATE '{PAGE_DAY}' - 90) AS last90,
      median(price) AS median_price, avg(CAST(available AS INTEGER)) AS available_share, count(DISTINCT vendor) AS vendor_count FROM feed GROUP BY 1),
  ap AS (SELECT domain, count(*) AS n, count(DISTINCT capability) AS ncap, count(*) FILTER (verified) AS nver, count(*) FILTER (capability = 'international_markets') AS nintl,
      coalesce(bool_or(capability = 'b2b_wholesale'), FALSE) AS b2b, coalesce(bool_or(capability = 'sso_login'), FALSE) AS sso, coalesce(bool_or(capability = 'discount_logic'), FALSE) AS disc FROM apps GROUP BY 1),
  s AS (SELECT g.domain, coalesce(ap.n, 0) AS app_count, coalesce(nintl, 0) AS intl_apps, coalesce(nver, 0) AS verified_apps, product_count,
      (last365 - prior365) / CAST(greatest(prior365, 1) AS DOUBLE) AS growth, last90, median_price, available_share, vendor_count, review_count_max, coalesce(review_vendor_count, 0) AS review_vendor_count,
      (SELECT count(*) FROM tags WHERE tags.page_ord = g.page_ord AND regexp_matches(tag, '(?i)hreflang="') AND starts_with(tag, '<link')) AS hreflang_alt_count, t.theme_name,
      CASE WHEN b2b THEN 3.0 ELSE 0 END + CASE WHEN sso THEN 1.5 ELSE 0 END + CASE WHEN disc THEN 1.5 ELSE 0 END + CASE WHEN nintl >= 2 THEN 1.0 ELSE 0 END
        + CASE WHEN (last365 - prior365) / CAST(greatest(prior365, 1) AS DOUBLE) >= 0.5 AND last90 >= 20 THEN 2.0 ELSE 0 END + CASE WHEN product_count >= 500 THEN 1.0 ELSE 0 END
        + CASE WHEN review_count_max >= 5000 THEN 2.0 WHEN review_count_max >= 1000 THEN 1.0 ELSE 0 END AS score, marks.domain IS NOT NULL AS fingerprint_any
    FROM good g LEFT JOIN ap ON ap.domain = g.domain LEFT JOIN cat ON cat.domain = g.domain LEFT JOIN rv ON rv.domain = g.domain LEFT JOIN marks ON marks.domain = g.domain LEFT JOIN theme t ON t.page_ord = g.page_ord)"""


@query(
    "scan_features",
    f"""WITH {_SCAN[5:]} SELECT domain, app_count, intl_apps, verified_apps, product_count, round(growth, 6) AS growth, last90, round(median_price, 6) AS median_price,
        round(available_share, 6) AS available_share, vendor_count, review_count_max, review_vendor_count, hreflang_alt_count, theme_name, CAST(score AS DOUBLE) AS score, fingerprint_any FROM s""",
)
def scan_features(spark, sf):
    return built_scan(spark, sf).features.select(
        "domain",
        F.col("workaround_app_count").alias("app_count"),
        F.col("workaround_intl_app_count").alias("intl_apps"),
        F.col("workaround_verified_count").alias("verified_apps"),
        "product_count",
        r6("catalog_growth_yoy", "growth"),
        F.col("products_last_90d").alias("last90"),
        r6("median_price", "median_price"),
        r6("available_share", "available_share"),
        "vendor_count",
        "review_count_max",
        "review_vendor_count",
        "hreflang_alt_count",
        "theme_name",
        "score",
        "fingerprint_any",
    )


@query(
    "scan_outcomes",
    f"""WITH {_SCAN[5:]} SELECT home.domain, CASE WHEN good.domain IS NULL THEN 'not_platform' ELSE 'scanned' END AS outcome FROM home LEFT JOIN good ON good.domain = home.domain""",
)
def scan_outcomes(spark, sf):
    return built_scan(spark, sf).outcomes.select("domain", "outcome")


@query(
    "snapshot_replay",
    f"""{PAGE_CTES}, hits AS (SELECT p.page_ord, d.capability FROM sf p JOIN (VALUES {', '.join("('" + e.capability + "', '" + kind + "', '" + pat.replace(chr(39), chr(39) * 2) + "')" for e in _APPS for kind in ('script_host', 'script_src', 'dom_marker') for pat in getattr(e, kind))}) AS d(capability, kind, pattern)
          ON (d.kind = 'dom_marker' AND regexp_matches(p.html, '(?i)' || d.pattern)) OR EXISTS (SELECT 1 FROM urls u WHERE u.page_ord = p.page_ord AND contains(u.u, '//') AND ((d.kind = 'script_host' AND regexp_matches(u.host, '(?i)' || d.pattern)) OR (d.kind = 'script_src' AND regexp_matches(u.u, '(?i)' || d.pattern))))),
        a AS (SELECT page_ord, string_agg(DISTINCT capability, ';' ORDER BY capability) AS caps FROM hits GROUP BY 1),
        ex AS (SELECT page_ord FROM (SELECT page_ord, domain, regexp_extract(lower(regexp_extract(tag, 'href="([^"]*)"', 1)), '//([^/]*)', 1) AS host FROM tags WHERE regexp_matches(tag, '(?i)^<link') AND contains(tag, 'hreflang')) WHERE host <> '' AND NOT ends_with(host, domain) GROUP BY 1 HAVING count(DISTINCT host) >= 2)
        SELECT domain, CAST(p.page_ord AS VARCHAR) AS timestamp, a.caps IS NOT NULL AS workaround_any, coalesce(a.caps, '') AS workaround_capabilities,
          (regexp_matches(p.html, '(?i)/account/login/multipass') OR regexp_matches(p.html, '(?i)shopify\\s+plus') OR ex.page_ord IS NOT NULL) AS fingerprint_any
        FROM sf p LEFT JOIN a ON a.page_ord = p.page_ord LEFT JOIN ex ON ex.page_ord = p.page_ord WHERE p.page_ord % 10 <> 9""",
)
def snapshot_replay(spark, sf):
    pages = storefront_pages(spark, sf)
    status = F.when(F.col("page_ord") % 10 == 9, 404).otherwise(200)
    return backtest_plan.replay(pages.select("domain", F.col("page_ord").cast("string").alias("timestamp"), status.alias("status"), "html"))


@query("parser_audit", "SELECT 0 AS differing WHERE FALSE")
def parser_audit(spark, sf):
    """Pages on which the tag scan and a real HTML parser disagree about scripts, links, metas or anchors; none expected."""
    pages = storefront_pages(spark, sf).select("page_ord", "html")
    lists = ["script_srcs", "link_hrefs", "anchors"]
    scanned = extraction.extract(pages).select("page_ord", *[F.hash(c).alias(f"a_{c}") for c in lists], F.hash("meta").alias("a_meta"))
    parsed = extraction.extract_parsed(pages).select("page_ord", *[F.hash(c).alias(f"b_{c}") for c in lists], F.hash("meta").alias("b_meta"))
    differ = F.lit(False)
    for c in [*lists, "meta"]:
        differ = differ | (F.col(f"a_{c}") != F.col(f"b_{c}"))
    return scanned.join(parsed, "page_ord").where(differ).select(F.lit(1).alias("differing"))


@query("crosssection_report")
def crosssection_report(spark, sf):
    """The evaluation job on the scored scan, with a store's label taken from its domain's length."""
    feats = built_scan(spark, sf).features
    even = F.length("domain") % 2 == 0
    _, metrics = crosssection.run_crosssection(
        feats, feats.where(even).select("domain"), feats.where(~even).select("domain")
    )
    return metrics


# ---- streaming --------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name: str):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_page_intake", "SELECT DISTINCT 'https://h' || user_id || '.example/' || event_type AS url, CAST(ts AS DATE) AS scan_day FROM events")
def stream_page_intake(spark, sf):
    events = _stream(spark, sf, "events")
    pages = events.select(
        F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example/"), F.col("event_type")).alias("url"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
    )
    out = _folder(spark, "intake")
    jobs.page_intake(pages, f"{out}/_checkpoint", f"{out}/pages", "40 days").awaitTermination()
    return spark.read.parquet(f"{out}/pages").select("url", "scan_day")


@query(
    "stream_posts",
    f"""WITH {POSTS} SELECT company_slug, external_id, domain, posted_at, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_seen FROM posts""",
)
def stream_posts(spark, sf):
    shaped = sightings(spark, sf)
    posts_folder = _folder(spark, "sightings")
    # Several source files, so the stream runs several micro-batches.
    shaped.repartition(4).write.parquet(posts_folder)
    stream = spark.readStream.schema(shaped.schema).option("maxFilesPerTrigger", 2).parquet(posts_folder)
    out = _folder(spark, "posts")
    jobs.post_sightings(stream, f"{out}/_checkpoint", f"{out}/table").awaitTermination()
    return tables.merged(spark, f"{out}/table").select(
        "company_slug",
        "external_id",
        "domain",
        "posted_at",
        F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
    )


@query("stream_post_months", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def stream_post_months(spark, sf):
    events = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("first_seen_at"))
    out = _folder(spark, "months")
    jobs.post_months(events, f"{out}/_checkpoint", f"{out}/table").awaitTermination()
    return tables.merged(spark, f"{out}/table").select("month", "n")


@query(
    "stream_conversion_alerts",
    """WITH st AS (SELECT 'u' || user_id AS domain, CAST(date_trunc('week', ts) AS DATE) AS scan_date, bool_or(event_type = 'purchase' AND value >= 100) AS verified FROM events GROUP BY 1, 2)
       SELECT n.domain, p.scan_date AS prior_scan_date, n.scan_date FROM st n JOIN st p ON p.domain = n.domain AND p.scan_date = n.scan_date - 7 WHERE n.verified AND NOT p.verified""",
)
def stream_conversion_alerts(spark, sf):
    week = F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp")))
    purchase = (F.col("event_type") == "purchase") & (F.col("value") >= 100)
    states = table(spark, sf, "events").groupBy(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), week.alias("scan_date")
    ).agg(F.bool_or(purchase).alias("verified"))
    seq = (F.date_diff("scan_date", F.lit("2024-01-01").cast("date")) / 7 + 1).cast("long")
    shaped = materialize(states.select("domain", seq.alias("scan_seq"), "scan_date", "verified"), "states")
    # Two weeks a batch; a third of the scans come a batch too late, behind the store's next scans.
    late = F.when(F.pmod(F.xxhash64("domain", "scan_seq"), F.lit(3)) == 0, 2).otherwise(0)
    arrival = F.ceil((F.col("scan_seq") + late) / 2)
    source, files = _folder(spark, "states"), 2
    for n in range(1, shaped.agg(F.max(arrival)).first()[0] + 1):
        shaped.where(arrival == n).repartition(files).write.mode("append").parquet(source)
    stream = spark.readStream.schema(shaped.schema).option("maxFilesPerTrigger", files).parquet(source)
    out = _folder(spark, "alerts")
    jobs.conversion_alerts(stream, f"{out}/_checkpoint", f"{out}/alerts", "28 days").awaitTermination()
    return spark.read.schema(jobs.ALERTS).parquet(f"{out}/alerts")
