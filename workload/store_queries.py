"""Queries over stores, products and variants: catalog, features, score, panel, controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import catalog, controls, features, keyed, panel, score, series
from vitrine.functions import dates, values
from vitrine.sources import archive
from workload.base import SCAN_DAY, products, query, r6, table, variants

def day():
    return F.lit(SCAN_DAY).cast("date")


PRODUCTS = "prod AS (SELECT 'c' || o_custkey AS domain, CAST(o_orderdate AS DATE) AS created, o_orderpriority AS vendor, o_orderkey FROM orders)"
VARIANTS = (
    "vars AS (SELECT 'c' || o_custkey AS domain, l_extendedprice AS price, l_returnflag = 'N' AS available, l_suppkey AS supplier "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
_W = f"""count(*) FILTER (created >= DATE '{SCAN_DAY}' - 90) AS products_created_last_90d,
  count(*) FILTER (created >= DATE '{SCAN_DAY}' - 365) AS products_created_last_365d,
  count(*) FILTER (created >= DATE '{SCAN_DAY}' - 730 AND created < DATE '{SCAN_DAY}' - 365) AS products_created_prior_365d"""


@query(
    "catalog_windows",
    f"""WITH {PRODUCTS} SELECT domain, count(*) AS product_count, min(created) AS earliest_created_at, max(created) AS latest_created_at, {_W},
        count(DISTINCT vendor) AS vendor_count FROM prod GROUP BY 1""",
)
def catalog_windows(spark, sf):
    return catalog.product_aggregates(products(spark, sf), ["domain"], day())


@query(
    "catalog_variants",
    f"""WITH {VARIANTS} SELECT domain, count(*) AS variant_count, round(avg(CAST(available AS INTEGER)), 6) AS available_share,
        round(median(price), 6) AS median_price FROM vars GROUP BY 1""",
)
def catalog_variants(spark, sf):
    out = catalog.variant_aggregates(variants(spark, sf), ["domain"])
    return out.select("domain", "variant_count", r6("available_share", "available_share"), r6("median_price", "median_price"))


def feed_pages(spark, sf):
    """Every line item as one feed page of its order's store: page number, status, JSON body.

    One page per (store, page number): of repeated line numbers of an order the smallest price stays.
    """
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_suppkey", "l_returnflag", "l_quantity")
    lines = keyed.keep_first(wide, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_shipdate"])
    item = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T08:00:00Z")).alias("created_at"),
                    F.col("l_suppkey").cast("string").alias("vendor"),
                    F.array(
                        F.struct(
                            F.col("l_extendedprice").cast("string").alias("price"),
                            F.when(F.col("l_linenumber") != 3, F.col("l_returnflag") == "N").alias("available"),
                        )
                    ).alias("variants"),
                )
            ).alias("products")
        )
    )
    odd = F.col("l_quantity") == 48
    empty = F.col("l_quantity") == 49
    return lines.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("domain"),
        F.lit(SCAN_DAY).cast("date").alias("scan_date"),
        F.col("l_linenumber").alias("page"),
        F.when(F.col("l_quantity") == 50, 503).otherwise(200).alias("status"),
        F.when(F.col("l_quantity") == 47, F.lit("robots_disallow")).alias("skip_reason"),
        F.when(odd, F.lit("<html>blocked</html>")).when(empty, F.lit('{"products": []}')).otherwise(item).alias("body"),
    )


FEED = """feed AS (SELECT 'o' || l_orderkey AS domain, l_linenumber AS page, max(CASE WHEN l_quantity IN (47, 48, 50) THEN 1 ELSE 0 END) AS bad,
    min(CASE WHEN l_quantity = 49 THEN 1 ELSE 0 END) AS empty, max(CASE WHEN l_quantity = 49 THEN 1 ELSE 0 END) AS any_empty,
    min(CASE WHEN l_quantity = 47 THEN 'robots_disallow' END) AS reason FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2),
  allp AS (SELECT d.domain, p.page, coalesce(f.bad, 1) AS bad, coalesce(f.any_empty, 0) AS empty, f.reason FROM (SELECT DISTINCT domain FROM feed) d
    CROSS JOIN (SELECT unnest(range(1, 9)) AS page) p LEFT JOIN feed f ON f.domain = d.domain AND f.page = p.page),
  stop AS (SELECT domain, min(page) FILTER (page = 8 OR bad = 1 OR empty = 1) AS stop_at FROM allp GROUP BY 1),
  walk AS (SELECT s.domain, stop_at, CASE WHEN stop_at = 8 THEN 0 WHEN a.bad = 0 AND a.empty = 1 THEN 1 ELSE 0 END AS by_empty, a.reason
    FROM stop s JOIN allp a ON a.domain = s.domain AND a.page = s.stop_at)"""


_ONE = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_shipdate) AS rn FROM lineitem) WHERE rn = 1),"""


@query(
    "take_while_pages",
    f"""WITH {_ONE} {FEED.replace('FROM lineitem', 'FROM one')}
        SELECT domain, (stop_at > 1 OR by_empty = 1) AS products_json_available,
          CASE WHEN stop_at = 1 AND by_empty = 0 THEN coalesce(reason, 'not_available') END AS skip_reason,
          CASE WHEN stop_at > 1 OR by_empty = 1 THEN CAST(stop_at - 1 + by_empty AS BIGINT) END AS pages_fetched,
          CASE WHEN stop_at > 1 OR by_empty = 1 THEN by_empty = 0 END AS truncated FROM walk""",
)
def take_while_pages(spark, sf):
    parsed = catalog.parse_feed(feed_pages(spark, sf))
    summary, _ = catalog.walk(parsed, ["domain"], max_pages=7)
    return summary


@query(
    "catalog_feed",
    f"""WITH {_ONE} {FEED.replace('FROM lineitem', 'FROM one')},
        kept AS (SELECT w.domain, l.* FROM walk w JOIN one l ON 'o' || l.l_orderkey = w.domain AND l.l_linenumber < w.stop_at),
        agg AS (SELECT domain, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first_day,
            count(*) FILTER (CAST(l_shipdate AS DATE) >= DATE '{SCAN_DAY}' - 365) AS last365, count(DISTINCT l_suppkey) AS vendors,
            round(avg(CASE WHEN l_linenumber <> 3 THEN CAST(l_returnflag = 'N' AS INTEGER) END), 6) AS available_share, round(median(l_extendedprice), 6) AS median_price FROM kept GROUP BY 1)
        SELECT w.domain, CASE WHEN stop_at > 1 OR by_empty = 1 THEN coalesce(n, 0) END AS product_count, first_day AS earliest_created_at,
          CASE WHEN stop_at > 1 OR by_empty = 1 THEN coalesce(last365, 0) END AS products_created_last_365d,
          CASE WHEN stop_at > 1 OR by_empty = 1 THEN coalesce(n, 0) END AS variant_count,
          CASE WHEN stop_at > 1 OR by_empty = 1 THEN coalesce(vendors, 0) END AS vendor_count, available_share, median_price
        FROM walk w LEFT JOIN agg a ON a.domain = w.domain""",
)
def catalog_feed(spark, sf):
    out = catalog.catalog_snapshots(feed_pages(spark, sf), ["domain", "scan_date"], max_pages=7)
    return out.select(
        "domain",
        "product_count",
        "earliest_created_at",
        "products_created_last_365d",
        "variant_count",
        "vendor_count",
        r6("available_share", "available_share"),
        r6("median_price", "median_price"),
    )


# ---- features and score -----------------------------------------------------------------------------

_CAPS = ["b2b_wholesale", "multistore_sync", "launch_scheduling", "discount_logic", "sso_login", "international_markets", "checkout_customization", "staff_permissions"]


def matches(spark, sf):
    """Every line item as an app match of its store: supplier as app, verified by status, capability by supplier, that of most items one that counts nothing."""
    owner = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    strained = (F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 40)
    capability = F.when(strained, F.element_at(F.array(*[F.lit(c) for c in _CAPS]), (F.col("l_suppkey") % 8 + 1).cast("int"))).otherwise("checkout_customization")
    return table(spark, sf, "lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain"),
        F.concat(F.lit("app"), F.col("l_suppkey").cast("string")).alias("key"),
        capability.alias("capability"),
        (F.col("l_linestatus") == "O").alias("verified"),
    )


_CAP_SQL = "CASE WHEN l_discount < 0.09 OR l_quantity < 40 THEN 'checkout_customization' " + " ".join(f"WHEN l_suppkey % 8 = {i} THEN '{c}'" for i, c in enumerate(_CAPS)) + " END"
MATCHES = f"""m AS (SELECT 'c' || o_custkey AS domain, 'app' || l_suppkey AS key, {_CAP_SQL} AS capability, l_linestatus = 'O' AS verified
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  counted AS (SELECT * FROM m WHERE capability <> 'checkout_customization')"""

_FLAG_SQL = ", ".join(f"CAST(coalesce(bool_or(capability = '{c}'), FALSE) AS INTEGER) AS {flag}" for c, flag in features.CAPABILITY_FLAGS.items())
_V_SQL = ", ".join(f"bool_or(verified) FILTER (capability = '{c}') AS v_{c}" for c in features.CAPABILITY_FLAGS)
APPS = f"""apps AS (SELECT domain, count(DISTINCT key) AS workaround_app_count, count(DISTINCT capability) AS workaround_capability_count,
  count(*) FILTER (verified) AS workaround_verified_count, count(DISTINCT key) FILTER (capability = 'international_markets') AS workaround_intl_app_count,
  {_FLAG_SQL}, {_V_SQL} FROM counted GROUP BY 1)"""


@query(
    "feature_flags",
    f"""WITH {MATCHES}, {APPS} SELECT domain, workaround_app_count, workaround_capability_count, workaround_verified_count, workaround_intl_app_count,
        {', '.join(features.CAPABILITY_FLAGS.values())}, {', '.join('v_' + c for c in features.CAPABILITY_FLAGS)} FROM apps""",
)
def feature_flags(spark, sf):
    out = features.app_features(matches(spark, sf), ["domain"])
    return out.select(
        "domain",
        "workaround_app_count",
        "workaround_capability_count",
        "workaround_verified_count",
        "workaround_intl_app_count",
        *features.CAPABILITY_FLAGS.values(),
        *[F.element_at("capability_verified", F.lit(c)).alias(f"v_{c}") for c in features.CAPABILITY_FLAGS],
    )


@query(
    "feature_growth",
    f"""WITH {PRODUCTS}, c AS (SELECT domain, {_W} FROM prod GROUP BY 1)
        SELECT domain, round((products_created_last_365d - products_created_prior_365d) / CAST(greatest(products_created_prior_365d, 1) AS DOUBLE), 6) AS catalog_growth_yoy FROM c""",
)
def feature_growth(spark, sf):
    counts = catalog.product_aggregates(products(spark, sf), ["domain"], day())
    growth = values.growth(F.col("products_created_last_365d"), F.col("products_created_prior_365d"))
    return counts.select("domain", r6(growth, "catalog_growth_yoy"))


SETTINGS = score.ScoreSettings(
    thresholds={**score.THRESHOLDS, "high_growth_last_90d": 1, "large_catalog_products": 12, "review_scale_1k": 20, "review_scale_5k": 30}
)


def feature_table(spark, sf):
    """The 24-field feature row per store: apps from line items, catalog from orders and line items, reviews from open lines."""
    stores = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("domain"),
        F.col("c_nationkey").cast("long").alias("hreflang_alt_count"),
        F.col("c_mktsegment").alias("theme_name"),
        (F.col("c_custkey") % 9 != 4).alias("_feed"),
    )
    by_product = catalog.product_aggregates(products(spark, sf), ["domain"], day())
    by_variant = catalog.variant_aggregates(variants(spark, sf), ["domain"])
    shop = stores.select("domain", F.col("_feed").alias("products_json_available")).join(by_product, "domain", "left").join(by_variant, "domain", "left")
    vendor = F.when(F.col("supplier") % 3 == 0, "judgeme").otherwise("loox")
    readings = variants(spark, sf).where("open_line").groupBy("domain", vendor.alias("vendor")).agg(F.count(F.lit(1)).alias("review_count"))
    return features.build_features(stores, matches(spark, sf), shop, readings, ["domain"])


FEATURES = f"""{PRODUCTS}, {VARIANTS}, {MATCHES}, {APPS},
  c AS (SELECT domain, count(*) AS product_count, {_W}, count(DISTINCT vendor) AS vendor_count FROM prod GROUP BY 1),
  v AS (SELECT domain, count(*) AS variant_count, avg(CAST(available AS INTEGER)) AS available_share, median(price) AS median_price FROM vars GROUP BY 1),
  rv AS (SELECT domain, max(n) AS review_count_max, count(*) AS review_vendor_count FROM (
      SELECT 'c' || o_custkey AS domain, CASE WHEN l_suppkey % 3 = 0 THEN 'judgeme' ELSE 'loox' END AS vendor, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' GROUP BY 1, 2) GROUP BY 1),
  f AS (SELECT s.domain, coalesce(workaround_app_count, 0) AS workaround_app_count, coalesce(workaround_capability_count, 0) AS workaround_capability_count,
      {', '.join(f'coalesce({x}, 0) AS {x}' for x in features.CAPABILITY_FLAGS.values())},
      coalesce(workaround_intl_app_count, 0) AS workaround_intl_app_count, coalesce(workaround_verified_count, 0) AS workaround_verified_count,
      {', '.join('v_' + x for x in features.CAPABILITY_FLAGS)},
      CASE WHEN feed THEN product_count END AS product_count,
      CASE WHEN feed THEN (products_created_last_365d - products_created_prior_365d) / CAST(greatest(products_created_prior_365d, 1) AS DOUBLE) END AS catalog_growth_yoy,
      CASE WHEN feed THEN products_created_last_90d END AS products_last_90d, CASE WHEN feed THEN variant_count END AS variant_count,
      CASE WHEN feed THEN vendor_count END AS vendor_count, CASE WHEN feed THEN available_share END AS available_share,
      CASE WHEN feed THEN median_price END AS median_price, review_count_max, coalesce(review_vendor_count, 0) AS review_vendor_count,
      CAST(coalesce(review_vendor_count, 0) > 0 AS INTEGER) AS has_reviews_vendor, hreflang_alt_count, theme_name, CAST(feed AS INTEGER) AS products_json_available
    FROM (SELECT 'c' || c_custkey AS domain, CAST(c_nationkey AS BIGINT) AS hreflang_alt_count, c_mktsegment AS theme_name, c_custkey % 9 <> 4 AS feed FROM customer) s
    LEFT JOIN apps ON apps.domain = s.domain LEFT JOIN c ON c.domain = s.domain LEFT JOIN v ON v.domain = s.domain LEFT JOIN rv ON rv.domain = s.domain)"""

_PLAIN = [
    "domain", "workaround_app_count", "workaround_capability_count", *features.CAPABILITY_FLAGS.values(), "workaround_intl_app_count",
    "workaround_verified_count", "product_count", "products_last_90d", "variant_count", "vendor_count", "review_count_max",
    "review_vendor_count", "has_reviews_vendor", "hreflang_alt_count", "theme_name", "products_json_available",
]
_ROUNDED = ["catalog_growth_yoy", "available_share", "median_price"]


@query("feature_rows", f"WITH {FEATURES} SELECT {', '.join(_PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM f")
def feature_rows(spark, sf):
    return feature_table(spark, sf).select(*_PLAIN, *[r6(c, c) for c in _ROUNDED])


def _cap_sql(flag: str, capability: str, weight: float) -> str:
    active = f"{flag} = 1" + (" AND workaround_intl_app_count >= 2" if flag == "workaround_intl" else "")
    return f"""SELECT domain, '{flag}' AS component, CASE WHEN NOT ({active}) THEN 0.0 WHEN v_{capability} = FALSE THEN {weight} * 0.5 ELSE {weight} END AS contribution,
      {weight} AS weight, ({active}) AS active, CASE WHEN {active} THEN v_{capability} END AS verified, CASE WHEN {active} AND v_{capability} = FALSE THEN 'unverified_half_weight' END AS note FROM f"""


SCORES = (
    f"{FEATURES}, comp AS ("
    + " UNION ALL ".join(_cap_sql(flag, cap, score.WEIGHTS[flag]) for flag, cap in score.CAPABILITY_COMPONENTS.items())
    + """ UNION ALL SELECT domain, 'high_growth', CASE WHEN catalog_growth_yoy >= 0.5 AND products_last_90d >= 1 THEN 2.0 ELSE 0.0 END, 2.0,
      coalesce(catalog_growth_yoy >= 0.5 AND products_last_90d >= 1, FALSE), NULL, CASE WHEN catalog_growth_yoy IS NULL OR products_last_90d IS NULL THEN 'null_input' END FROM f
    UNION ALL SELECT domain, 'large_catalog', CASE WHEN product_count >= 12 THEN 1.0 ELSE 0.0 END, 1.0, coalesce(product_count >= 12, FALSE), NULL, CASE WHEN product_count IS NULL THEN 'null_input' END FROM f
    UNION ALL SELECT domain, 'review_scale', CASE WHEN review_count_max >= 30 THEN 2.0 WHEN review_count_max >= 20 THEN 1.0 ELSE 0.0 END,
      CASE WHEN review_count_max IS NULL OR review_count_max >= 30 THEN 2.0 ELSE 1.0 END, coalesce(review_count_max >= 20, FALSE), NULL, CASE WHEN review_count_max IS NULL THEN 'null_input' END FROM f),
  tot AS (SELECT domain, CAST(sum(contribution) AS DOUBLE) AS score FROM comp GROUP BY 1)"""
)


def scored(spark, sf):
    return score.with_score(feature_table(spark, sf), SETTINGS)


@query("score_components", f"WITH {SCORES} SELECT domain, component, CAST(contribution AS DOUBLE) AS contribution, CAST(weight AS DOUBLE) AS weight, active, verified, note FROM comp")
def score_components(spark, sf):
    return score.component_rows(scored(spark, sf), ["domain"])


@query("score_total", f"WITH {SCORES} SELECT domain, score FROM tot")
def score_total(spark, sf):
    return scored(spark, sf).select("domain", "score")


@query("score_check", f"WITH {SCORES} SELECT domain, score FROM tot WHERE score < 0 OR score > 15")
def score_check(spark, sf):
    return score.broken_totals(scored(spark, sf), ["domain"]).select("domain", "score")


@query(
    "share_at_threshold",
    f"""WITH {SCORES} SELECT count(*) AS stores, count(*) FILTER (score >= 3) AS at_threshold,
        round(count(*) FILTER (score >= 3) / CAST(count(*) AS DOUBLE), 6) AS share_at_threshold FROM tot""",
)
def share_at_threshold(spark, sf):
    out = series.share_at_threshold(scored(spark, sf))
    return out.withColumn("share_at_threshold", F.round("share_at_threshold", 6))


# ---- panel ------------------------------------------------------------------------------------------


def candidates(spark, sf):
    stores = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("domain"),
        (F.col("c_acctbal") > 0).alias("is_platform"),
        "c_custkey",
        "c_mktsegment",
    )
    counts = products(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("product_count"))
    shop = stores.select("domain", (F.col("c_custkey") % 9 != 4).alias("products_json_available")).join(counts, "domain", "left")
    positives = stores.where(F.col("c_mktsegment") == "BUILDING").select("domain")
    marked = variants(spark, sf).where((F.col("price") > 100000) & F.col("available")).select("domain").distinct()
    return panel.eligible(stores, shop, positives, marked)


CANDIDATES = f"""{PRODUCTS}, {VARIANTS}, cand AS (
  SELECT s.domain, c.n AS product_count FROM (SELECT 'c' || c_custkey AS domain, * FROM customer) s LEFT JOIN (SELECT domain, count(*) AS n FROM prod GROUP BY 1) c ON c.domain = s.domain
  WHERE c_acctbal > 0 AND c_custkey % 9 <> 4 AND c_mktsegment <> 'BUILDING' AND s.domain NOT IN (SELECT domain FROM vars WHERE price > 100000 AND available))"""
STRATA = f"""{CANDIDATES}, ord AS (SELECT product_count, row_number() OVER (ORDER BY product_count) - 1 AS i, count(*) OVER () AS n FROM cand WHERE product_count IS NOT NULL),
  e AS (SELECT max(n) AS n, max(product_count) FILTER (i = n // 4) AS q1, max(product_count) FILTER (i = n // 2) AS q2, max(product_count) FILTER (i = 3 * n // 4) AS q3 FROM ord),
  strata AS (SELECT domain, product_count, CASE WHEN n < 4 OR product_count IS NULL OR product_count <= q1 THEN 0 WHEN product_count <= q2 THEN 1 WHEN product_count <= q3 THEN 2 ELSE 3 END AS stratum FROM cand, e)"""


@query("panel_eligible", f"WITH {CANDIDATES} SELECT domain, product_count FROM cand")
def panel_eligible(spark, sf):
    return candidates(spark, sf)


@query("panel_strata", f"WITH {STRATA} SELECT domain, product_count, stratum FROM strata")
def panel_strata(spark, sf):
    return panel.with_stratum(candidates(spark, sf)).select("domain", "product_count", "stratum")


@query(
    "panel_sample",
    f"""WITH {STRATA}, h AS (SELECT *, sha256('7:' || domain) AS hash FROM strata),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY hash) AS rs FROM h),
        p AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rs <= 20 THEN 0 ELSE 1 END, CASE WHEN rs <= 20 THEN stratum END, hash) AS place FROM r)
        SELECT domain, product_count, stratum, place FROM p WHERE place <= 83""",
)
def panel_sample(spark, sf):
    return panel.select_panel(candidates(spark, sf), size=83).withColumn("place", F.col("place").cast("long"))


# ---- controls ---------------------------------------------------------------------------------------


def _groups(spark, sf):
    stores = table(spark, sf, "customer").withColumn("domain", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    migrators = stores.where(F.col("c_mktsegment") == "MACHINERY").select(
        "domain", F.date_format(F.add_months(F.lit("2023-09-01").cast("date"), (F.col("c_custkey") % 7).cast("int")), "yyyy-MM").alias("anchor_month")
    )
    negatives = stores.where(F.col("c_mktsegment") != "MACHINERY").select("domain")
    sizes = products(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("product_count"))
    return migrators, negatives, sizes


GROUPS = f"""{PRODUCTS}, sizes AS (SELECT domain, count(*) AS product_count FROM prod GROUP BY 1),
  mig AS (SELECT 'c' || c_custkey AS domain, strftime(DATE '2023-09-01' + to_months(CAST(c_custkey % 7 AS INTEGER)), '%Y-%m') AS anchor_month FROM customer WHERE c_mktsegment = 'MACHINERY'),
  neg AS (SELECT 'c' || c_custkey AS domain FROM customer WHERE c_mktsegment <> 'MACHINERY'),
  med AS (SELECT median(product_count) AS m FROM mig JOIN sizes USING (domain)),
  ctrl AS (SELECT neg.domain, product_count FROM neg JOIN sizes USING (domain), med ORDER BY abs(product_count - m), neg.domain LIMIT 20)"""


@query("matched_controls", f"WITH {GROUPS} SELECT domain, product_count, 'nearest_size' AS method FROM ctrl")
def matched_controls(spark, sf):
    migrators, negatives, sizes = _groups(spark, sf)
    return controls.matched_controls(negatives, migrators, sizes)


@query(
    "sampled_controls",
    f"""WITH {GROUPS} SELECT neg.domain, product_count, 'seeded_sample' AS method FROM neg LEFT JOIN sizes USING (domain)
        ORDER BY sha256('7:' || neg.domain) LIMIT 20""",
)
def sampled_controls(spark, sf):
    migrators, negatives, sizes = _groups(spark, sf)
    unknown = sizes.join(migrators.select("domain"), "domain", "left_anti")
    return controls.matched_controls(negatives, migrators, unknown)


REFERENCE = "ref AS (SELECT anchor_month AS reference_month FROM (SELECT anchor_month, row_number() OVER (ORDER BY anchor_month) - 1 AS i, count(*) OVER () AS n FROM mig) WHERE i = n // 2)"


@query("reference_month", f"WITH {GROUPS}, {REFERENCE} SELECT reference_month FROM ref")
def reference_month(spark, sf):
    return controls.reference_month(_groups(spark, sf)[0])


GRID = f"""{GROUPS}, {REFERENCE},
  plans AS (SELECT domain, 'migrator' AS "group", anchor_month FROM mig UNION ALL SELECT domain, 'control', reference_month FROM ctrl, ref),
  grid AS (SELECT domain, "group", anchor_month, o AS "offset", strftime(CAST(anchor_month || '-01' AS DATE) + to_months(CAST(o AS INTEGER)), '%Y-%m') AS target_month,
      CAST(CAST(anchor_month || '-01' AS DATE) + to_months(CAST(o AS INTEGER)) AS DATE) + 14 AS target_day FROM plans, (SELECT unnest([-18, -12, -6, -3, 3]) AS o))"""


def planned(spark, sf):
    migrators, negatives, sizes = _groups(spark, sf)
    chosen = controls.matched_controls(negatives, migrators, sizes)
    return controls.plans(migrators, chosen, controls.reference_month(migrators))


@query("backtest_grid", f'WITH {GRID} SELECT domain, "group", anchor_month, "offset", target_month, target_day FROM grid')
def backtest_grid(spark, sf):
    return controls.grid(planned(spark, sf))


def snapshots(spark, sf):
    """Events as archive captures of a store, moved back over three years; every fourth timestamp is damaged."""
    ev = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    moved = F.date_sub(F.to_date("ts"), (F.col("event_id") % 1200).cast("int"))
    stamp = F.concat(F.date_format(moved, "yyyyMMdd"), F.lpad((F.col("event_id") % 240000).cast("string"), 6, "0"))
    return ev.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("domain"),
        F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("20239"), F.substring(stamp, 6, 9))).otherwise(stamp).alias("timestamp"),
        "event_type",
        "value",
    )


SNAPS = """raw AS (SELECT 'c' || user_id AS domain, strftime(CAST(ts AS DATE) - CAST(event_id % 1200 AS INTEGER), '%Y%m%d') || lpad(CAST(event_id % 240000 AS VARCHAR), 6, '0') AS stamp, event_id, event_type, value FROM events),
  snaps AS (SELECT domain, CASE WHEN event_id % 4 = 3 THEN '20239' || substr(stamp, 6, 9) ELSE stamp END AS timestamp, event_type, value FROM raw),
  dated AS (SELECT *, CAST(try_strptime(substr(timestamp, 1, 8), '%Y%m%d') AS DATE) AS day FROM snaps)"""
PICKS = f"""{GRID}, {SNAPS}, picked AS (SELECT g.*, d.timestamp, abs(date_diff('day', g.target_day, d.day)) AS distance,
    row_number() OVER (PARTITION BY g.domain, g."group", g.target_month ORDER BY abs(date_diff('day', g.target_day, d.day)) NULLS LAST, d.timestamp NULLS LAST) AS rn
  FROM grid g LEFT JOIN dated d ON d.domain = g.domain AND abs(date_diff('day', g.target_day, d.day)) <= 45),
  pick AS (SELECT * FROM picked WHERE rn = 1)"""


@query("asof_nearest", f'WITH {PICKS} SELECT domain, "group", "offset", target_month, timestamp, CAST(distance AS INTEGER) AS distance FROM pick')
def asof_nearest(spark, sf):
    out = controls.pick_snapshots(controls.grid(planned(spark, sf)), snapshots(spark, sf))
    return out.select("domain", "group", "offset", "target_month", "timestamp", "distance")


@query(
    "archive_index",
    f"""WITH {SNAPS} SELECT domain, timestamp, CASE WHEN value < 3 THEN '404' ELSE '200' END AS status, 'text/html' AS mimetype, event_type AS digest FROM snaps WHERE event_type <> 'signup'""",
)
def archive_index(spark, sf):
    """Each capture as an archive-index answer of its own, with a header and a short row; sign-ups answer no JSON."""
    snaps = snapshots(spark, sf)
    status = F.when(F.col("value") < 3, "404").otherwise("200")
    head = F.array(*[F.lit(x) for x in ("timestamp", "statuscode", "mimetype", "digest")])
    body = F.to_json(F.array(head, F.array(F.col("timestamp"), status, F.lit("text/html"), F.col("event_type")), F.array(F.lit("short"))))
    answers = snaps.select("domain", F.when(F.col("event_type") == "signup", "<html>").otherwise(body).alias("body"))
    return archive.parse_archive_index(answers)


def backtest(spark, sf):
    snaps = snapshots(spark, sf)
    picked = controls.pick_snapshots(controls.grid(planned(spark, sf)), snaps)
    status = F.when(F.col("value") < 3, 404).otherwise(200)
    keys = ["domain", "timestamp"]
    archived = snaps.select(*keys, status.alias("status"), F.lit("<html></html>").alias("html"))
    apps = snaps.where(F.col("event_type").isin("click", "view", "purchase")).select(*keys, F.col("event_type").alias("key"), F.concat(F.lit("cap_"), "event_type").alias("capability"))
    marks = snaps.where(F.col("event_type") == "error").select(*keys, F.lit("mark").alias("key"))
    return controls.backtest_rows(picked, controls.snapshot_hits(archived, apps, marks))


BACKTEST = f"""{PICKS}, hit AS (SELECT domain, timestamp, bool_or(event_type IN ('click', 'view', 'purchase')) AS any_app, bool_or(value >= 3) AS readable,
    coalesce(string_agg(DISTINCT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'cap_' || event_type END, ';' ORDER BY CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'cap_' || event_type END), '') AS caps, bool_or(event_type = 'error') AS mark FROM snaps GROUP BY 1, 2),
  bt AS (SELECT p.domain, p."group", p.anchor_month AS migration_month, p."offset", coalesce(h.readable, FALSE) AS snapshot_found,
    CASE WHEN h.readable THEN h.any_app END AS workaround_any, CASE WHEN h.readable THEN h.caps END AS workaround_capabilities, CASE WHEN h.readable THEN h.mark END AS fingerprint_any
    FROM pick p LEFT JOIN hit h ON h.domain = p.domain AND h.timestamp = p.timestamp)"""


@query("backtest_rows", f'WITH {BACKTEST} SELECT domain, "group", migration_month, "offset", snapshot_found, workaround_any, workaround_capabilities, fingerprint_any FROM bt')
def backtest_rows(spark, sf):
    return backtest(spark, sf)


@query(
    "backtest_coverage",
    f"WITH {BACKTEST} SELECT count(*) AS requested, count(*) FILTER (snapshot_found) AS found, round(count(*) FILTER (snapshot_found) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM bt",
)
def backtest_coverage(spark, sf):
    return controls.coverage(backtest(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query(
    "backtest_prevalence",
    f"""WITH {BACKTEST} SELECT g."group", o."offset", count(bt.domain) AS n_found, round(avg(CAST(workaround_any AS INTEGER)), 6) AS prevalence
        FROM (SELECT unnest(['migrator', 'control']) AS "group") g CROSS JOIN (SELECT unnest([-18, -12, -6, -3, 3]) AS "offset") o
        LEFT JOIN bt ON bt."group" = g."group" AND bt."offset" = o."offset" AND snapshot_found GROUP BY 1, 2""",
)
def backtest_prevalence(spark, sf):
    return controls.prevalence(backtest(spark, sf)).withColumn("prevalence", F.round("prevalence", 6))


@query(
    "backtest_earliest",
    f"""WITH {BACKTEST} SELECT domain, min("offset") AS earliest_offset FROM bt WHERE "group" = 'migrator' AND snapshot_found AND workaround_any GROUP BY 1""",
)
def backtest_earliest(spark, sf):
    return controls.earliest_offsets(backtest(spark, sf))


# ---- dates ------------------------------------------------------------------------------------------


@query(
    "month_math",
    """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y/%m') WHEN o_orderkey % 13 = 0 THEN '1997-13' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders),
       d AS (SELECT *, CASE WHEN regexp_matches(month, '^[0-9]{4}-(0[1-9]|1[0-2])$') THEN CAST(month || '-01' AS DATE) END AS d FROM m)
       SELECT o_orderkey, d AS month_start, strftime(d - to_months(18), '%Y-%m') AS back_18, CAST(d AS DATE) + 14 AS midpoint,
         CAST(2001 * 12 + 8 - (year(d) * 12 + month(d)) AS INTEGER) AS age FROM d""",
)
def month_math(spark, sf):
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    month = F.when(k % 11 == 0, F.date_format("o_orderdate", "yyyy/MM")).when(k % 13 == 0, "1997-13").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    m = orders.select("o_orderkey", month.alias("month"))
    start = dates.month_start(F.col("month"))
    return m.select(
        "o_orderkey",
        start.alias("month_start"),
        dates.shift_month(F.col("month"), -18).alias("back_18"),
        dates.month_midpoint(F.col("month")).alias("midpoint"),
        dates.whole_months(start, day()).alias("age"),
    )


@query(
    "quarter_math",
    """SELECT q AS quarter, CASE WHEN q LIKE '%Q%' THEN CAST(CAST(substr(q, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(q, 5) ELSE q END AS prior_quarter, count(*) AS n
       FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE year(o_orderdate) || 'Q' || quarter(o_orderdate) END AS q FROM orders) GROUP BY 1, 2""",
)
def quarter_math(spark, sf):
    placed = F.to_date("o_orderdate")
    q = F.when(F.col("o_orderkey") % 10 == 0, F.date_format(placed, "yyyy-MM")).otherwise(dates.quarter_of(placed))
    named = table(spark, sf, "orders").select(q.alias("quarter"))
    return named.groupBy("quarter", dates.prior_year_quarter(F.col("quarter")).alias("prior_quarter")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "timestamp_parse",
    f"WITH {SNAPS} SELECT timestamp, day, count(*) AS n FROM dated GROUP BY 1, 2",
)
def timestamp_parse(spark, sf):
    return snapshots(spark, sf).groupBy("timestamp", dates.archive_day(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "iso_date_parse",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day,
         CASE WHEN l_linenumber = 5 THEN 'not-a-d' ELSE strftime(l_shipdate, '%Y-%m') END AS month FROM lineitem""",
)
def iso_date_parse(spark, sf):
    n = F.col("l_linenumber")
    text = (
        F.when(n == 4, F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-32T00:00:00Z")))
        .when(n == 5, F.lit("not-a-date"))
        .when(n == 6, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T23:30:00.5-04:00")))
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", text.alias("t"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", dates.iso_day(F.col("t")).alias("day"), dates.iso_month_prefix(F.col("t")).alias("month")
    )


@query(
    "price_parse",
    "SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_linenumber <> 2) AS parsed, round(sum(CASE WHEN l_linenumber <> 2 THEN l_extendedprice END), 2) AS total FROM lineitem GROUP BY 1",
)
def price_parse(spark, sf):
    text = F.when(F.col("l_linenumber") == 2, F.concat(F.col("l_extendedprice").cast("string"), F.lit(" EUR"))).otherwise(F.col("l_extendedprice").cast("string"))
    rows = table(spark, sf, "lineitem").select("l_linenumber", values.price(text).alias("p"))
    return rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("parsed"), F.round(F.sum("p"), 2).alias("total"))
