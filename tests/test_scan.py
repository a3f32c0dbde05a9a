from datetime import date

from pyspark.sql import functions as F

from tests.test_extraction import HOME
from vitrine import schemas
from vitrine.plans import scan
from vitrine.sinks import tables

DAY = date(2026, 9, 8)


def inputs(spark):
    def row(domain, ord_, role, status=200, html=HOME, skip=None):
        return (domain, DAY, ord_, role, f"https://{domain}/{role}", status, skip, {}, html if status == 200 else None, None)

    pages = spark.createDataFrame(
        [
            row("shop.example", 0, "home"),
            row("shop.example", 1, "product", html='<span class="jdgm-prev-badge__text">2,500 reviews</span> /account/login/multipass'),
            row("shop.example", 2, "other", html="limoniapps-discountninja"),
            row("blog.example", 0, "home", html="<p>plain</p>"),
            row("down.example", 0, "home", status=503),
        ],
        schemas.PAGES,
    ).withColumn("panel_version", F.lit("v1"))
    body = '{"products": [{"created_at": "2026-08-15", "vendor": "a", "variants": [{"price": "10", "available": true}]}]}'
    feed = spark.createDataFrame(
        [("shop.example", DAY, "v1", 1, 200, None, body), ("shop.example", DAY, "v1", 2, 200, None, '{"products": []}'), ("blog.example", DAY, "v1", 1, 200, None, body)],
        "domain string, scan_date date, panel_version string, page int, status int, skip_reason string, body string",
    )
    return pages, feed


def test_scan_end_to_end_and_rerun(spark, tmp_path):
    pages, feed = inputs(spark)
    result = scan.build_scan(pages, feed)
    for _ in range(2):
        scan.write_scan(result, str(tmp_path))
    read = lambda name: tables.read_scan_table(spark, str(tmp_path), name)
    for name, df in vars(result).items():
        assert set(df.dtypes) == set(read(name).dtypes), name
    assert {r.domain: r.outcome for r in read("outcomes").collect()} == {
        "shop.example": "scanned", "blog.example": "not_platform", "down.example": "home_failed",
    }
    assert {r.key for r in read("app_matches").collect()} == {"sparklayer", "weglot"}
    assert {r.key for r in read("fingerprint_matches").collect()} == {"multipass_login", "expansion_store_hreflang"}
    f = read("features").collect()
    assert len(f) == 1
    f = f[0]
    assert (f.product_count, f.products_last_90d, f.catalog_growth_yoy, f.review_count_max) == (1, 1, 1.0, 2500)
    assert (f.workaround_app_count, f.workaround_intl, f.hreflang_alt_count, f.theme_name) == (2, 1, 3, "Dawn")
    # b2b 3.0, one international app alone 0, growth without 20 new products 0, reviews above 1000 1.0.
    assert f.score == 4.0 and f.fingerprint_any and f.collection_branch == "nav_link"
    assert read("catalog_snapshots").count() == 1 and read("review_snapshots").first().vendor == "judgeme"
    assert read("assets").where("asset_type = 'script_src'").count() == 3


def test_scan_plan_reads_the_facts_not_the_html(spark):
    pages, feed = inputs(spark)
    built = scan.build_scan(pages, feed)
    plan = built.app_matches._jdf.queryExecution().executedPlan().toString()
    assert "page_facts" in plan and "script_srcs" not in plan.split("ReadSchema", 1)[1].split("\n")[0]


def test_panel_and_index_over_two_scans(spark, tmp_path):
    import pytest

    from vitrine.plans import index, panel

    warehouse = str(tmp_path)
    pages, feed = inputs(spark)
    # A shop whose pages carry no fingerprint at the first scan and a verified one at the second.
    clean = HOME.replace("https://maison.example/", "https://shop.example/fr")
    first = pages.withColumn("html", F.when(F.col("page_role") == "home", F.when(F.col("html") == HOME, clean).otherwise(F.col("html"))))
    later = pages.withColumn("scan_date", F.lit("2026-10-08").cast("date"))
    scan.write_scan(scan.build_scan(first, feed), warehouse)
    with pytest.raises(panel.PanelError):
        panel.build_panel(spark, warehouse, spark.createDataFrame([("shop.example",)], "domain string"), "p1", "2026-09-08")
    nobody = spark.createDataFrame([], "domain string")
    chosen = panel.build_panel(spark, warehouse, nobody, "p1", "2026-09-08")
    assert [r.domain for r in chosen.collect()] == ["shop.example"]
    with pytest.raises(tables.FrozenPanel):
        panel.build_panel(spark, warehouse, nobody, "p1", "2026-09-08")
    scan.write_scan(scan.build_scan(later, feed.withColumn("scan_date", F.lit("2026-10-08").cast("date"))), warehouse)
    for _ in range(2):
        rows = index.run_index(spark, warehouse, "v1", "2026-10-09", panel=chosen).orderBy("scan_date").collect()
    assert [(r.panel_n, r.panel_n_scanned, r.share_at_threshold) for r in rows] == [(1, 1, 1.0), (1, 1, None)]
    assert [(r.n_converted, r.n_prior_selfserve, r.share_converted_since_prior) for r in rows] == [(None, None, None), (1, 1, 1.0)]
    tables.export(spark.read.parquet(f"{warehouse}/index_values"), "index_timeseries", f"{warehouse}/exports", ["scan_date"])
    lines = [x for p in sorted((tmp_path / "exports/index_timeseries").glob("part-*.csv")) for x in p.read_text().splitlines()]
    # A rerun in which the fingerprint is gone leaves no stale match behind.
    scan.write_scan(scan.build_scan(first.withColumn("scan_date", F.lit("2026-10-08").cast("date")), feed), warehouse)
    assert tables.read_scan_table(spark, warehouse, "fingerprint_matches").count() == 0
    assert lines[0].startswith("scan_date,panel_version,panel_n") and sum(x.startswith("2026-") for x in lines) == 2


def test_recorded_posts_and_scan_ledger(spark, tmp_path):
    from vitrine.plans import posts
    from vitrine.sources import dictionaries

    payloads = spark.createDataFrame(
        [("lever", "acme", '[{"id": "1", "text": "Hydrogen lead"}, {"id": "2", "text": "Cook"}]')], "board string, company_slug string, body string"
    )
    boards = spark.createDataFrame([("lever", "acme", "shop.example")], "board string, company_slug string, domain string")
    table = str(tmp_path / "posts")
    posts.record_posts(payloads, boards, "2026-09-01", table)
    rows = posts.record_posts(payloads, boards, "2026-10-01", table).collect()
    assert [(r.external_id, r.domain, str(r.first_seen_at.date()), str(r.last_seen_at.date())) for r in rows] == [("1", "shop.example", "2026-09-01", "2026-10-01")]

    sha = dictionaries.config_hash(dictionaries.SHIPPED_FILES)
    assert len(sha) == 64
    ledger = str(tmp_path / "scans")
    for started in ("a", "b"):
        tables.open_scan(spark, ledger, "2026-09-08", "v1", started, "git", sha)
    tables.close_scan(spark, ledger, "2026-09-08", "v1", "z")
    r = tables.current(spark, ledger).collect()
    assert [(x.started_at, x.finished_at, x.config_sha) for x in r] == [("a", "z", sha)]
