"""Rules that one small case decides: one scan of a day, safe replacement, tied sightings, NaN, kinds of truth."""

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalog, hiring, matching
from vitrine.plans import crosssection
from vitrine.sinks import tables


def test_the_latest_scan_is_one_panel_version(spark):
    rows = [("a", "2026-01-01", "v1"), ("a", "2026-02-01", "v1"), ("a", "2026-02-01", "v2"), ("b", "2026-02-01", "v2")]
    feats = spark.createDataFrame(rows, "domain string, scan_date string, panel_version string").withColumn("scan_date", F.col("scan_date").cast("date"))
    assert sorted((r.domain, r.panel_version) for r in crosssection.scan_of(feats).collect()) == [("a", "v2"), ("b", "v2")]
    assert [r.panel_version for r in crosssection.scan_of(feats, "2026-01-01").collect()] == ["v1"]


def test_replaced_scans_are_dropped_after_the_write(spark, tmp_path):
    path = str(tmp_path / "facts")
    schema = "scan_date string, panel_version string, n int"
    tables.replace_scan(spark.createDataFrame([("2026-01-01", "v:1", 1), ("2026-01-02", "v:1", 2)], schema), path)
    broken = spark.createDataFrame([("2026-01-01", "v:1", 3)], schema).withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        tables.replace_scan(broken, path, scans=[("2026-01-01", "v:1")])
    assert spark.read.parquet(path).count() == 2
    none = spark.createDataFrame([], schema)
    tables.replace_scan(none, path, scans=[("2026-01-01", "v:1")])
    assert [r.n for r in spark.read.parquet(path).collect()] == [2]


def test_tied_sightings_merge_alike_in_any_order(spark):
    schema = "board string, token string, post_id string, domain string, title string, posted_at string, first_seen_at string, last_seen_at string, matched_terms array<string>, source_url string"
    names = {*hiring.POST_KEY}
    row = lambda title, url: tuple([*["x"] * len(names), "d", title, "p", "2026-01-01", "2026-01-01", ["t"], url])
    schema = ", ".join([*[f"{k} string" for k in hiring.POST_KEY], "domain string, title string, posted_at string, first_seen_at string, last_seen_at string, matched_terms array<string>, source_url string"])
    batch = [row("one", "u1"), row("two", "u2")]
    for rows in (batch, batch[::-1]):
        df = spark.createDataFrame(rows, schema)
        got = hiring.merge_posts(df.limit(0), df).first()
        assert (got.title, got.source_url) == ("two", "u1")
        again = hiring.merge_posts(spark.createDataFrame([row("zzz", "u9")], schema), df).first()
        assert (again.title, again.source_url) == ("two", "u9")


def test_available_counts_by_its_kind(spark):
    body = '{"products":[{"variants":[{"available":"false"},{"available":""},{"available":0},{"available":2},{"available":null},{"available":true},{}]}]}'
    page = spark.createDataFrame([("d", 1, 200, None, body)], "domain string, page int, status int, skip_reason string, body string")
    got = [v.available for v in catalog.parse_feed(page).first().products[0].variants]
    assert got == [True, False, False, True, False, True, None]


def test_feeds_have_no_last_page(spark):
    product = '{"products":[{"variants":[]}]}'
    pages = [("d", i, 200, None, product) for i in range(1, 46)] + [("d", 46, 200, None, '{"products":[]}'), ("d", 48, 200, None, product)]
    parsed = catalog.parse_feed(spark.createDataFrame(pages, "domain string, page int, status int, skip_reason string, body string"))
    summary, kept = catalog.walk(parsed, ["domain"])
    r = summary.first()
    assert (r.pages_fetched, r.truncated, kept.count()) == (46, False, 45)
    cut = catalog.walk(parsed, ["domain"], max_pages=40)[0].first()
    assert (cut.pages_fetched, cut.truncated) == (40, True)


def test_every_alternate_host_is_reported(spark):
    hosts = [f"h{i:03}.example.org" for i in range(300)]
    pages = spark.createDataFrame([("d", hosts)], "domain string, external_hosts array<string>")
    assert matching.hreflang_matches(pages, ["domain"]).first().matched_on == ";".join(hosts)
