import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalog, controls, features, panel, score, series

DAY = date(2026, 9, 8)
KEYS = ["domain", "scan_date"]
FEED = "domain string, scan_date date, page int, status int, skip_reason string, body string"


def feed(spark, *pages, domain="s.example"):
    rows = [(domain, DAY, i, 200, None, p) if isinstance(p, str) else (domain, DAY, i, *p) for i, p in enumerate(pages, 1)]
    return spark.createDataFrame(rows, FEED)


def products(*items):
    return json.dumps({"products": list(items)})


FOUR = products(
    {"created_at": "2026-08-15T23:30:00-04:00", "vendor": "a", "variants": [{"price": "10.00", "available": True}]},
    {"created_at": "2026-01-10", "vendor": "a", "variants": [{"price": "20.00", "available": False}]},
    {"created_at": "2025-03-01", "vendor": "b", "variants": [{"price": 30, "available": True}]},
    {"created_at": "2023-05-01", "vendor": "c", "variants": [{"price": "40.00", "available": True}]},
)


def test_catalog_windows_and_medians(spark):
    r = catalog.catalog_snapshots(feed(spark, FOUR, products()), KEYS).first()
    assert (r.product_count, r.pages_fetched, r.truncated) == (4, 2, False)
    assert (r.products_created_last_90d, r.products_created_last_365d, r.products_created_prior_365d) == (1, 2, 1)
    assert (r.earliest_created_at, r.latest_created_at) == (date(2023, 5, 1), date(2026, 8, 15))
    assert (r.variant_count, r.vendor_count, r.available_share, r.median_price, r.currency) == (4, 3, 0.75, 25.0, None)


def test_odd_products(spark):
    body = products(
        7,
        {"created_at": "soon", "vendor": "", "variants": [{"price": "free"}, 3, {"available": None}]},
        {"created_at": "2027-01-01", "variants": "none"},
    )
    r = catalog.catalog_snapshots(feed(spark, body, products()), KEYS).first()
    # The future product counts; the number is no product; a null flag is false, an absent one is skipped.
    assert (r.product_count, r.products_created_last_90d, r.variant_count, r.vendor_count) == (2, 1, 2, 0)
    assert (r.available_share, r.median_price) == (0.0, None)


@pytest.mark.parametrize(
    "pages,expected",
    [
        (["<html>"], (False, "not_available", None, None, None)),
        ([(403, None, None)], (False, "not_available", None, None, None)),
        ([(None, "robots_disallow", None)], (False, "robots_disallow", None, None, None)),
        (['{"items": []}'], (False, "not_available", None, None, None)),
        ([products()], (True, None, 1, False, 0)),
        ([products({"vendor": "a"}), (500, None, None)], (True, None, 1, True, 1)),
        ([products({"vendor": "a"}), "[]"], (True, None, 1, True, 1)),
        ([products({}), products({}), products({})], (True, None, 2, True, 2)),
    ],
)
def test_feed_walk(spark, pages, expected):
    r = catalog.catalog_snapshots(feed(spark, *pages), KEYS, max_pages=2).first()
    assert (r.products_json_available, r.skip_reason, r.pages_fetched, r.truncated, r.product_count) == expected


def test_grouped_median_equals_builtin(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("domain"),
        (F.col("id") * 7919 % 1013).cast("double").alias("price"),
        F.lit(True).alias("available"),
    )
    a = {r.domain: r.median_price for r in catalog.variant_aggregates(df, ["domain"]).collect()}
    b = {r.domain: r.m for r in df.groupBy("domain").agg(F.percentile("price", 0.5).alias("m")).collect()}
    assert a == b


def feature_row(spark, **changes):
    base = {
        **{f: 0 for f in features.CAPABILITY_FLAGS.values()},
        "workaround_intl_app_count": 0,
        "capability_verified": {},
        "catalog_growth_yoy": None,
        "products_last_90d": None,
        "product_count": None,
        "review_count_max": None,
    }
    base.update(changes)
    kinds = {"capability_verified": "map<string,boolean>", "catalog_growth_yoy": "double", "products_last_90d": "long", "product_count": "long", "review_count_max": "long"}
    shape = "domain string, " + ", ".join(f"{k} {kinds.get(k, 'int')}" for k in base)
    return spark.createDataFrame([("s.example", *base.values())], shape)


def scored(spark, **changes):
    return score.with_score(feature_row(spark, **changes)).first()


def test_full_score(spark):
    r = scored(
        spark,
        workaround_b2b=1,
        workaround_discount=1,
        capability_verified={"b2b_wholesale": True, "discount_logic": True},
        product_count=600,
        catalog_growth_yoy=0.8,
        products_last_90d=30,
        review_count_max=6000,
    )
    assert r.score == 9.5


def test_unverified_halves_but_unknown_does_not(spark):
    r = scored(spark, workaround_b2b=1, capability_verified={"b2b_wholesale": False})
    assert r.score == 1.5 and r.components.workaround_b2b.note == "unverified_half_weight"
    assert scored(spark, workaround_b2b=1).score == 3.0


def test_missing_inputs(spark):
    r = scored(spark)
    notes = [c.note for c in r.components]
    assert r.score == 0.0 and notes.count("null_input") == 3
    assert r.components.review_scale.weight == 2.0
    assert scored(spark, review_count_max=12).components.review_scale.weight == 1.0


@pytest.mark.parametrize("apps,expected", [(1, 0.0), (2, 1.0)])
def test_international_needs_two(spark, apps, expected):
    assert scored(spark, workaround_intl=1, workaround_intl_app_count=apps).score == expected


@pytest.mark.parametrize("n,expected", [(12, 0.0), (1000, 1.0), (1200, 1.0), (5000, 2.0)])
def test_review_steps(spark, n, expected):
    assert scored(spark, review_count_max=n).score == expected


def test_settings_without_weights(spark):
    bare = score.ScoreSettings(weights={})
    df = feature_row(spark, workaround_b2b=1, review_count_max=6000)
    assert score.with_score(df, bare).first().score == 2.0
    assert score.broken_totals(score.with_score(df, bare), ["domain"]).count() == 0


def test_panel_sizes(spark):
    df = spark.createDataFrame([(f"s{i:02}.example", 10 * i) for i in range(1, 25)], "domain string, product_count long")
    for size in (8, 4, 3, 24, 100):
        rows = panel.select_panel(df, size=size).collect()
        assert len(rows) == min(size, 24) == len({r.domain for r in rows})
    assert {r.stratum for r in panel.select_panel(df, size=8).collect()} == {0, 1, 2, 3}
    again = [r.domain for r in panel.select_panel(df, size=8).orderBy("place").collect()]
    assert again == [r.domain for r in panel.select_panel(df, size=8).orderBy("place").collect()]
    assert again != [r.domain for r in panel.select_panel(df, size=8, seed=8).orderBy("place").collect()]


def test_strata_edges_go_down(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", None)], "domain string, product_count long")
    assert {r.domain: r.stratum for r in panel.with_stratum(df).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 0}
    few = df.where("product_count < 4")
    assert {r.stratum for r in panel.with_stratum(few).collect()} == {0}


def test_eligibility(spark):
    names = [f"s{i}" for i in range(6)]
    stores = spark.createDataFrame([(n, i != 5) for i, n in enumerate(names)], "domain string, is_platform boolean")
    shop = spark.createDataFrame([(n, i != 4, 10) for i, n in enumerate(names)], "domain string, products_json_available boolean, product_count long")
    pos, marked = spark.createDataFrame([("s0",)], "domain string"), spark.createDataFrame([("s1",)], "domain string")
    assert {r.domain for r in panel.eligible(stores, shop, pos, marked).collect()} == {"s2", "s3"}


SCANS = "scan_date date, panel_version string"
D1, D2 = date(2026, 8, 1), date(2026, 9, 1)


def index_inputs(spark, rows, hits):
    scans = spark.createDataFrame([(D1, "v1"), (D2, "v1")], SCANS)
    feats = spark.createDataFrame(
        [(d, day, "v1", s, 1 if s > 1 else 0, s > 4) for d, day, s in rows],
        f"domain string, {SCANS}, score double, workaround_app_count long, high_growth_active boolean",
    )
    marks = spark.createDataFrame([(d, day, "v1", v) for d, day, v in hits], f"domain string, {SCANS}, verified boolean")
    return scans, feats, marks


def test_conversions_and_attrition(spark):
    rows = [(d, day, 1.0) for d in "abce" for day in (D1, D2)] + [("d", D1, 1.0)]
    args = index_inputs(spark, rows, [("a", D2, True), ("b", D2, False), ("e", D1, True), ("e", D2, True)])
    moved = {r.domain: (r.present, r.converted) for r in series.transitions(*args).collect()}
    assert moved == {"a": (True, True), "b": (True, False), "c": (True, False), "d": (False, False)}
    r = series.conversion_counts(series.transitions(*args)).first()
    assert (r.n_converted, r.n_prior_selfserve, r.n_attrition) == (1, 3, 1)


def test_index_of_a_panel(spark):
    args = index_inputs(spark, [("a", D1, 5.0), ("b", D1, 0.5), ("x", D1, 9.0)], [])
    listed = spark.createDataFrame([("a",), ("b",), ("never",)], "domain string")
    first = series.index_series(*args, listed).where(F.col("scan_date") == F.lit(D1)).first()
    assert (first.panel_n, first.panel_n_scanned, first.share_at_threshold, first.share_workaround_any) == (3, 2, 0.5, 0.5)
    assert (first.share_converted_since_prior, first.n_converted, first.hiring_posts_month) == (None, None, 0)
    empty = series.index_series(*args, listed.limit(0)).where(F.col("scan_date") == F.lit(D1)).first()
    assert (empty.panel_n, empty.panel_n_scanned) == (3, 3)
    second = series.index_series(*args, listed).where(F.col("scan_date") == F.lit(D2)).first()
    assert (second.panel_n_scanned, second.share_at_threshold, second.n_prior_selfserve) == (0, None, 0)


def captures(spark, *stamps):
    return spark.createDataFrame([("s.example", s) for s in stamps], "domain string, timestamp string")


def target(spark, month="2025-06"):
    plan = spark.createDataFrame([("s.example", "migrator", month)], "domain string, group string, anchor_month string")
    return controls.grid(plan, (0,))


@pytest.mark.parametrize(
    "stamps,picked",
    [
        (["20250601000000", "20250614000000", "20250710000000"], "20250614000000"),
        (["20250730000000"], "20250730000000"),
        (["20250731000000"], None),
        (["20250616000000", "20250614000000"], "20250614000000"),
        (["2025061", "20259901000000"], None),
        (["20250614120000", "20250614080000"], "20250614080000"),
    ],
)
def test_nearest_snapshot(spark, stamps, picked):
    assert controls.pick_snapshots(target(spark), captures(spark, *stamps)).first().timestamp == picked


def test_as_of_equals_brute_force(spark):
    stamps = [f"2025{m:02}{d:02}000000" for m in range(1, 13) for d in (1, 9, 23)]
    plan = spark.createDataFrame([("s.example", "migrator", "2025-06")], "domain string, group string, anchor_month string")
    rows = controls.pick_snapshots(controls.grid(plan, tuple(range(-8, 9))), captures(spark, *stamps), 12).collect()
    for r in rows:
        near = [(abs((date(2025, int(s[4:6]), int(s[6:8])) - r.target_day).days), s) for s in stamps]
        near = [x for x in near if x[0] <= 12]
        assert r.timestamp == (min(near)[1] if near else None)


def test_backtest_grid_and_summaries(spark):
    from vitrine.plans import backtest

    migrators = spark.createDataFrame([("m.example", "2025-06")], "domain string, anchor_month string")
    negatives = spark.createDataFrame([("c1.example",), ("c2.example",), ("m.example",)], "domain string")
    sizes = spark.createDataFrame([], "domain string, product_count long")
    index = spark.createDataFrame([("m.example", "20241214000000"), ("c1.example", "20241216000000")], "domain string, timestamp string")
    pages = spark.createDataFrame(
        [("m.example", "20241214000000", 200, '<script src="https://cdn.sparklayer.io/x.js">'), ("c1.example", "20241216000000", 404, None)],
        "domain string, timestamp string, status int, html string",
    )
    out = backtest.run_backtest(migrators, negatives, sizes, index, pages, offsets=(-6, 3))
    rows = {(r.domain, r.offset): (r.snapshot_found, r.workaround_any, r.workaround_capabilities) for r in out.rows.collect()}
    assert len(rows) == 6 and rows[("m.example", -6)] == (True, True, "b2b_wholesale")
    assert rows[("m.example", 3)] == rows[("c1.example", -6)] == (False, None, None)
    assert tuple(out.coverage.first()) == (6, 1, pytest.approx(1 / 6))
    assert {(r.group, r.offset): r.prevalence for r in out.prevalence.collect()} == {
        ("migrator", -6): 1.0, ("migrator", 3): None, ("control", -6): None, ("control", 3): None,
    }
    assert [tuple(r) for r in out.earliest.collect()] == [("m.example", -6)]
    nothing = backtest.run_backtest(migrators.limit(0), negatives, sizes, index, pages, offsets=(-6, 3))
    assert nothing.rows.count() == 0 and nothing.coverage.first().coverage is None


def test_controls_and_reference_month(spark):
    migrators = spark.createDataFrame([("m1", "2024-01"), ("m2", "2024-05"), ("m3", "2023-11"), ("m4", "2024-02")], "domain string, anchor_month string")
    assert controls.reference_month(migrators).first()[0] == "2024-02"
    assert controls.reference_month(migrators).first()[0] == "2024-02"
    negatives = spark.createDataFrame([(f"n{i}",) for i in range(10)] + [("m1",)], "domain string")
    sizes = spark.createDataFrame([("m1", 50), ("m2", 60)] + [(f"n{i}", 10 * i) for i in range(10)], "domain string, product_count long")
    near = controls.matched_controls(negatives, migrators, sizes, k=3).collect()
    assert {r.domain for r in near} == {"n5", "n6", "n4"} and {r.method for r in near} == {"nearest_size"}
    drawn = controls.matched_controls(negatives, migrators, sizes.limit(3), k=3).collect()
    assert len(drawn) == 3 and {r.method for r in drawn} == {"seeded_sample"} and "m1" not in {r.domain for r in drawn}
