import pytest
from pyspark.sql import functions as F

from vitrine.operators import extraction, features, matching, reviews
from vitrine.sources import dictionaries

HOME = """<!doctype html><html><head>
<script src="https://shop.example/cdn/shop/theme.js"></script>
<script src='https://cdn.sparklayer.io/boot.js'></script>
<SCRIPT async SRC=https://cdn.weglot.com/weglot.min.js></SCRIPT>
<!-- <script src="https://hidden.example/x.js"></script> -->
<link rel="stylesheet" href=" /base.css ">
<link rel="alternate" hreflang="de" href="https://shop.example/de">
<link rel="alternate" hreflang="fr" href="https://maison.example/">
<link hreflang="it" rel="nofollow alternate" href="//negozio.example/">
<meta name="description" content="a &quot;b&quot;"><meta property="og:type" content="site"><meta charset="utf-8">
<script type="application/ld+json">{"@type": "Store"}</script>
<script type="application/ld+json">{broken</script>
<script>window.Shopify = {}; Shopify.theme = {"name": "Dawn", "id": 77}; var s = "acme-9.myshopify.com"; var h = "<a href='/no'>";</script>
</head><body><nav><a href="/collections/all/">all</a><a href="/collections/summer">s</a><a href="../products/hat?v=1">p</a><a name="x">n</a></nav></body></html>"""


def page(spark, html=HOME, domain="shop.example", headers=None, page_ord=0):
    rows = [(domain, page_ord, f"https://{domain}/a/b", headers or {}, html)]
    return spark.createDataFrame(rows, "domain string, page_ord int, url string, headers map<string,string>, html string")


def test_extract_reads_a_store_home(spark):
    r = extraction.extract(page(spark)).first()
    assert r.script_srcs == ["https://shop.example/cdn/shop/theme.js", "https://cdn.sparklayer.io/boot.js", "https://cdn.weglot.com/weglot.min.js"]
    assert r.link_hrefs == ["/base.css", "https://shop.example/de", "https://maison.example/", "//negozio.example/"]
    assert [tuple(m) for m in r.meta] == [("description", 'a "b"'), ("og:type", "site")]
    assert [tuple(h) for h in r.hreflang_alternates] == [
        ("de", "https://shop.example/de"),
        ("fr", "https://maison.example/"),
        ("it", "//negozio.example/"),
    ]
    assert len(r.jsonld) == 1 and "Store" in r.jsonld[0]
    assert r.anchors == ["/collections/all/", "/collections/summer", "../products/hat?v=1"]
    assert (r.platform_domain, r.theme_name, r.theme_id) == ("acme-9.myshopify.com", "Dawn", 77)
    assert "window.Shopify" in r.inline_script_text and "Store" not in r.inline_script_text


def test_scan_and_parser_agree(spark):
    names = ["script_srcs", "link_hrefs", "meta", "hreflang_alternates", "anchors"]
    a = extraction.extract(page(spark)).select(names).first()
    b = extraction.extract_parsed(page(spark)).select(names).first()
    assert a == b


def test_nested_theme_object_falls_back_to_the_patterns(spark):
    html = '<script>Shopify.theme = {"name":"Sense","settings":{"a":1},"id":5};</script>'
    r = extraction.extract(page(spark, html)).first()
    assert r.theme_name == "Sense" and r.theme_id is None


def test_inline_text_is_cut_at_a_given_cap_only(spark):
    scripts = page(spark, "<script>abcde</script><script>fghij</script><script>k</script>")
    assert extraction.extract(scripts, inline_cap=7).first().inline_script_text == "abcde\nfg"
    assert extraction.extract(scripts).first().inline_script_text == "abcde\nfghij\nk"


def test_verdict_needs_two_kinds(spark):
    assert extraction.with_verdict(extraction.extract(page(spark))).first().is_platform
    only_host = page(spark, '<script src="https://cdn.shopify.com/x.js"></script>')
    assert not extraction.with_verdict(extraction.extract(only_host)).first().is_platform
    by_header = page(spark, '<div class="shopify-section">', headers={"X-SHOPID": "1"})
    r = extraction.with_verdict(extraction.extract(by_header)).first()
    assert r.is_platform and r.evidence == ["X-ShopId response header", "shopify-section class name"]
    foreign = page(spark, "<script src='https://other.example/x.js'></script>")
    assert extraction.with_verdict(extraction.extract(foreign)).first().evidence == []


def test_first_links(spark):
    df = extraction.extract(page(spark))
    r = df.select(
        extraction.collection_link(F.col("anchors"), F.col("url")).alias("c"), extraction.product_link(F.col("anchors"), F.col("url")).alias("p")
    ).first()
    assert tuple(r.c) == ("https://shop.example/collections/summer", "nav_link")
    assert r.p == "https://shop.example/products/hat?v=1"
    bare = extraction.extract(page(spark, "<a href='/collections/all'>x</a>"))
    r = bare.select(extraction.collection_link(F.col("anchors"), F.col("url")).alias("c"), extraction.product_link(F.col("anchors"), F.col("url")).alias("p")).first()
    assert tuple(r.c) == ("https://shop.example/collections/all", "collections_all_fallback") and r.p is None


def test_asset_rows(spark):
    rows = extraction.asset_rows(extraction.extract(page(spark)), ["domain"]).collect()
    assert {r.asset_type for r in rows} == {"script_src", "link_href", "inline_script_marker", "meta"}
    assert next(r for r in rows if r.value == "/base.css").host is None
    assert next(r for r in rows if r.value == "//negozio.example/").host == "negozio.example"


def test_matches_on_a_store_home(spark):
    found = matching.match_signatures(extraction.extract(page(spark)), dictionaries.load_apps(), ["domain"]).collect()
    assert {m.key for m in found} == {"sparklayer", "weglot"}
    spark_layer = next(m for m in found if m.key == "sparklayer")
    assert spark_layer.matched_on == "https://cdn.sparklayer.io/boot.js" and spark_layer.verified


def test_shared_host_alone_matches_nothing(spark):
    html = '<script src="https://cdn.shopify.com/a.js"></script><script src="https://cdn.shopify.com/extensions/1/other-2/assets/b.js"></script>'
    assert matching.match_signatures(extraction.extract(page(spark, html)), dictionaries.load_apps(), ["domain"]).count() == 0


def test_addresses_of_later_pages_beat_texts_of_earlier_ones(spark):
    entry = dictionaries.Signature("k", script_src=("late",), dom_marker=("early",))
    both = page(spark, "early", page_ord=0).unionByName(page(spark, "<script src='//x.example/late.js'></script>", page_ord=1))
    assert matching.match_signatures(extraction.extract(both), [entry], ["domain"]).first().matched_on == "//x.example/late.js"


def test_fingerprints_and_hreflang_rule(spark):
    html = '<a href="/account/login/multipass/t">in</a> on Shopify   Plus'
    found = matching.match_fingerprints(extraction.extract(page(spark, html)), dictionaries.load_fingerprints(), ["domain"]).collect()
    assert {(m.key, m.verified) for m in found} == {("multipass_login", True), ("shopify_plus_text", False)}
    home = matching.match_fingerprints(extraction.extract(page(spark)), dictionaries.load_fingerprints(), ["domain"]).collect()
    assert [(m.key, m.matched_on) for m in home] == [("expansion_store_hreflang", "maison.example;negozio.example")]


def test_dictionary_guards(tmp_path):
    bad_host = tmp_path / "host.yaml"
    bad_host.write_text("- {app_key: x, capability: sso_login, patterns: {script_host: ['shopify.com']}}")
    with pytest.raises(dictionaries.DictionaryError, match="shared"):
        dictionaries.load_apps(bad_host)
    bad_capability = tmp_path / "cap.yaml"
    bad_capability.write_text("- {key: x, capability: flying}")
    with pytest.raises(dictionaries.DictionaryError, match="taxonomy"):
        dictionaries.load_apps(bad_capability)
    bad_confidence = tmp_path / "conf.yaml"
    bad_confidence.write_text("- {key: x, capability: sso_login, confidence: certain}")
    with pytest.raises(dictionaries.DictionaryError, match="confidence"):
        dictionaries.load_apps(bad_confidence)


def test_shipped_dictionaries(spark):
    from vitrine.operators import quality

    known = dictionaries.load_all()
    entries = dictionaries.entry_rows(spark, "apps", known.apps).unionByName(dictionaries.entry_rows(spark, "plans", known.fingerprints))
    totals = {r.dict: (r.entries, r.verified, r.unverified) for r in quality.dictionary_totals(entries).collect()}
    assert totals == {"apps": (23, 14, 9), "plans": (6, 1, 5)}
    assert quality.unverified_keys(entries).count() == 14
    assert len(known.vendors) == 6
    patterns = dictionaries.as_rows(spark, "apps", known.apps)
    assert patterns.where("key = 'syncio'").count() == 0 and patterns.where("key = 'weglot'").count() == 4


def test_review_reading(spark):
    html = '<script src="https://judge.me/w.js"></script><span class="jdgm-prev-badge__text">1,284 reviews</span>'
    r = reviews.read_reviews(extraction.extract(page(spark, html)), dictionaries.load_vendors(), ["domain"]).first()
    assert (r.vendor, r.review_count, r.source_url, r.method) == ("judgeme", 1284, "https://shop.example/a/b", "html_widget")
    plain = reviews.read_reviews(extraction.extract(page(spark, "<p>x</p>")), dictionaries.load_vendors(), ["domain"]).collect()
    assert [(p.vendor, p.review_count, p.method) for p in plain] == [("none", None, "not_available")]


@pytest.mark.parametrize(
    "shown,expected",
    [
        ("https://api.v.example/777", (777, "https://api.v.example/777", "json_endpoint_referenced_in_page")),
        ("api.v.example/777", (None, None, "not_available")),
        ("https://api.v.example/404", (None, None, "not_available")),
    ],
)
def test_review_endpoint(spark, shown, expected):
    vendor = dictionaries.ReviewVendor("v", detect=("widget-v",), count=(r'"n": ([0-9,]+)',), endpoint=r"(?:https://)?api\.v\.example/[0-9]+")
    answers = spark.createDataFrame(
        [("https://api.v.example/777", 200, '{"n": 777}'), ("https://api.v.example/404", 404, None)], "url string, status int, body string"
    )
    df = extraction.extract(page(spark, f"<i class='widget-v' data='{shown}'></i>"))
    r = reviews.read_reviews(df, [vendor], ["domain"], answers).first()
    assert (r.review_count, r.source_url, r.method) == expected


def test_candidates_from_a_listing(spark):
    listing = spark.createDataFrame(
        [("https://list.example/p", ["/own", "https://www.good.example/x", "https://bad.example", "https://good.example/y", "mailto:a@b.c"])],
        "page_url string, anchors array<string>",
    )
    good = spark.createDataFrame([("good.example", "two kinds")], "domain string, evidence string")
    rows = extraction.candidate_domains(listing, good).collect()
    assert [(r.place, r.domain) for r in rows] == [(1, "good.example")]


def test_no_fingerprint_key_among_features(spark):
    from vitrine import schemas

    empty = spark.createDataFrame([], schemas.FEATURES)
    keys = [e.key for e in dictionaries.load_fingerprints()]
    assert features.leaked_names(empty, keys) == []
    assert features.leaked_names(empty.withColumn("shopify_plus_text", F.lit(1)), keys) == ["shopify_plus_text"]
    assert len(empty.columns) == 24
