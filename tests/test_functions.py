from datetime import date
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from vitrine.functions import dates, markup, urls, values


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "url,host",
    [
        ("https://User:Pw@Shop.Example:8443/a?b", "shop.example"),
        ("//cdn.example.com/x.js", "cdn.example.com"),
        ("https://my_host.example.com", "my_host.example.com"),
        ("/relative/path", ""),
        ("mailto:me@x.example", ""),
        ("https://a@b@c.example/", "c.example"),
    ],
)
def test_host_of(spark, url, host):
    assert one(spark, url, urls.host_of) == host


@pytest.mark.parametrize(
    "raw,domain",
    [
        (" WWW.Shop.Example. ", "shop.example"),
        ("https://www.shop.example/path?q#f", "shop.example"),
        ("shop.example:443", "shop.example"),
        ("https://me:pw@shop.example/x", "shop.example"),
        ("", None),
        ("nodots", None),
        ("two words.example x", None),
        ("http:///path.only", None),
    ],
)
def test_normalize_domain(spark, raw, domain):
    assert one(spark, raw, urls.normalize_domain) == domain


BASES = ["https://shop.example/a/b/c", "https://shop.example", "https://shop.example/", "https://shop.example/a/?q=1#f", "https://shop.example/a//b//c", "https://shop.example/x"]
HREFS = [
    "", "x", "./x", "../x", "../../../x", "/x/../y", "/x/./y/", "//cdn.example/z", "https://other.example/a/../b",
    "?p=2", "#top", "x/", "..", ".", "a//b", "/a//b", "/a//../b", "/..//x", "/a/..", "/a/./", "..//x", "./", "a/../..", "mailto:a@b.c", "x?y=../z", "/",
]


def test_resolve_url_agrees_with_the_standard_library(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    rows = spark.createDataFrame(pairs, "b string, h string").select("b", "h", urls.resolve_url(F.col("b"), F.col("h")).alias("r"))
    for r in rows.collect():
        assert r.r == urljoin(r.b, r.h), (r.b, r.h)


def test_external_host_has_no_dot_boundary_by_default(spark):
    df = spark.createDataFrame([("notshop.example", "shop.example"), ("fr.shop.example", "shop.example"), ("a.b", "shop.example")], "h string, d string")
    loose = [r[0] for r in df.select(urls.is_external(F.col("h"), F.col("d"))).collect()]
    strict = [r[0] for r in df.select(urls.is_external(F.col("h"), F.col("d"), dot_boundary=True)).collect()]
    assert loose == [False, False, True]
    assert strict == [True, False, True]


def test_months(spark):
    assert one(spark, "2026-13", dates.month_start) is None
    assert one(spark, "2026-1", dates.month_start) is None
    assert one(spark, "2026-02", dates.month_start) == date(2026, 2, 1)
    assert one(spark, "2026-02", lambda c: dates.shift_month(c, -18)) == "2024-08"
    assert one(spark, "2026-02", dates.month_midpoint) == date(2026, 2, 15)
    assert one(spark, "2026Q2", dates.prior_year_quarter) == "2025Q2"
    assert one(spark, "soon", dates.prior_year_quarter) == "soon"


@pytest.mark.parametrize(
    "stamp,day", [("20250614120000", date(2025, 6, 14)), ("20250230000000", None), ("2025", None), ("2025061x000000", None)]
)
def test_archive_day(spark, stamp, day):
    assert one(spark, stamp, dates.archive_day) == day


@pytest.mark.parametrize(
    "text,day",
    [
        ("2026-08-15T23:30:00-04:00", date(2026, 8, 15)),
        ("2026-08-15", date(2026, 8, 15)),
        ("2026-08-15T10:00:00.123Z", date(2026, 8, 15)),
        ("2026-02-30T00:00:00Z", None),
        ("yesterday", None),
    ],
)
def test_iso_day(spark, text, day):
    assert one(spark, text, dates.iso_day) == day


def test_values(spark):
    assert one(spark, "1,284", values.digit_count) == 1284
    assert one(spark, ",", values.digit_count) is None
    assert one(spark, "12.5 EUR", values.price) is None
    assert one(spark, None, values.three_decimals, "double") == "n/a"
    assert one(spark, 0.4941, values.three_decimals, "double") == "0.494"
    assert one(spark, "We use Shopify+ Plus and HYDROGEN", lambda c: values.matching_terms(c, ["hydrogen", "shopify+ ", "none"])) == [
        "hydrogen",
        "shopify+ ",
    ]


@pytest.mark.parametrize(
    "pattern,literal",
    [
        (r"cdn\.weglot\.com", "cdn.weglot.com"),
        (r"shopify\s+plus", "shopify"),
        ("a|b", None),
        ("(ab)?cd", "cd"),
        (r"foo[\]x]barr", "barr"),
        (r"\x41bc", None),
        ("xy?z{2}", "x"),
    ],
)
def test_required_literal(pattern, literal):
    assert values.required_literal(pattern) == literal


def test_visible_text(spark):
    html = "<div> a <b>b &amp; c</b><!-- no --><script>x<1</script>\n<p>&nbsp;</p>d</div>"
    assert one(spark, html, markup.visible_text) == "a b & c d"


def test_attribute(spark):
    tag = """<a data-x="href=no" HREF = '/x?a=1&amp;b=2' href="/second">"""
    assert one(spark, tag, lambda c: markup.attribute(c, "href")) == "/x?a=1&b=2"
    assert one(spark, "<a name=x>", lambda c: markup.attribute(c, "href")) is None
    assert one(spark, "<a href=/bare title=t>", lambda c: markup.attribute(c, "href")) == "/bare"
    assert one(spark, '<a href="">', lambda c: markup.attribute(c, "href")) == ""
