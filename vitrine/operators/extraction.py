"""Static extraction from archived pages: scripts, links, metas, theme, platform verdict, anchors, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import markup, urls, values

# Platform markers looked for in a page.
PLATFORM_DOMAIN = r"([a-z0-9-]+\.myshopify\.com)"
THEME_OBJECT = r"(?s)Shopify\.theme\s*=\s*(\{.*?\})"
THEME_NAME = r'"name"\s*:\s*"([^"]*)"'
THEME_ID = r'"id"\s*:\s*(\d+)'


def _inline_text(parts: Column, cap: int | None) -> Column:
    """Inline scripts joined by newlines, whole or cut after `cap` characters of script (newlines not counted)."""
    joined = F.array_join(parts, "\n")
    if cap is None:
        return joined
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"))

    def take(acc: Column, part: Column) -> Column:
        piece = F.substr(part, F.lit(1), F.lit(cap) - acc["size"])
        return F.when(
            acc["size"] < cap,
            F.struct(F.concat(acc["kept"], F.array(piece)).alias("kept"), (acc["size"] + F.length(piece)).alias("size")),
        ).otherwise(acc)

    capped = F.aggregate(parts, start, take, lambda acc: F.array_join(acc["kept"], "\n"))
    return F.when(F.length(joined) <= cap, joined).otherwise(capped)


def extract(pages: DataFrame, html: str = "html", inline_cap: int | None = None) -> DataFrame:
    """Add what a page states about itself, in document order, without running any script.

    `inline_cap` cuts the inline script text after so many characters; by default all of it is read.

    script_srcs, link_hrefs, inline_script_text, meta, jsonld, hreflang_alternates, anchors,
    platform_domain, theme_name, theme_id.
    """
    scanned = pages.withColumn("_tags", markup.tags(F.col(html)))
    split = scanned.select(
        *pages.columns,
        F.transform(
            markup.named(F.col("_tags"), "script"),
            lambda t: F.struct(
                markup.trimmed(F.coalesce(markup.attribute(markup.open_tag(t), "src"), F.lit(""))).alias("src"),
                F.coalesce(markup.attribute(markup.open_tag(t), "type"), F.lit("")).alias("type"),
                markup.script_body(t).alias("body"),
            ),
        ).alias("_scripts"),
        F.transform(
            markup.named(F.col("_tags"), "link"),
            lambda t: F.struct(
                markup.trimmed(markup.attribute(t, "href")).alias("href"),
                F.coalesce(markup.attribute(t, "rel"), F.lit("")).alias("rel"),
                markup.attribute(t, "hreflang").alias("lang"),
            ),
        ).alias("_links"),
        F.transform(
            markup.named(F.col("_tags"), "meta"),
            lambda t: F.struct(
                F.coalesce(
                    F.nullif(markup.attribute(t, "name"), F.lit("")), markup.attribute(t, "property")
                ).alias("key"),
                markup.attribute(t, "content").alias("value"),
            ),
        ).alias("_metas"),
        F.filter(
            F.transform(markup.named(F.col("_tags"), "a"), lambda t: markup.attribute(t, "href")),
            lambda h: h.isNotNull(),
        ).alias("anchors"),
    )
    bodies = F.filter("_scripts", lambda s: (s["src"] == "") & (s["body"] != ""))
    shaped = split.select(
        *pages.columns,
        F.transform(F.filter("_scripts", lambda s: s["src"] != ""), lambda s: s["src"]).alias("script_srcs"),
        F.transform(
            F.filter("_links", lambda x: F.coalesce(x["href"], F.lit("")) != ""), lambda x: x["href"]
        ).alias("link_hrefs"),
        F.transform(F.filter(bodies, lambda s: ~s["type"].contains("ld+json")), lambda s: s["body"]).alias("_inline"),
        F.filter(
            F.transform(
                F.filter(bodies, lambda s: s["type"].contains("ld+json")),
                lambda s: F.to_json(F.try_parse_json(s["body"])),
            ),
            lambda j: j.isNotNull(),
        ).alias("jsonld"),
        F.filter("_metas", lambda m: m["key"].isNotNull() & m["value"].isNotNull()).alias("meta"),
        F.transform(
            F.filter(
                "_links",
                lambda x: F.array_contains(F.split(x["rel"], r"\s+"), "alternate")
                & x["lang"].isNotNull()
                & x["href"].isNotNull(),
            ),
            lambda x: F.struct(x["lang"].alias("lang"), x["href"].alias("href")),
        ).alias("hreflang_alternates"),
        "anchors",
    )
    with_text = shaped.withColumn("inline_script_text", _inline_text(F.col("_inline"), inline_cap)).drop("_inline")
    return with_text.select(
        "*",
        F.nullif(F.regexp_extract("inline_script_text", PLATFORM_DOMAIN, 1), F.lit("")).alias("platform_domain"),
        *theme(F.col("inline_script_text")),
    )


def theme(script: Column) -> list[Column]:
    """Theme name and id from the first theme object; regular expressions where it is no valid JSON."""
    blob = F.regexp_extract(script, THEME_OBJECT, 1)
    parsed = F.try_parse_json(F.nullif(blob, F.lit("")))
    name = F.when(parsed.isNotNull(), F.try_variant_get(parsed, "$.name", "string")).otherwise(
        F.when(blob.rlike(THEME_NAME), F.regexp_extract(blob, THEME_NAME, 1))
    )
    number = F.when(parsed.isNotNull(), F.try_variant_get(parsed, "$.id", "bigint")).otherwise(
        F.regexp_extract(blob, THEME_ID, 1).try_cast("bigint")
    )
    return [name.alias("theme_name"), number.alias("theme_id")]


def extract_parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """The tag lists of `extract` read by a real HTML parser, in Arrow batches.

    Use it to audit `extract`: same columns for scripts, links, metas, hreflang and anchors, with every
    HTML5 character reference decoded.
    """
    fields = (
        "script_srcs array<string>, link_hrefs array<string>, "
        "meta array<struct<key:string,value:string>>, "
        "hreflang_alternates array<struct<lang:string,href:string>>, anchors array<string>"
    )
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html]

    def batches(frames):
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                found = dict(reversed(attrs))
                href = (found.get("href") or "").strip()
                if tag == "script" and (found.get("src") or "").strip():
                    self.out["script_srcs"].append(found["src"].strip())
                elif tag == "a" and found.get("href") is not None:
                    self.out["anchors"].append(found["href"])
                elif tag == "meta" and (found.get("name") or found.get("property")) and found.get("content") is not None:
                    key = found.get("name") or found.get("property")
                    self.out["meta"].append({"key": key, "value": found["content"]})
                elif tag == "link":
                    if href:
                        self.out["link_hrefs"].append(href)
                    rel = (found.get("rel") or "").split()
                    if "alternate" in rel and found.get("hreflang") is not None and found.get("href") is not None:
                        self.out["hreflang_alternates"].append({"lang": found["hreflang"], "href": href})

        names = ("script_srcs", "link_hrefs", "meta", "hreflang_alternates", "anchors")
        for frame in frames:
            read = []
            for text in frame[html]:
                reader = Reader(convert_charrefs=True)
                reader.out = {n: [] for n in names}
                if text is not None:
                    reader.feed(text)
                    reader.close()
                read.append(reader.out)
            kept = frame.drop(columns=[html])
            for n in names:
                kept[n] = [r[n] for r in read]
            yield kept

    return pages.mapInPandas(batches, ", ".join([*keys, fields]))


def platform_evidence(html: Column, headers: Column, script_srcs: Column, link_hrefs: Column, inline: Column, domain: Column) -> Column:
    """The independent kinds of platform evidence a page shows, in fixed order."""
    asset_host = F.exists(F.concat(script_srcs, link_hrefs), lambda u: urls.asset_host(u) == "cdn.shopify.com")
    names = F.transform(F.coalesce(F.map_keys(headers), F.array().cast("array<string>")), lambda k: F.lower(k))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(asset_host, F.lit(False)), F.lit("cdn.shopify.com asset host")),
            F.when(
                inline.contains("window.Shopify") | inline.contains("Shopify.theme"),
                F.lit("window.Shopify or Shopify.theme inline script"),
            ),
            F.when(F.array_contains(names, "x-shopid"), F.lit("X-ShopId response header")),
            F.when(F.array_contains(names, "x-shopify-stage"), F.lit("X-Shopify-Stage response header")),
            F.when(html.contains("/cdn/shop/"), F.lit("/cdn/shop/ asset path")),
            F.when(html.contains("shopify-section"), F.lit("shopify-section class name")),
            F.when(domain.isNotNull(), F.concat(F.lit("myshopify domain in inline script: "), domain)),
        )
    )


def with_verdict(extracted: DataFrame) -> DataFrame:
    """Add `evidence` and `is_platform`: true with at least two independent kinds of evidence."""
    evidence = platform_evidence(
        F.col("html"),
        F.col("headers"),
        F.col("script_srcs"),
        F.col("link_hrefs"),
        F.col("inline_script_text"),
        F.col("platform_domain"),
    )
    return extracted.withColumn("evidence", evidence).withColumn("is_platform", F.size("evidence") >= 2)


def asset_rows(extracted: DataFrame, keys: list[str], text_cap: int | None = None) -> DataFrame:
    """One row per asset of a page: (keys, asset_ord, asset_type, value, host); meta values are cut at `text_cap` if given."""

    def assets(values: Column, kind: str, hosted: bool) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(
                F.lit(kind).alias("asset_type"),
                v.alias("value"),
                (urls.asset_host(v) if hosted else F.lit(None).cast("string")).alias("host"),
            ),
        )

    meta_text = F.transform("meta", lambda m: values.cut(F.concat(m["key"], F.lit("="), m["value"]), text_cap))
    everything = F.concat(
        assets(F.col("script_srcs"), "script_src", True),
        assets(F.col("link_hrefs"), "link_href", True),
        assets(F.array_compact(F.array("platform_domain")), "inline_script_marker", False),
        assets(meta_text, "meta", False),
    )
    return values.exploded(extracted, keys, everything, "_asset", "asset_ord").select(
        *keys, "asset_ord", "_asset.asset_type", "_asset.value", "_asset.host"
    )


def asset_urls(script_srcs: Column, link_hrefs: Column) -> Column:
    """The asset addresses of a page that can name a host, scripts before links: array of struct(url_ord, url, host)."""
    numbered = F.transform(
        F.concat(script_srcs, link_hrefs),
        lambda u, i: F.struct(i.alias("url_ord"), u.alias("url"), urls.asset_host(u).alias("host")),
    )
    return F.filter(numbered, lambda a: a["host"].isNotNull())


def collection_link(anchors: Column, base: Column) -> Column:
    """First anchor to a collection other than the catch-all one, resolved; else the catch-all page.

    Returns struct(url, branch) with branch `nav_link` or `collections_all_fallback`.
    """
    wanted = F.filter(
        anchors,
        lambda h: h.contains("/collections/") & ~F.regexp_replace(h, r"/+$", "").endswith("/collections/all"),
    )
    first = F.get(wanted, F.lit(0))
    return F.struct(
        urls.resolve_url(base, F.coalesce(first, F.lit("/collections/all"))).alias("url"),
        F.when(first.isNotNull(), F.lit("nav_link")).otherwise(F.lit("collections_all_fallback")).alias("branch"),
    )


def product_link(anchors: Column, base: Column) -> Column:
    """First anchor to a product page, resolved; NULL when there is none."""
    return urls.resolve_url(base, F.get(F.filter(anchors, lambda h: h.rlike(r"/products/[^/?#]+")), F.lit(0)))


def external_hosts(alternates: Column, domain: Column, dot_boundary: bool = False) -> Column:
    """Distinct external hosts among a page's hreflang alternates."""
    hosts = F.transform(alternates, lambda a: urls.asset_host(a["href"]))
    return F.array_distinct(F.filter(hosts, lambda h: h.isNotNull() & urls.is_external(h, domain, dot_boundary)))


def candidate_domains(listing_pages: DataFrame, platform_domains: DataFrame, limit: int | None = None) -> DataFrame:
    """Store candidates linked from listing pages, in first-seen order per listing.

    `listing_pages` holds (page_url, anchors); `platform_domains` holds the domains with a positive
    verdict and their evidence. With a `limit`, only so many distinct external domains per listing are looked
    at, before the verdict is asked for.
    """
    from pyspark.sql import Window

    found = values.exploded(listing_pages, ["page_url"], "anchors", "href", "pos")
    absolute = found.withColumn("absolute", urls.resolve_url(F.col("page_url"), markup.trimmed(F.col("href"))))
    named = absolute.where(F.col("absolute").startswith("http")).withColumn("domain", urls.normalize_domain(F.col("absolute")))
    own = urls.normalize_domain(F.col("page_url"))
    external = named.where(F.col("domain").isNotNull() & ~F.col("domain").eqNullSafe(own))
    first = external.groupBy("page_url", "domain").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("page_url").orderBy("pos"))
    placed = first.withColumn("place", place)
    looked_at = placed if limit is None else placed.where(F.col("place") <= limit)
    return looked_at.join(platform_domains, "domain").select("page_url", "place", "domain", "evidence")
