"""Signature matching: every dictionary pattern against every asset address and page text, first match wins.

The dictionary is compiled into the projection: each pattern is a literal regular expression tested by the
JVM in the same pass that reads the page, behind a plain substring test for the characters any match needs,
and only hits leave it. There is no pattern join. The first match
per signature is then a `min_by`, which aggregates before the shuffle, so a store with any number of pages
costs no more than its hits per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import values
from vitrine.operators import extraction
from vitrine.sources.dictionaries import Signature

HREFLANG_KEY = "expansion_store_hreflang"
HREFLANG_MIN_HOSTS = 2


def _hit(entry: Signature, stage: int, kind_ord: int, pattern_ord: int, pattern: str, url_ord: Column, matched: Column) -> Column:
    """A hit; its first five fields are the order in which hits of one page are preferred."""
    return F.struct(
        F.lit(stage).alias("stage"),
        url_ord.cast("int").alias("url_ord"),
        F.lit(kind_ord).alias("kind_ord"),
        F.lit(pattern_ord).alias("pattern_ord"),
        F.lit(entry.key).alias("key"),
        F.lit(entry.capability).cast("string").alias("capability"),
        F.lit(entry.verified).alias("verified"),
        F.lit(pattern).alias("pattern"),
        matched.alias("matched_on"),
    )


HIT = (
    "array<struct<stage:int,url_ord:int,kind_ord:int,pattern_ord:int,key:string,capability:string,"
    "verified:boolean,pattern:string,matched_on:string>>"
)


def _any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _address_hits(asset_urls: Column, entries: list[Signature]) -> Column:
    """Hits of host patterns on an address's host and of source patterns on all of it, over a page's addresses."""
    hosts = [(e, j, p) for e in entries for j, p in enumerate(e.script_host)]
    sources = [(e, j, p) for e in entries for j, p in enumerate(e.script_src)]
    if not hosts and not sources:
        return F.array().cast(HIT)

    def on(address: Column) -> Column:
        url, at, host = address["url"], address["url_ord"], address["host"]
        tests = [F.when(host.rlike(f"(?i){p}"), _hit(e, 0, 0, j, p, at, url)) for e, j, p in hosts]
        tests += [F.when(url.rlike(f"(?i){p}"), _hit(e, 0, 1, j, p, at, url)) for e, j, p in sources]
        return F.array_compact(F.array(*tests))

    # Most addresses hit nothing: one alternation each for hosts and addresses drops them first.
    maybe = F.filter(
        asset_urls,
        lambda a: (a["host"].rlike(_any_of([p for _, _, p in hosts])) if hosts else F.lit(False))
        | (a["url"].rlike(_any_of([p for _, _, p in sources])) if sources else F.lit(False)),
    )
    return F.flatten(F.transform(maybe, on))


def _text_hits(html: Column, lowered: Column, entries: list[Signature]) -> Column:
    """Hits of text patterns on the page, with the text that matched."""
    tests = [
        F.when(
            values.may_match(lowered, p) & html.rlike(f"(?i){p}"),
            _hit(e, 1, 0, j, p, F.lit(0), F.regexp_extract(html, f"(?i){p}", 0)),
        )
        for e in entries
        for j, p in enumerate(e.dom_marker)
    ]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast(HIT)


def page_hits(entries: list[Signature], lowered: str = "html_lower") -> Column:
    """All hits of a dictionary on one extracted page that carries its lower-cased text."""
    found = F.concat(
        _address_hits(extraction.asset_urls(F.col("script_srcs"), F.col("link_hrefs")), entries),
        _text_hits(F.col("html"), F.col(lowered), entries),
    )
    return found.cast(HIT)


def with_lower(extracted: DataFrame) -> DataFrame:
    """Add `html_lower`, the text the cheap pre-tests look at."""
    return extracted.withColumn("html_lower", F.lower("html"))


def first_matches(pages: DataFrame, hits: str, keys: list[str], page_ord: str = "page_ord") -> DataFrame:
    """The preferred hit per (keys, signature): keys, key, capability, matched_on, pattern, verified.

    Addresses of all pages come before texts of all pages. Within a stage the order is page, address
    (scripts before links), host patterns before source patterns, then pattern order.
    """
    found = values.exploded(pages, [*keys, page_ord], hits, "hit")
    order = F.struct("hit.stage", page_ord, "hit.url_ord", "hit.kind_ord", "hit.pattern_ord")
    first = found.groupBy(*keys, F.col("hit.key").alias("key")).agg(F.min_by("hit", order).alias("hit"))
    return first.select(*keys, "key", "hit.capability", "hit.matched_on", "hit.pattern", "hit.verified")


def match_signatures(extracted: DataFrame, entries: list[Signature], keys: list[str], page_ord: str = "page_ord") -> DataFrame:
    """First match per (keys, signature) over extracted pages."""
    return first_matches(with_lower(extracted).withColumn("_hits", page_hits(entries)), "_hits", keys, page_ord)


def hreflang_matches(
    pages: DataFrame,
    keys: list[str],
    hosts: str = "external_hosts",
    verified: bool = False,
    min_hosts: int = HREFLANG_MIN_HOSTS,
) -> DataFrame:
    """Stores whose pages name at least `min_hosts` distinct external hosts as language alternates.

    `hosts` is the page's array of external hosts. The reported text is the sorted list of a store's hosts.
    """
    distinct = values.exploded(pages, keys, hosts, "host").distinct()
    shown = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list("host")).alias("listed")).where(F.size("listed") >= min_hosts)
    return shown.select(
        *keys,
        F.lit(HREFLANG_KEY).alias("key"),
        F.lit(None).cast("string").alias("capability"),
        F.array_join("listed", ";").alias("matched_on"),
        F.lit(f"hreflang alternates on >= {min_hosts} external hosts").alias("pattern"),
        F.lit(verified).alias("verified"),
    )


def fingerprint_matches(pages: DataFrame, hits: str, entries: list[Signature], keys: list[str], page_ord: str = "page_ord") -> DataFrame:
    """First matches of the fingerprint patterns, plus the computed hreflang rule when its entry is present."""
    out = first_matches(pages, hits, keys, page_ord)
    for e in entries:
        if e.key == HREFLANG_KEY:
            out = out.unionByName(hreflang_matches(pages, keys, verified=e.verified))
    return out


def match_fingerprints(extracted: DataFrame, entries: list[Signature], keys: list[str], page_ord: str = "page_ord") -> DataFrame:
    """Fingerprint matches over extracted pages."""
    hosts = extraction.external_hosts(F.col("hreflang_alternates"), F.col("domain"))
    shaped = with_lower(extracted).withColumn("_hits", page_hits(entries)).withColumn("external_hosts", hosts)
    return fingerprint_matches(shaped, "_hits", entries, keys, page_ord)
