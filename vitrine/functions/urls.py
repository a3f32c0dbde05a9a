"""URL and domain expressions. All of them are JVM-side columns; bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def _bare_host(authority: Column) -> Column:
    """Drop user info (up to the last @) and the port."""
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":.*$", "")


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without credentials or port; '' when the URL names no host."""
    return _bare_host(F.lower(F.regexp_extract(url, _AUTHORITY, 1)))


def asset_host(url: Column) -> Column:
    """Host of an asset URL, NULL for URLs that cannot name one (no `//`)."""
    return F.when(url.contains("//"), host_of(url))


def normalize_domain(raw: Column) -> Column:
    """Registrable form of a domain or URL: lower case, no scheme, path, credentials, port, `www.` or final dots.

    NULL when nothing is left, there is no dot, or a space remains.
    """
    text = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    after_scheme = F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://", "")
    authority = F.regexp_extract(after_scheme, r"^([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(_bare_host(authority), r"^www\.", ""), r"\.+$", "")
    return F.when(bare.contains(".") & ~bare.contains(" "), bare)


def is_http_url(url: Column) -> Column:
    """True for an absolute http or https URL with an authority."""
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#]+"), F.lit(False))


def is_external(host: Column, domain: Column, dot_boundary: bool = False) -> Column:
    """True when `host` is not the store's own.

    By default any host ending in the domain text counts as own, without a dot boundary, so
    `notshop.example` is own to `shop.example`. `dot_boundary=True` asks for a real sub-domain.
    """
    own = host.endswith(F.concat(F.lit("."), domain)) if dot_boundary else host.endswith(domain)
    return (host != "") & (host != domain) & ~own


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a reference against a base URL: absolute, `//host`, `/path`, `?query`, `#part` and dot segments."""
    base_scheme = F.regexp_extract(base, _SCHEME, 1)
    base_root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)

    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    query = F.regexp_extract(href, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(href, r"(#.*)$", 1)
    query = F.when(query == "?", "").otherwise(query)
    fragment = F.when(fragment == "#", "").otherwise(fragment)

    # Empty segments inside a path stay where it begins with a slash; a relative reference drops them from the whole.
    from_base = F.split(F.regexp_replace(base_path, r"(.)/[^/]+$|^/[^/]+$", "$1"), "/")
    joined = F.concat(from_base, F.split(path, "/"))
    inner = F.filter(F.slice(joined, F.lit(2), F.size(joined) - 2), lambda p: p != "")
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, -1, 1)))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    dots = F.element_at(segments, -1).isin(".", "..")
    shown = F.array_join(F.when(dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    clean_path = F.when(shown.startswith("/"), shown).otherwise(F.concat(F.lit("/"), shown))

    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(base_scheme, F.lit(":"), href))
        .when(
            path == "",
            F.concat(base_root, base_path, F.when(query != "", query).otherwise(base_query), fragment),
        )
        .otherwise(F.concat(base_root, clean_path, query, fragment))
    )


def archive_query_url(domain: Column, from_month: Column, to_month: Column) -> Column:
    """Public web-archive index query listing a domain's captured home pages between two months."""
    return F.concat(
        F.lit("https://web.archive.org/cdx/search/cdx?url="),
        domain,
        F.lit("&output=json&fl=timestamp,statuscode,mimetype,digest&filter=statuscode:200&filter=mimetype:text/html&from="),
        F.replace(from_month, F.lit("-"), F.lit("")),
        F.lit("&to="),
        F.replace(to_month, F.lit("-"), F.lit("")),
        F.lit("&collapse=digest"),
    )


def archive_replay_url(timestamp: Column, domain: Column) -> Column:
    """Address of the unmodified archived copy of a domain's home page."""
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("id_/https://"), domain, F.lit("/"))


# Public addresses of the three job-board layouts.
BOARD_ADDRESSES = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{slug}/jobs?content=true",
    "lever": "https://api.lever.co/v0/postings/{slug}?mode=json",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{slug}",
}


def board_url(board: Column, slug: Column) -> Column:
    """Address of a company's public job feed; NULL for an unknown board."""
    out = F.lit(None).cast("string")
    for name, address in BOARD_ADDRESSES.items():
        head, tail = address.split("{slug}")
        out = F.when(board == name, F.concat(F.lit(head), slug, F.lit(tail))).otherwise(out)
    return out
