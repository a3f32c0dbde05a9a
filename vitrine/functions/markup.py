"""HTML as columns: a tag scanner built from two regular expressions, plus attribute and text helpers.

`tags` walks the page once and returns, in document order, every script (with its body) and every
`a`, `link` and `meta` open tag. Comments and style blocks are consumed by the same scan, so markup
quoted inside them is never reported. Possessive quantifiers keep Java's matcher iterative on pages of
any length.
"""

from pyspark.sql import Column, functions as F

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_NAME_END = r"(?=[\s/>])"
TAG_SCAN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(?:script|style){_NAME_END}{_ATTRS}>.*?(?:</(?:script|style)\s*>|\z)"
    rf"|<(?:a|link|meta){_NAME_END}{_ATTRS}>"
)
_ATTR_SCAN = r"""(?s)[^\s"'<>/=]+\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]+)"""

# The named references decoded without a parser. The parser mode decodes all of HTML5.
_CORE_REFERENCES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#x27;": "'",
    "&nbsp;": "\u00a0",
    "&amp;": "&",
}


def decode_references(text: Column) -> Column:
    """Decode the core character references; `&amp;` goes last so nothing is decoded twice."""
    out = text
    for reference, char in _CORE_REFERENCES.items():
        out = F.replace(out, F.lit(reference), F.lit(char))
    return F.when(text.contains("&"), out).otherwise(text)


def tags(html: Column) -> Column:
    """All scripts and all `a`, `link`, `meta` open tags, in document order."""
    return F.filter(
        F.regexp_extract_all(html, F.lit(TAG_SCAN), F.lit(0)),
        lambda t: ~t.startswith("<!") & ~t.rlike(r"(?i)^<style"),
    )


def named(found: Column, name: str) -> Column:
    """The tags of one element name, kept in order."""
    return F.filter(found, lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))


def open_tag(tag: Column) -> Column:
    return F.regexp_extract(tag, rf"(?is)^<[a-z]+{_ATTRS}>", 0)


def script_body(tag: Column) -> Column:
    inner = F.substr(tag, F.length(open_tag(tag)) + 1)
    return F.regexp_replace(inner, r"(?is)</(?:script|style)\s*>$", "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an open tag, NULL when it is absent. The first of repeated attributes counts."""
    pairs = F.regexp_extract_all(F.regexp_replace(tag, r"^<[A-Za-z]+", ""), F.lit(_ATTR_SCAN), F.lit(0))
    mine = F.get(F.filter(pairs, lambda p: p.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    value = F.regexp_replace(mine, r"(?s)^[^=]*=\s*", "")
    bare = F.when(value.rlike(r"""^["']"""), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return decode_references(bare)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")


def text_nodes(html: Column) -> Column:
    """The text between tags, as written, in order; scripts, styles and comments are left out."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)[\s>].*?(?:</\1\s*>|\z)", "<x>")
    return F.split(shown, r"(?s)<[/!?A-Za-z][^>]*>")


def visible_text(html: Column) -> Column:
    """Text nodes with core references decoded, each trimmed, joined by one space."""
    texts = F.transform(text_nodes(html), lambda n: trimmed(decode_references(n)))
    return F.array_join(F.filter(texts, lambda n: n != ""), " ")


def unescape_udf():
    """Arrow-batched decoding of every HTML5 character reference, for text that needs more than the core ones."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def unescape(text: pd.Series) -> pd.Series:
        from html import unescape as decode

        return text.map(decode, na_action="ignore")

    return unescape


def joined_text_udf():
    """Arrow-batched `visible_text` over text nodes, with every HTML5 character reference decoded."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def join(nodes: pd.Series) -> pd.Series:
        from html import unescape as decode

        return nodes.map(lambda found: " ".join(t for t in (decode(n).strip() for n in found) if t), na_action="ignore")

    return join
