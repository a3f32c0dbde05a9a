"""Job posts: board links, board feeds in three layouts, term matching, first/last seen, monthly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import dates, markup, values

# Search terms (the trailing blank of the second is meant), board hosts, career paths.
TERMS = [
    "shopify plus",
    "shopify+ ",
    "hydrogen",
    "headless commerce",
    "replatform",
    "re-platform",
    "checkout extensibility",
    "shopify functions",
]
SLUG_PATTERNS = {
    "greenhouse": r"boards\.greenhouse\.io/([A-Za-z0-9_-]+)",
    "lever": r"jobs\.lever\.co/([A-Za-z0-9_-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)",
}
NOT_SLUGS = ["embed", "job", "jobs"]
CAREER_PATHS = ["/pages/careers", "/pages/jobs", "/careers", "/jobs"]

POST_KEY = ["board", "company_slug", "external_id"]


def board_slugs(html: Column) -> Column:
    """Array of struct(board, slug) named anywhere in a page, distinct, without reserved words."""

    def on(board: str, pattern: str) -> Column:
        slugs = F.filter(
            F.regexp_extract_all(html, F.lit(f"(?i){pattern}"), F.lit(1)), lambda s: ~F.lower(s).isin(NOT_SLUGS)
        )
        return F.transform(slugs, lambda s: F.struct(F.lit(board).alias("board"), s.alias("slug")))

    return F.array_distinct(F.concat(*[on(b, p) for b, p in SLUG_PATTERNS.items()]))


def discover_boards(pages: DataFrame) -> DataFrame:
    """Boards linked from a store's home page or its career pages, each with the first page that named it."""
    home_or_career = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).isin("", "/", *CAREER_PATHS)
    usable = pages.where(home_or_career & (F.col("status") == 200) & F.col("html").isNotNull())
    named = values.exploded(usable, ["domain", "page_ord", "url"], board_slugs(F.col("html")), "b")
    first = F.struct("page_ord", "domain", "url")
    return named.groupBy(F.col("b.board").alias("board"), F.col("b.slug").alias("company_slug")).agg(
        F.min_by(F.struct("domain", "url"), first).alias("_f")
    ).select("board", "company_slug", "_f.domain", F.col("_f.url").alias("discovered_from_url"))


def _text(value: Column) -> Column:
    """An absent value becomes empty text."""
    return F.coalesce(value, F.lit(""))


def parse_boards(payloads: DataFrame) -> DataFrame:
    """Board feed bodies (board, company_slug, body) to postings. Text that is no JSON yields no rows.

    The three layouts differ in where jobs sit, in field names, and in how the posting time is given; the
    first one carries its description as escaped HTML.
    """
    unescape, joined = markup.unescape_udf(), markup.joined_text_udf()
    body = F.try_parse_json("body")
    in_object = F.try_variant_get(body, "$.jobs", "array<variant>")
    top_level = F.try_variant_get(body, "$", "array<variant>")
    listed = F.when(F.col("board") == "lever", top_level).otherwise(in_object)
    jobs = values.exploded(payloads, ["board", "company_slug"], listed, "job").where(
        F.schema_of_variant("job").startswith("OBJECT")
    )

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("job", f"$.{name}", kind)

    created_kind = F.schema_of_variant(F.try_variant_get("job", "$.createdAt", "variant"))
    millis = F.when(created_kind.rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), field("createdAt", "double"))
    greenhouse, lever, ashby = (F.col("board") == b for b in SLUG_PATTERNS)
    markup_text = (
        F.when(greenhouse, _text(field("content")))
        .when(lever, _text(field("description")))
        .otherwise(_text(field("descriptionHtml")))
    )
    nonempty = lambda c: F.nullif(c, F.lit(""))
    flat = jobs.select(
        "board",
        "company_slug",
        _text(field("id")).alias("external_id"),
        _text(F.when(lever, field("text")).otherwise(field("title"))).alias("title"),
        markup_text.alias("_markup"),
        F.when(greenhouse, F.coalesce(nonempty(field("updated_at")), field("first_published")))
        .when(lever, dates.epoch_millis_iso(millis))
        .otherwise(field("publishedAt"))
        .alias("posted_at"),
        _text(F.when(greenhouse, field("absolute_url")).when(lever, field("hostedUrl")).otherwise(field("jobUrl"))).alias("url"),
    )
    # Only text that holds references travels to the decoder; the rest passes by as NULL.
    written = F.col("_markup")
    decoded = F.coalesce(unescape(F.when(F.col("board").eqNullSafe("greenhouse") & written.contains("&"), written)), written)
    return flat.withColumn("_markup", decoded).select(
        "board",
        "company_slug",
        "external_id",
        "title",
        joined(markup.text_nodes(F.col("_markup"))).alias("description_text"),
        "posted_at",
        "url",
    )


def matching_posts(postings: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """Postings that name at least one term, with the terms; a posting counts once however many it names."""
    haystack = F.concat(F.col("title"), F.lit("\n"), F.col("description_text"))
    return postings.withColumn("matched_terms", values.matching_terms(haystack, terms)).where(F.size("matched_terms") > 0)


def merge_posts(recorded: DataFrame, batch: DataFrame) -> DataFrame:
    """Recorded posts after a batch: the first sighting keeps its fields, the last one sets title, terms and last_seen_at.

    Both sides have the post key, domain, title, posted_at, first_seen_at, last_seen_at, matched_terms, source_url.
    Of sightings at one time what is recorded comes before the batch, and within either the fields decide, so
    the result does not depend on the order of rows.
    """
    both = recorded.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    first = F.min(F.struct("first_seen_at", "_new", "source_url", "domain", "posted_at"))
    last = F.max(F.struct("last_seen_at", "_new", "title", "matched_terms"))
    merged = both.groupBy(*POST_KEY).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), first.alias("_f"), last.alias("_l")
    )
    return merged.select(
        *POST_KEY, "_f.domain", "_l.title", "_f.posted_at", "first_seen_at", "last_seen_at", "_l.matched_terms", "_f.source_url"
    )


def monthly_counts(posts: DataFrame, first_seen: str = "first_seen_at", posted: str = "posted_at") -> DataFrame:
    """(basis, month, n): posts by first-seen month and by posted month as written."""
    seen = F.struct(F.lit("first_seen").alias("basis"), F.date_format(first_seen, "yyyy-MM").alias("month"))
    dated = F.struct(F.lit("posted_at").alias("basis"), dates.iso_month_prefix(F.nullif(F.col(posted), F.lit(""))).alias("month"))
    rows = posts.select(F.explode(F.array(seen, dated)).alias("m")).where(F.col("m.month").isNotNull())
    return rows.groupBy("m.basis", "m.month").agg(F.count(F.lit(1)).alias("n"))


def counts_for_months(months: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts first seen in each asked month; 0 where there were none. `months` has a `month` column."""
    seen = monthly_counts(posts).where(F.col("basis") == "first_seen").select("month", "n")
    return months.join(seen, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def attach_stores(posts: DataFrame, boards: DataFrame) -> DataFrame:
    """Posts with the store whose board carried them; NULL for boards not discovered on a store."""
    known = boards.select("board", "company_slug", F.col("domain").alias("_store"))
    joined = posts.drop("domain").join(known, ["board", "company_slug"], "left")
    return joined.withColumnRenamed("_store", "domain")


def board_coverage(stores: DataFrame, boards: DataFrame) -> DataFrame:
    """Stores, stores with at least one board, and the share."""
    with_board = boards.select("domain").distinct().withColumn("_has", F.lit(True))
    counts = stores.select("domain").distinct().join(with_board, "domain", "left").agg(
        F.count(F.lit(1)).alias("stores"), F.count("_has").alias("stores_with_board")
    )
    return counts.withColumn("coverage", values.ratio(F.col("stores_with_board"), F.col("stores")))
