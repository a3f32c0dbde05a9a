"""Queries over labelled documents, events and tables at large: evaluation, index series, posts, labels, keyed tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vitrine.functions import dates, markup, urls, values
from vitrine.operators import evaluation, hiring, keyed, labels, quality, reconcile, resampling, review, series
from workload.base import DOMAIN_SQL, EVENT_SCANS, event_scans, query, r6, scored_documents, table
from workload.store_queries import PRODUCTS, SCORES, matches, products, scored

# ---- evaluation -------------------------------------------------------------------------------------

SCORED = "sd AS (SELECT d.doc_id, d.n_chars AS score, l.quality AS y, l.toxic, d.lang, d.source FROM documents d JOIN labels l USING (doc_id))"


def _auc_sql(source: str, score: str, groups: str = "", y: str = "y", weight: str = "1") -> str:
    """Rank form of the AUC as a sub-select with positives, negatives, auc."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""(SELECT {g}CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
      CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) END AS auc FROM (
      SELECT {g}p, n, coalesce(sum(n) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT {g}{score} AS s, CAST(coalesce(sum({weight}) FILTER ({y} = 1), 0) AS DOUBLE) AS p, CAST(coalesce(sum({weight}) FILTER ({y} = 0), 0) AS DOUBLE) AS n
        FROM {source} WHERE {score} IS NOT NULL GROUP BY {g}{score})) {by})"""


@query("eval_auc", f"WITH {SCORED} SELECT positives, negatives, round(auc, 6) AS auc FROM {_auc_sql('sd', 'score')}")
def eval_auc(spark, sf):
    return evaluation.auc(scored_documents(spark, sf)).withColumn("auc", F.round("auc", 6))


@query(
    "eval_pr_decile",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, sha256('7:' || doc_id)) AS rn, count(*) OVER () AS n, sum(y) OVER () AS pos FROM sd),
        t AS (SELECT max(greatest(1, n // 10)) AS k, CAST(sum(CASE WHEN rn <= greatest(1, n // 10) THEN y ELSE 0 END) AS BIGINT) AS hits, max(pos) AS pos FROM r)
        SELECT k, hits, round(hits / CAST(k AS DOUBLE), 6) AS precision, round(hits / CAST(pos AS DOUBLE), 6) AS recall FROM t""",
)
def eval_pr_decile(spark, sf):
    out = evaluation.precision_recall_top(scored_documents(spark, sf), "doc_id")
    return out.select("k", "hits", r6("precision", "precision"), r6("recall", "recall"))


@query(
    "eval_pr_decile_ties",
    f"""WITH {SCORED}, q AS (SELECT *, score // 5000 AS coarse FROM sd),
        r AS (SELECT *, row_number() OVER (ORDER BY coarse DESC, sha256('7:' || doc_id)) AS rn, count(*) OVER () AS n, sum(y) OVER () AS pos FROM q),
        t AS (SELECT max(greatest(1, n // 10)) AS k, CAST(sum(CASE WHEN rn <= greatest(1, n // 10) THEN y ELSE 0 END) AS BIGINT) AS hits, max(pos) AS pos FROM r)
        SELECT k, hits, round(hits / CAST(k AS DOUBLE), 6) AS precision, round(hits / CAST(pos AS DOUBLE), 6) AS recall FROM t""",
)
def eval_pr_decile_ties(spark, sf):
    coarse = scored_documents(spark, sf).withColumn("score", F.floor(F.col("score") / 5000))
    out = evaluation.precision_recall_top(coarse, "doc_id")
    return out.select("k", "hits", r6("precision", "precision"), r6("recall", "recall"))


@query(
    "eval_pr_threshold",
    f"""WITH {SCORED} SELECT count(*) FILTER (score >= 2000) AS flagged,
        round(count(*) FILTER (score >= 2000 AND y = 1) / CAST(count(*) FILTER (score >= 2000) AS DOUBLE), 6) AS precision,
        round(count(*) FILTER (score >= 2000 AND y = 1) / CAST(count(*) FILTER (y = 1) AS DOUBLE), 6) AS recall FROM sd""",
)
def eval_pr_threshold(spark, sf):
    out = evaluation.precision_recall_at(scored_documents(spark, sf), 2000)
    return out.select("flagged", r6("precision", "precision"), r6("recall", "recall"))


@query(
    "eval_size_buckets",
    f"""WITH {SCORED}, z AS (SELECT *, CAST(doc_id AS BIGINT) * 7919 % 1009 AS size FROM sd),
        e AS (SELECT quantile_cont(CAST(size AS DOUBLE), 0.25) AS e1, quantile_cont(CAST(size AS DOUBLE), 0.5) AS e2, quantile_cont(CAST(size AS DOUBLE), 0.75) AS e3 FROM z WHERE doc_id % 6 <> 0),
        b AS (SELECT z.*, CASE WHEN size >= e3 THEN 'q4_largest' WHEN size >= e2 THEN 'q3' WHEN size >= e1 THEN 'q2' ELSE 'q1_smallest' END AS name FROM z, e WHERE doc_id % 6 <> 0)
        SELECT name, round(auc, 6) AS auc FROM {_auc_sql('b', 'score', 'name')}""",
)
def eval_size_buckets(spark, sf):
    size = F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") * 7919 % 1009)
    out = evaluation.size_bucket_aucs(scored_documents(spark, sf).withColumn("size", size), "size")
    return out.withColumn("auc", F.round("auc", 6))


_FEATURE_SQL = """u AS (SELECT y, 'n_chars' AS feature, CAST(score AS DOUBLE) AS value FROM sd UNION ALL
  SELECT y, 'toxic', CAST(CASE WHEN doc_id % 4 <> 1 THEN toxic END AS DOUBLE) FROM sd UNION ALL SELECT y, 'id_mod', CAST(doc_id % 97 AS DOUBLE) FROM sd)"""


@query("eval_single_feature_auc", f"WITH {SCORED}, {_FEATURE_SQL} SELECT feature, positives, negatives, round(auc, 6) AS auc FROM {_auc_sql('u', 'value', 'feature')}")
def eval_single_feature_auc(spark, sf):
    docs = scored_documents(spark, sf).select(
        "y", "n_chars", F.when(F.col("doc_id") % 4 != 1, F.col("toxic")).alias("toxic"), (F.col("doc_id") % 97).alias("id_mod")
    )
    return evaluation.single_feature_aucs(docs, ["n_chars", "toxic", "id_mod"]).withColumn("auc", F.round("auc", 6))


RESAMPLES = 1000


@query(
    "eval_bootstrap_ci",
    f"""WITH {SCORED}, seeds AS (SELECT score, y, CAST(('0x' || substr(sha256('7:' || doc_id), 1, 8)) AS BIGINT) AS seed FROM sd),
        res AS (SELECT b, score, y, {resampling.weight_sql("seed", "b")} AS w FROM seeds, (SELECT unnest(range(0, {RESAMPLES})) AS b)),
        a AS (SELECT b, auc FROM {_auc_sql('res', 'score', 'b', weight='w')} WHERE auc IS NOT NULL)
        SELECT count(*) AS used, round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high FROM a""",
)
def eval_bootstrap_ci(spark, sf):
    out = evaluation.bootstrap_interval(scored_documents(spark, sf), "doc_id", resamples=RESAMPLES)
    return out.select("used", r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


@query(
    "eval_base_rate",
    f"WITH {SCORED} SELECT count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives, round(avg(y), 6) AS base_rate FROM sd",
)
def eval_base_rate(spark, sf):
    return evaluation.base_rate(scored_documents(spark, sf)).withColumn("base_rate", F.round("base_rate", 6))


@query("eval_logistic_cv")
def eval_logistic_cv(spark, sf):
    docs = scored_documents(spark, sf).withColumn("id_mod", F.col("doc_id") % 97)
    result = evaluation.logistic_diagnostic(docs, "doc_id", ["n_chars", "toxic", "id_mod"])
    return evaluation.metric_rows(spark, result)


@query("score_table", f"WITH {SCORED} SELECT doc_id, y AS label, round(CAST(score AS DOUBLE), 4) AS score FROM sd")
def score_table(spark, sf):
    docs = scored_documents(spark, sf).withColumn("score", F.col("score").cast("double"))
    return evaluation.score_table(docs, "doc_id")


@query(
    "top_negatives",
    f"""WITH {SCORES}, neg AS (SELECT domain FROM f WHERE hreflang_alt_count < 12),
        b AS (SELECT domain, score FROM neg JOIN tot USING (domain) ORDER BY score DESC, domain LIMIT 30)
        SELECT b.domain, score, product_count, review_count_max, coalesce((SELECT string_agg(DISTINCT key, ';' ORDER BY key) FROM m WHERE m.domain = b.domain), '') AS matched_app_keys
        FROM b JOIN f ON f.domain = b.domain""",
)
def top_negatives(spark, sf):
    rows = scored(spark, sf)
    negatives = rows.where(F.col("hreflang_alt_count") < 12).select("domain")
    out = evaluation.top_negatives(negatives, rows, matches(spark, sf))
    return out.select("domain", "score", "product_count", "review_count_max", "matched_app_keys")


@query(
    "report_format",
    f"""WITH {SCORED} SELECT lang, CASE WHEN auc IS NULL THEN 'n/a' ELSE printf('%.3f', auc) END AS auc FROM {_auc_sql('sd', 'score', 'lang')}""",
)
def report_format(spark, sf):
    return evaluation.auc(scored_documents(spark, sf), group=["lang"]).select("lang", values.three_decimals(F.col("auc")).alias("auc"))


# ---- review tabulation ------------------------------------------------------------------------------

_CATEGORY = "CASE doc_id % 9 WHEN 0 THEN 'volume_only_legit' WHEN 1 THEN 'unknown' WHEN 2 THEN 'score_zero_not_flagged' WHEN 3 THEN 'possibly_plus_mislabeled' ELSE 'new_store_zero_base' END"
_VOCABULARY = ", ".join(f"'{c}'" for c in review.CATEGORIES)


@query(
    "review_tabulation",
    f"""WITH {SCORED}, r AS (SELECT {_CATEGORY} AS category, CASE WHEN toxic = 1 OR doc_id % 3 = 0 THEN 0 ELSE score END AS score FROM sd),
        c AS (SELECT v.category, count(r.category) AS n, count(*) FILTER (r.score > 0) AS flagged FROM (SELECT unnest([{_VOCABULARY}]) AS category) v LEFT JOIN r ON r.category = v.category GROUP BY 1),
        d AS (SELECT sum(flagged) AS total FROM c WHERE category <> 'score_zero_not_flagged')
        SELECT category, n, flagged, CASE WHEN category <> 'score_zero_not_flagged' THEN round(flagged / CAST(total AS DOUBLE), 6) END AS flagged_share FROM c, d""",
)
def review_tabulation(spark, sf):
    docs = scored_documents(spark, sf)
    zero = (F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0)
    reviewed = docs.select(F.expr(_CATEGORY).alias("reviewer_category"), F.when(zero, 0).otherwise(F.col("score")).alias("score"))
    return review.tabulate(reviewed).withColumn("flagged_share", F.round("flagged_share", 6))


# ---- index series -----------------------------------------------------------------------------------


@query("prior_scan", f"WITH {EVENT_SCANS} SELECT scan_date, prior_scan_date FROM scans")
def prior_scan(spark, sf):
    return series.with_prior_scan(event_scans(spark, sf)[0]).drop("panel_version")


MOVES = f"""{EVENT_SCANS}, ver AS (SELECT DISTINCT domain, scan_date FROM hits WHERE verified),
  moves AS (SELECT f.domain, s.scan_date, s.prior_scan_date, n.domain IS NOT NULL AS present, n.domain IS NOT NULL AND w.domain IS NOT NULL AS converted
    FROM feats f JOIN scans s ON s.prior_scan_date = f.scan_date
    LEFT JOIN feats n ON n.domain = f.domain AND n.scan_date = s.scan_date LEFT JOIN ver w ON w.domain = f.domain AND w.scan_date = s.scan_date
    WHERE NOT EXISTS (SELECT 1 FROM ver v WHERE v.domain = f.domain AND v.scan_date = f.scan_date))"""


@query("scan_conversions", f"WITH {MOVES} SELECT domain, scan_date, prior_scan_date, present, converted FROM moves")
def scan_conversions(spark, sf):
    return series.transitions(*event_scans(spark, sf)).drop("panel_version")


@query(
    "scan_attrition",
    f"""WITH {MOVES} SELECT scan_date, count(*) FILTER (converted) AS n_converted, count(*) FILTER (present) AS n_prior_selfserve, count(*) FILTER (NOT present) AS n_attrition FROM moves GROUP BY 1""",
)
def scan_attrition(spark, sf):
    return series.conversion_counts(series.transitions(*event_scans(spark, sf))).drop("panel_version")


def _series_sql(filtered: bool) -> str:
    members = "SELECT f.* FROM feats f WHERE CAST(substr(domain, 2) AS BIGINT) % 3 <> 0" if filtered else "SELECT * FROM feats"
    n = "(SELECT count(DISTINCT domain) FROM feats WHERE CAST(substr(domain, 2) AS BIGINT) % 3 <> 0)" if filtered else "scanned"
    return f"""WITH {MOVES}, mem AS ({members}), anyfp AS (SELECT DISTINCT domain, scan_date FROM hits),
      flagged AS (SELECT mem.*, a.domain IS NULL AS self FROM mem LEFT JOIN anyfp a ON a.domain = mem.domain AND a.scan_date = mem.scan_date),
      sh AS (SELECT scan_date, count(*) AS scanned, avg(CAST(score >= 200 AS INTEGER)) FILTER (self) AS a, avg(CAST(workaround_app_count > 0 AS INTEGER)) FILTER (self) AS b, avg(CAST(high_growth_active AS INTEGER)) FILTER (self) AS c FROM flagged GROUP BY 1),
      mv AS (SELECT scan_date, count(*) FILTER (converted) AS n_converted, count(*) FILTER (present) AS n_prior FROM moves GROUP BY 1),
      mp AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
      SELECT s.scan_date, CAST({n} AS BIGINT) AS panel_n, scanned AS panel_n_scanned, round(a, 6) AS share_at_threshold, round(b, 6) AS share_workaround_any, round(c, 6) AS share_high_growth,
        CASE WHEN n_prior > 0 THEN round(n_converted / CAST(n_prior AS DOUBLE), 6) END AS share_converted_since_prior, n_converted, n_prior AS n_prior_selfserve, coalesce(mp.n, 0) AS hiring_posts_month
      FROM scans s LEFT JOIN sh ON sh.scan_date = s.scan_date LEFT JOIN mv ON mv.scan_date = s.scan_date LEFT JOIN mp ON mp.month = strftime(s.scan_date, '%Y-%m')"""


def _series(spark, sf, with_panel: bool):
    scans, features, hits = event_scans(spark, sf)
    posts = table(spark, sf, "events").where(F.col("event_type") == "signup")
    monthly = posts.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    panel = features.where(F.substr("domain", F.lit(2)).cast("long") % 3 != 0).select("domain") if with_panel else None
    out = series.index_series(scans, features, hits, panel, monthly, threshold=200)
    shares = ["share_at_threshold", "share_workaround_any", "share_high_growth", "share_converted_since_prior"]
    return out.select(*[r6(c, c) if c in shares else F.col(c) for c in out.columns if c != "panel_version"])


@query("index_series", _series_sql(True))
def index_series(spark, sf):
    return _series(spark, sf, True)


@query("index_series_no_panel", _series_sql(False))
def index_series_no_panel(spark, sf):
    return _series(spark, sf, False)


@query("fingerprint_any_stores", f"WITH {EVENT_SCANS} SELECT scan_date, count(DISTINCT domain) AS stores, count(DISTINCT domain) FILTER (verified) AS verified_stores FROM hits GROUP BY 1")
def fingerprint_any_stores(spark, sf):
    _, _, hits = event_scans(spark, sf)
    once = hits.groupBy("domain", "scan_date").agg(F.bool_or("verified").alias("verified"))
    return once.groupBy("scan_date").agg(F.count(F.lit(1)).alias("stores"), F.count_if("verified").alias("verified_stores"))


# ---- posts ------------------------------------------------------------------------------------------

TERMS = ["the ", "Que ", "ing and", "der", "para", "zzz-none"]
_TERM_SQL = ", ".join(f"'{t}'" for t in TERMS)


@query(
    "term_match",
    f"""WITH a AS (SELECT doc_id, list_filter([{_TERM_SQL}], lambda t: contains(lower(source || chr(10) || text), lower(t))) AS terms FROM documents)
        SELECT doc_id, array_to_string(terms, '|') AS matched_terms FROM a WHERE len(terms) > 0""",
)
def term_match(spark, sf):
    posts = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("description_text"))
    return hiring.matching_posts(posts, TERMS).select("doc_id", F.array_join("matched_terms", "|").alias("matched_terms"))


def board_payloads(spark, sf):
    """Documents as one-job board feeds in the three layouts; some bodies are no JSON."""
    docs = table(spark, sf, "documents")
    i = F.col("doc_id")
    board = F.element_at(F.array(F.lit("greenhouse"), F.lit("lever"), F.lit("ashby")), (i % 3 + 1).cast("int"))
    text = F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("<"), F.lit(" ")), F.lit("&"), F.lit("+")), F.lit("</p><script>x()</script><b> end &amp; out </b>"))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ident = i.cast("string")
    one = F.struct(
        i.alias("id"),
        F.col("source").alias("title"),
        escaped.alias("content"),
        F.when(i % 2 == 0, F.lit("2026-08-01T10:00:00-04:00")).alias("updated_at"),
        F.lit("2026-05-02").alias("first_published"),
        F.concat(F.lit("https://boards.example/"), ident).alias("absolute_url"),
    )
    two = F.struct(
        ident.alias("id"),
        F.col("source").alias("text"),
        text.alias("description"),
        (F.lit(1750000000000) + i * 86400000).alias("createdAt"),
        F.concat(F.lit("https://jobs.example/"), ident).alias("hostedUrl"),
    )
    three = F.struct(
        ident.alias("id"),
        F.col("source").alias("title"),
        text.alias("descriptionHtml"),
        F.lit("2026-07-03T00:00:00Z").alias("publishedAt"),
        F.concat(F.lit("https://ashby.example/"), ident).alias("jobUrl"),
    )
    body = (
        F.when(i % 50 == 7, "<html>not json</html>")
        .when(i % 3 == 0, F.to_json(F.struct(F.array(one).alias("jobs"))))
        .when(i % 3 == 1, F.to_json(F.array(two)))
        .otherwise(F.to_json(F.struct(F.array(three).alias("jobs"))))
    )
    return docs.select(board.alias("board"), F.concat(F.lit("slug"), (i % 40).cast("string")).alias("company_slug"), body.alias("body"))


@query(
    "board_postings",
    r"""WITH d AS (SELECT doc_id AS i, source, regexp_replace(replace(replace(text, '<', ' '), '&', '+'), '^\s+|\s+$', '', 'g') AS body FROM documents WHERE doc_id % 50 <> 7)
        SELECT CASE i % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS board, 'slug' || (i % 40) AS company_slug, CAST(i AS VARCHAR) AS external_id, source AS title,
          md5(CASE WHEN body = '' THEN '' ELSE body || ' ' END || 'end & out') AS description_md5,
          CASE i % 3 WHEN 0 THEN CASE WHEN i % 2 = 0 THEN '2026-08-01T10:00:00-04:00' ELSE '2026-05-02' END
            WHEN 1 THEN strftime(make_timestamp_ms(1750000000000 + i * 86400000), '%Y-%m-%dT%H:%M:%SZ') ELSE '2026-07-03T00:00:00Z' END AS posted_at,
          CASE i % 3 WHEN 0 THEN 'https://boards.example/' WHEN 1 THEN 'https://jobs.example/' ELSE 'https://ashby.example/' END || i AS url FROM d""",
)
def board_postings(spark, sf):
    out = hiring.parse_boards(board_payloads(spark, sf))
    return out.withColumn("description_md5", F.md5("description_text")).drop("description_text")


@query("epoch_millis", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def epoch_millis(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", dates.epoch_millis_iso(ms).alias("iso"))


def sightings(spark, sf):
    """Events as sightings of posts: the post is (event type, user), the title its value."""
    ev = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        F.lit("lever").alias("board"),
        F.col("event_type").alias("company_slug"),
        F.col("user_id").cast("string").alias("external_id"),
        F.concat(F.lit("store"), (F.col("event_id") % 7).cast("string")).alias("domain"),
        F.col("value").cast("string").alias("title"),
        F.date_format(F.date_sub(F.to_date(ts), (F.col("event_id") % 90).cast("int")), "yyyy-MM-dd").alias("posted_at"),
        ts.alias("first_seen_at"),
        ts.alias("last_seen_at"),
        F.array(F.col("event_type")).alias("matched_terms"),
        F.concat(F.lit("https://jobs.example/"), F.col("event_id").cast("string")).alias("source_url"),
    )


def merged_posts(spark, sf):
    seen = sightings(spark, sf)
    half = F.col("first_seen_at") < F.lit("2024-01-15").cast("timestamp")
    old = hiring.merge_posts(seen.where(half).limit(0), seen.where(half))
    return hiring.merge_posts(old, seen.where(~half))


POSTS = """posts AS (SELECT event_type AS company_slug, CAST(user_id AS VARCHAR) AS external_id, 'store' || arg_min(event_id % 7, ts) AS domain, max(ts) AS last_ts, min(ts) AS first_ts,
    arg_max(value, ts) AS last_value, strftime(CAST(arg_min(CAST(ts AS DATE) - CAST(event_id % 90 AS INTEGER), ts) AS DATE), '%Y-%m-%d') AS posted_at, arg_min(event_id, ts) AS first_event FROM events GROUP BY 1, 2)"""


@query(
    "posts_first_last_seen",
    f"""WITH {POSTS} SELECT company_slug, external_id, domain, posted_at, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_seen,
        CAST(last_value AS DOUBLE) AS title_value, 'https://jobs.example/' || first_event AS source_url FROM posts""",
)
def posts_first_last_seen(spark, sf):
    return merged_posts(spark, sf).select(
        "company_slug",
        "external_id",
        "domain",
        "posted_at",
        F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        F.col("title").cast("double").alias("title_value"),
        "source_url",
    )


MONTHLY = f"""{POSTS}, monthly AS (SELECT 'first_seen' AS basis, strftime(first_ts, '%Y-%m') AS month, count(*) AS n FROM posts GROUP BY 1, 2
  UNION ALL SELECT 'posted_at', substr(posted_at, 1, 7), count(*) FROM posts GROUP BY 1, 2)"""


@query("posts_monthly", f"WITH {MONTHLY} SELECT basis, month, n FROM monthly")
def posts_monthly(spark, sf):
    return hiring.monthly_counts(merged_posts(spark, sf))


@query(
    "posts_for_month",
    f"""WITH {MONTHLY}, asked AS (SELECT DISTINCT strftime(CAST(ts AS DATE) + to_months(1), '%Y-%m') AS month FROM events UNION SELECT DISTINCT strftime(ts, '%Y-%m') FROM events)
        SELECT asked.month, coalesce(n, 0) AS n FROM asked LEFT JOIN monthly ON monthly.month = asked.month AND basis = 'first_seen'""",
)
def posts_for_month(spark, sf):
    day = F.to_date("ts")
    both = F.explode(F.array(F.date_format(day, "yyyy-MM"), F.date_format(F.add_months(day, 1), "yyyy-MM")))
    asked = table(spark, sf, "events").select(both.alias("month")).distinct()
    return hiring.counts_for_months(asked, merged_posts(spark, sf))


@query(
    "posts_to_store",
    f"""WITH {POSTS}, b AS (SELECT company_slug, 'owner-' || company_slug AS domain FROM (SELECT DISTINCT event_type AS company_slug FROM events) WHERE company_slug <> 'error')
        SELECT posts.company_slug, external_id, b.domain FROM posts LEFT JOIN b USING (company_slug)""",
)
def posts_to_store(spark, sf):
    boards = table(spark, sf, "events").where(F.col("event_type") != "error").select("event_type").distinct()
    known = boards.select(F.lit("lever").alias("board"), F.col("event_type").alias("company_slug"), F.concat(F.lit("owner-"), "event_type").alias("domain"))
    return hiring.attach_stores(merged_posts(spark, sf), known).select("company_slug", "external_id", "domain")


# ---- labels -----------------------------------------------------------------------------------------

TODAY = date(2001, 8, 15)


def label_file(spark, sf):
    """Customers as label lines with planted faults."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    domain = (
        F.when(k % 50 == 7, "")
        .when(k % 50 == 8, "no-dot")
        .when(k % 20 == 3, F.concat(F.lit("WWW.Shop"), (k % 30).cast("string"), F.lit(".example")))
        .otherwise(F.concat(F.lit("https://shop-"), k.cast("string"), F.lit(".example/x")))
    )
    month = (
        F.when(k % 31 == 2, "2001/01")
        .when(k % 31 == 5, "2001-07")
        .otherwise(F.date_format(F.add_months(F.lit("2001-05-01").cast("date"), -(k % 40).cast("int")), "yyyy-MM"))
    )
    return c.select(
        (k + 2).alias("line"),
        domain.alias("domain"),
        F.when(k % 41 == 4, "ftp://x.example").otherwise("https://news.example/a").alias("source_url"),
        month.alias("migration_month"),
        F.when(k % 3 == 0, "").otherwise("said so").alias("quote"),
        F.when(k % 37 == 6, "").otherwise("me").alias("added_by"),
        F.lit("2001-08-01").alias("added_at"),
    )


LABEL_FILE = r"""lf AS (SELECT c_custkey + 2 AS line, c_custkey AS k,
    CASE WHEN c_custkey % 50 = 7 THEN '' WHEN c_custkey % 50 = 8 THEN 'no-dot' WHEN c_custkey % 20 = 3 THEN 'WWW.Shop' || (c_custkey % 30) || '.example' ELSE 'https://shop-' || c_custkey || '.example/x' END AS raw,
    CASE WHEN c_custkey % 50 IN (7, 8) THEN NULL WHEN c_custkey % 20 = 3 THEN 'shop' || (c_custkey % 30) || '.example' ELSE 'shop-' || c_custkey || '.example' END AS domain,
    CASE WHEN c_custkey % 31 = 2 THEN '2001/01' WHEN c_custkey % 31 = 5 THEN '2001-07' ELSE strftime(DATE '2001-05-01' - to_months(CAST(c_custkey % 40 AS INTEGER)), '%Y-%m') END AS month FROM customer),
  le AS (SELECT line, 'empty required column domain' AS error FROM lf WHERE raw = ''
    UNION ALL SELECT line, 'empty required column added_by' FROM lf WHERE k % 37 = 6
    UNION ALL SELECT line, CASE WHEN raw = '' THEN 'empty domain' ELSE 'not a domain: ' || raw END FROM lf WHERE domain IS NULL
    UNION ALL SELECT line, 'duplicate domain ' || domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY line) AS rn FROM lf WHERE domain IS NOT NULL) WHERE rn > 1
    UNION ALL SELECT line, 'source_url is not a valid http(s) URL: ftp://x.example' FROM lf WHERE domain IS NOT NULL AND k % 41 = 4
    UNION ALL SELECT line, 'not a yyyy-mm month: 2001/01' FROM lf WHERE domain IS NOT NULL AND k % 31 = 2
    UNION ALL SELECT line, 'migration_month 2001-07 is less than 3 months before today' FROM lf WHERE domain IS NOT NULL AND k % 31 = 5)"""


@query("label_errors", f"WITH {LABEL_FILE} SELECT line, error FROM le")
def label_errors(spark, sf):
    _, required = labels.LABEL_FILES["confirmed_migrators.csv"]
    return labels.error_rows(labels.validate(label_file(spark, sf), "confirmed_migrator", required, TODAY))


@query(
    "label_valid_rows",
    f"""WITH {LABEL_FILE} SELECT domain, 'confirmed_migrator' AS label_set, month AS label_value, CASE WHEN k % 3 <> 0 THEN 'said so' END AS quote FROM lf WHERE line NOT IN (SELECT line FROM le)""",
)
def label_valid_rows(spark, sf):
    _, required = labels.LABEL_FILES["confirmed_migrators.csv"]
    checked = labels.validate(label_file(spark, sf), "confirmed_migrator", required, TODAY)
    return labels.label_rows(checked.where(F.size("errors") == 0), "confirmed_migrator").select("domain", "label_set", "label_value", "quote")


@query("label_overlap", "SELECT DISTINCT d.source AS domain FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 INTERSECT SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0")
def label_overlap(spark, sf):
    docs = scored_documents(spark, sf).withColumn("domain", F.col("source"))
    return labels.overlap(docs.where(F.col("y") == 1), docs.where(F.col("y") == 0))


def _members(spark, sf):
    _, features, hits = event_scans(spark, sf)
    marked = hits.groupBy("domain", "scan_date").agg(F.lit(True).alias("fingerprint_any"))
    states = features.join(marked, ["domain", "scan_date"], "left").withColumn("fingerprint_any", F.coalesce("fingerprint_any", F.lit(False)))
    customers = table(spark, sf, "customer")
    sets = customers.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("domain"), F.col("c_mktsegment").alias("label_set"))
    return labels.set_members(sets, states)


MEMBERS = f"""{EVENT_SCANS}, st AS (SELECT f.domain, f.scan_date, EXISTS (SELECT 1 FROM hits h WHERE h.domain = f.domain AND h.scan_date = f.scan_date) AS fp FROM feats f),
  newest AS (SELECT domain, arg_max(fp, scan_date) AS fp FROM st GROUP BY 1),
  mem AS (SELECT c_mktsegment AS label_set, 'u' || c_custkey AS domain, CASE WHEN n.fp IS NULL THEN 'unscanned' WHEN n.fp THEN 'flagged' ELSE 'clean' END AS state
    FROM customer LEFT JOIN newest n ON n.domain = 'u' || c_custkey)"""


@query("label_set_members", f"WITH {MEMBERS} SELECT label_set, domain, state FROM mem")
def label_set_members(spark, sf):
    return _members(spark, sf)


@query(
    "label_set_quality",
    f"""WITH {MEMBERS} SELECT label_set, count(*) AS total, count(*) FILTER (state <> 'unscanned') AS scanned, count(*) FILTER (state = 'flagged') AS with_fingerprint,
        CASE WHEN count(*) FILTER (state <> 'unscanned') > 0 THEN round(count(*) FILTER (state = 'flagged') / CAST(count(*) FILTER (state <> 'unscanned') AS DOUBLE), 6) END AS share_with_fingerprint FROM mem GROUP BY 1""",
)
def label_set_quality(spark, sf):
    return labels.set_quality(_members(spark, sf)).withColumn("share_with_fingerprint", F.round("share_with_fingerprint", 6))


# ---- keyed tables -----------------------------------------------------------------------------------


@query("latest_per_key", "SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def latest_per_key(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return keyed.latest(ev, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("keep_first_per_key", "SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value FROM events GROUP BY 1, 2")
def keep_first_per_key(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return keyed.keep_first(ev, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def _halves(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return ev.where(F.col("event_id") % 3 == 0), ev.where(F.col("event_id") % 3 != 0)


@query(
    "keep_first_upsert",
    "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 3 = 0 AND o.user_id = events.user_id AND o.event_type = events.event_type) GROUP BY 1, 2",
)
def keep_first_upsert(spark, sf):
    old, new = _halves(spark, sf)
    return keyed.upsert_keep_first(old, new, ["user_id", "event_type"], ["event_id"])


@query(
    "replace_upsert",
    """WITH o AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
         n AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
       SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""",
)
def replace_upsert(spark, sf):
    old, new = _halves(spark, sf)
    keys = ["user_id", "event_type"]
    return keyed.upsert_replace(keyed.latest(old, keys, ["event_id"]), new, keys, ["event_id"])


@query(
    "merge_coalesce",
    """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 2 = 0),
         n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'renamed' END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'moved' END AS segment FROM customer WHERE c_custkey % 3 = 0)
       SELECT coalesce(c.k, n.k) AS k, coalesce(n.name, c.name) AS name, coalesce(n.segment, c.segment) AS segment FROM c FULL JOIN n ON n.k = c.k""",
)
def merge_coalesce(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 2 == 0).select(k.alias("k"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    new = c.where(k % 3 == 0).select(k.alias("k"), F.when(k % 5 == 0, "renamed").alias("name"), F.when(k % 7 == 0, "moved").alias("segment"))
    return keyed.partial_update(old, new, ["k"])


@query(
    "append_unseen",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 3 = 0 AND o.user_id = events.user_id AND o.event_type = events.event_type)",
)
def append_unseen(spark, sf):
    old, new = _halves(spark, sf)
    return keyed.append_unseen(new, old, ["user_id", "event_type"])


@query("orphan_check", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def orphan_check(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    known = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select("o_orderkey")
    return keyed.orphans(lines, known, "l_orderkey", "o_orderkey")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("customer", "orders", "lineitem", "events", "pages", "documents", "labels")))
def row_counts(spark, sf):
    return keyed.row_counts({t: table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events", "pages", "documents", "labels")})


@query("point_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def point_read(spark, sf):
    return keyed.rows_for(table(spark, sf, "orders"), o_custkey=7, o_orderstatus="F").select("o_orderkey", "o_totalprice")


@query("undetermined_stores", "SELECT 'c' || c_custkey AS domain FROM customer WHERE c_custkey % 6 = 5")
def undetermined_stores(spark, sf):
    from vitrine.operators import intake

    k = F.col("c_custkey")
    stores = table(spark, sf, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("domain"), F.when(k % 6 != 5, k % 2 == 0).alias("is_platform"))
    return intake.undetermined(stores).select("domain")


@query("json_variant_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_variant_extract(spark, sf):
    parsed = F.try_parse_json("props")
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"), F.try_variant_get(parsed, "$.missing", "string").alias("missing")
    )


# ---- audits and reconciliation ----------------------------------------------------------------------


@query(
    "number_trace",
    r"""WITH nums AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) AS number FROM documents),
         runs AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[0-9.]+')) AS run FROM pages)
       SELECT number, EXISTS (SELECT 1 FROM runs WHERE contains(run, number)) AS traced FROM nums""",
)
def number_trace(spark, sf):
    return quality.trace_numbers(quality.numbers_in(table(spark, sf, "documents")), table(spark, sf, "pages"), "html")


def disclosures(spark, sf):
    """Orders as quarterly disclosures: totals, open share, and two list prices."""
    o = table(spark, sf, "orders")
    q = o.groupBy(dates.quarter_of(F.to_date("o_orderdate")).alias("quarter")).agg(
        F.round(F.sum("o_totalprice") / 1000000, 3).alias("total"),
        F.round(F.count_if(F.col("o_orderstatus") == "O") * 100 / F.count(F.lit(1)), 3).alias("share"),
        F.round(F.min("o_totalprice"), 2).alias("low"),
        F.round(F.max("o_totalprice"), 2).alias("high"),
        F.count(F.lit(1)).cast("double").alias("base"),
    )
    names = {"total": reconcile.TOTAL_MRR, "share": reconcile.PLUS_SHARE, "low": reconcile.ADVANCED_PRICE, "high": reconcile.PLUS_PRICE, "base": reconcile.BASE}
    long = q.withColumn("share", F.col("share").cast("double")).unpivot(["quarter"], list(names), "k", "value")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("k"))
    return long.select("quarter", named.alias("metric"), F.col("value").cast("double").alias("value"))


DISCLOSURES = f"""q AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, round(sum(o_totalprice) / 1000000, 3) AS total,
    round(CAST(count(*) FILTER (o_orderstatus = 'O') * 100 / CAST(count(*) AS DOUBLE) AS DOUBLE), 3) AS share, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high, CAST(count(*) AS DOUBLE) AS base FROM orders GROUP BY 1),
  dis AS (SELECT quarter, '{reconcile.TOTAL_MRR}' AS metric, total AS value FROM q UNION ALL SELECT quarter, '{reconcile.PLUS_SHARE}', share FROM q UNION ALL SELECT quarter, '{reconcile.ADVANCED_PRICE}', low FROM q
    UNION ALL SELECT quarter, '{reconcile.PLUS_PRICE}', high FROM q UNION ALL SELECT quarter, '{reconcile.BASE}', base FROM q)"""


@query("latest_metric", f"WITH {DISCLOSURES} SELECT metric, max(quarter) AS quarter, arg_max(value, quarter) AS value FROM dis GROUP BY 1")
def latest_metric(spark, sf):
    return reconcile.latest_by_metric(disclosures(spark, sf))


@query(
    "year_on_year",
    f"""WITH {DISCLOSURES}, s AS (SELECT quarter, value FROM dis WHERE metric = '{reconcile.PLUS_SHARE}')
        SELECT a.quarter, a.value, CAST(CAST(substr(a.quarter, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(a.quarter, 5) AS prior_quarter, b.value AS prior_value
        FROM s a LEFT JOIN s b ON b.quarter = CAST(CAST(substr(a.quarter, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(a.quarter, 5)""",
)
def year_on_year(spark, sf):
    return reconcile.year_on_year(disclosures(spark, sf), reconcile.PLUS_SHARE)


@query(
    "missing_metrics",
    f"WITH {DISCLOSURES} SELECT m AS metric FROM (SELECT unnest(['{reconcile.TOTAL_MRR}', '{reconcile.PLUS_PRICE}', 'never_disclosed']) AS m) WHERE m NOT IN (SELECT metric FROM dis WHERE metric <> '{reconcile.PLUS_PRICE}')",
)
def missing_metrics(spark, sf):
    known = disclosures(spark, sf).where(F.col("metric") != reconcile.PLUS_PRICE)
    return reconcile.missing_metrics(known, [reconcile.TOTAL_MRR, reconcile.PLUS_PRICE, "never_disclosed"])


@query(
    "reconcile",
    f"""WITH {DISCLOSURES}, l AS (SELECT metric, arg_max(value, quarter) AS v, max(quarter) AS quarter FROM dis GROUP BY 1),
        w AS (SELECT max(v) FILTER (metric = '{reconcile.TOTAL_MRR}') AS total, max(quarter) FILTER (metric = '{reconcile.TOTAL_MRR}') AS quarter, max(v) FILTER (metric = '{reconcile.PLUS_SHARE}') AS share,
            max(v) FILTER (metric = '{reconcile.PLUS_PRICE}') - max(v) FILTER (metric = '{reconcile.ADVANCED_PRICE}') AS delta, max(v) FILTER (metric = '{reconcile.BASE}') AS base FROM l),
        p AS (SELECT *, CAST(CAST(substr(quarter, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(quarter, 5) AS prior_quarter FROM w),
        r AS (SELECT p.prior_quarter, delta, 0.01 * total * 1000000 / delta AS per_pp, (share - value) / 100 * total * 1000000 / delta AS implied, 0.175 * base AS flagged
              FROM p LEFT JOIN dis ON dis.quarter = p.prior_quarter AND metric = '{reconcile.PLUS_SHARE}')
        SELECT prior_quarter, round(delta, 4) AS monthly_delta_usd, round(per_pp, 4) AS upgrades_for_1pp_of_mrr, round(implied, 4) AS implied_annual_upgrades, round(flagged, 4) AS flagged_stores_implied,
          CASE WHEN flagged > 0 THEN round(implied / flagged, 4) END AS required_upgrade_rate_among_flagged FROM r""",
)
def reconcile_query(spark, sf):
    out = reconcile.reconcile(disclosures(spark, sf), 0.175, None)
    return out.select("prior_quarter", *[F.round(c, 4).alias(c) for c in out.columns if c != "prior_quarter"])
