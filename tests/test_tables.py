from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vitrine.operators import hiring, intake, keyed, labels, quality, reconcile, review
from vitrine.sinks import tables
from vitrine.sources import archive, csv_files
from vitrine.streaming import jobs

TODAY = date(2026, 9, 8)


# ---- job posts --------------------------------------------------------------------------------------


def postings(spark, board, body):
    return hiring.parse_boards(spark.createDataFrame([(board, "acme", body)], "board string, company_slug string, body string"))


def test_first_layout(spark):
    body = (
        '{"jobs": [{"id": 11, "title": "Lead", "content": "&lt;p&gt;Own our &lt;b&gt;Hydrogen&lt;/b&gt; build &amp;amp; more&lt;/p&gt;",'
        ' "updated_at": "2026-08-01T10:00:00-04:00", "first_published": "2026-01-01", "absolute_url": "https://b.example/11"},'
        ' {"id": 12, "title": "Dev", "first_published": "2026-02-02"}, 5]}'
    )
    rows = {r.external_id: r for r in postings(spark, "greenhouse", body).collect()}
    assert rows["11"].description_text == "Own our Hydrogen build & more"
    assert rows["11"].posted_at == "2026-08-01T10:00:00-04:00" and rows["12"].posted_at == "2026-02-02"
    assert (rows["12"].description_text, rows["12"].url) == ("", "") and len(rows) == 2


def test_second_and_third_layout(spark):
    body = '[{"id": "a", "text": "T", "description": "<div>x&eacute;</div>", "createdAt": 1750000000000, "hostedUrl": "u"}, {"id": "b", "createdAt": "soon"}]'
    rows = {r.external_id: r for r in postings(spark, "lever", body).collect()}
    assert (rows["a"].title, rows["a"].description_text, rows["a"].posted_at) == ("T", "xé", "2025-06-15T15:06:40Z")
    assert rows["b"].posted_at is None
    third = '{"jobs": [{"id": "z", "title": "Z", "descriptionHtml": "<p>q</p>", "publishedAt": "2026-07-03", "jobUrl": "w"}]}'
    r = postings(spark, "ashby", third).first()
    assert (r.external_id, r.title, r.description_text, r.posted_at, r.url) == ("z", "Z", "q", "2026-07-03", "w")
    assert postings(spark, "ashby", "<html>").count() == 0


def test_matching_and_merging_posts(spark):
    body = '[{"id": "1", "text": "Shopify Plus and Hydrogen"}, {"id": "2", "text": "Baker"}]'
    found = hiring.matching_posts(postings(spark, "lever", body))
    assert [(r.external_id, r.matched_terms) for r in found.collect()] == [("1", ["shopify plus", "hydrogen"])]

    def seen(title, when, posted):
        return found.select(
            *hiring.POST_KEY,
            F.lit("s.example").alias("domain"),
            F.lit(title).alias("title"),
            F.lit(posted).alias("posted_at"),
            F.lit(when).cast("timestamp").alias("first_seen_at"),
            F.lit(when).cast("timestamp").alias("last_seen_at"),
            "matched_terms",
            F.col("url").alias("source_url"),
        )

    merged = hiring.merge_posts(seen("old", "2026-07-01", "2026-06-30"), seen("new", "2026-08-02", "2026-08-01"))
    r = merged.first()
    assert (r.title, r.posted_at, r.first_seen_at, r.last_seen_at) == ("new", "2026-06-30", datetime(2026, 7, 1), datetime(2026, 8, 2))
    assert hiring.merge_posts(merged, seen("new", "2026-08-02", "2026-08-01")).first() == r
    counts = {(c.basis, c.month): c.n for c in hiring.monthly_counts(merged).collect()}
    assert counts == {("first_seen", "2026-07"): 1, ("posted_at", "2026-06"): 1}
    asked = spark.createDataFrame([("2026-07",), ("2026-08",)], "month string")
    assert {m.month: m.n for m in hiring.counts_for_months(asked, merged).collect()} == {"2026-07": 1, "2026-08": 0}


def test_board_discovery(spark):
    html = "boards.greenhouse.io/Acme x https://jobs.lever.co/jobs https://jobs.lever.co/beta https://jobs.ashbyhq.com/gam_ma boards.greenhouse.io/Acme"
    pages = spark.createDataFrame(
        [("a.example", 1, "https://a.example/careers", 200, html), ("b.example", 0, "https://b.example/", 200, html), ("c.example", 0, "https://c.example/blog", 200, "jobs.lever.co/no")],
        "domain string, page_ord int, url string, status int, html string",
    )
    rows = {(r.board, r.company_slug): r.domain for r in hiring.discover_boards(pages).collect()}
    assert rows == {("greenhouse", "Acme"): "b.example", ("lever", "beta"): "b.example", ("ashby", "gam_ma"): "b.example"}


# ---- labels and files -------------------------------------------------------------------------------

HEAD = "domain,source_url,source_type,added_by,added_at\n"
MIGRATORS = "domain,migration_month,source_url,quote,added_by,added_at\n"


def write_labels(folder, positives="", negatives="", migrators=""):
    (folder / "plus_positives.csv").write_text(HEAD + positives)
    (folder / "non_plus_negatives.csv").write_text(HEAD + negatives)
    (folder / "confirmed_migrators.csv").write_text(MIGRATORS + migrators)
    return str(folder)


def test_label_load(spark, tmp_path):
    folder = write_labels(
        tmp_path,
        "WWW.Good.Example,https://n.example/a,case,me,2026-01-01\n,,,,\n",
        "other.example,https://n.example/b,,me,2026-01-01\n",
        'moved.example,2026-02,https://n.example/c,"said, so",me,2026-01-01\n',
    )
    with pytest.raises(labels.LabelError, match="line 2: empty required column source_type"):
        csv_files.load_labels(spark, folder, TODAY)
    write_labels(tmp_path, "WWW.Good.Example,https://n.example/a,case,me,2026-01-01\n", "other.example,https://n.example/b,dir,me,2026-01-01\n", 'moved.example,2026-02,https://n.example/c,"said, so",me,2026-01-01\n')
    loaded = csv_files.load_labels(spark, folder, TODAY)
    assert loaded.where("label_set = 'plus_positive'").first().domain == "good.example"
    m = loaded.where("label_set = 'confirmed_migrator'").first()
    assert (m.domain, m.label_value, m.quote, m.source_type) == ("moved.example", "2026-02", "said, so", "manual")
    assert {r.label_set for r in loaded.collect()} == {"plus_positive", "non_plus_negative", "confirmed_migrator"}


@pytest.mark.parametrize(
    "line,message",
    [
        ("x.example,2026-13,https://n.example,,me,d\n", "not a yyyy-mm month: 2026-13"),
        ("x.example,2026-07,https://n.example,,me,d\n", "less than 3 months"),
        ("x.example,2026-01,notaurl,,me,d\n", "not a valid"),
        ("nodot,2026-01,https://n.example,,me,d\n", "not a domain: nodot"),
        ("x.example,2026-01,https://n.example,,me,d\nWWW.x.example,2026-01,https://n.example,,me,d\n", "line 3: duplicate domain x.example"),
    ],
)
def test_label_faults(spark, tmp_path, line, message):
    folder = write_labels(tmp_path, migrators=line)
    with pytest.raises(labels.LabelError, match=message):
        csv_files.load_labels(spark, folder, TODAY)


def test_label_overlap_and_missing_columns(spark, tmp_path):
    row = "x.example,https://n.example/a,case,me,2026-01-01\n"
    with pytest.raises(labels.LabelError, match="x.example") as refused:
        csv_files.load_labels(spark, write_labels(tmp_path, row, row), TODAY, str(tmp_path / "table"))
    assert {(r.line, r.error) for r in refused.value.errors.collect()} == {(2, "domain in both positives and negatives: x.example")}
    assert refused.value.errors.count() == 2 and not (tmp_path / "table").exists()
    (tmp_path / "plus_positives.csv").write_text("domain,source_url\nx.example,https://n.example\n")
    with pytest.raises(csv_files.MissingColumns, match="source_type, added_by, added_at"):
        csv_files.load_labels(spark, str(tmp_path), TODAY)


def test_label_set_quality(spark):
    sets = spark.createDataFrame([("plus", d) for d in "abc"], "label_set string, domain string")
    feats = spark.createDataFrame([("a", date(2026, 1, 1), False), ("a", date(2026, 2, 1), True), ("b", date(2026, 1, 1), False)], "domain string, scan_date date, fingerprint_any boolean")
    members = labels.set_members(sets, feats)
    assert {r.domain: r.state for r in members.collect()} == {"a": "flagged", "b": "clean", "c": "unscanned"}
    assert tuple(labels.set_quality(members).first()) == ("plus", 3, 2, 1, 0.5)


def test_domain_and_panel_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("domain,note\nWWW.a.example,1\nbad,2\na.example,3\nb.example,4\n")
    rows = csv_files.read_domains(spark, str(tmp_path / "d.csv")).orderBy("line").collect()
    assert [(r.domain, r.line) for r in rows] == [("a.example", 2), ("b.example", 5)]
    (tmp_path / "p.csv").write_text("domain,added_at,panel_version\na.example,x,v1\n b.example ,x, v2 \n,x,v2\n")
    assert [r.domain for r in csv_files.read_panel(spark, str(tmp_path / "p.csv"), "v2").collect()] == ["b.example"]


DISCLOSED = """quarter,metric,value,unit,source_url,page_ref
2026Q2,total_mrr_usd_m,200,USD m,u,p1
2026Q2,plus_share_of_mrr_pct,33,%,u,p2
2025Q2,plus_share_of_mrr_pct,31,%,u,p3
2026Q1,advanced_list_price_usd_monthly,399,USD,u,p4
2026Q1,plus_list_price_usd_monthly,"2,300",USD,u,p5
"""


def test_reconcile(spark, tmp_path):
    (tmp_path / "d.csv").write_text(DISCLOSED)
    d = csv_files.read_disclosures(spark, str(tmp_path / "d.csv"))
    r = reconcile.checked_reconcile(d, 0.10, 100_000).first()
    assert r.monthly_delta_usd == 1901 and r.prior_quarter == "2025Q2"
    assert r.upgrades_for_1pp_of_mrr == pytest.approx(2_000_000 / 1901)
    assert r.implied_annual_upgrades == pytest.approx(4_000_000 / 1901)
    assert r.flagged_stores_implied == 10_000
    assert r.required_upgrade_rate_among_flagged == pytest.approx(4_000_000 / 1901 / 10_000)
    assert reconcile.report_rows(reconcile.reconcile(d)).count() == 3
    disclosed_base = d.unionByName(d.limit(1).withColumn("metric", F.lit(reconcile.BASE)).withColumn("value", F.lit(50.0)))
    assert reconcile.reconcile(disclosed_base, 0.10, 100_000).first().flagged_stores_implied == 5.0
    assert "2300 USD (2026Q1, u, p5)" in {c.citation for c in reconcile.citations(d).collect()}
    with pytest.raises(reconcile.ReconcileError, match="total_mrr_usd_m"):
        reconcile.checked_reconcile(d.where("metric != 'total_mrr_usd_m'"))
    with pytest.raises(reconcile.ReconcileError, match="no disclosures"):
        reconcile.checked_reconcile(d.limit(0))
    (tmp_path / "bad.csv").write_text(DISCLOSED.replace("200,USD m", "many,USD m"))
    with pytest.raises(reconcile.ReconcileError, match="line 2"):
        csv_files.read_disclosures(spark, str(tmp_path / "bad.csv"))


def test_review_tabulation(spark, tmp_path):
    lines = ["domain,final_score,note,reviewer_category"] + [f"s{i},{s},n,{c}" for i, (s, c) in enumerate(
        [(4, "volume_only_legit"), (3, "unknown"), (2, "unknown"), (1, "volume_only_dropship"), (0, "score_zero_not_flagged")])]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    rows = {r.category: r for r in review.tabulate(csv_files.read_reviewed(spark, str(tmp_path / "r.csv"))).collect()}
    assert len(rows) == 7 and sum(r.n for r in rows.values()) == 5 and sum(r.flagged for r in rows.values()) == 4
    assert (rows["unknown"].flagged_share, rows["volume_only_legit"].flagged_share) == (0.5, 0.25)
    assert rows["score_zero_not_flagged"].flagged_share is None and rows["new_store_zero_base"].flagged_share == 0.0
    (tmp_path / "r.csv").write_text("final_score,reviewer_category\n1,perhaps\n")
    with pytest.raises(ValueError, match="perhaps"):
        csv_files.read_reviewed(spark, str(tmp_path / "r.csv"))


# ---- intake -----------------------------------------------------------------------------------------

ROBOTS = """User-agent: bigbot
User-agent: researchbot
Disallow: /private # secret
Allow: /products.json?ok
Disallow: /products.json
Crawl-delay: 7

Disallow: /ignored
User-agent: *
Disallow:
"""


@pytest.mark.parametrize(
    "url,agent,allowed,reason,delay",
    [
        ("https://a.example/private/x", "ResearchBot/1.0", False, "robots_disallow", 7.0),
        ("https://a.example/products.json?page=1", "ResearchBot/1.0", False, "robots_disallow", 7.0),
        ("https://a.example/products.json?ok", "ResearchBot/1.0", True, None, 7.0),
        ("https://a.example/ignored", "ResearchBot/1.0", True, None, 7.0),
        ("https://a.example/private", "other", True, None, None),
        ("https://down.example/x", "other", True, "robots_unreachable", None),
    ],
)
def test_robots(spark, url, agent, allowed, reason, delay):
    robots = spark.createDataFrame([("a.example", 200, ROBOTS), ("down.example", 500, None)], "host string, status int, body string")
    rules = intake.robots_rules(robots, agent)
    frontier = spark.createDataFrame([(url,)], "url string")
    r = intake.admit(frontier, rules, robots.where("status = 200")).first()
    assert (r.allowed, r.reason, r.crawl_delay) == (allowed, reason, delay)


def test_frontier(spark):
    d1, d2 = date(2026, 9, 1), date(2026, 9, 2)
    log = spark.createDataFrame(
        [
            (d1, "v1", "u1", 503, None, datetime(2026, 9, 1, 5), 1),
            (d2, "v1", "u2", 200, "x", datetime(2026, 9, 1, 9), 2),
            (d2, "v1", "u2", 200, "y", datetime(2026, 9, 1, 10), 3),
        ],
        "scan_date date, panel_version string, url string, status int, html string, fetched_at timestamp, fetch_ord long",
    )
    asked = spark.createDataFrame([(d1, "v1", u) for u in ("u1", "u2", "u3")], "scan_date date, panel_version string, url string")
    # A failed fetch is not retried in its scan; a same-day body of another scan is reused.
    assert [r.url for r in intake.frontier_dedupe(asked, log).collect()] == ["u3"]
    assert {r.url: r.status for r in intake.latest_fetch(log).collect()} == {"u1": 503, "u2": 200}
    assert intake.cached_bodies(log).first().html == "y"


def test_archive_index(spark):
    body = '[["timestamp","statuscode","mimetype","digest"],["20250601000000","200","text/html","A"],["short"]]'
    df = spark.createDataFrame([("a", body), ("b", "<html>"), ("c", "[]")], "domain string, body string")
    assert [tuple(r) for r in archive.parse_archive_index(df).collect()] == [("a", "20250601000000", "200", "text/html", "A")]


def test_page_files(spark, tmp_path):
    import hashlib
    import json

    body = "<p>é</p>".encode() + b"\xff"
    sha = hashlib.sha256(body).hexdigest()
    folder = tmp_path / "www.a.example" / "2026-09-08"
    folder.mkdir(parents=True)
    (folder / f"{sha}.html").write_bytes(body)
    (folder / f"{sha}.json").write_text(json.dumps({"url": "https://a.example/", "http_status": 200, "headers": {"X-ShopId": "1"}, "fetched_at": "2026-09-08T01:02:03Z"}, indent=2))
    r = archive.read_page_files(spark, str(tmp_path)).first()
    assert (r.domain, r.scan_date, r.url, r.status, r.headers) == ("a.example", TODAY, "https://a.example/", 200, {"X-ShopId": "1"})
    assert r.html == "<p>é</p>�" and r.fetched_at == datetime(2026, 9, 8, 1, 2, 3)


# ---- keyed tables and sinks -------------------------------------------------------------------------


def kv(spark, *rows):
    return spark.createDataFrame(rows, "k string, v int, ord int")


def test_keyed_operators(spark):
    old, new = kv(spark, ("a", 1, 0), ("b", 2, 0)), kv(spark, ("b", 3, 2), ("b", 4, 1), ("c", 5, 1))
    first = keyed.upsert_keep_first(old, new, ["k"], ["ord"])
    assert [(r.k, r.v) for r in first.collect()] == [("c", 5)]
    replaced = keyed.upsert_replace(old, new, ["k"], ["ord"])
    assert {(r.k, r.v) for r in replaced.collect()} == {("a", 1), ("b", 3), ("c", 5)}
    part = keyed.partial_update(old, spark.createDataFrame([("b", None, 9), ("d", 7, None)], "k string, v int, ord int"), ["k"])
    assert {tuple(r) for r in part.collect()} == {("a", 1, 0), ("b", 2, 9), ("d", 7, None)}
    assert keyed.append_unseen(new, old, ["k"]).count() == 1
    assert [r.k for r in keyed.orphans(new, old, "k", "k").collect()] == ["c"]
    assert keyed.rows_for(new, k="b", v=4).count() == 1
    assert [r.v for r in keyed.first_rows(new, 2, "v").collect()] == [3, 4] and keyed.first_rows(new, 0, "v").count() == 3


def test_scan_rerun_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "facts")
    one = kv(spark, ("a", 1, 0)).withColumn("scan_date", F.lit(TODAY)).withColumn("panel_version", F.lit("v1"))
    two = one.withColumn("scan_date", F.lit(date(2026, 10, 1))).withColumn("v", F.lit(2))
    for df in (one, two, one, two):
        tables.replace_scan(df, path)
    assert spark.read.parquet(path).count() == 2
    for _ in range(2):
        tables.append_facts(one.withColumn("k", F.lit("z")), path, ["k"])
        tables.append_first(one.withColumn("k", F.lit("y")), path, ["k"], ["ord"], tables.SCAN_PARTITION)
    assert spark.read.parquet(path).count() == 4


def test_dimension_upserts(spark, tmp_path):
    path = str(tmp_path / "dim")
    tables.upsert(kv(spark, ("a", 1, 0)), path, ["k"], ["ord"])
    tables.upsert(kv(spark, ("a", 2, 0), ("b", 3, 0)), path, ["k"], ["ord"])
    tables.update_fields(spark.createDataFrame([("a", None, 5)], "k string, v int, ord int"), path, ["k"])
    assert {tuple(r) for r in tables.current(spark, path).collect()} == {("a", 2, 5), ("b", 3, 0)}


def test_frozen_panel_and_csv(spark, tmp_path):
    panel = spark.createDataFrame([("a.example", True, None), ("b.example", False, 2)], "domain string, flag boolean, n int")
    tables.freeze_panel(panel, str(tmp_path / "panel"), "v1")
    with pytest.raises(tables.FrozenPanel):
        tables.freeze_panel(panel, str(tmp_path / "panel"), "v1")
    tables.freeze_panel(panel, str(tmp_path / "panel"), "v2")
    assert spark.read.parquet(str(tmp_path / "panel")).where("panel_version = 'v2'").count() == 2
    tables.export_csv(panel, str(tmp_path / "csv"), ["domain", "flag", "n"], ["domain"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*.csv")))
    assert text.replace("domain,flag,n\n", "") == "a.example,1,\nb.example,0,2\n"


def test_number_trace(spark):
    numbers = quality.numbers_in(spark.createDataFrame([("AUC 0.494, 36 of 99",)], "text string"))
    lines = spark.createDataFrame([("x,0.4941",), ("n=1360",)], "line string")
    assert {r.number: r.traced for r in quality.trace_numbers(numbers, lines).collect()} == {"0.494": True, "36": True, "99": False}


# ---- streaming --------------------------------------------------------------------------------------


def test_conversion_alerts_over_micro_batches(spark, tmp_path):
    shape = "domain string, scan_seq long, scan_date date, verified boolean"
    days = [date(2026, m, 1) for m in (1, 2, 3, 4)]
    states = {"a": [0, 1, 1, 0], "b": [0, 0, 0, 1], "c": [1, 0, 1, None], "gap": [0, None, 1, 1]}
    source = str(tmp_path / "in")
    for i, day in enumerate(days):
        rows = [(d, i + 1, day, bool(v[i])) for d, v in states.items() if v[i] is not None]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        jobs.conversion_alerts(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    got = {(r.domain, r.scan_date) for r in spark.read.schema(jobs.ALERTS).parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", days[1]), ("b", days[3]), ("c", days[2])}
