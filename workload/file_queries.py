"""Sources and sinks as queries: the given tables go out as files in the shared folder and come back through the readers."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.operators import keyed, labels, quality, review
from vitrine.session import shared_dir
from vitrine.sinks import tables
from vitrine.sources import csv_files
from workload.base import query, table

TODAY = date(2026, 9, 8)


def _place(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


FILES = 8


def _csv(df: DataFrame, order: str) -> str:
    """A folder of headed CSV files, rows dealt by the order column and kept in its order inside each file."""
    path = _place(df.sparkSession)
    parts = df.withColumn("part", F.col(order) % FILES).repartition("part").sortWithinPartitions("part", order)
    parts.drop(order).write.option("header", "true").partitionBy("part").csv(path)
    return path


def _part() -> Column:
    return F.regexp_extract("file", "part=([0-9]+)", 1).cast("int")


# Each third store with a scheme and a path, each seventh broken, each eleventh a repeat of its predecessor.
_DOMAIN = """CASE WHEN c_custkey % 7 = 0 THEN 'not a domain' ELSE concat(CASE WHEN c_custkey % 3 = 0 THEN 'https://www.' ELSE '' END, 'shop', CAST(c_custkey - CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS STRING), '.example.com', CASE WHEN c_custkey % 3 = 0 THEN '/a?b=1' ELSE '' END) END"""
_KEPT = "concat('shop', CAST(c_custkey - CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR), '.example.com')"


@query(
    "csv_domains",
    f"""WITH l AS (SELECT c_custkey, {_KEPT} AS domain, c_custkey % {FILES} AS part, row_number() OVER (PARTITION BY c_custkey % {FILES} ORDER BY c_custkey) + 1 AS line FROM customer)
        SELECT domain, CAST(min(part) AS INTEGER) AS part, min_by(line, part * 1000000000000 + line) AS line FROM l WHERE c_custkey % 7 <> 0 GROUP BY 1""",
)
def csv_domains(spark, sf):
    path = _csv(table(spark, sf, "customer").select("c_custkey", F.expr(_DOMAIN).alias("domain")), "c_custkey")
    return csv_files.read_domains(spark, path).select("domain", _part().alias("part"), "line")


@query(
    "csv_panel",
    """SELECT concat('s', CAST(s_suppkey AS VARCHAR), '.example.com') AS domain, CAST(s_suppkey % 8 AS INTEGER) AS part,
       row_number() OVER (PARTITION BY s_suppkey % 8 ORDER BY s_suppkey) + 1 AS line FROM supplier QUALIFY s_nationkey % 2 = 1""",
)
def csv_panel(spark, sf):
    s = table(spark, sf, "supplier")
    version = F.when(F.col("s_nationkey") % 2 == 1, " v1 ").otherwise("v2")
    path = _csv(s.select("s_suppkey", F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain"), version.alias("panel_version")), "s_suppkey")
    return csv_files.read_panel(spark, path, "v1").select("domain", _part().alias("part"), "line")


def _label_file(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    rows = c.select(
        "c_custkey",
        F.expr(_DOMAIN).alias("domain"),
        F.when(F.col("c_custkey") % 5 == 0, "ftp://x").otherwise(F.concat(F.lit("https://news.example.org/"), F.col("c_custkey").cast("string"))).alias("source_url"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.lit("press")).alias("source_type"),
        F.col("c_mktsegment").alias("added_by"),
        F.lit("2026-01-02").alias("added_at"),
    )
    label_set, required = labels.LABEL_FILES["plus_positives.csv"]
    return csv_files.read_label_file(spark, _csv(rows, "c_custkey"), label_set, required, TODAY)


_LABEL_LINES = f"""l AS (SELECT *, c_custkey % {FILES} AS part, row_number() OVER (PARTITION BY c_custkey % {FILES} ORDER BY c_custkey) + 1 AS line, CASE WHEN c_custkey % 7 <> 0 THEN {_KEPT} END AS domain FROM customer),
  r AS (SELECT *, domain IS NOT NULL AND row_number() OVER (PARTITION BY domain ORDER BY part, line) > 1 AS again FROM l)"""


@query(
    "csv_label_errors",
    f"""WITH {_LABEL_LINES}
        SELECT CAST(part AS INTEGER) AS part, line, CAST(c_custkey % 4 = 0 AS INTEGER) + CAST(domain IS NULL AS INTEGER) + CAST(again AS INTEGER) + CAST(domain IS NOT NULL AND c_custkey % 5 = 0 AS INTEGER) AS errors FROM r
        WHERE c_custkey % 4 = 0 OR domain IS NULL OR again OR c_custkey % 5 = 0""",
)
def csv_label_errors(spark, sf):
    return labels.error_rows(_label_file(spark, sf)).groupBy(_part().alias("part"), "line").agg(F.count("*").cast("int").alias("errors"))


@query(
    "csv_label_rows",
    f"""WITH {_LABEL_LINES} SELECT domain, 'plus_positive' AS label_set, 'https://news.example.org/' || c_custkey AS source_url, 'press' AS source_type, c_mktsegment AS added_by
        FROM r WHERE NOT (c_custkey % 4 = 0 OR domain IS NULL OR again OR c_custkey % 5 = 0)""",
)
def csv_label_rows(spark, sf):
    good = _label_file(spark, sf).where(F.size("errors") == 0)
    return labels.label_rows(good, "plus_positive").select("domain", "label_set", "source_url", "source_type", "added_by")


@query(
    "csv_disclosures",
    """SELECT o_orderpriority AS metric, CAST(o_totalprice AS DOUBLE) AS value, CAST(o_orderkey % 8 AS INTEGER) AS part, line FROM
       (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) + 1 AS line FROM orders)""",
)
def csv_disclosures(spark, sf):
    o = table(spark, sf, "orders")
    spaced = F.concat(F.lit(" "), F.format_number(F.col("o_totalprice").cast("double"), 2))
    path = _csv(o.select("o_orderkey", F.lit("2026Q1").alias("quarter"), F.col("o_orderpriority").alias("metric"), spaced.alias("value")), "o_orderkey")
    return csv_files.read_disclosures(spark, path).select("metric", "value", _part().alias("part"), "line")


_LOADED = "concat('shop', CAST(c_custkey AS VARCHAR), '.example.com')"


def _label_folder(spark, sf, broken: bool) -> str:
    """The three label files, each a folder of files: positives, negatives and migrators by customer; `broken` has a few faults."""
    c = table(spark, sf, "customer")
    domain = F.concat(F.lit("shop"), F.col("c_custkey").cast("string"), F.lit(".example.com"))
    url = F.concat(F.lit("https://news.example.org/"), F.col("c_custkey").cast("string"))
    rows = c.select("c_custkey", domain.alias("domain"), url.alias("source_url"), F.lit("press").alias("source_type"), F.col("c_mktsegment").alias("added_by"), F.lit("2026-01-02").alias("added_at"))
    quoted = rows.select("c_custkey", "domain", F.lit("2026-01").alias("migration_month"), "source_url", F.concat(F.lit('said "so",\nthen\n\nleft '), F.col("c_custkey").cast("string")).alias("quote"), "added_by", "added_at")
    side = F.col("c_custkey") % 3
    positives, negatives = rows.where(side == 0), rows.where(side == 1)
    if broken:
        positives = positives.withColumn("source_url", F.when(F.col("c_custkey") % 5 == 0, "ftp://x").otherwise(F.col("source_url")))
        negatives = rows.where((side == 1) | (F.col("c_custkey") % 21 == 0))
    folder = _place(spark)
    for name, df in (("plus_positives", positives), ("non_plus_negatives", negatives), ("confirmed_migrators", quoted.where(side == 2))):
        parts = df.withColumn("part", F.col("c_custkey") % FILES).repartition("part").sortWithinPartitions("part", "c_custkey")
        parts.drop("c_custkey").write.option("header", "true").option("escape", '"').partitionBy("part").csv(f"{folder}/{name}.csv")
    return folder


@query(
    "labels_load",
    f"""SELECT {_LOADED} AS domain, CASE c_custkey % 3 WHEN 0 THEN 'plus_positive' WHEN 1 THEN 'non_plus_negative' ELSE 'confirmed_migrator' END AS label_set,
          CASE WHEN c_custkey % 3 = 2 THEN '2026-01' END AS label_value, 'https://news.example.org/' || c_custkey AS source_url, CASE WHEN c_custkey % 3 = 2 THEN 'manual' ELSE 'press' END AS source_type,
          CASE WHEN c_custkey % 3 = 2 THEN 'said "so",' || chr(10) || 'then' || chr(10) || chr(10) || 'left ' || c_custkey END AS quote, c_mktsegment AS added_by, '2026-01-02' AS added_at FROM customer""",
)
def labels_load(spark, sf):
    """The labels table after a load, the same load again, and a load that is refused as a whole."""
    path = _place(spark)
    good = _label_folder(spark, sf, broken=False)
    csv_files.load_labels(spark, good, TODAY, path)
    csv_files.load_labels(spark, good, TODAY, path)
    try:
        csv_files.load_labels(spark, _label_folder(spark, sf, broken=True), TODAY, path)
    except labels.LabelError:
        return spark.read.parquet(path)
    raise AssertionError("a load with errors was not refused")


@query(
    "labels_refused",
    f"""WITH p AS (SELECT c_custkey, 'plus_positives' AS name, c_custkey % 5 = 0 AS bad_url, c_custkey % 21 = 0 AS shared FROM customer WHERE c_custkey % 3 = 0
          UNION ALL SELECT c_custkey, 'non_plus_negatives', false, c_custkey % 21 = 0 FROM customer WHERE c_custkey % 3 = 1 OR c_custkey % 21 = 0),
        l AS (SELECT *, row_number() OVER (PARTITION BY name, c_custkey % {FILES} ORDER BY c_custkey) + 1 AS line FROM p)
        SELECT name, CAST(c_custkey % {FILES} AS INTEGER) AS part, line, 'source_url is not a valid http(s) URL: ftp://x' AS error FROM l WHERE bad_url
        UNION ALL SELECT name, CAST(c_custkey % {FILES} AS INTEGER), line, 'domain in both positives and negatives: ' || {_LOADED} FROM l WHERE shared""",
)
def labels_refused(spark, sf):
    """The table of errors of a refused load."""
    _, errors, _ = csv_files.stage_labels(spark, _label_folder(spark, sf, broken=True), TODAY)
    return errors.select(F.regexp_extract("file", r"/([a-z_]+)\.csv/", 1).alias("name"), _part().alias("part"), "line", "error")


_CATEGORY = "CASE p_size % 4 WHEN 0 THEN 'legitimate_ceiling_case' WHEN 1 THEN 'unknown' WHEN 2 THEN 'volume_only_legit' ELSE 'score_zero_not_flagged' END"


@query(
    "csv_reviewed",
    f"""WITH r AS (SELECT {_CATEGORY} AS category, count(*) AS n, count(*) FILTER (p_size % 3 > 0) AS flagged FROM part GROUP BY 1),
        v AS (SELECT unnest({review.CATEGORIES}) AS category), t AS (SELECT category, coalesce(n, 0) AS n, coalesce(flagged, 0) AS flagged FROM v LEFT JOIN r USING (category))
        SELECT category, n, flagged, CASE WHEN category <> '{review.NOT_FLAGGED}' THEN round(flagged / (SELECT sum(flagged) FROM t WHERE category <> '{review.NOT_FLAGGED}'), 6) END AS flagged_share FROM t""",
)
def csv_reviewed(spark, sf):
    p = table(spark, sf, "part")
    path = _csv(p.select("p_partkey", F.expr(_CATEGORY).alias("reviewer_category"), F.when(F.col("p_size") % 3 > 0, "1.5").alias("panel_score")), "p_partkey")
    out = review.tabulate(csv_files.read_reviewed(spark, path))
    return out.withColumn("flagged_share", F.round("flagged_share", 6))


@query("exported_scores", "SELECT CAST(o_orderkey AS VARCHAR) AS domain, CASE WHEN o_totalprice > 100000 THEN '1' ELSE '0' END AS label, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey + 7 AS VARCHAR) END AS score FROM orders")
def exported_scores(spark, sf):
    o = table(spark, sf, "orders")
    score = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_custkey") + 7).cast("string"))
    path = _place(spark)
    tables.export(o.select(F.col("o_orderkey").cast("string").alias("domain"), (F.col("o_totalprice") > 100000).alias("label"), score.alias("score")), "scores", path, ["domain"])
    return spark.read.csv(f"{path}/scores", header=True)


@query("frozen_panels", "SELECT s_suppkey AS domain, CASE WHEN s_nationkey % 2 = 1 THEN 'v1' ELSE 'v2' END AS panel_version FROM supplier")
def frozen_panels(spark, sf):
    s, path = table(spark, sf, "supplier"), _place(spark)
    for version, odd in (("v1", 1), ("v2", 0)):
        tables.freeze_panel(s.where(F.col("s_nationkey") % 2 == odd).select(F.col("s_suppkey").alias("domain"), F.lit(version).alias("panel_version")), path, version)
    return spark.read.parquet(path)


def _entries(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("dict"), F.col("p_partkey").cast("string").alias("key"), (F.col("p_size") > 25).alias("verified"))


@query("dictionary_totals", "SELECT p_brand AS dict, count(*) AS entries, count(*) FILTER (p_size > 25) AS verified, count(*) FILTER (NOT p_size > 25) AS unverified FROM part GROUP BY 1")
def dictionary_totals(spark, sf):
    return quality.dictionary_totals(_entries(spark, sf))


@query("unverified_entries", "SELECT p_brand AS dict, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE NOT p_size > 25")
def unverified_entries(spark, sf):
    return quality.unverified_keys(_entries(spark, sf))


@query("first_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def first_rows(spark, sf):
    return keyed.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 25, "o_orderkey")
