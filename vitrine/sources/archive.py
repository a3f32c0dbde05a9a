"""Archived pages, fetch logs and archive-index answers as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine import schemas
from vitrine.functions import urls, values

_SIDECAR = (
    "url string, final_url string, http_status int, headers map<string,string>, fetched_at string, sha256 string"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages table as Parquet, partitioned by scan_date; filters on it prune folders."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_page_files(spark: SparkSession, root: str) -> DataFrame:
    """Loose archive files `{host}/{date}/{sha256}.html`, each with a JSON sidecar of the same name.

    Bodies are read as bytes and joined to their sidecar on (folder, content hash); text is UTF-8 with
    invalid bytes replaced. A body whose hash differs from its name is dropped.
    """
    options = {"recursiveFileLookup": "true"}
    bodies = spark.read.format("binaryFile").options(**options, pathGlobFilter="*.html").load(root)
    named = bodies.select(
        F.regexp_extract("path", r"([^/]+)/([^/]+)/[0-9a-f]{64}\.", 1).alias("host"),
        F.regexp_extract("path", r"([^/]+)/([^/]+)/[0-9a-f]{64}\.", 2).alias("day"),
        F.regexp_extract("path", r"([0-9a-f]{64})\.html$", 1).alias("sha256"),
        "content",
    )
    intact = named.where((F.col("sha256") != "") & (F.sha2("content", 256) == F.col("sha256")))
    sidecars = spark.read.options(**options, pathGlobFilter="*.json", multiLine="true").schema(_SIDECAR).json(root)
    facts = sidecars.withColumn("_path", F.input_file_name()).select(
        F.regexp_extract("_path", r"([^/]+)/([^/]+)/[0-9a-f]{64}\.", 1).alias("host"),
        F.regexp_extract("_path", r"([^/]+)/([^/]+)/[0-9a-f]{64}\.", 2).alias("day"),
        F.regexp_extract("_path", r"([0-9a-f]{64})\.", 1).alias("sha256"),
        "url",
        "final_url",
        F.col("http_status").alias("status"),
        "headers",
        F.to_timestamp("fetched_at").alias("fetched_at"),
    )
    joined = intact.join(facts, ["host", "day", "sha256"])
    return joined.select(
        urls.normalize_domain(F.col("host")).alias("domain"),
        F.col("day").try_cast("date").alias("scan_date"),
        "url",
        "final_url",
        "status",
        "headers",
        F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
        "fetched_at",
        "sha256",
    )


def parse_archive_index(answers: DataFrame) -> DataFrame:
    """Archive-index answers (domain, body) to rows: domain, timestamp, status, mimetype, digest.

    A body is an array of arrays whose first row is a header. Text that is no JSON, or holds nothing after
    the header, yields no rows; short rows are skipped.
    """
    listed = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    rows = values.exploded(answers, ["domain"], listed, "v", "at").where(F.col("at") > 0)
    cells = rows.select("domain", F.try_variant_get("v", "$", "array<string>").alias("c")).where(F.size("c") >= 4)
    return cells.select(
        "domain",
        F.col("c")[0].alias("timestamp"),
        F.col("c")[1].alias("status"),
        F.col("c")[2].alias("mimetype"),
        F.col("c")[3].alias("digest"),
    )
