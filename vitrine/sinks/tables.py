"""Table writes with the reference semantics of keyed tables, on plain Parquet.

Facts are partitioned by `scan_date, panel_version` and overwritten partition by partition, so a rerun of a
scan replaces that scan and nothing else. Dimensions are rewritten through a new folder version, never in
place while they are being read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine import schemas
from vitrine.operators import keyed

SCAN_PARTITION = ["scan_date", "panel_version"]


class FrozenPanel(ValueError):
    """A panel version exists already and may not be written again."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds; nothing happens where there is none."""
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def replace_scan(df: DataFrame, path: str, partition: list[str] | None = None, scans: list | None = None) -> None:
    """Replace the partitions the batch touches; others stay. Running it twice changes nothing.

    `scans` lists the (scan_date, panel_version) the batch stands for, so that a scan without any row now
    loses the rows an earlier run left.
    """
    spark = df.sparkSession
    by = partition or SCAN_PARTITION
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    # Only after the write has succeeded: scans that have no row now lose what they had.
    written = {(str(r[0]), str(r[1])) for r in df.select(*SCAN_PARTITION).distinct().collect()} if scans else set()
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for scan_date, version in scans or []:
        if (str(scan_date), str(version)) not in written:
            fs, folder = _fs(spark, f"{path}/scan_date={escaped(str(scan_date))}/panel_version={escaped(str(version))}")
            fs.delete(folder, True)


def read_scan_table(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """A table of the scan warehouse with its declared schema; empty when no scan has rows in it."""
    return spark.read.schema(schemas.SCAN_TABLES[name]).parquet(f"{warehouse.rstrip('/')}/{name}")


def append_facts(df: DataFrame, path: str, keys: list[str], partition: list[str] | None = None) -> None:
    """Append rows of keys that are not in the table yet; all rows of a new key are kept."""
    spark = df.sparkSession
    rows = keyed.append_unseen(df, spark.read.parquet(path), keys) if exists(spark, path) else df
    rows.write.mode("append").partitionBy(*(partition or SCAN_PARTITION)).parquet(path)


def append_first(df: DataFrame, path: str, keys: list[str], order: list[str], partition: list[str] | None = None) -> None:
    """Append rows so that the first row ever written for a key stays the only one."""
    spark = df.sparkSession
    if exists(spark, path):
        rows = keyed.upsert_keep_first(spark.read.parquet(path), df, keys, order)
    else:
        rows = keyed.keep_first(df, keys, order)
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a versioned dimension, None before the first write."""
    if not exists(spark, f"{path}/versions"):
        return None
    newest = spark.read.parquet(f"{path}/versions").agg(F.max_by("folder", "version")).first()[0]
    return spark.read.parquet(f"{path}/{newest}")


def publish(df: DataFrame, path: str) -> None:
    """Write a new version of a dimension and make it current; the version read from stays untouched."""
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{folder}")
    version = 0
    if exists(spark, f"{path}/versions"):
        version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0] + 1
    spark.createDataFrame([(version, folder)], "version long, folder string").coalesce(1).write.mode("append").parquet(
        f"{path}/versions"
    )


def upsert(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Replace-upsert a dimension: the last new row of a key wins."""
    old = current(df.sparkSession, path)
    publish(keyed.latest(df, keys, order) if old is None else keyed.upsert_replace(old, df, keys, order), path)


def update_fields(df: DataFrame, path: str, keys: list[str]) -> None:
    """Partial update of a dimension: new non-null values win."""
    old = current(df.sparkSession, path)
    publish(df if old is None else keyed.partial_update(old, df, keys), path)


#: Buckets of a merged table; a table keeps the number that it was first written with.
BUCKETS = 64
MARKS = "bucket int, buckets int, batch_id long"


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKS).parquet(f"{path}/marks")


def _newest(spark: SparkSession, path: str) -> dict[int, int]:
    """The batch that wrote each bucket last; as many rows as there are buckets."""
    last = _marks(spark, path).where("bucket IS NOT NULL").groupBy("bucket").agg(F.max("batch_id").alias("batch_id"))
    return {r.bucket: r.batch_id for r in last.collect()}


def _folder(path: str, batch_id: int, bucket: int) -> str:
    return f"{path}/data/batch={batch_id}/bucket={bucket}"


def merged(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that `merge_touched` keeps: the newest generation of each bucket, None before the first batch with rows."""
    if not exists(spark, f"{path}/marks"):
        return None
    folders = [_folder(path, batch_id, bucket) for bucket, batch_id in sorted(_newest(spark, path).items())]
    return spark.read.parquet(*folders) if folders else None


def merge_touched(
    batch: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int, buckets: int = BUCKETS
) -> list[int]:
    """Merge a batch into a table bucketed by its keys; the buckets that were rewritten.

    `merge(old, new)` gives the rows of the touched buckets; the others are neither read nor written. A batch writes a
    generation of its own for each bucket, and a mark at the end makes them current at once, so a reader or a
    failure in between sees the table before the batch. A batch that has its mark is not merged again; a batch
    that was cut off replaces what it had written. Two writers of one batch id do not both succeed.
    """
    spark = batch.sparkSession
    newest: dict[int, int] = {}
    if exists(spark, f"{path}/marks"):
        known = _marks(spark, path).agg(F.max("buckets").alias("buckets"), F.max((F.col("batch_id") == batch_id).cast("int")).alias("done")).first()
        if known.done:
            return []
        buckets, newest = known.buckets, _newest(spark, path)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    batch = batch.persist()  # read for its buckets and again for its rows
    try:
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # `buckets` numbers at most
        folders = [_folder(path, newest[b], b) for b in touched if b in newest]
        old = spark.read.schema(batch.schema).parquet(*folders) if folders else batch.limit(0)
        if touched:
            rows = merge(old, batch).withColumn("batch", F.lit(batch_id)).withColumn("bucket", bucket).repartition("bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{path}/data")
    finally:
        batch.unpersist()
    marks = spark.createDataFrame([(b, buckets, batch_id) for b in touched] or [(None, buckets, batch_id)], MARKS)
    marks.coalesce(1).write.mode("errorifexists").parquet(f"{path}/marks/batch={batch_id}")
    return touched


def drop_superseded(spark: SparkSession, path: str, keep_from: int) -> int:
    """Delete generations that a later batch has replaced, unless batch `keep_from` or a later one wrote them; how many."""
    newest = _newest(spark, path)
    old = [(r.batch_id, r.bucket) for r in _marks(spark, path).where(f"bucket IS NOT NULL AND batch_id < {int(keep_from)}").collect() if newest[r.bucket] != r.batch_id]
    dropped = 0
    for batch_id, bucket in old:
        fs, folder = _fs(spark, _folder(path, batch_id, bucket))
        dropped += bool(fs.delete(folder, True))
    return dropped


def freeze_panel(panel: DataFrame, path: str, version: str) -> None:
    """Write a panel version once; an existing version is refused."""
    folder = f"{path}/panel_version={version}"
    if exists(panel.sparkSession, folder):
        raise FrozenPanel(f"panel version {version} exists and panels are frozen; choose a new version")
    panel.drop("panel_version").write.mode("errorifexists").parquet(folder)


def export_csv(df: DataFrame, path: str, columns: list[str], order: list | None = None) -> None:
    """A headed CSV export with a fixed column order; booleans as 0/1, NULL as empty text.

    Sorted exports are range-partitioned by the sort, so the part files in name order are the sorted table.
    """
    plain = df.select(
        *[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.select(*columns).dtypes]
    )
    (plain.orderBy(*order) if order else plain).write.mode("overwrite").option("header", "true").option(
        "emptyValue", ""
    ).option("nullValue", "").csv(path)


# Column order of the exports.
EXPORTS = {
    "scores": ["domain", "label", "score"],
    "top_negatives": ["domain", "score", "components", "product_count", "review_count_max", "matched_app_keys", "reviewer_category"],
    "index_timeseries": [
        "scan_date",
        "panel_version",
        "panel_n",
        "panel_n_scanned",
        "share_at_threshold",
        "share_workaround_any",
        "share_high_growth",
        "share_converted_since_prior",
        "n_converted",
        "n_prior_selfserve",
        "hiring_posts_month",
        "computed_at",
    ],
    "backtest": ["domain", "group", "migration_month", "offset", "snapshot_found", "workaround_any", "workaround_capabilities", "fingerprint_any"],
    "candidates": ["domain", "source_url", "source_type", "added_by", "added_at", "evidence"],
}


def export(df: DataFrame, name: str, folder: str, order: list | None = None) -> None:
    """Write one of the named exports; nested columns become JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("struct", "array", "map"))]
    plain = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
    export_csv(plain, f"{folder}/{name}", EXPORTS[name], order)


def open_scan(spark: SparkSession, path: str, scan_date: str, version: str, started_at: str, git_sha: str, config_sha: str) -> None:
    """Record a scan unless (scan_date, panel_version) is recorded already."""
    row = spark.createDataFrame(
        [(scan_date, version, started_at, None, git_sha, config_sha)],
        "scan_date string, panel_version string, started_at string, finished_at string, git_sha string, config_sha string",
    ).withColumn("scan_date", F.col("scan_date").cast("date"))
    old = current(spark, path)
    fresh = row if old is None else keyed.upsert_keep_first(old, row, SCAN_PARTITION, ["started_at"])
    publish(fresh if old is None else old.unionByName(fresh), path)


def close_scan(spark: SparkSession, path: str, scan_date: str, version: str, finished_at: str) -> None:
    """Set the closing time of a recorded scan."""
    done = spark.createDataFrame([(scan_date, version, finished_at)], "scan_date string, panel_version string, finished_at string")
    update_fields(done.withColumn("scan_date", F.col("scan_date").cast("date")), path, SCAN_PARTITION)
