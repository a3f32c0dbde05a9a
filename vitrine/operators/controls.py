"""Backtest of events against archived snapshots: plans, matched controls, grid, prevalence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.functions import dates, values
from vitrine.operators import asof, ordering

# The published backtest settings.
OFFSETS = (-18, -12, -6, -3, 3)
TOLERANCE_DAYS = 45
CONTROL_GROUP = 20
CONTROL_SEED = 7


def reference_month(migrators: DataFrame, month: str = "anchor_month") -> DataFrame:
    """The upper median of the migrators' months: the one at position n // 2 of the sorted list."""
    at = migrators.where(F.col(month).isNotNull()).select(dates.whole_months(F.lit("0001-01-01").cast("date"), dates.month_start(F.col(month))).alias("m"))
    picked = ordering.value_at_positions(at, "m", {"m": (0.5, F.floor(F.col("n") / 2))})
    start = F.lit("0001-01-01").cast("date")
    return picked.select(dates.month_text(F.add_months(start, F.col("m"))).alias("reference_month"))


def matched_controls(
    negatives: DataFrame,
    migrators: DataFrame,
    sizes: DataFrame,
    k: int = CONTROL_GROUP,
    seed: int = CONTROL_SEED,
) -> DataFrame:
    """`k` negatives nearest in size to the migrators' median, or a seeded sample when sizes are too few.

    Matching needs at least one migrator with a known size and at least `k` negatives with one.
    `sizes` has (domain, product_count), one row per domain. Returns domain, product_count, method, place.
    """
    pool = negatives.select("domain").join(migrators.select("domain"), "domain", "left_anti").join(sizes, "domain", "left")
    known = migrators.select("domain").join(sizes, "domain").where(F.col("product_count").isNotNull())
    median = ordering.exact_percentiles(known, "product_count", {"median": 0.5}).select("median").scalar()
    usable = pool.agg(F.count("product_count")).scalar()
    matching = F.col("_median").isNotNull() & (F.col("_usable") >= k)
    measured = pool.withColumn("_median", median).withColumn("_usable", usable)
    near = (
        measured.where(matching & F.col("product_count").isNotNull())
        .withColumn("_by", F.abs(F.col("product_count") - F.col("_median")))
        .orderBy("_by", "domain")
        .limit(k)
        .select("domain", "product_count", F.lit("nearest_size").alias("method"))
    )
    drawn = (
        measured.where(~matching)
        .withColumn("_by", values.seeded_order(seed, F.col("domain")))
        .orderBy("_by")
        .limit(k)
        .select("domain", "product_count", F.lit("seeded_sample").alias("method"))
    )
    return near.unionByName(drawn)


def plans(migrators: DataFrame, controls: DataFrame, reference: DataFrame) -> DataFrame:
    """(domain, group, anchor_month): migrators at their own month, controls at the reference month."""
    own = migrators.select("domain", F.lit("migrator").alias("group"), "anchor_month")
    shared = controls.select("domain", F.lit("control").alias("group")).withColumn(
        "anchor_month", reference.select("reference_month").scalar()
    )
    return own.unionByName(shared)


def grid(planned: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """One row per plan and month offset, with the target month and its midpoint. No offsets means the default ones."""
    listed = F.array(*[F.lit(o) for o in (offsets or OFFSETS)])
    at = planned.withColumn("offset", F.explode(listed))
    month = dates.shift_month(F.col("anchor_month"), F.col("offset"))
    return at.withColumn("target_month", month).withColumn("target_day", dates.month_midpoint(F.col("target_month")))


def pick_snapshots(wanted: DataFrame, archive_index: DataFrame, tolerance_days: int = TOLERANCE_DAYS) -> DataFrame:
    """The archive timestamp nearest the 15th of each target month within the tolerance, per domain."""
    dated = archive_index.withColumn("snapshot_day", dates.archive_day(F.col("timestamp")))
    return asof.nearest(wanted, dated, ["domain"], "target_day", "snapshot_day", "timestamp", tolerance_days)


def backtest_rows(picked: DataFrame, snapshot_hits: DataFrame) -> DataFrame:
    """One row per plan and offset: found, any app, capabilities seen, any fingerprint; unknown when not found.

    `snapshot_hits` has one row per readable snapshot (domain, timestamp): workaround_any,
    workaround_capabilities, fingerprint_any.
    """
    joined = picked.join(snapshot_hits, ["domain", "timestamp"], "left")
    return joined.select(
        "domain",
        "group",
        F.col("anchor_month").alias("migration_month"),
        "offset",
        F.col("workaround_any").isNotNull().alias("snapshot_found"),
        "workaround_any",
        "workaround_capabilities",
        "fingerprint_any",
    )


def snapshot_hits(snapshots: DataFrame, app_matches: DataFrame, fingerprint_matches: DataFrame) -> DataFrame:
    """Readable snapshots with what their page matched. The capability list is bounded by the taxonomy."""
    keys = ["domain", "timestamp"]
    apps = app_matches.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("capability")), ";").alias("_capabilities")
    )
    marks = fingerprint_matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_marks"))
    readable = snapshots.where((F.col("status") == 200) & F.col("html").isNotNull()).select(*keys).distinct()
    joined = readable.join(apps, keys, "left").join(marks, keys, "left")
    return joined.select(
        *keys,
        F.col("_capabilities").isNotNull().alias("workaround_any"),
        F.coalesce("_capabilities", F.lit("")).alias("workaround_capabilities"),
        F.col("_marks").isNotNull().alias("fingerprint_any"),
    )


def coverage(rows: DataFrame) -> DataFrame:
    """Requested, found, and their ratio (NULL when nothing was requested)."""
    counts = rows.agg(F.count(F.lit(1)).alias("requested"), F.count_if("snapshot_found").alias("found"))
    return counts.withColumn("coverage", values.ratio(F.col("found"), F.col("requested")))


def prevalence(rows: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Share of found snapshots with any app by group and offset; the whole grid is listed, NULL where none was found."""
    spark = rows.sparkSession
    full = spark.createDataFrame([(g, o) for g in ("migrator", "control") for o in (offsets or OFFSETS)], "group string, offset int")
    shares = rows.where("snapshot_found").groupBy("group", "offset").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.col("workaround_any").cast("int")).alias("prevalence")
    )
    return full.join(shares, ["group", "offset"], "left").select("group", "offset", F.coalesce("_n", F.lit(0)).alias("n_found"), "prevalence")


def earliest_offsets(rows: DataFrame) -> DataFrame:
    """Per migrator, the earliest offset whose snapshot showed an app; migrators without one are absent."""
    hits = rows.where((F.col("group") == "migrator") & F.col("snapshot_found") & F.col("workaround_any"))
    return hits.groupBy("domain").agg(F.min("offset").alias("earliest_offset"))
