"""CSV files: domain lists, labels, panels, disclosures, reviewed exports, each one file or a folder of files."""

from __future__ import annotations

import csv
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from vitrine.functions import markup, urls
from vitrine.operators import labels, reconcile, review
from vitrine.session import materialize
from vitrine.sinks import tables


class MissingColumns(ValueError):
    """A file lacks required columns."""


QUOTED = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the records of headed CSV files, a record's quoted line feeds kept, `line` its place in its file from 1.

    Files are split and read by many tasks. A record begins where the quotes before it are even in number, so the
    lines of each block are numbered for an even and for an odd start, and the blocks of a file, a short table,
    carry quotes and counts forward. Blank lines between records count nothing, as in the files' usual readers.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    inside = Window.partitionBy("file", "block").orderBy("at")
    flipped = lines.withColumn("odd", odd).withColumn("open", F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    begins = [((F.col("open") == parity) & (F.col("value") != "")).cast("int") for parity in (0, 1)]
    marked = flipped.select("*", begins[0].alias("begins0"), begins[1].alias("begins1"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.select("*", *[F.sum(f"begins{i}").over(upto).alias(f"upto{i}") for i in (0, 1)])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.sum("begins0").alias("n0"), F.sum("begins1").alias("n1"))
    blocks = blocks.withColumn("start", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))).over(earlier), F.lit(0)))
    known = placed.drop("odd").join(blocks.select("file", "block", "start", "before"), ["file", "block"])
    even = F.col("start") == 0
    numbered = known.select(
        "file",
        "block",
        "at",
        "value",
        (F.col("before") + F.when(even, F.col("upto0")).otherwise(F.col("upto1"))).alias("line"),
        (F.when(even, F.col("begins0")).otherwise(F.col("begins1")) == 1).alias("begins"),
        (F.col("open") == F.col("start")).alias("between"),
        (odd == 0).alias("closed"),
    ).where("begins OR NOT between")
    whole = numbered.where("begins AND closed").select("file", "line", F.col("value").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    torn = numbered.where("NOT (begins AND closed)").groupBy("file", "line").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))
    return whole.unionByName(torn)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV files, one or a folder of them, as text columns plus `file` and `line`, the header being line 1.

    All files have the header of the first one; another one fails the read.
    """
    first = spark.read.text(path).where("_metadata.file_block_start = 0").first()
    columns = next(csv.reader([first.value.removeprefix("\ufeff")]), []) if first else []
    if not columns:
        raise MissingColumns(f"{path}: line 1: no header")
    shape = ", ".join(f"`{c}` string" for c in columns)
    head = F.from_csv(F.ltrim("text", F.lit("\ufeff")), ", ".join(f"c{i} string" for i in range(len(columns) + 1)), QUOTED)
    wanted = F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(columns)], F.lit(None).cast("string").alias(f"c{len(columns)}"))
    alien = F.concat(F.col("file"), F.lit(f": line 1: the header is not {','.join(columns)}"))
    # The check stands in the text and in the filter, so it is met in whichever order later filters put them.
    checked = F.when((F.col("line") == 1) & ~head.eqNullSafe(wanted), F.raise_error(alien).cast("string")).otherwise(F.col("text"))
    parsed = records(spark, path).select("file", "line", checked.alias("text"))
    return parsed.where((F.col("line") > 1) | F.col("text").isNull()).select(F.from_csv("text", shape, QUOTED).alias("r"), "file", "line").select("r.*", "file", "line")


def _need(df: DataFrame, required: list[str], path: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"{path}: line 1: missing required columns: {', '.join(missing)}")
    return df


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, file, line): valid domains normalised, bad ones skipped, the first of repeated ones kept, by file and line."""
    rows = _need(read_lines(spark, path), ["domain"], path)
    named = rows.select(urls.normalize_domain(F.col("domain")).alias("domain"), "file", "line").where(F.col("domain").isNotNull())
    return named.groupBy("domain").agg(F.min(F.struct("file", "line")).alias("_at")).select("domain", "_at.*")


def read_panel(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(domain, file, line): the domains of one panel version."""
    rows = _need(read_lines(spark, path), ["domain", "panel_version"], path)
    mine = rows.where(F.trim("panel_version") == version).select(F.trim("domain").alias("domain"), "file", "line")
    return mine.where(F.coalesce("domain", F.lit("")) != "")


def read_label_file(spark: SparkSession, path: str, label_set: str, required: list[str], today: date) -> DataFrame:
    """A label file with normalised domains and per-line errors."""
    return labels.validate(_need(read_lines(spark, path), required, path), label_set, required, today)


def stage_labels(spark: SparkSession, folder: str, today: date) -> tuple[DataFrame, DataFrame, int]:
    """The checked rows of all label files as one written table, their errors (file, line, error), and the number of errors.

    A domain among both positives and negatives is an error of each of its lines. Errors are counted while the rows are written;
    nothing but that count reaches the driver.
    """
    checked = []
    for name, (label_set, required) in labels.LABEL_FILES.items():
        rows = read_label_file(spark, f"{folder.rstrip('/')}/{name}", label_set, required, today)
        checked.append(labels.label_rows(rows, label_set, keep=["file", "line", "errors"]))
    both = checked[0]
    for more in checked[1:]:
        both = both.unionByName(more)
    opposed = [labels.LABEL_FILES[n][0] for n in ("plus_positives.csv", "non_plus_negatives.csv")]
    sides = both.where(F.col("domain").isNotNull() & F.col("label_set").isin(opposed)).groupBy(F.col("domain").alias("_d")).agg(F.count_distinct("label_set").alias("_sides"))
    torn = both.join(sides.where("_sides > 1"), (F.col("domain") == F.col("_d")) & F.col("label_set").isin(opposed), "left")
    shared = F.when(F.col("_d").isNotNull(), F.array(F.concat(F.lit("domain in both positives and negatives: "), F.col("domain")))).otherwise(F.array().cast("array<string>"))
    seen = Observation("labels")
    marked = torn.withColumn("errors", F.concat("errors", shared)).drop("_d", "_sides")
    staged = materialize(marked.observe(seen, F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors")), "labels")
    return staged, staged.select("file", "line", F.explode("errors").alias("error")), seen.get["errors"]


def load_labels(spark: SparkSession, folder: str, today: date, table: str | None = None) -> DataFrame:
    """The rows of all label files, refused as a whole on any error in any of them: `LabelError.errors` is then the table of errors.

    With `table`, the rows are added to that table of labels, the first row of each (domain, label_set) staying for good.
    """
    staged, errors, count = stage_labels(spark, folder, today)
    if count:
        some = errors.withColumn("file", F.element_at(F.split("file", "/"), -1)).orderBy("file", "line", "error").limit(20).collect()
        shown = "\n".join(f"{r.file}: line {r.line}: {r.error}" for r in some)
        raise labels.LabelError(f"{count} error(s)\n{shown}", errors)
    rows = staged.drop("file", "line", "errors")
    if table:
        tables.append_first(rows, table, ["domain", "label_set"], ["added_at", "source_url"])
    return rows


def read_disclosures(spark: SparkSession, path: str) -> DataFrame:
    """Disclosed figures; thousands separators are dropped, blank lines skipped, a bad value is an error with its line."""
    fields = ["quarter", "metric", "value", "unit", "source_url", "page_ref"]
    rows = _need(read_lines(spark, path), fields[:3], path)
    present = [c for c in fields if c in rows.columns]
    clean = rows.select("file", "line", *[markup.trimmed(F.coalesce(c, F.lit(""))).alias(c) for c in present])
    filled = clean.where(F.concat(*[F.col(c) for c in present]) != "")
    parsed = filled.withColumn("_value", F.replace("value", F.lit(","), F.lit("")).try_cast("double"))
    bad = parsed.where(F.col("_value").isNull()).agg(F.min(F.struct("file", "line", "value")).alias("at")).select("at.*").first()
    if bad.line is not None:
        raise reconcile.ReconcileError(f"{bad.file} line {bad.line}: bad value {bad.value!r}")
    return parsed.select(*[F.col("_value").alias("value") if c == "value" else F.col(c) for c in present], "file", "line")


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed export: (reviewer_category, score). Other columns are ignored; unknown categories are an error."""
    rows = read_lines(spark, path)
    score = "score" if "score" in rows.columns else next((c for c in rows.columns if c.endswith("_score")), "score")
    _need(rows, ["reviewer_category", score], path)
    picked = rows.select(
        F.trim(F.coalesce("reviewer_category", F.lit(""))).alias("reviewer_category"),
        F.coalesce(F.nullif(F.trim(score), F.lit("")), F.lit("0")).cast("double").alias("score"),
    )
    wrong = [r.category for r in review.unknown_categories(picked).orderBy("category").take(10)]
    if wrong:
        raise ValueError(f"{path}: reviewer_category {wrong} not in {review.CATEGORIES}; use 'unknown' for undecided rows")
    return picked
