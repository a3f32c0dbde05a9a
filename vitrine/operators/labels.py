"""Label files: validation with line numbers, overlap, label-set quality."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import dates, markup, urls

# Label files, the set each one feeds, and its required columns.
LABEL_FILES = {
    "plus_positives.csv": ("plus_positive", ["domain", "source_url", "source_type", "added_by", "added_at"]),
    "non_plus_negatives.csv": ("non_plus_negative", ["domain", "source_url", "source_type", "added_by", "added_at"]),
    "confirmed_migrators.csv": (
        "confirmed_migrator",
        ["domain", "migration_month", "source_url", "quote", "added_by", "added_at"],
    ),
}
MAY_BE_EMPTY = "quote"
MIN_AGE_MONTHS = 3


class LabelError(ValueError):
    """A label file breaks a rule; the message shows the first offending lines, `errors` is the table of all."""

    def __init__(self, message: str, errors: DataFrame | None = None):
        super().__init__(message)
        self.errors = errors


def _errors(required: list[str], label_set: str, today: Column) -> Column:
    """All error texts of one line, in the order they are found."""
    empty = [
        F.when(F.col("raw_domain" if c == "domain" else c) == "", F.lit(f"empty required column {c}"))
        for c in required
        if c != MAY_BE_EMPTY
    ]
    raw = F.coalesce(F.col("raw_domain"), F.lit(""))
    bad_domain = F.col("domain").isNull()
    what = F.when(raw == "", F.lit("empty domain")).otherwise(F.concat(F.lit("not a domain: "), raw))
    later = [
        F.when(bad_domain, what),
        F.when(F.col("repeated"), F.concat(F.lit("duplicate domain "), F.col("domain"))),
        F.when(
            ~bad_domain & ~urls.is_http_url(F.col("source_url")),
            F.concat(F.lit("source_url is not a valid http(s) URL: "), F.coalesce(F.col("source_url"), F.lit(""))),
        ),
    ]
    if label_set == "confirmed_migrator":
        month = F.coalesce(F.col("migration_month"), F.lit(""))
        start = dates.month_start(month)
        age = dates.whole_months(start, today)
        later.append(F.when(~bad_domain & start.isNull(), F.concat(F.lit("not a yyyy-mm month: "), month)))
        later.append(
            F.when(
                ~bad_domain & (age < MIN_AGE_MONTHS),
                F.concat(F.lit("migration_month "), month, F.lit(f" is less than {MIN_AGE_MONTHS} months before today")),
            )
        )
    return F.array_compact(F.array(*empty, *later))


def validate(rows: DataFrame, label_set: str, required: list[str], today: date) -> DataFrame:
    """Add `domain` (normalised) and `errors` to label rows that carry `line`, and `file` where there are several; blank lines are dropped.

    A repeated domain is an error on every line after its first.
    """
    place = [c for c in ("file", "line") if c in rows.columns]
    fields = [c for c in rows.columns if c not in place]
    clean = rows.select(*place, *[markup.trimmed(F.coalesce(c, F.lit(""))).alias(c) for c in fields])
    filled = clean.where(F.concat(*[F.col(c) for c in fields]) != "")
    named = filled.withColumnRenamed("domain", "raw_domain").withColumn("domain", urls.normalize_domain(F.col("raw_domain")))
    # One first line per domain, joined back on domain and place: a domain repeated on many lines stays one row per task.
    first = named.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.min(F.struct(*place)).alias("_at")).select("domain", "_at.*", F.lit(True).alias("_first"))
    marked = named.join(first, ["domain", *place], "left")
    flagged = marked.withColumn("repeated", F.col("domain").isNotNull() & F.col("_first").isNull()).drop("_first")
    return flagged.withColumn("errors", _errors(required, label_set, F.lit(today))).drop("raw_domain", "repeated")


def error_rows(validated: DataFrame) -> DataFrame:
    """(line, error) for every error found, with the file where there are several."""
    return validated.select(*[c for c in ("file", "line") if c in validated.columns], F.explode("errors").alias("error"))


def overlap(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Domains that sit in both sets."""
    return positives.select("domain").intersect(negatives.select("domain"))


def label_rows(validated: DataFrame, label_set: str, keep: Sequence[str] = ()) -> DataFrame:
    """Validated rows in the shape of the labels table, with the columns to keep."""

    def optional(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in validated.columns else F.lit(None).cast("string")

    return validated.select(
        "domain",
        F.lit(label_set).alias("label_set"),
        optional("migration_month").alias("label_value"),
        "source_url",
        F.coalesce(optional("source_type"), F.lit("manual")).alias("source_type"),
        optional("quote").alias("quote"),
        "added_by",
        "added_at",
        *keep,
    )


def set_members(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Each labelled store with its state at its latest scan: `unscanned`, `flagged` (any fingerprint) or `clean`."""
    newest = features.groupBy("domain").agg(F.max_by("fingerprint_any", "scan_date").alias("_any"))
    joined = labels.select("label_set", "domain").join(newest, "domain", "left")
    state = F.when(F.col("_any").isNull(), "unscanned").when(F.col("_any"), "flagged").otherwise("clean")
    return joined.select("label_set", "domain", state.alias("state"))


def set_quality(members: DataFrame) -> DataFrame:
    """Per label set: total, scanned, with fingerprint, and the share among scanned (NULL when none was)."""
    counts = members.groupBy("label_set").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") != "unscanned").alias("scanned"),
        F.count_if(F.col("state") == "flagged").alias("with_fingerprint"),
    )
    share = F.try_divide(F.col("with_fingerprint").cast("double"), F.col("scanned").cast("double"))
    return counts.withColumn("share_with_fingerprint", share)
