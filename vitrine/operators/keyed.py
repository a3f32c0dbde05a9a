"""Natural-key operators: latest, keep-first, replace, merge, partial update, anti-join append, set helpers.

Every one-row-per-key choice is a `min_by`/`max_by` aggregate, so it combines before the shuffle and a hot
key costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest order per key."""
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the smallest order per key."""
    return _pick(df, keys, order, F.min_by)


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def upsert_keep_first(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows to append so that a key already present, or repeated in the batch, keeps its first row."""
    return keep_first(new, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def upsert_replace(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The table after the batch: the last new row of a key replaces the old one."""
    last = latest(new, keys, order).select(*existing.columns)
    return existing.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def partial_update(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New non-null values win, old values stay elsewhere; unknown keys are added. One new row per key."""
    fields = [c for c in existing.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields if c in new.columns])
    joined = existing.join(renamed, list(keys), "full_outer")
    return joined.select(
        *keys, *[(F.coalesce(f"_new_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in fields]
    )


def append_unseen(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts of keys that are not recorded yet; all rows of a new key are kept."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


def rows_for(df: DataFrame, **key) -> DataFrame:
    """Point read on a key; on a partitioned table the scan is pruned."""
    out = df
    for name, value in key.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row; a NULL key is no reference and passes."""
    known = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) for each table given."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first `n` rows in order; 0 means all of them."""
    return df.orderBy(order).limit(n) if n > 0 else df
