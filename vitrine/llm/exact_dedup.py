"""Exact dedup: group by a 128-bit content hash, keep one document, compare bytes inside groups.

Only narrow rows (id, hash, length) meet by hash. The bytes of a group are compared through the smallest and
the largest text of the group: they are equal exactly when all texts are. Both are plain aggregates that
combine before the shuffle, so a group holding a third of all rows reaches its last task as one row per map
task. A group whose texts differ, a collision, is grouped again by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.words import id_key, squeeze, text_or_empty
from vitrine.session import materialize


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _verdict(members: DataFrame, keys: list[str]) -> DataFrame:
    """Per group its size and the id that stays: most code points first, then the smallest id."""
    best = F.max(F.struct("chars", F.bitwise_not("k").alias("k"))).getField("k")
    return members.groupBy(*keys).agg(F.count("*").alias("group_size"), F.bitwise_not(best).alias("keep"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = squeeze,
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when `normalise` makes them equal; a null text is an empty one and all empty texts are
    equal. Rows that repeat an id and its text share one verdict and each count towards group_size. A null id
    loses against every other; a group of null ids alone has keep_id null and is kept. Other columns are not
    read, so their names cannot clash.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), id_key(id_col).alias("k"), F.char_length(text).alias("chars"), normalise(text).alias("norm"))
    rows = rows.withColumn("h", digest(F.col("norm")))
    narrow = materialize(rows.select("id", "k", "chars", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-rows")
    groups = materialize(_verdict(narrow, ["h"]), "exact-groups")

    # Bytes of the groups with more than one row. Their texts are dealt out by id and hash, not by hash alone.
    several = narrow.join(groups.where("group_size > 1").select("h"), "h", "left_semi").select("k", "h")
    texts = rows.select("k", "h", "norm").join(several, ["k", "h"], "left_semi")
    spans = texts.groupBy("h").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clashes = materialize(spans.where("low <> high").select("h"), "exact-clashes")

    named = [F.col("id"), F.col("k"), F.col("keep"), F.col("group_size"), F.col("sha")]
    alike = narrow.join(groups, "h").select(*named, "h")
    if clashes.isEmpty():
        whole = alike
    else:
        mixed = rows.join(clashes, "h", "left_semi")
        apart = mixed.join(_verdict(mixed, ["h", "norm"]), ["h", "norm"]).withColumn("sha", F.unhex(F.sha2("norm", 256)))
        whole = alike.join(clashes, "h", "left_anti").select(*named).unionByName(apart.select(*named))
    keep_id = F.when(F.col("keep") == F.col("k"), F.col("id")).otherwise(F.col("keep"))
    return whole.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("keep") == F.col("k")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
