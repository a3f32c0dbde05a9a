"""A bitmap of fixed size that keeps most rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.session import materialize


def bit(n: Column) -> Column:
    """The long with bit n modulo 64 set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(63).cast("int"))


def maybe_in(column: str | Column, known: DataFrame, bits: int = 1 << 20) -> Column:
    """False only where `column` is not among the values of `known`, a table of one column.

    The bitmap is gathered by an aggregate and reaches the tasks as one scalar of bits / 8 bytes, whatever the
    tables' sizes; where it fills up it stops sparing rows and nothing else changes.
    """
    cell = F.xxhash64(known.columns[0]).bitwiseAND(bits - 1)
    words = known.select(F.shiftright(cell, 6).alias("at"), bit(cell).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    filled = known.sparkSession.range(bits // 64).select(F.col("id").alias("at")).join(words, "at", "left")
    packed = filled.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("a"))
    table = materialize(packed.select(F.transform("a", lambda x: x["bits"]).alias("a")), "filter").scalar()
    mine = F.xxhash64(column).bitwiseAND(bits - 1)
    return F.get(table, F.shiftright(mine, 6).cast("int")).bitwiseAND(bit(mine)) != 0


def join_touched(docs: DataFrame, key: Column, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_row, _k) of the documents that may have a partner in `found`, a table with a column k, and of those that surely have none."""
    wrapped = docs.select(F.struct("*").alias("_row"), key.alias("_k"))
    maybe = F.coalesce(maybe_in("_k", found.select("k")), F.lit(False))
    return wrapped.where(maybe), wrapped.where(~maybe)
