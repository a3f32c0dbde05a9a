"""Order statistics, ranks and running sums that never put a whole table or group into one task.

A global `Window.orderBy` moves every row to one task, and a per-key window does the same for a hot key. Order
statistics are found in two aggregates instead: a mergeable quantile sketch per group gives a bracket around each
wanted position, then rows are counted exactly below, inside and above it, and only the distinct values inside a
bracket are put in order. Sums over an order are taken by range-partitioned tasks and carried forward over
one row for each task and group. Every function is one lazy plan, whatever the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: A sketch is off by at most this part of a group's rows; a bracket holds four such parts.
ACCURACY = 10_000


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL, keeping the left side's copies of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def value_at_positions(
    df: DataFrame,
    value: str,
    positions: dict[str, tuple[float, Column]],
    group: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Order statistics: for each name, the value at a 0-based position of the sorted non-null values, and their number n.

    A position is a share of n and an expression over `n` that is at most one away from that share of n.
    Groups without a value are absent; without `group` there is one row in any case.
    """
    group, names = list(group), list(positions)
    known = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    slack = 2 / accuracy
    probes = [max(0.0, p - slack) for p, _ in positions.values()] + [min(1.0, p + slack) for p, _ in positions.values()]
    brackets = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", probes, accuracy).alias("_b"))
    counts = known.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_rows"))
    if group:
        placed = _null_safe_join(counts, brackets, group)
    else:
        placed = counts.withColumn("_x", brackets.select(F.struct("n", "_b")).scalar()).select("*", "_x.n", "_x._b")
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_b")[i].alias("low"), F.col("_b")[len(names) + i].alias("high")) for i in range(len(names))])
    each = placed.select(*group, "n", "_v", "_rows", F.explode(places).alias("_p"))
    side = F.when(F.col("_v") < F.col("_p.low"), -1).when(F.col("_v") > F.col("_p.high"), 1).otherwise(0)
    cells = (
        each.select(*group, "n", "_v", "_rows", F.col("_p.i").alias("_i"), side.alias("_side"))
        .groupBy(*group, "_i", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_cell"))
        .agg(F.sum("_rows").alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest"), F.max("n").alias("n"))
    )
    # What lies inside the brackets, and one row for each side of them.
    before = Window.partitionBy(*[F.col(g) for g in group], "_i").orderBy("_side", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("_below", F.coalesce(F.sum("_rows").over(before), F.lit(0)))

    def pick(i: int, at: Column) -> Column:
        mine, upto = F.col("_i") == i, F.col("_below") + F.col("_rows")
        inside = F.min(F.when(mine & (F.col("_side") == 0) & (F.col("_below") <= at) & (upto > at), F.col("_cell")))
        under = F.min(F.when(mine & (F.col("_side") == -1) & (at == upto - 1), F.col("_greatest")))
        over = F.min(F.when(mine & (F.col("_side") == 1) & (at == F.col("_below")), F.col("_least")))
        missed = F.when(F.max("n") > 0, F.raise_error(F.lit("an order statistic lies outside its bracket")))
        return F.coalesce(inside, under, over, missed)

    return ranked.groupBy(*group).agg(F.max("n").alias("n"), *[pick(i, at).alias(name) for i, (name, (_, at)) in enumerate(positions.items())])


def exact_percentiles(df: DataFrame, value: str, percents: dict[str, float], group: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolated percentiles per group, exact at any size; groups without a value are absent."""
    places = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in percents.items()}
    positions = {f"_lo_{name}": (percents[name], F.floor(at)) for name, at in places.items()} | {f"_hi_{name}": (percents[name], F.ceil(at)) for name, at in places.items()}
    picked = value_at_positions(df, value, positions, group, accuracy)
    between = {name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (at - F.floor(at)) for name, at in places.items()}
    return picked.select(*group, *[between[name].alias(name) for name in percents])


def _wins_of_runs(width: int):
    """Per task and run of equal groups: the least order, sums of p and n, and twice the pairs that p wins against n."""

    def wins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the run that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0)
            differ = np.append(True, np.array(pa.compute.not_equal(key.slice(1), key.slice(0, len(key) - 1))))
            starts = np.flatnonzero(differ)
            p, n = (np.asarray(b.column(width + i), np.int64) for i in (2, 3))
            upto = np.cumsum(n) - n
            below = upto - np.repeat(upto[starts], np.diff(np.append(starts, len(n))))
            sums = [np.add.reduceat(x, starts) for x in (p, n, p * (2 * below + n))]
            runs = pa.RecordBatch.from_arrays([*b.take(pa.array(starts)).columns[: width + 2], *map(pa.array, sums)], names=[*b.schema.names[: width + 2], "p", "n", "won2"])
            if held is not None:
                if held.column(0)[0] == runs.column(0)[0]:
                    hp, hn, hw = (held.column(width + 2 + i)[0].as_py() for i in range(3))
                    sums[2][0] += hw + 2 * hn * sums[0][0]
                    sums[0][0] += hp
                    sums[1][0] += hn
                    runs = pa.RecordBatch.from_arrays([*(pa.concat_arrays([h, r.slice(1)]) for h, r in zip(held.columns[: width + 2], runs.columns, strict=False)), *map(pa.array, sums)], names=runs.schema.names)
                else:
                    yield held
            held = runs.slice(runs.num_rows - 1)
            if runs.num_rows > 1:
                yield runs.slice(0, runs.num_rows - 1)
        if held is not None:
            yield held

    return wins


def pair_wins(counts: DataFrame, order: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, p, n, won2) from counts p and n per (group, order): their sums, and twice the pairs in which p stands higher, ties half.

    The counts are range-partitioned by group and order, so a large group spreads over tasks; every task sends one row for
    each group it meets. Whole numbers, exact up to two thousand million rows a side.
    """
    group = list(group)
    keyed = counts.select(F.to_json(F.struct(*group, F.lit(0).alias("_"))).alias("_k"), *group, F.col(order).alias("_at"), F.col("p").cast("long"), F.col("n").cast("long"))
    ordered = keyed.repartitionByRange("_k", "_at").sortWithinPartitions("_k", "_at")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields) + ", won2 long"
    parts = ordered.mapInArrow(_wins_of_runs(len(group)), shape)
    before = Window.partitionBy("_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = F.sum(F.col("won2") + 2 * F.col("p") * F.col("_below"))
    return carried.groupBy("_k", *group).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), total.alias("won2")).drop("_k")


HEX_DIGITS = 4


def _prefix_totals(counts: DataFrame) -> DataFrame:
    """Counts of hash prefixes, at most 16^4 rows, with their running sum."""
    return counts.withColumn("rows_upto", F.sum("rows").over(Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def first_by_hash(df: DataFrame, hashed: str, k: Column) -> DataFrame:
    """The `k` rows with the smallest hash text, for a `k` that may grow with the data.

    Counts per hash prefix (at most 16^4 rows) locate the prefix where `k` falls; only the rows of that
    prefix, one part in 65,536 of the table, are put in order. The hashed key must be unique.
    """
    prefixed = df.withColumn("_prefix", F.substring(hashed, 1, HEX_DIGITS))
    counts = prefixed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("rows"))
    upto = _prefix_totals(counts)
    bounds = upto.select(F.col("_prefix"), (F.col("rows_upto") - F.col("rows")).alias("_before"), "rows_upto")
    placed = prefixed.join(bounds, "_prefix").withColumn("_k", k)
    whole = placed.where(F.col("rows_upto") <= F.col("_k"))
    cut = placed.where((F.col("_before") < F.col("_k")) & (F.col("rows_upto") > F.col("_k")))
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy(hashed))
    partial = cut.withColumn("_place", place).where(F.col("_place") + F.col("_before") <= F.col("_k"))
    return whole.select(*df.columns).unionByName(partial.select(*df.columns))


def row_index(df: DataFrame, hashed: str, name: str = "row_index") -> DataFrame:
    """A dense 0-based index in hash order: each hash prefix is numbered on its own and offset by a count."""
    prefixed = df.withColumn("_prefix", F.substring(hashed, 1, HEX_DIGITS))
    counts = prefixed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("rows"))
    upto = _prefix_totals(counts)
    offsets = upto.select("_prefix", (F.col("rows_upto") - F.col("rows")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_prefix").orderBy(hashed))
    return (
        prefixed.withColumn("_inside", inside)
        .join(offsets, "_prefix")
        .select(*df.columns, (F.col("_inside") + F.col("_before") - 1).alias(name))
    )
