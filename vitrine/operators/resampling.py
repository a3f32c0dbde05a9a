"""Bootstrap of the AUC from Poisson weights, with one shuffle of the rows and no join on the draws.

A row's weight in a resample is Poisson(1), drawn from an integer hash of the row's seed and the resample's number.
Rows are range-partitioned by score, ties split over tasks by their seed, and every task sums its part for all resamples
at once: vectors of weights per score at its two ends, and one vector for everything between them. These few vectors
per task, carried forward in score order, hold all that the AUC of each resample needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import values

WORD = 1 << 32
#: Multipliers of the integer hash.
STEP, MIX = 0x9E3779B1, 0x45D9F3B
#: Rows whose weights a task holds at once.
CHUNK = 1024
VECTORS = "score double, inside int, p array<long>, n array<long>, won2 array<long>"


def poisson_limits() -> list[int]:
    """A hash below limit k means a weight of at most k: the Poisson(1) distribution function in 32 bits."""
    e = sum(Fraction(1, math.factorial(k)) for k in range(30))
    limits = [math.floor(WORD * sum(Fraction(1, math.factorial(k)) for k in range(j + 1)) / e) for j in range(20)]
    return [x for x in limits if x < WORD - 1]


def weights(seeds: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """The weight of every row (32-bit seed) in every resample."""
    x = seeds.astype(np.uint32)[:, None] + resamples.astype(np.uint32) * np.uint32(STEP)
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIX)
    x ^= x >> np.uint32(16)
    out = np.zeros(x.shape, np.uint8)
    for limit in poisson_limits():
        out += x >= np.uint32(limit)
    return out


def weight_sql(seed: str, resample: str) -> str:
    """The same weight as a SQL expression over a 32-bit seed and a resample number."""
    start = f"(({seed} + {resample} * {STEP}) & {WORD - 1})"
    mixed = start
    for _ in range(2):
        mixed = f"list_transform([{mixed}], lambda v: (xor(v, v >> 16) * {MIX}) & {WORD - 1})[1]"
    last = f"list_transform([{mixed}], lambda v: xor(v, v >> 16))[1]"
    return f"list_transform([{last}], lambda v: {' + '.join(f'CAST(v >= {x} AS BIGINT)' for x in poisson_limits())})[1]"


def seed_of(seed: int, key: Column) -> Column:
    return F.conv(F.substring(values.seeded_order(seed, key), 1, 8), 16, 10).cast("long")


class _Sums:
    """Sums over the scores of one task in rising order; the first and the last score are kept apart."""

    def __init__(self, resamples: int):
        self.first, self.open = None, None
        self.inner_p, self.inner_n, self.won2 = (np.zeros(resamples, np.int64) for _ in range(3))
        self.inner = False

    def add(self, scores: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Distinct scores in rising order with their sums per resample."""
        if self.open is not None:
            if self.open[0] == scores[0] or (np.isnan(self.open[0]) and np.isnan(scores[0])):
                p[0] += self.open[1]
                n[0] += self.open[2]
            else:
                scores, p, n = np.append(self.open[0], scores), np.vstack([self.open[1], p]), np.vstack([self.open[2], n])
        self.open = (scores[-1], p[-1].copy(), n[-1].copy())
        scores, p, n = scores[:-1], p[:-1], n[:-1]
        if len(scores) and self.first is None:
            self.first = (scores[0], p[0].copy(), n[0].copy())
            scores, p, n = scores[1:], p[1:], n[1:]
        if len(scores):
            below = self.inner_n + np.cumsum(n, axis=0) - n
            self.won2 += (p * (2 * below + n)).sum(axis=0)
            self.inner_p += p.sum(axis=0)
            self.inner_n += n.sum(axis=0)
            self.inner = True

    def rows(self) -> list[tuple]:
        none = np.zeros_like(self.won2)
        out = [(end[0], 0, end[1], end[2], none) for end in (self.first, self.open) if end is not None]
        return [*out, (self.first[0], 1, self.inner_p, self.inner_n, self.won2)] if self.inner else out


def _task_sums(resamples: int):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, total = np.arange(resamples), _Sums(resamples)
        for b in batches:
            for i in range(0, len(b), CHUNK):
                part = b.iloc[i : i + CHUNK]
                score = part["score"].to_numpy(np.float64)
                starts = np.flatnonzero(np.append(True, ~((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))))
                w, y = weights(part["seed"].to_numpy(np.int64), numbers), part["y"].to_numpy(np.int64)
                p, n = (np.add.reduceat(w * (y == label).astype(np.uint8)[:, None], starts, axis=0, dtype=np.int64) for label in (1, 0))
                total.add(score[starts], p, n)
        yield pd.DataFrame(total.rows(), columns=["score", "inside", "p", "n", "won2"])

    return sums


def poisson_aucs(rows: DataFrame, key: str, score: str, y: str, resamples: int, seed: int) -> DataFrame:
    """(b, auc) for each resample in which both classes have weight; rows without a score or label are left out.

    The sums are whole numbers, exact up to two thousand million rows a class.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    slim = known.select(F.col(score).cast("double").alias("score"), seed_of(seed, F.col(key)).alias("seed"), F.col(y).cast("int").alias("y"))
    ordered = slim.repartitionByRange("score", "seed").sortWithinPartitions("score")
    vectors = ordered.mapInPandas(_task_sums(resamples), VECTORS)
    # From here on: three rows for each task and resample, whatever the table holds.
    each = vectors.select("score", "inside", F.posexplode(F.arrays_zip("p", "n", "won2")).alias("b", "v"))
    spots = each.groupBy("b", "score", "inside").agg(*[F.sum(f"v.{c}").alias(c) for c in ("p", "n", "won2")])
    before = Window.partitionBy("b").orderBy("score", "inside").rowsBetween(Window.unboundedPreceding, -1)
    placed = spots.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    tied = F.when(F.col("inside") == 0, F.col("n")).otherwise(0)
    won2 = F.sum(F.col("won2") + F.col("p") * (2 * F.col("below") + tied)).cast("double")
    pairs2 = 2 * F.sum("p").cast("double") * F.sum("n").cast("double")
    return placed.groupBy("b").agg(F.try_divide(won2, pairs2).alias("auc")).where("auc IS NOT NULL")
