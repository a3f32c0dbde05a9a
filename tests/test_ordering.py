"""Order statistics and pair counts against sorted lists, on one lazy plan."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import evaluation, ordering


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_positions_equal_sorted_lists(spark, accuracy):
    rng = random.Random(accuracy)
    rows = []
    for g, n in enumerate([1, 2, 3, 4, 5, 7, 10, 11, 99, 500, 900]):
        kind = g % 3
        rows += [(str(g) if g else None, float(rng.randrange(3)) if kind == 0 else 1e9 + rng.random() * 1e-3 if kind == 1 else rng.expovariate(1)) for _ in range(n)]
    rows += [("none", None), ("5", None), ("8", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    n = F.col("n")
    at = {"first": (0.0, F.lit(0)), "low": (0.25, F.floor(n / 4)), "middle": (0.5, F.floor(n / 2)), "top": (0.9, n - F.greatest(F.lit(1), F.floor(n / 10))), "last": (1.0, n - 1)}
    got = {r.g: r for r in ordering.value_at_positions(df, "v", at, ["g"], accuracy).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs.sort(key=lambda v: (v != v, v))
        k = len(vs)
        want = [vs[0], vs[k // 4], vs[k // 2], vs[k - max(1, k // 10)], vs[-1]]
        assert [str(got[g][name]) for name in at] == [str(v) for v in want], (g, k)
        assert got[g]["n"] == k
    empty = ordering.value_at_positions(df.where("g = 'none'"), "v", at, (), accuracy).collect()
    assert len(empty) == 1 and empty[0].last is None


def _jobs(spark, make):
    tracker, group = spark.sparkContext.statusTracker(), f"plan-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        made = make()
        return made, list(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


def test_no_job_runs_while_a_plan_is_built(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.rand(3).alias("score"), (F.col("id") % 2).cast("int").alias("y"))
    for make in (
        lambda: ordering.exact_percentiles(df, "score", {"m": 0.5}, ["g"]),
        lambda: evaluation.auc(df, group=["g"]),
        lambda: evaluation.precision_recall_top(df, "id"),
        lambda: evaluation.bootstrap_interval(df, "id", resamples=3),
    ):
        assert _jobs(spark, make)[1] == []


def test_a_hot_group_in_a_narrow_range_spreads(spark):
    """Of a group of 200,000 close values few thousand reach the ordered part, and the counts before it spread by value."""
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (1e6 + F.col("id") * 1e-7).alias("v"))
    out = ordering.value_at_positions(df, "v", {"m": (0.5, F.floor(F.col("n") / 2))}, ["g"])
    assert out.first().m == pytest.approx(1e6 + 100_000 * 1e-7, abs=1e-9)
    low, high = df.agg(F.percentile_approx("v", [0.4998, 0.5002], ordering.ACCURACY)).first()[0]
    assert df.where(F.col("v").between(low, high)).count() < 200


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_pair_wins_over_task_borders(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["a", "b", "", None]), rng.randrange(40), rng.randrange(5), rng.randrange(5)) for _ in range(400)]
    counts = spark.createDataFrame(rows, "g string, s long, p long, n long").groupBy("g", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = {r.g: (r.p, r.n, r.won2) for r in ordering.pair_wins(counts, "s", ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        won2 = sum(p * n * (2 * (s > t) + (s == t)) for _, s, p, _ in mine for _, t, _, n in mine)
        want[g] = (sum(r[2] for r in mine), sum(r[3] for r in mine), won2)
    assert got == want
