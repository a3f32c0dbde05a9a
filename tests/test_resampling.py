"""Poisson bootstrap against weighted AUCs computed pair by pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import resampling as rs


def plain_auc(scores, y, w):
    pos = [(s, k) for s, t, k in zip(scores, y, w, strict=True) if t == 1]
    neg = [(s, k) for s, t, k in zip(scores, y, w, strict=True) if t == 0]
    pairs = sum(k for _, k in pos) * sum(k for _, k in neg)
    return sum(k * m * ((a > b) + (a == b) / 2) for a, k in pos for b, m in neg) / pairs if pairs else None


@pytest.mark.parametrize(("distinct", "partitions"), [(3, 8), (1, 5), (1000, 8), (40, 1)])
def test_aucs_equal_the_weighted_pairs(spark, distinct, partitions):
    rng = random.Random(distinct)
    # One score may hold most rows: its ties are spread over tasks.
    rows = [(i, float(0 if rng.random() < 0.4 else rng.randrange(distinct)), rng.randint(0, 1)) for i in range(150)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, 1.0, None)], "id long, score double, y int")
    seeds = {r.id: r.s for r in df.select("id", rs.seed_of(7, F.col("id")).alias("s")).collect()}
    w = rs.weights(np.array([seeds[i] for i, _, _ in rows]), np.arange(20))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.b: r.auc for r in rs.poisson_aucs(df, "id", "score", "y", 20, 7).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {b: plain_auc([s for _, s, _ in rows], [y for _, _, y in rows], w[:, b].tolist()) for b in range(20)}
    assert got == pytest.approx({b: a for b, a in want.items() if a is not None})


def test_small_chunks_carry_a_score_over(monkeypatch):
    monkeypatch.setattr(rs, "CHUNK", 3)
    rng = random.Random(1)
    import pandas as pd

    frame = pd.DataFrame({"score": sorted(rng.randrange(6) / 2 for _ in range(50)), "seed": range(50), "y": [rng.randint(0, 1) for _ in range(50)]})
    out = pd.concat(rs._task_sums(4)([frame.iloc[:20], frame.iloc[20:]]))
    w = rs.weights(frame["seed"].to_numpy(), np.arange(4))
    assert out["inside"].tolist() == [0, 0, 1]
    assert np.array_equal(sum(out["p"]), (w * (frame["y"] == 1).to_numpy()[:, None]).sum(axis=0))
    assert np.array_equal(sum(out["n"]), (w * (frame["y"] == 0).to_numpy()[:, None]).sum(axis=0))


def test_weights_are_poisson_and_independent_enough():
    w = rs.weights(np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, 4000), np.arange(300)).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.005)
    assert w.var() == pytest.approx(1, abs=0.01)
    assert [np.mean(w == k) for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.002)
    apart = np.corrcoef(w.T) - np.eye(300)
    assert abs(apart).max() < 0.09 and abs(apart.mean()) < 1e-3


def test_plan_has_no_join_and_one_shuffle_of_rows(spark):
    df = spark.range(100).select("id", F.rand(1).alias("score"), (F.col("id") % 2).cast("int").alias("y"))
    plan = rs.poisson_aucs(df, "id", "score", "y", 10, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("rangepartitioning") == 1
