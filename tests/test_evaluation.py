import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Observation, functions as F

from vitrine.operators import evaluation, ordering

Y = [1, 1, 1, 1, 0, 0, 0, 0, 1, 0]
S = [0.9, 0.8, 0.4, 0.7, 0.3, 0.2, 0.6, 0.1, 0.5, 0.35]


def frame(spark, y=Y, s=S):
    return spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "id long, y int, score double")


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s, strict=True) if a == 1]
    neg = [b for a, b in zip(y, s, strict=True) if a == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toy_values(spark):
    df = frame(spark)
    assert evaluation.auc(df).first()["auc"] == pytest.approx(0.92)
    top = evaluation.precision_recall_top(df, "id").first()
    assert (top.k, top.precision, top.recall) == (1, 1.0, 0.2)
    at = evaluation.precision_recall_at(df, 0.5).first()
    assert (at.flagged, at.precision, at.recall) == (5, 0.8, 0.8)
    none = evaluation.precision_recall_at(df, 2.0).first()
    assert (none.flagged, none.precision, none.recall) == (0, 0.0, 0.0)
    assert evaluation.base_rate(df).first().base_rate == 0.5


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40), st.sampled_from([1, 6]))
def test_auc_equals_pair_counting(spark, pairs, partitions):
    y, s = [p[0] for p in pairs], [p[1] for p in pairs]
    got = evaluation.auc(frame(spark, y, s).repartition(partitions)).first()["auc"]
    want = brute_auc(y, s)
    assert got == want if want is None else got == pytest.approx(want)
    if want is not None:
        mirrored = evaluation.auc(frame(spark, y, [-v for v in s])).first()["auc"]
        assert got + mirrored == pytest.approx(1.0)


def test_grouped_auc_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", rng.randint(0, 1), float(rng.randint(0, 90))) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    got = {r.g: r["auc"] for r in evaluation.auc(df, group=["g"]).collect()}
    for g in {r[0] for r in rows}:
        want = brute_auc([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
        assert got[g] == pytest.approx(want)


def test_bootstrap_interval(spark):
    r = evaluation.bootstrap_interval(frame(spark), "id", resamples=200).first()
    assert 0 <= r.ci_low <= 0.92 <= r.ci_high <= 1 and r.used <= 200
    again = evaluation.bootstrap_interval(frame(spark).repartition(5), "id", resamples=200).first()
    assert tuple(again) == tuple(r)
    one_class = evaluation.bootstrap_interval(frame(spark, [1, 1], [0.1, 0.2]), "id", resamples=20).first()
    assert (one_class.used, one_class.ci_low, one_class.ci_high) == (0, None, None)


def test_top_decile_takes_exactly_k_when_scores_tie(spark):
    y = [i % 2 for i in range(100)]
    df = frame(spark, y, [0.0] * 97 + [1.0] * 3)
    for partitions in (1, 7):
        r = evaluation.precision_recall_top(df.repartition(partitions), "id").first()
        assert r.k == 10 and r.precision == r.hits / 10 and r.recall == r.hits / 50
        assert 2 <= r.hits <= 9


def test_size_buckets(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 1), rng.random(), float((i + 1) ** 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, score double, product_count double")
    a = {r.name: r["auc"] for r in evaluation.size_bucket_aucs(df, "product_count").collect()}
    b = {r.name: r["auc"] for r in evaluation.size_bucket_aucs(df, "product_count").collect()}
    assert list(sorted(a)) == sorted(evaluation.BUCKETS) and a == pytest.approx(b)
    few = evaluation.size_bucket_aucs(df.limit(7), "product_count").collect()
    assert [tuple(r) for r in few] == [("insufficient_product_count_data", None)]
    one_class = df.withColumn("y", F.when(F.col("product_count") < 250, 1).otherwise(F.col("y")))
    assert {r.name: r["auc"] for r in evaluation.size_bucket_aucs(one_class, "product_count").collect()}["q1_smallest"] is None


def test_interpolated_percentiles(spark):
    rng = random.Random(1)
    vals = [round(rng.random() * 50, 2) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for p in (0.0, 0.25, 0.5, 0.731, 1.0):
        at = (len(vals) - 1) * p
        lo, hi = sorted(vals)[math.floor(at)], sorted(vals)[math.ceil(at)]
        want = lo + (hi - lo) * (at - math.floor(at))
        for accuracy in (20, 10_000):
            got = ordering.exact_percentiles(df, "v", {"p": p}, accuracy=accuracy).first()["p"]
            assert got == pytest.approx(want)


def test_row_index_and_first_by_hash(spark):
    df = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    ordered = [r.id for r in df.orderBy("h").collect()]
    indexed = {r.row_index: r.id for r in ordering.row_index(df, "h").collect()}
    assert [indexed[i] for i in range(500)] == ordered
    for k in (0, 1, 137, 500):
        assert {r.id for r in ordering.first_by_hash(df, "h", F.lit(k)).collect()} == set(ordered[:k])


def test_logistic_diagnostic(spark):
    rows = [(i, int(i >= 20), float(i % 20) + (8 if i >= 20 else 0), None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = evaluation.logistic_diagnostic(df, "id", ["a", "b"])
    assert out["cv_folds"] == 5 and 0.6 < out["cv_auc_mean"] <= 1.0 and out["coefficients"]["a"] > 0
    assert out["coefficients"]["b"] == pytest.approx(0.0, abs=1e-6)
    assert "error" in evaluation.logistic_diagnostic(df.limit(5), "id", ["a"])
    folds = evaluation.with_stratified_folds(df, "id", 5).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in folds} == {4}


def test_logistic_diagnostic_in_an_observed_session_with_many_partitions(spark):
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 3
    rows = [(i, i % 2, float(i % 20) + (8 if i % 2 else 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int, a double")
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    spark.sparkContext.setJobGroup("diagnostic", "")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = evaluation.logistic_diagnostic(df, "id", ["a"], max_folds=2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out["cv_folds"] == 2 and out["cv_auc_mean"] > 0.8
    # The passes of a fit: their tasks, and what these send to the driver, follow the table's size, not the shuffles before it.
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("diagnostic") for s in tracker.getJobInfo(j).stageIds]
    passes = [s.numTasks for s in stages if s and "RDDLossFunction" in s.name]
    assert passes and max(passes) <= 2 * spark.sparkContext.defaultParallelism


def test_crosssection_plan(spark):
    from vitrine.plans import crosssection

    rows = [(f"s{i}", "2026-09-08", float(i), i % 5, i) for i in range(16)]
    feats = spark.createDataFrame(rows, "domain string, d string, score double, workaround_app_count int, product_count int").withColumn(
        "scan_date", F.col("d").cast("date")
    )
    pos = feats.where("score >= 8").select("domain")
    neg = feats.where("score < 8").select("domain")
    only_neg = crosssection.run_crosssection(feats, pos.limit(0), neg, resamples=20)[1]
    assert {r.metric: r.value for r in only_neg.collect()} == {"positives": 0.0, "negatives": 8.0}
    no_scan, metrics = crosssection.run_crosssection(feats.limit(0), pos, neg, resamples=20)
    assert no_scan.count() == 0 and {r.metric for r in metrics.collect()} == {"positives", "negatives"}


def test_crosssection_plan_in_an_observed_session(spark):
    from vitrine.plans import crosssection

    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 3
    rows = [(f"s{i}", "2026-09-08", float(i % 9), i % 5, i) for i in range(16)]
    feats = spark.createDataFrame(rows, "domain string, d string, score double, workaround_app_count int, product_count int").withColumn(
        "scan_date", F.col("d").cast("date")
    )
    pos, neg = feats.where("product_count % 8 < 2").select("domain"), feats.where("product_count % 8 >= 2").select("domain")
    metrics = {r.metric: r.value for r in crosssection.run_crosssection(feats, pos, neg, resamples=20)[1].collect()}
    assert (metrics["positives"], metrics["negatives"], metrics["logistic_cv_folds"]) == (4.0, 12.0, 4.0)
    assert {"logistic_cv_auc_mean", "coefficient.product_count", "coefficient.workaround_app_count"} <= set(metrics)


def test_top_negatives(spark):
    feats = spark.createDataFrame([(f"s{i}", float(i), "c", i, None) for i in range(8)], "domain string, score double, components string, product_count int, review_count_max long")
    matches = spark.createDataFrame([("s7", "b"), ("s7", "a"), ("s0", "z")], "domain string, key string")
    rows = evaluation.top_negatives(feats.select("domain"), feats, matches, top=3).collect()
    assert [(r.domain, r.matched_app_keys) for r in rows] == [("s7", "a;b"), ("s6", ""), ("s5", "")]
