"""Streams against their batch rules: scans in any order, merges that touch only what changed."""

import os
import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrine.operators import hiring
from vitrine.sinks import tables
from vitrine.streaming import jobs

STATE = "domain string, scan_seq long, scan_date date, verified boolean"


def _day(seq):
    return date(2026, 1, 1) + timedelta(7 * seq)


def _alerts(spark, tmp_path, batches, delay):
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(STATE).parquet(source)
        jobs.conversion_alerts(stream, str(tmp_path / "cp"), str(tmp_path / "out"), delay).awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(jobs.ALERTS).parquet(str(tmp_path / "out")).collect())


def _expected(rows):
    state = {(d, s): (day, v) for d, s, day, v in rows}
    return sorted((d, state[d, s - 1][0], day) for (d, s), (day, v) in state.items() if v and (d, s - 1) in state and not state[d, s - 1][1])


def _kept(spark, tmp_path, name):
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", name)
    return sorted(r[0] for r in state.load().select("key.domain").collect())


def test_late_and_repeated_scans_give_each_alert_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{d}", s, _day(s), rng.random() < 0.5) for d in range(12) for s in range(1, 9) if rng.random() < 0.85]
    batches = [[] for _ in range(4)]
    for r in rows:
        batches[min(3, (r[1] - 1) // 2 + rng.choice([0, 0, 1, 2]))].append(r)
    batches[3] += rng.sample(rows, 15)  # repeats
    assert _alerts(spark, tmp_path, batches, "200 days") == _expected(rows)


def test_state_is_released_when_the_watermark_has_passed_a_gap(spark, tmp_path):
    first = [("a", 1, _day(1), False), ("a", 3, _day(3), True), ("b", 2, _day(2), False)]
    got = _alerts(spark, tmp_path, [first], "14 days")
    assert got == [] and _kept(spark, tmp_path, "earlier") == ["a"]
    # Far later scans move the watermark; the scan 2 of store a is then too late and its gap is closed.
    _alerts(spark, tmp_path, [[("b", 20, _day(20), True)], [("b", 21, _day(21), True)]], "14 days")
    got = _alerts(spark, tmp_path, [[("a", 2, _day(2), False), ("b", 22, _day(22), False)]], "14 days")
    assert got == []
    assert _kept(spark, tmp_path, "newest") == ["a", "b"]
    assert _kept(spark, tmp_path, "earlier") == ["b"]  # the gap before its scan 20 is still open


POST = "board string, company_slug string, external_id string, domain string, title string, posted_at string, first_seen_at timestamp, last_seen_at timestamp, matched_terms array<string>, source_url string"


def _posts(spark, ids, hour):
    rows = [("b", "c", str(i), "d.example", f"t{hour}", None, f"2026-01-01 {hour:02}:00:00", f"2026-01-01 {hour:02}:00:00", "x", "u") for i in ids]
    df = spark.createDataFrame(rows, "board string, company_slug string, external_id string, domain string, title string, posted_at string, first_seen_at string, last_seen_at string, matched_terms string, source_url string")
    return df.withColumn("first_seen_at", F.to_timestamp("first_seen_at")).withColumn("last_seen_at", F.to_timestamp("last_seen_at")).withColumn("matched_terms", F.array("matched_terms"))


def _files(path):
    return {p: os.path.getmtime(p) for p in Path(path).rglob("*") if p.is_file()}


def test_a_merge_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.merged(spark, path) is None
    merge = lambda batch, n: tables.merge_touched(batch, path, hiring.POST_KEY, hiring.merge_posts, n, 16)
    assert len(merge(_posts(spark, range(200), 1), 0)) == 16
    before = _files(path)
    touched = merge(_posts(spark, [3, 5, 1000], 2), 1)
    assert 1 <= len(touched) <= 3
    after = _files(path)
    assert before.items() <= after.items()
    assert {p.parent.name for p in set(after) - set(before) if p.suffix == ".parquet" and "data" in p.parts} == {f"bucket={b}" for b in touched}
    whole = hiring.merge_posts(_posts(spark, range(200), 1), _posts(spark, [3, 5, 1000], 2))
    got = tables.merged(spark, path).select(whole.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    # A replayed batch changes nothing, an empty one leaves its mark only.
    assert merge(_posts(spark, [3, 5, 1000], 9), 1) == []
    assert _files(path) == after
    assert merge(_posts(spark, [1], 3).limit(0), 2) == []
    assert tables.merged(spark, path).count() == 201


def test_superseded_generations_are_dropped_and_unfinished_ones_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = lambda batch, n: tables.merge_touched(batch, path, hiring.POST_KEY, hiring.merge_posts, n, 4)
    merge(_posts(spark, range(20), 1), 0)
    # A writer that died before its mark: what it left is not seen, and its batch replaces it.
    _posts(spark, [77], 5).withColumn("batch", F.lit(1)).withColumn("bucket", F.lit(0)).write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/data")
    assert tables.merged(spark, path).count() == 20
    merge(_posts(spark, range(20), 2), 1)
    assert tables.merged(spark, path).where("external_id = '77'").count() == 0
    assert tables.merged(spark, path).select("title").distinct().collect()[0].title == "t2"
    assert tables.drop_superseded(spark, path, 1) == 4
    assert tables.merged(spark, path).count() == 20
    with pytest.raises(Exception, match="exists"):
        spark.createDataFrame([(0, 4, 1)], tables.MARKS).write.mode("errorifexists").parquet(f"{path}/marks/batch=1")
