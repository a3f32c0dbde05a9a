"""CSV records of split files and folders against the standard reader."""

import csv
import io
import random
from datetime import date

import pytest

from vitrine.operators import labels
from vitrine.sources import csv_files


def _file(rng, n):
    """Text of a headed file with quotes, commas, line feeds and blank lines, and its records."""
    out, parts = io.StringIO(), ['plain', 'a,b', 'say "x"', 'two\nlines', '"', "\n\n", "é, ü\n", " spaced "]
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["key", "note"])
    for i in range(n):
        writer.writerow([f"k{i}", rng.choice(parts) + rng.choice(["", "x", "\n,"])])
        if rng.random() < 0.2:
            out.write("\n")
    return out.getvalue()


def _expected(text):
    return [(i + 2, *r) for i, r in enumerate(r for r in list(csv.reader(io.StringIO(text)))[1:] if r)]


@pytest.mark.parametrize("block", [None, 48, 200])
def test_records_of_split_files_equal_the_standard_reader(spark, tmp_path, block):
    rng, texts = random.Random(9), {}
    folder = tmp_path / "in"
    for i, n in enumerate([0, 1, 40, 300]):
        texts[f"f{i}.csv"] = _file(rng, n)
        folder.mkdir(exist_ok=True)
        (folder / f"f{i}.csv").write_text(texts[f"f{i}.csv"], encoding="utf-8")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = csv_files.read_lines(spark, str(folder))
        if block:
            assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.key, r.note) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual[0])
        spark.conf.set("spark.sql.files.openCostInBytes", usual[1])
    assert got == sorted((name, *r) for name, text in texts.items() for r in _expected(text))


def test_a_foreign_header_fails_and_a_byte_order_mark_does_not(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿domain,note\na.example,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("domain,note\nb.example,2\n")
    assert sorted((r.domain, r.line) for r in csv_files.read_domains(spark, str(tmp_path)).collect()) == [("a.example", 2), ("b.example", 2)]
    (tmp_path / "c.csv").write_text("note,domain\n1,c.example\n")
    with pytest.raises(Exception, match="the header is not"):
        csv_files.read_domains(spark, str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.csv").write_text("")
    with pytest.raises(csv_files.MissingColumns, match="no header"):
        csv_files.read_lines(spark, str(tmp_path / "none"))


HEAD = "domain,source_url,source_type,added_by,added_at\n"


def test_a_folder_of_files_loads_whole_or_not_at_all(spark, tmp_path):
    today, table = date(2026, 9, 8), str(tmp_path / "labels")
    for name in ("plus_positives.csv", "non_plus_negatives.csv"):
        (tmp_path / "in" / name).mkdir(parents=True)
        for i in range(3):
            (tmp_path / "in" / name / f"p{i}.csv").write_text(HEAD + f"{name[0]}{i}.example,https://n.example/{i},case,me,2026-01-0{i + 1}\n")
    (tmp_path / "in" / "confirmed_migrators.csv").write_text("domain,migration_month,source_url,quote,added_by,added_at\n")
    assert csv_files.load_labels(spark, str(tmp_path / "in"), today, table).count() == 6
    # Another file repeats a domain under another date: the first row of a key stays.
    again = tmp_path / "in" / "plus_positives.csv" / "p0.csv"
    again.write_text(HEAD + "p0.example,https://n.example/0,case,me,2026-05-05\nnew.example,https://n.example/9,case,me,2026-05-05\n")
    csv_files.load_labels(spark, str(tmp_path / "in"), today, table)
    rows = {r.domain: r.added_at for r in spark.read.parquet(table).collect()}
    assert len(rows) == 7 and rows["p0.example"] == "2026-01-01"
    (tmp_path / "in" / "plus_positives.csv" / "p2.csv").write_text(HEAD + "p1.example,ftp://x,,me,2026-01-01\nz.example,https://n.example,case,me,2026-01-01\n")
    with pytest.raises(labels.LabelError, match="3 error") as refused:
        csv_files.load_labels(spark, str(tmp_path / "in"), today, table)
    assert {(r.file.rsplit("/", 1)[1], r.line) for r in refused.value.errors.collect()} == {("p2.csv", 2)}
    assert spark.read.parquet(table).count() == 7
