"""Audits: dictionary totals, number traceability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.functions import values

NUMBER = r"\d+(?:\.\d+)?"


def dictionary_totals(entries: DataFrame) -> DataFrame:
    """Entries, verified and unverified ones per dictionary."""
    return entries.groupBy("dict").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if("verified").alias("verified"),
        F.count_if(~F.col("verified")).alias("unverified"),
    )


def unverified_keys(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("verified")).select("dict", "key")


def numbers_in(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct numbers written in the texts."""
    found = values.exploded(texts, [], F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), "number")
    return found.distinct()


def trace_numbers(numbers: DataFrame, lines: DataFrame, line: str = "line") -> DataFrame:
    """Each number with `traced`: whether some export line contains it as a substring.

    Every digit run of a line is cut into the substrings a number could match (`12.50` also contains
    `2.5`), so the containment test becomes an equality join over distinct pieces; no line is skipped.
    """
    wanted = numbers.select("number").distinct()
    runs = values.exploded(lines, [], F.regexp_extract_all(line, F.lit(r"[0-9.]+"), F.lit(0)), "run").distinct()
    longest = wanted.agg(F.coalesce(F.max(F.length("number")), F.lit(0))).scalar()
    starts = runs.withColumn("_longest", longest).select(
        "run", "_longest", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")
    )
    lengths = F.sequence(F.lit(1), F.least("_longest", F.length("run") - F.col("at") + 1))
    pieces = starts.where(F.col("_longest") > 0).select(F.explode(F.transform(lengths, lambda n: F.substr("run", "at", n))).alias("number"))
    hit = pieces.distinct().withColumn("_hit", F.lit(True))
    return wanted.join(hit, "number", "left").select("number", F.col("_hit").isNotNull().alias("traced"))
