"""Quality rules: plain document figures, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed byte n-grams are counted over all documents: the raw corpus and the part of it
that is trusted. A document's score is its mean log ratio per n-gram, and every document is held against the
same threshold. Counts leave a task as a few arrays of fixed size, whatever it has read, and are summed in two
steps, so no task meets more than a bounded number of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.words import text_or_empty

# The symbols that count as noise.
SYMBOLS = b"#*$%&|<>"
CELLS = 1 << 16
#: Counts of so many cells travel as one row.
PART = 1 << 12
#: Tasks of the first summing step.
SPREAD = 64
MULTIPLIER = np.uint32(2654435761)


def cells_of(text: str, n: int, cells: int) -> np.ndarray:
    """How often each cell's byte n-grams occur in the text."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(raw) < n:
        return np.zeros(cells, np.int64)
    code = np.zeros(len(raw) - n + 1, np.uint32)
    for i in range(n):
        code = code * np.uint32(257) + raw[i : len(raw) - n + 1 + i]
    return np.bincount(((code * MULTIPLIER) >> np.uint32(32 - (cells.bit_length() - 1))).astype(np.int64), minlength=cells)


def _parts(counts: dict[bool, np.ndarray], cells: int) -> pd.DataFrame:
    part = min(PART, cells)
    rows = [(kind, p, total[p * part : (p + 1) * part].astype("<i8").tobytes()) for kind, total in counts.items() for p in range(cells // part)]
    return pd.DataFrame(rows, columns=["trusted", "part", "counts"])


def ngram_counts(docs: DataFrame, n: int, cells: int) -> dict[bool, np.ndarray]:
    """Cell counts over (text, trusted): of the trusted texts and of all the others. Two arrays of `cells` numbers reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {False: np.zeros(cells, np.int64), True: np.zeros(cells, np.int64)}
        for b in batches:
            for text, trusted in zip(b["text"], b["trusted"], strict=True):
                totals[bool(trusted)] += cells_of(text, n, cells)
        yield _parts(totals, cells).assign(salt=TaskContext.get().partitionId() % SPREAD)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for b in batches:
            for kind, p, blob in zip(b["trusted"], b["part"], b["counts"], strict=True):
                new = np.frombuffer(blob, "<i8")
                totals[kind, p] = totals[kind, p] + new if (kind, p) in totals else new
        yield pd.DataFrame([(*k, v.tobytes()) for k, v in totals.items()], columns=["trusted", "part", "counts"])

    schema = "trusted boolean, part int, counts binary"
    some = docs.mapInPandas(count, schema + ", salt int").repartition(SPREAD, "salt").drop("salt").mapInPandas(add, schema)
    rows = some.repartition(16, "trusted", "part").mapInPandas(add, schema).collect()
    out = {False: np.zeros(cells, np.int64), True: np.zeros(cells, np.int64)}
    part = min(PART, cells)
    for r in rows:
        out[r["trusted"]][r["part"] * part : (r["part"] + 1) * part] += np.frombuffer(r["counts"], "<i8")
    return out


def log_ratios(counts: dict[bool, np.ndarray], smoothing: float = 1.0) -> np.ndarray:
    """Per cell the log of its trusted over its raw probability; the raw corpus includes what is trusted."""
    trusted, raw = counts[True] + smoothing, counts[True] + counts[False] + smoothing
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    blanks = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = 0
    if n >= 3:
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        if len(numbers) < 1 << 20:
            windows = (ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:]
            _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
            often = times[where] > 1
        else:
            seen = Counter(zip(words, words[1:], words[2:], strict=False))
            often = np.array([seen[w] > 1 for w in zip(words, words[1:], words[2:], strict=False)])
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= often
        repeats = int(covered.sum())
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeats


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    cells: int = CELLS,
    threshold: float = -0.5,
    least_words: int = 50,
    repeat_percent: int = 50,
) -> DataFrame:
    """One row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    `trusted` holds the ids of the target texts in its first column. `base_failed` is a fixed rule on words
    and repetition; `kept` is false where it is true, and else tells whether the score, the mean log ratio per
    n-gram, reaches `threshold`. A null text is an empty one; a text shorter than n bytes scores 0. Without
    any trusted row every score is 0. Rows that repeat count as often as they occur; a null id is never
    trusted. Only id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    good = trusted.select(F.col(trusted.columns[0]).alias("id")).where("id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    # A merge join at every size: the ids of trusted rows grow with the corpus, so they are never broadcast.
    marked = read.join(good.hint("merge"), "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = ngram_counts(marked, n, cells)
    weights = log_ratios(counts) if counts[True].any() else np.zeros(cells)
    shared = spark.sparkContext.broadcast(weights.astype(np.float64))  # `cells` numbers

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            rows = []
            for text in b["text"]:
                grams = cells_of(text, n, cells)
                total = int(grams.sum())
                score = float(grams @ w) / total if total else 0.0
                f = figures(text)
                failed = f[0] < least_words or 100 * f[4] > repeat_percent * f[0]
                rows.append((*f, failed, score, not failed and score >= threshold))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    kind = read.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return read.mapInPandas(judge, schema).withColumnRenamed("id", id_col)
