"""Substring dedup: repeated-phrase automata over recurring passages.

A passage recurs when a window of consecutive words occurs twice. Every window names one of its short runs of
words, the one of least hash, so equal windows name equal runs; only runs that are named twice in the corpus
can lie in a recurring window, and only windows with such a run are counted. The first document that holds a
recurring window keeps it: its windows, joined, are the confirmed passages. They go to the documents that
share a window with them, each batch of documents compiles an Aho-Corasick automaton of its own share of the
passages, and the automaton locates every occurrence, which is then extended word by word. So hashes only
choose what is compared; what is removed is equal word for word.

Documents of equal words meet first, by hash: of a later copy every window starts earlier, so it needs no
automaton, and groups of copies of any size stay out of the joins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.filters import join_touched, maybe_in
from vitrine.llm.grams import minimizers, run_hashes, word_hashes
from vitrine.llm.scanned import buffers, scan
from vitrine.llm.words import LAST_ID, id_key, text_or_empty, words_of
from vitrine.session import materialize

#: Words in the short runs that windows are found by.
RUN = 8
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _joined(text: bytes) -> bytes:
    """The words joined by one space. Most texts need no more than their blanks turned to spaces."""
    spaced = text.translate(SPACES)
    return spaced if b"  " not in spaced and spaced == spaced.strip() else b" ".join(spaced.split())


def worded(texts: Iterable[str], derive: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> Iterator[tuple]:
    """For each text its joined words, the first byte of each, its first word's place in the buffer and the place behind its
    last one, and what `derive` makes of the buffer's word hashes.

    The words and the runs of a buffer of texts are hashed at once; of what `derive` makes, a text may use only runs inside its places.
    """
    for held in buffers(texts):
        held = [_joined(x) for x in held]
        begins, hashes = scan(b"\n".join(held))
        made = derive(hashes)
        start = first = 0
        for joined in held:
            last = int(np.searchsorted(begins, start + len(joined)))
            yield joined, begins[first:last] - start, first, last, *made
            start, first = start + len(joined) + 1, last


def _anchors(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The run hashes of words and, for each window of them, the position of the run that it names."""
    runs = run_hashes(hashes, run)
    return runs, minimizers(runs, window - run + 1)


def _survey(window: int, run: int):
    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, (joined, begins, first, last, runs, at) in zip(b["k"], worded(b["text"], lambda h: _anchors(h, window, run)), strict=True):
                named = at[first : max(first, last - window + 1)]
                rows.append((k, hashlib.md5(joined).digest(), len(begins), hashlib.sha256(joined).digest(), runs[np.unique(named)].view(np.int64)))
            yield pd.DataFrame(rows, columns=["k", "h", "n_words", "sha", "anchors"])

    return survey


def _keyed(texts: Iterable[str], anchors: Iterable[np.ndarray], window: int, run: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its joined words, the first byte of each, and starts and keys of the windows that name one of its recurring runs."""

    def derive(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs, at = _anchors(hashes, window, run)
        return runs[at], run_hashes(hashes, window, seed=1)

    for recurring, (joined, begins, first, last, named, keys) in zip(anchors, worded(texts, derive), strict=True):
        mine = slice(first, max(first, last - window + 1))
        starts = np.flatnonzero(np.isin(named[mine], np.asarray(recurring, np.int64).view(np.uint64)))
        yield joined, begins, starts, keys[mine][starts].view(np.int64)


def _windows(window: int, run: int):
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [np.unique(found) for *_, found in _keyed(b["text"], b["anchors"], window, run)]
            yield pd.DataFrame({"k": np.repeat(b["k"].to_numpy(), [len(x) for x in keys]), "key": np.concatenate([*keys, np.zeros(0, np.int64)])})

    return windows


def _passages(window: int, run: int):
    """The confirmed passages of the first documents: for every window key its passage, and once the passage's text."""

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, known, (joined, at, starts, keys) in zip(b["k"], b["keys"], _keyed(b["text"], b["anchors"], window, run), strict=True):
                own = np.isin(keys, np.asarray(known, np.int64))
                starts, keys = starts[own], keys[own]
                if not len(starts):
                    continue
                new = np.concatenate([[True], np.diff(starts) > window])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(starts)]]) - 1
                begins = starts[first]
                ends = np.append(at[1:] - 1, len(joined))
                texts = [joined[i:j].decode() for i, j in zip(at[begins], ends[starts[last] + window - 1], strict=True)]
                text_of = np.full(len(starts), None, object)
                text_of[first] = texts
                yield pd.DataFrame({"key": keys, "source": np.full(len(keys), k), "begin": begins[np.cumsum(new) - 1], "passage": text_of})

    return passages


def _recurs(keys: np.ndarray) -> bool:
    """Whether two of the keys are equal."""
    ordered = np.sort(keys)
    return bool((ordered[1:] == ordered[:-1]).any())


def repeated_in(words: list[bytes], window: int) -> np.ndarray:
    """Which words lie in a window that starts earlier in the same text too; windows are told apart exactly."""
    covered = np.zeros(len(words), bool)
    count = len(words) - window + 1
    if count <= 1:
        return covered
    keys = run_hashes(word_hashes(words), window, seed=2)
    if not _recurs(keys):
        return covered
    # Number the runs of 1, 2, 4, ... words by their two halves, then the windows by the two runs that overlap in them.
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    size = 1
    while size * 2 <= window:
        ids = paired(ids[:-size], ids[size:])
        size *= 2
    if size < window:
        ids = paired(ids[:count], ids[window - size : window - size + count])
    _, first = np.unique(ids, return_index=True)
    later = np.ones(count, bool)
    later[first] = False
    for i in range(window):
        covered[i : i + count] |= later
    return covered


class Automaton:
    """An Aho-Corasick automaton of passages, cut into blocks of half a window: any window inside a passage holds a whole block."""

    def __init__(self, passages: list[tuple[int, str]], window: int):
        self.window, self.block = window, max(1, window // 2)
        self.passages = [(source, text.encode().split()) for source, text in passages]
        places: dict[str, list[tuple[int, int]]] = {}
        for p, (_, words) in enumerate(self.passages):
            for at in range(0, len(words) - self.block + 1, self.block):
                places.setdefault(b" ".join([b"", *words[at : at + self.block], b""]).decode(), []).append((p, at))
        self.machine = ahocorasick.Automaton()
        for phrase, found in places.items():
            self.machine.add_word(phrase, (len(phrase), found))
        if places:
            self.machine.make_automaton()
        self.empty = not places

    def cover(self, k: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window that a passage of an earlier document holds."""
        covered = np.zeros(len(words), bool)
        if self.empty or len(words) < self.window:
            return covered
        raw = b" ".join([b"", *words, b""])
        shown = raw.decode()
        codes = np.frombuffer(raw, np.uint8) if len(raw) == len(shown) else np.frombuffer(shown.encode("utf-32-le"), "<u4")
        blanks = np.flatnonzero(codes == 32)  # the i-th is before the i-th word
        done: dict[tuple[int, int], int] = {}
        for end, (length, found) in self.machine.iter(shown):
            j = int(np.searchsorted(blanks, end - length + 1))
            for p, at in found:
                source, passage = self.passages[p]
                shift = j - at
                if source >= k or done.get((p, shift), -1) > j:
                    continue
                lo, hi = j, j + self.block
                while lo > 0 and lo > shift and words[lo - 1] == passage[lo - 1 - shift]:
                    lo -= 1
                while hi < len(words) and hi - shift < len(passage) and words[hi] == passage[hi - shift]:
                    hi += 1
                done[p, shift] = hi
                if hi - lo >= self.window:
                    covered[lo:hi] = True
        return covered


def _spans(covered: np.ndarray) -> np.ndarray:
    """Starts and ends of the covered stretches, in one array."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edges.astype(np.int64)


def _locate(window: int):
    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # One automaton for the batch: each passage once, however many documents of the batch hold it.
            share = {(p["source"], p["begin"]): p["passage"] for listed in b["passages"] if listed is not None for p in listed}
            machine = Automaton([(source, text) for (source, _), text in share.items()], window)
            rows = []
            found = worded(b["text"], lambda h: (run_hashes(h, window, seed=2),))
            for k, listed, (joined, _, start, end, keys) in zip(b["k"], b["passages"], found, strict=True):
                recurs = _recurs(keys[start : max(start, end - window + 1)])
                if listed is None and not recurs:
                    continue
                words = joined.split()
                covered = repeated_in(words, window) if recurs else np.zeros(len(words), bool)
                if listed is not None:
                    covered |= machine.cover(k, words)
                if covered.any():
                    h = hashlib.md5(joined).digest()
                    kept = b" ".join([w for w, out in zip(words, covered, strict=True) if not out])
                    rows.append((k, h, _spans(covered), int(covered.sum()), hashlib.sha256(kept).digest()))
            yield pd.DataFrame(rows, columns=["k", "h", "spans", "n_removed", "kept_sha"])

    return locate


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, run: int = RUN) -> DataFrame:
    """One row per input row: its id, k, h, n_words, n_removed, spans, kept_sha.

    Words are the runs of characters other than blanks. A word is removed when it lies in a window of
    `window` words that also starts earlier: in a document of smaller id, or earlier in the same one. `spans`
    holds the removed stretches as word positions, start and end in turn; kept_sha is the SHA-256 of the words
    that stay, joined by one space. A null text has no words; a null id comes after every other, and rows that
    share an id, null or not, are never earlier than each other. k and h tell rows apart: the id as a number
    and a hash of the words. Only id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(id_key(id_col).alias("k"), text_or_empty(text_col).alias("text"))
    surveyed = materialize(texts.mapInPandas(_survey(window, run), "k long, h binary, n_words long, sha binary, anchors array<long>"), "survey")
    copies = materialize(surveyed.groupBy("h").agg(F.min("k").alias("first")), "copies")
    first = surveyed.join(copies.select("h", F.col("first").alias("k")), ["h", "k"], "left_semi")

    # Runs that are named twice, and the documents that hold them.
    named = first.select("k", F.explode("anchors").alias("anchor"))
    twice = materialize(named.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "runs")
    held = named.where(maybe_in("anchor", twice, 1 << 22)).join(twice, "anchor")
    holders = materialize(held.groupBy("k").agg(F.collect_set("anchor").alias("anchors")), "holders")
    some = materialize(texts.where(maybe_in("k", holders.select("k"))).join(holders, "k"), "holder-texts")

    # Windows that several documents hold; the smallest id keeps them.
    windows = materialize(some.select("k", "text", "anchors").mapInPandas(_windows(window, run), "k long, key long"), "window-keys")
    shared = materialize(windows.groupBy("key").agg(F.min("k").alias("k"), F.count("*").alias("n")).where("n > 1").select("key", "k"), "windows")
    owned = shared.groupBy("k").agg(F.collect_list("key").alias("keys"))
    confirmed = some.select("k", "text", "anchors").join(owned, "k").mapInPandas(_passages(window, run), "key long, source long, begin long, passage string")
    confirmed = materialize(confirmed, "passages")
    passages = confirmed.where("passage IS NOT NULL").select("source", "begin", "passage").dropDuplicates(["source", "begin"])

    # Which passages a later document meets, and every occurrence of them.
    places = confirmed.select("key", "source", "begin")
    met = windows.where(maybe_in("key", shared.select("key"), 1 << 23)).join(places, "key").where("source < k").select("k", "source", "begin").distinct()
    given = met.join(passages, ["source", "begin"]).groupBy("k").agg(F.collect_list(F.struct("source", "begin", "passage")).alias("passages"))
    located = some.select("k", "text").join(given, "k", "left").mapInPandas(_locate(window), "k long, h binary, spans array<long>, n_removed long, kept_sha binary")
    located = materialize(located, "spans").dropDuplicates(["k", "h"])

    judged = surveyed.drop("anchors").join(copies, "h")
    late = (F.col("first") < F.col("k")) & (F.col("n_words") >= window)
    out = judged.join(located, ["k", "h"], "left")
    return out.select(
        F.when(F.col("k") != LAST_ID, F.col("k")).alias(id_col),
        "k",
        "h",
        "n_words",
        F.when(late, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(late, F.array(F.lit(0).cast("long"), F.col("n_words"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
        F.when(late, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"),
    )


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the words of the spans; each stretch goes with the blanks behind it."""
    if text is None or spans is None or not len(spans):
        return text
    begins = [m.start() for m in WORD.finditer(text)] + [len(text)]
    edges = [0, *[begins[i] for i in spans], len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, run: int = RUN) -> DataFrame:
    """The documents, all columns and rows, without the words that `repeated_spans` removes; a text can become empty, a null stays null."""
    found = repeated_spans(docs, id_col, text_col, window, run).where("n_removed > 0").select("k", "h", "spans")
    found = materialize(found, "cuts").dropDuplicates(["k", "h"])
    some, others = join_touched(docs, id_key(id_col), found)
    h = F.unhex(F.md5(F.array_join(words_of(text_or_empty(F.col(f"_row.`{text_col}`"))), " ")))
    joined = some.join(found.select(F.struct("*").alias("_cut")), (F.col("_k") == F.col("_cut.k")) & (h == F.col("_cut.h")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    row = [F.col(f"_row.`{c}`") for c in docs.columns]
    changed = joined.select(*[cut(r, F.col("_cut.spans")).alias(c) if c == text_col else r for c, r in zip(docs.columns, row, strict=True)])
    return changed.union(others.select(*row))
