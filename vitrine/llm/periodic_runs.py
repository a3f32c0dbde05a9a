"""Periodic runs: stretches of words that repeat with a period, found through suffix trees and Lyndon roots.

A run is a stretch of smallest period q that no neighbouring word extends. Every run has a root that is the
longest Lyndon word at some position, in the order of the words or in its inverse. So the candidates are one
period for each position and order, and each is extended to both sides by the longest common extension: the
depth of the lowest common ancestor of two leaves, in the suffix tree of the words to the right, in that of the
reversed words to the left. The trees are built by Ukkonen's algorithm; the ancestor's depth is the least one
between the leaves' places on the Euler tour, read in constant time from a sparse table.

A long enough run repeats its own windows of `window` words, so trees are built only over the stretches that
repeated windows cover. A window's hash decides what is built, never what is a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.grams import run_hashes, word_hashes
from vitrine.llm.words import text_or_empty

#: Entries of one block of `Least`.
BLOCK = 32


class Least:
    """Range minima in constant time: a sparse table over blocks, and running minima inside them."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.cells = np.full((blocks, BLOCK), np.iinfo(np.int32).max, np.int32)
        self.cells.reshape(-1)[: len(values)] = values
        self.upto = np.minimum.accumulate(self.cells, axis=1)
        self.since = np.minimum.accumulate(self.cells[:, ::-1], axis=1)[:, ::-1]
        self.levels = [self.upto[:, -1].copy()]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last, np.concatenate([last[step:], last[-step:]])))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of low..high, both included, for each pair."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.since[a, low % BLOCK], self.upto[b, high % BLOCK])
        for i in range(0, len(low), 1 << 14):
            at = np.flatnonzero(a[i : i + (1 << 14)] == b[i : i + (1 << 14)]) + i
            column = np.arange(BLOCK)
            inside = (column >= (low[at] % BLOCK)[:, None]) & (column <= (high[at] % BLOCK)[:, None])
            out[at] = np.where(inside, self.cells[a[at]], np.iinfo(np.int32).max).min(axis=1)
        far = np.flatnonzero(b - a > 1)
        span = b[far] - a[far] - 1
        level = np.frexp(span)[1] - 1
        for k in np.unique(level):
            some = far[level == k]
            table = self.levels[k]
            out[some] = np.minimum(out[some], np.minimum(table[a[some] + 1], table[b[some] - (1 << int(k))]))
        return out


class SuffixTree:
    """Ukkonen's tree over numbers from 1 on; a 0, less than all and found nowhere else, is put at the end."""

    def __init__(self, numbers: list[int]):
        word = [*numbers, 0]
        n, sigma = len(word), max(word) + 1
        start, end, link, suffix = [0], [0], [0], [-1]
        edges: dict[int, int] = {}
        node = edge = length = rest = 0
        for i, c in enumerate(word):
            rest += 1
            made = 0
            while rest:
                if not length:
                    edge = i
                key = node * sigma + word[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(i - rest + 1)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    at = start[child]
                    size = end[child] - at
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if word[at + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    middle = len(start)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    suffix += (-1, i - rest + 1)
                    edges[key] = middle
                    edges[middle * sigma + c] = middle + 1
                    edges[middle * sigma + word[at + length]] = child
                    start[child] = at + length
                    if made:
                        link[made] = middle
                    made = middle
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.n, self.nodes, self.suffix = n, len(start), suffix
        self.size = (np.array(end) - np.array(start)).tolist()
        keys = np.fromiter(edges, np.int64, len(edges))
        self.parents, self.symbols = keys // sigma, keys % sigma
        self.children = np.fromiter(edges.values(), np.int64, len(edges))

    def _ordered(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        order = np.lexsort((symbols, self.parents))
        return self.children[order].tolist(), np.searchsorted(self.parents[order], np.arange(self.nodes + 1)).tolist()

    def euler_tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The depth in words of each node that the tour passes, and the place on it of every suffix."""
        children, first = self._ordered(self.symbols)
        depth, place, tour, stack = [0] * self.nodes, [0] * self.n, [], [0]
        size, suffix = self.size, self.suffix
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d, a, b = depth[v], first[v], first[v + 1]
            if a == b:
                place[suffix[v]] = len(tour)
            tour.append(d)
            for c in children[a:b][::-1]:
                depth[c] = d + size[c]
                stack.append(~v)
                stack.append(c)
        return np.array(tour, np.int32), np.array(place, np.int64)

    def ranks(self, inverse: bool) -> list[int]:
        """The rank of every suffix where numbers rise, or fall; the end is less than all in both orders."""
        children, first = self._ordered(np.where(self.symbols > 0, -self.symbols, np.iinfo(np.int64).min) if inverse else self.symbols)
        rank, count, stack, suffix = [0] * self.n, 0, [0], self.suffix
        while stack:
            v = stack.pop()
            a, b = first[v], first[v + 1]
            if a == b:
                rank[suffix[v]] = count
                count += 1
            else:
                stack.extend(children[a:b][::-1])
        return rank


class Extensions:
    """The longest common extension of two positions, in constant time."""

    def __init__(self, tree: SuffixTree):
        tour, self.place = tree.euler_tour()
        self.least = Least(tour)

    def of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        a, b = self.place[one], self.place[two]
        return self.least.between(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each position the next one of smaller rank, where the longest Lyndon word that begins here ends."""
    n = len(rank) - 1
    out = [n] * n
    for i in range(n - 1, -1, -1):
        r, j = rank[i], i + 1
        while j < n and rank[j] > r:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_in(numbers: list[int], min_length: int, exponent: int) -> np.ndarray:
    """(start, length, period) of the runs in a sequence of numbers from 1 on, by start, then period."""
    n = len(numbers)
    if n < min_length:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(numbers)
    at = np.arange(n)
    starts = np.concatenate([at, at])
    periods = np.concatenate([next_smaller(tree.ranks(inverse)) for inverse in (False, True)]) - starts
    able = periods * exponent <= n
    starts, periods = starts[able], periods[able]
    right = Extensions(tree).of(starts, starts + periods)
    del tree
    back = Extensions(SuffixTree(numbers[::-1]))
    # The words before a position i are the suffix n - i of the reversed sequence.
    left = back.of(n - starts, n - starts - periods)
    length = left + periods + right
    found = np.stack([starts - left, length, periods], axis=1)[(length >= min_length) & (length >= exponent * periods)]
    return np.unique(found, axis=0)


def repeated_stretches(words: list[bytes], window: int, exponent: int) -> list[tuple[int, int]]:
    """The stretches (start, stop) of words covered by windows that have an equal one near enough.

    A period is at most a stretch's length by `exponent`, so windows whose nearest equal one is further away drop out.
    """
    hashes = run_hashes(word_hashes(words), window)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    spots = np.flatnonzero(np.isin(hashes, twice))
    by_hash = spots[np.argsort(hashes[spots], kind="stable")]
    gaps = np.where(hashes[by_hash[1:]] == hashes[by_hash[:-1]], np.diff(by_hash), len(words))
    nearest = np.zeros(len(hashes), np.int64)
    nearest[by_hash] = np.minimum(np.append(gaps, len(words)), np.append(len(words), gaps))
    while len(spots):
        breaks = np.diff(spots) > window
        group = np.concatenate([[0], np.cumsum(breaks)])
        firsts, lasts = spots[np.append(True, breaks)], spots[np.append(breaks, True)] + window
        near = nearest[spots] * exponent <= (lasts - firsts)[group]
        if near.all():
            return list(zip(firsts.tolist(), lasts.tolist(), strict=True))
        spots = spots[near]
    return []


def runs_of(words: list[bytes], min_length: int, exponent: int) -> np.ndarray:
    """(start, length, period) of every run in the words, by start, then period."""
    found = []
    # A run and its shift by one period have this many words in common, so each of its words lies in such a window.
    for start, stop in repeated_stretches(words, min_length - min_length // exponent, exponent):
        numbers: dict[bytes, int] = {}
        runs = runs_in([numbers.setdefault(w, len(numbers) + 1) for w in words[start:stop]], min_length, exponent)
        runs[:, 0] += start
        found.append(runs)
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, exponent: int = 3) -> DataFrame:
    """One row per input row: its id, n_words, runs (start, length, period, by start, then period), collapsed text.

    A run has at least `min_length` words and `exponent` periods (2 or more). Words are what stands between
    blanks, compared whole and with case. The collapsed text joins by one space the words that no run holds after
    its first period. Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are judged one by one: null
    and repeated ids, repeated rows and the order of rows change nothing. A run of equal rank does not hide
    another: overlapping runs are all returned. Only id and text are read, so other columns may have any name; an empty table
    gives an empty one. A task holds one batch of texts and the trees of one stretch, about 400 bytes for each of
    its words; texts without a repeated window need no tree.
    """
    if exponent < 2 or min_length < exponent:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, spans, texts = [], ([], [], []), []
            for text in b.column(1).to_pylist():
                words = text.encode().split()
                runs = runs_of(words, min_length, exponent)
                counts.append(len(words))
                for i in range(3):
                    spans[i].append(runs[:, i].tolist())
                texts.append(b" ".join(collapse(words, runs)))
            lists = [pa.array(s, pa.list_(pa.int64())) for s in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "start", "length", "period", "collapsed"])

    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    found = read.mapInArrow(judge, f"id {kind}, n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    return found.select(F.col("id").alias(id_col), "n_words", F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")
