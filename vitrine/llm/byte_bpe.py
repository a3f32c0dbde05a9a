"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text falls into chunks, each a run of white space with the run of other characters after it; no pre-token
crosses their borders, so a chunk's ids do not depend on its neighbours and a bounded memo can hold them. The
pre-tokens of a chunk are looked up as a whole through a minimal perfect hash of the vocabulary; what is not
in the vocabulary is merged from its bytes by a heap of candidate pairs over a linked list.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.words import text_or_empty

# The characters with Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Chunks that a worker remembers before it starts anew; about 250 bytes each.
MEMO = 800_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash by displacement: one slot for each key, one comparison for each lookup."""

    def __init__(self, keys: dict[bytes, int]):
        n = len(keys)
        self.n, self.m = n, n // 4 + 1
        self.slot_key: list[bytes | None] = [None] * n
        self.slot_id = [0] * n
        self.shift = [0] * self.m
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.m)]
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            buckets[h % self.m].append((h, key))
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            bucket = buckets[b]
            if len(bucket) > 1:
                d = 1
                while True:
                    slots = {self._slot(h, d) for h, _ in bucket}
                    if len(slots) == len(bucket) and all(self.slot_key[s] is None for s in slots):
                        break
                    d += 1
                self.shift[b] = d
                for h, key in bucket:
                    self._put(self._slot(h, d), key, keys)
            elif bucket:
                # Buckets of one key take what is left, named directly.
                free = free or (s for s in range(n) if self.slot_key[s] is None)
                s = next(free)
                self.shift[b] = -s - 1
                self._put(s, bucket[0][1], keys)

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 32) + d * ((h & 0xFFFFFFFF) | 1)) % self.n

    def _put(self, s: int, key: bytes, keys: dict[bytes, int]) -> None:
        self.slot_key[s], self.slot_id[s] = key, keys[key]

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.slot_id[s] if self.slot_key[s] == key else None


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of least rank, leftmost first, is joined until none is left."""
    n = len(token)
    end = list(range(1, n + 1))  # a node is named by where it starts; end[i] is also its right neighbour
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(token[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(token[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := left[i]) >= 0 and (r := ranks.get(token[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = read_ranks(ranks_path)
        self.whole = PerfectHash(self.ranks)
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in self.pattern.findall(chunk):
            token = word.encode()
            if (one := self.whole.get(token)) is not None:
                ids.append(one)
            else:
                ids.extend(merge(token, self.ranks))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        chunks, memo = CHUNK.findall(text), self.memo
        try:
            return b"".join([memo[c] for c in chunks])
        except KeyError:
            new = {c for c in chunks if c not in memo}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set(chunks)
        for c in new:
            memo[c] = self._chunk(c)
        return b"".join([memo[c] for c in chunks])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process: tables and memo outlive the task."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and `ids`, the token ids packed as little-endian unsigned 32-bit integers.

    Each match of `pattern` is encoded by itself; there are no special tokens. A null or empty text has no
    ids. `ranks_path` names a rank file that every executor can read. Only id and text are read, so other
    columns cannot clash; repeated rows are encoded as often as they occur.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [c.encode(t) for t in b["text"]]})

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInPandas(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of `encode`: the id, `ids` and `bytes`, the UTF-8 text they stand for. Null ids give null bytes."""
    small_batches(encoded.sparkSession)
    read = encoded.select(F.col(id_col).alias("id"), "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": b["ids"], "bytes": [None if x is None else c.decode(x) for x in b["ids"]]})

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInPandas(run, f"id {kind}, ids binary, bytes binary").withColumnRenamed("id", id_col)
