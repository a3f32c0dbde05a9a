"""Packing: bounded-space online packing of token ids into sequences of at most `window` ids.

Every task keeps a fixed number of open windows. What is left of a document after its full windows goes to the
open window that it fills best; when none has room, the fullest one is filled up with its beginning and
emitted. The windows still open at a task's end are merged in further rounds, each over far fewer rows, until
one task holds them all; the last few sequences are cut at powers of two, which need no padding. Every round
writes its table before the next one reads it, so a task that runs again cannot deal an id twice.
"""

from __future__ import annotations

import contextlib
import os
import re
import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.memo import Memo
from vitrine.llm.words import text_or_empty
from vitrine.session import shared_dir

#: Bytes of each of the two generations of words that a worker remembers.
MEMO_BYTES = 64 << 20
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Windows that one task of a merging round reads.
MERGE = 2048
# The vocabulary's own split pattern, with its character classes spelled out for Latin-1.
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\x09-\\x0d \x85\xa0{LETTERS}{DIGITS}]+")
# The same for words of printable ASCII in lower case, over their bytes.
SHOWN, SHOWN_SPLIT = re.compile(b"[!-~]+"), re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# UTF-8 of Latin-1.
LATIN = re.compile(b"(?:[\x00-\x7f]|[\xc2\xc3][\x80-\xbf])*")
PIECE = "doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed boolean"

#: The columns of a piece; the types of ids come with them.
COLUMNS = {"doc_id": None, "start": pa.int64(), "length": pa.int64(), "ids": None, "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "closed": pa.bool_()}


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts through one memo of words and pre-tokens, bounded in bytes.

    The vocabulary's normaliser folds white space to single spaces that no pre-token crosses, so a text's ids
    are those of its words, one after the other. Words are cut at ASCII white space; any other kind stays
    inside a word. Words of Latin-1 are in normal form C already and lower-case letter by letter, so their
    pre-tokens go straight to the tokenizer's model; other words take the whole tokenizer.
    With `added`, the content of an added token in a text is that token, as the library reads it by default: a
    text that holds one takes the whole tokenizer. Without, it is text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = Memo(self._ids, MEMO_BYTES)

    def _model_ids(self, text: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(text)]
        return pack_ids(f"<{len(ids)}i", *ids)

    def _ids(self, word: bytes) -> bytes:
        # Most words are letters, or letters and one other sign behind them, and need no pattern to be cut.
        if word.isalpha():
            low = word.lower()
            return self._model_ids(word.decode()) if low == word else self.words.one(low)
        known = self.words.young.get
        if word[:-1].isalpha() and 33 <= word[-1] <= 126:
            low, sign = word[:-1].lower(), word[-1:]
            return (known(low) or self.words.one(low)) + (known(sign) or self.words.one(sign))
        if SHOWN.fullmatch(word):
            # Printable ASCII stands for itself in the vocabulary, and needs no characters to be cut.
            parts = SHOWN_SPLIT.findall(word.lower())
            if parts != [word]:
                return b"".join([known(p) or self.words.one(p) for p in parts])
            return self._model_ids(word.decode())
        text = word.decode()
        if LATIN.fullmatch(word):
            parts = SPLIT.findall(text.lower())
            if parts == [text]:
                return self._model_ids(word.decode("latin-1").translate(self.letters))
            # A pre-token is a word of its own and has the same ids there.
            return b"".join([self.words.one(p.encode()) for p in parts])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if self.added and any(x in low for low in (text.lower(),) for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4")
        return np.frombuffer(b"".join(self.words.many(text.encode().split())), "<i4")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path, added=True)
    return _TOKENIZERS[path]


class Packer:
    """The open windows of one task; finished rows are taken from `rows`."""

    def __init__(self, window: int, space: int, task: int):
        self.window, self.space = window, space
        self.open: dict[int, list] = {}  # sequence -> its pieces
        self.gaps: list[tuple[int, int]] = []  # (room left, sequence), sorted
        self.next = task << 40
        self.rows: list[tuple] = []

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, sequence: int, pieces: list, closed: bool = True) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids, zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, at, closed))
            at += len(ids)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self._close(self._sequence(), [(doc, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                room, sequence = self.gaps.pop(at)
                take = len(ids)
            elif len(self.gaps) < self.space:
                room, sequence, take = self.window, self._sequence(), len(ids)
                self.open[sequence] = []
            else:
                room, sequence = self.gaps.pop(0)
                take = room
            self.open[sequence].append((doc, start, ids[:take], total))
            if room == take:
                self._close(sequence, self.open.pop(sequence))
            else:
                insort(self.gaps, (room - take, sequence))
            start, ids = start + take, ids[take:]

    def leave(self) -> None:
        """Emit the open windows as they are, for another round."""
        for sequence, pieces in self.open.items():
            self._close(sequence, pieces, False)
        self.open, self.gaps = {}, []

    def finish(self) -> None:
        """Join the open windows and cut them into full ones and powers of two."""
        parts = [p for _, sequence in self.gaps for p in self.open[sequence]]
        left = sum(len(ids) for _, _, ids, _ in parts)
        self.open, self.gaps = {}, []
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            left, room, pieces = left - size, size, []
            while room:
                doc, start, ids, total = parts.pop(0)
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    parts.insert(0, (doc, start + room, ids[room:], total))
                room -= len(pieces[-1][2])
            self._close(self._sequence(), pieces)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        """The finished rows; `kind` is the type of the ids of documents."""
        rows, self.rows = self.rows, []
        columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in COLUMNS]
        ends = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *columns[3]])))
        made = [pa.array(c, t) for c, t in zip(columns, COLUMNS.values(), strict=True) if t is not None]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *made[:2], ids, *made[2:]], list(COLUMNS))


@contextlib.contextmanager
def two_open_files(spark: SparkSession) -> Iterator[None]:
    """Rows of two folders are written as they come, by a writer for each folder, instead of being sorted by folder first."""
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, "2")
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES, before)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    window: int = 4096,
    space: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and then `end_id`; a null or empty text is `end_id` alone. Every id lies
    in exactly one piece, sequences are gapless, and all but the few that are powers of two are full. An
    empty table gives no rows. Rows that repeat an id are packed each for itself. Only id and text are read.
    `window` is a power of two; `space` is the number of open windows of a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    piece = PIECE.format(kind=read.schema["doc_id"].dataType.simpleString())
    place = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, p, end = tokenizer(tokenizer_path), Packer(window, space, TaskContext.get().partitionId()), np.array([end_id], "<i4")
        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.concatenate([t.encode(text.as_py()), end])
                p.add(doc, 0, ids, len(ids))
                if len(p.rows) >= 512:
                    yield p.batch(kind)
        p.leave()
        if p.rows:
            yield p.batch(kind)

    def again(last: bool, level: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = Packer(window, space, (level << 21) + TaskContext.get().partitionId())
            kind = None
            for b in batches:
                kind, held = b.column("doc_id").type, b.column("ids")
                values, ends = held.values.to_numpy(), held.offsets.to_numpy()
                for n, (doc, start, total) in enumerate(zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")], strict=True)):
                    p.add(doc, start, values[ends[n] : ends[n + 1]], total)
                if len(p.rows) >= 512:
                    yield p.batch(kind)
            p.finish() if last else p.leave()
            if p.rows:
                yield p.batch(kind)

        return merge

    def write(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """The finished and the open pieces of a round, from folders of their own."""
        path = f"{place}/{level}"
        with two_open_files(spark):
            rows.write.partitionBy("closed").parquet(path)
        table = spark.read.schema(piece).parquet(path)
        return table.where("closed").drop("closed"), table.where("not closed").drop("closed")

    level = 0
    done, left = write(read.mapInArrow(first, piece), level)
    while n := left.select("sequence_id").distinct().count():
        level += 1
        tasks = -(-n // MERGE)
        dealt = left.repartition(tasks, "sequence_id") if tasks > 1 else left.coalesce(1)
        more, left = write(dealt.sortWithinPartitions("sequence_id", "offset").mapInArrow(again(tasks == 1, level), piece), level)
        done = done.unionByName(more)
    return done.withColumnRenamed("doc_id", id_col)
