"""Ranked lexical search over a term-partitioned index, with item bundles that pass from one term owner to the next.

Documents are dealt to shards of bounded size as they are read, and every shard has one posting block for each term: the
places of its documents and how often the term occurs there. Terms belong to owners by how rare they are. A
bundle is an item in one shard: its terms that are still to come, and a sparse accumulator of integer scores. Stage
after stage the bundles of a shard are cogrouped with the posting blocks of the next owner, which adds its
contributions. Rare terms come first, so that a document drops out of an accumulator as soon as all that is to
come cannot bring it to the shard's k best; that prunes no document that could be among them. What is left after
the last owner is each shard's k best, from which the k best of all are taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.words import id_key, text_or_empty
from vitrine.session import materialize, shared_dir

#: A shard ends at so many documents, postings or bytes of remembered terms.
SHARD_DOCS, SHARD_POSTINGS, MEMO_BYTES = 1 << 14, 1 << 21, 32 << 20
#: A term belongs to the first owner whose share of all documents it does not exceed; the last owner has the others.
OWNERS = (0.002, 0.01, 0.04, 0.12)
#: Items that meet a shard in one group.
ITEMS = 256
#: Bits of the filter that keeps most terms without an item out of the index.
FILTER_BITS = 1 << 22
#: No contribution reaches a term's weight times this.
UNIT = 1_000_000

_BYTES = bytearray(range(256))
for _c in range(128):
    if not chr(_c).isalnum():
        _BYTES[_c] = 0x20
    elif 0x41 <= _c <= 0x5A:
        _BYTES[_c] = _c + 0x20
#: ASCII letters in lower case, a space for every ASCII character that is no letter or digit.
FOLD = bytes(_BYTES)

POSTINGS = "shard long, term string, df long, docs array<int>, tfs array<int>"
BUNDLE = "shard long, block int, item string, terms array<string>, weights array<long>, owners array<int>, docs array<int>, scores array<long>"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order, repeats included."""
    return text.encode().translate(FOLD).split()


def _terms(texts: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of every row (item, text), the item's id being a string."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [list(dict.fromkeys(terms_of(t))) for t in b.column(1).to_pylist()]
            flat = pa.array([w for ws in lists for w in ws], pa.binary()).cast(pa.string())
            at = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), flat], names=["item", "term"])

    return texts.mapInArrow(each, "item string, term string").distinct()


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the hashes of `wanted` (term), whatever the number of terms."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[[xxhash.xxh64_intdigest(t.encode()) % FILTER_BITS for t in b["term"]]] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            for blob in b["bits"]:
                total |= np.frombuffer(blob, np.uint8)
        yield pd.DataFrame({"bits": [total.tobytes()]})

    some = wanted.mapInPandas(mark, "bits binary").coalesce(16).mapInPandas(merge, "bits binary")
    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in some.toLocalIterator():  # 16 rows of half a megabyte at most
        total |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(total).astype(bool)


class _Known(dict):
    """The number that a shard gives to each term it may need, -1 for the others."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits, self.terms, self.size = bits, [], 0

    def __missing__(self, term: bytes) -> int:
        wanted = self.bits[xxhash.xxh64_intdigest(term) % FILTER_BITS]
        if not wanted and len(term) > 64:
            return -1
        self.size += len(term) + 120
        self[term] = len(self.terms) if wanted else -1
        if wanted:
            self.terms.append(term)
        return self[term]


def index(docs: DataFrame, wanted: DataFrame, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, DataFrame]:
    """The posting blocks of `docs` (id, text) for terms that may be `wanted` (term), and each shard's ids and lengths.

    Places follow the ids inside a shard, a null id last. Documents without a term are in no shard.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter(wanted))  # FILTER_BITS bytes
    names = ["shard", "term", "df", "docs", "tfs", "ids", "ns"]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.int64(), pa.string(), pa.int64(), ints, ints, longs, ints]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        known, ids, ns, numbers, counts = _Known(bits.value), [], [], [], []

        def shard() -> list[pa.RecordBatch]:
            order = np.argsort(np.array([2**63 - 1 if k is None else k for k in ids], np.int64), kind="stable")
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids))
            term, tf = np.concatenate(numbers), np.concatenate(counts)
            doc = np.repeat(place, [len(x) for x in numbers])
            by = np.lexsort((doc, term))
            term, doc, tf = term[by], doc[by].astype(np.int32), tf[by].astype(np.int32)
            firsts = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
            ends = np.append(firsts, len(term)).astype(np.int32)
            n, label = len(firsts), (task << 32) + made
            words = pa.array([known.terms[t] for t in term[firsts]], pa.binary()).cast(pa.string())
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (doc, tf)]
            blocks = [pa.array(np.full(n, label)), words, pa.array(np.diff(ends), pa.int64()), *lists, *(pa.nulls(n, t) for t in kinds[5:])]
            roster = [label, None, 0, None, None, [ids[i] for i in order], [ns[i] for i in order]]
            whole = pa.RecordBatch.from_arrays(blocks, names=names)
            parts = [whole.slice(i, 2048) for i in range(0, n, 2048)]
            return [*parts, pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(roster, kinds, strict=True)], names=names)]

        held = 0
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                term, tf = np.unique(found[found >= 0], return_counts=True)
                ids.append(k)
                ns.append(len(words))
                numbers.append(term)
                counts.append(tf)
                held += len(term)
                if len(ids) >= shard_docs or held >= SHARD_POSTINGS or known.size >= MEMO_BYTES:
                    yield from shard()
                    made, held = made + 1, 0
                    known, ids, ns, numbers, counts = _Known(bits.value), [], [], [], []
        if ids:
            yield from shard()

    built = materialize(docs.mapInArrow(build, f"{POSTINGS}, ids array<long>, ns array<int>"), "lexical-index")
    return built.where("term IS NOT NULL").select("shard", "term", "df", "docs", "tfs"), built.where("term IS NULL").select("shard", "ids", "ns")


def best(scores: np.ndarray, k: int) -> int:
    """The k-th greatest score, zero if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else 0


def _stage(owner: int, last: bool, k: int):
    """Add the contributions of one owner's terms to the bundles of a shard; the last stage keeps the k best."""

    def add(bundles: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        roster = blocks[blocks["term"].isna()]
        if not len(bundles) or not len(roster):
            return bundles.iloc[:0]
        m = np.asarray(roster["docs"].iloc[0], np.int64)
        postings = {t: (np.asarray(d, np.int64), np.asarray(n, np.int64)) for t, d, n in zip(blocks["term"], blocks["docs"], blocks["tfs"], strict=True) if isinstance(t, str)}
        shares: dict[str, np.ndarray] = {}
        out = []
        for item, terms, weights, owners, docs, scores in bundles[["item", "terms", "weights", "owners", "docs", "scores"]].itertuples(index=False):
            mine, w = np.asarray(owners) == owner, np.asarray(weights, np.int64)
            total = np.zeros(len(m), np.int64)
            total[np.asarray(docs, np.int64)] = np.asarray(scores, np.int64)
            for i in np.flatnonzero(mine):
                if (found := postings.get(terms[i])) is not None:
                    at, tf = found
                    if terms[i] not in shares:
                        shares[terms[i]] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
                    total[at] += w[i] * shares[terms[i]]
            rest = int(w[~mine].sum()) * UNIT
            keep = np.flatnonzero((total > 0) & (total + rest >= best(total, k)))
            if last and len(keep) > k:
                keep = np.sort(keep[np.lexsort((keep, -total[keep]))[:k]])
            if len(keep) or not last:
                out.append((item, [terms[i] for i in np.flatnonzero(~mine)], w[~mine], np.asarray(owners)[~mine], keep.astype(np.int32), total[keep]))
        done = pd.DataFrame(out, columns=["item", "terms", "weights", "owners", "docs", "scores"])
        done.insert(0, "shard", bundles["shard"].iloc[0])
        done.insert(1, "block", bundles["block"].iloc[0])
        return done

    return add


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
    owners: tuple[float, ...] = OWNERS,
    shard_docs: int = SHARD_DOCS,
    items_per_block: int = ITEMS,
) -> DataFrame:
    """Each item's k documents of greatest score, equal scores by id: the item's id, rank from 1, the document's id, score.

    Terms are the maximal runs of ASCII letters and digits and of all other characters, lower-cased over A-Z. N counts the
    documents with a term, df those that hold a given one; its weight is floor(1000 * ln((2N + 2) / (2df + 1))). A document of
    n terms has m = 10 + 90 n N div L, with L the terms of all documents; a term that occurs tf times in it brings
    weight * (10^9 tf div (1000 tf + 8 m)). All but the logarithm is exact. Only scores above 0 count.

    Null, empty and blank texts have no terms: such documents are found by no item, such items have no rows. Rows that repeat
    an item's id are one item with the terms of all; rows that repeat a document's id are documents of their own. A null id comes
    last among equals. Other columns of either table are not read and may have any name; where a table is empty, there are no rows.
    A group of a stage holds `items_per_block` items and one shard, however frequent a term is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = materialize(_terms(items.select(F.col(item_col).cast("string"), text_or_empty(item_text_col))), "lexical-items")
    texts = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col))
    postings, roster = index(texts, wanted.select("term").distinct(), shard_docs)

    totals = roster.select(F.size("ids").cast("long").alias("docs"), F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n).alias("terms")).agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    n, length = totals["n"] or 0, totals["l"] or 1
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0)))
    owner = F.lit(0)
    for share in owners:
        owner = owner + (F.col("df") > F.lit(share * n)).cast("int")
    # A term that no document holds, and one whose weight is 0, brings nothing.
    weighed = materialize(postings.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"), owner.alias("owner")).where("weight > 0").join(wanted.select("term").distinct(), "term", "left_semi"), "lexical-terms")

    block = F.pmod(F.xxhash64("item"), F.lit(blocks := max(1, -(-wanted.select("item").distinct().count() // items_per_block)))).cast("int")
    lists = wanted.join(weighed, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("owner", "term", "weight"))).alias("t"))
    ready = lists.select(block.alias("block"), "item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.col("t.owner").alias("owners"))
    places = roster.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    bundles = places.join(materialize(ready, "lexical-bundles"), "block").select("shard", "block", "item", "terms", "weights", "owners", F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores"))

    m = F.transform("ns", lambda x: (10 + F.call_function("div", 90 * x.cast("long") * n, F.lit(length))).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    head = roster.select("shard", every, F.lit(None).cast("string").alias("term"), m.alias("docs"), F.array().cast("array<int>").alias("tfs"))
    path = f"{shared_dir(spark)}/lexical-owned-{uuid.uuid4().hex}"
    owned = postings.join(weighed, "term").select("shard", "term", "docs", "tfs", "owner")
    owned.write.partitionBy("owner").parquet(path)
    owned = spark.read.schema(owned.schema).parquet(path)
    for o in range(len(owners) + 1):
        mine = owned.where(F.col("owner") == o).select("shard", every, "term", "docs", "tfs").unionByName(head)
        bundles = bundles.groupBy("shard", "block").cogroup(mine.groupBy("shard", "block")).applyInPandas(_stage(o, o == len(owners), k), BUNDLE)
    found = bundles.select("shard", "item", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("shard", "item", "x.docs", "x.scores")
    named = found.join(roster.select("shard", "ids"), "shard").select("item", F.get("ids", F.col("docs")).alias("doc"), F.col("scores").alias("score"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), id_key("doc"))
    ranked = named.select("item", "doc", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(items.schema[item_col].dataType).alias(item_col), "rank", F.col("doc").alias(id_col), "score")
