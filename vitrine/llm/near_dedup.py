"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle's weight is its count in the document times the inverse of its document frequency, brought to 1 (in
every document) to 2 (in one). Frequencies are counted over all documents in a table of fixed size, indexed by
the shingle's hash; the usual load of a cell is taken off, so what remains are the shingles that many
documents share. Every document gets `bands` times
`rows` consistent weighted samples; two documents agree in one sample with the probability of their weighted
Jaccard similarity.

Documents of equal text meet first, by hash, and go on as one. A band's bucket is then held against its
smallest member, which settles groups of any size with one pair for each member. Of the members that this has
left apart, those whose shingles do not reach the similarity outside their component are done; of the others
those meet in pairs whose weights or numbers of shingles allow a link. Pairs are verified on the shingles of
both documents: a link needs the similarity with the weights or without them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.components import components
from vitrine.llm.filters import bit, join_touched, maybe_in
from vitrine.llm.grams import ODD, mix, run_hashes
from vitrine.llm.scanned import buffers, scan
from vitrine.llm.words import text_or_empty
from vitrine.session import materialize

CELLS = 1 << 18
#: Frequencies of so many cells travel as one row; tasks of the first summing step.
PART, SPREAD = 1 << 14, 32
TABLE = 1 << 16
#: Shingles that are sampled at once: what is held for them fits a core's cache.
BLOCK = 512
#: Words of 64 parities that tell two nodes apart before they are compared; a power of two.
MARKS = 4
MARKED = [f"mark{i}" for i in range(MARKS)]
EPS = 1e-9
#: More than sums of weights in another order can differ.
SLACK = 1e-6


def shingles_of(texts: Iterable[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, sorted, and how often each occurs; a text of fewer words is one shingle.

    The words and the shingles of a buffer of texts are hashed at once; shingles that cross texts are passed over.
    """
    for held in buffers(texts):
        begins, words = scan(b"\n".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        upto = np.searchsorted(begins, ends).tolist()
        runs, first = run_hashes(words, size, seed=size), 0
        for last in upto:
            n = last - first
            if n >= size:
                yield np.unique(runs[first : last - size + 1], return_counts=True)
            elif n:
                yield np.unique(run_hashes(words[first:last], n, seed=size), return_counts=True)
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
            first = last


def shingles(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """`shingles_of` one text."""
    return next(shingles_of([text], size))


def cell_of(codes: np.ndarray, cells: int) -> np.ndarray:
    return (codes >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def cell_frequencies(docs: DataFrame, size: int, cells: int) -> tuple[np.ndarray, int]:
    """In how many documents the shingles of each cell occur, and the number of documents; `cells` numbers reach the driver."""
    part = min(PART, cells)

    def pieces(total: np.ndarray) -> list[tuple[int, bytes]]:
        return [(p, total[p * part : (p + 1) * part].astype("<i8").tobytes()) for p in range(cells // part)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(cells, np.int64), 0
        for b in batches:
            n += len(b)
            found = [cell_of(codes, cells) for codes, _ in shingles_of(b["text"], size)]
            total += np.bincount(np.concatenate([*found, np.zeros(0, np.int64)]), minlength=cells)
        salt = TaskContext.get().partitionId() % SPREAD
        yield pd.DataFrame([(p, blob, salt) for p, blob in [*pieces(total), (-1, np.array([n], "<i8").tobytes())]], columns=["part", "counts", "salt"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for p, blob in zip(b["part"], b["counts"], strict=True):
                new = np.frombuffer(blob, "<i8")
                totals[p] = totals[p] + new if p in totals else new
        yield pd.DataFrame([(p, v.tobytes()) for p, v in totals.items()], columns=["part", "counts"])

    some = docs.select("text").mapInPandas(count, "part int, counts binary, salt int").repartition(SPREAD, "salt").drop("salt").mapInPandas(add, "part int, counts binary")
    total, n = np.zeros(cells, np.int64), 0
    for r in some.repartition(16, "part").mapInPandas(add, "part int, counts binary").collect():
        new = np.frombuffer(r["counts"], "<i8")
        if r["part"] < 0:
            n += int(new[0])
        else:
            total[r["part"] * part : (r["part"] + 1) * part] += new
    return total, n


def cell_weights(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency of each cell, without the load that cells have anyway, brought to 1 to 2.

    A group's copies are counted too, so without a bound what a large group shares would weigh next to nothing
    beside the few shingles that each copy has for itself, and the copies would not find each other.
    """
    n = max(1, n)
    above = np.clip(frequencies - int(np.median(frequencies)), 1, n)
    return 1 + np.log(n / above) / np.log(max(2, n))


def weigh(text: str, size: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = shingles(text, size)
    return codes, counts * weights[cell_of(codes, len(weights))]


class Sampler:
    """Improved consistent weighted sampling; the variates of a (shingle, sample) come from tables by its hash."""

    def __init__(self, bands: int, rows: int):
        uniform = np.random.Generator(np.random.PCG64(20)).random((4, TABLE))
        self.gamma = -np.log(uniform[0] * uniform[1])
        self.log_c = np.log(-np.log(uniform[2] * uniform[3]))
        self.bands, self.rows = bands, rows
        self.seeds = (np.arange(1, bands * rows + 1, dtype=np.uint64) * ODD)[:, None]

    def bands_of(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One hash for each band; none for a document without shingles."""
        if not len(codes):
            return np.zeros(0, np.int64)
        k = self.bands * self.rows
        least, chosen, level = np.full(k, np.inf), np.zeros(k, np.uint64), np.zeros(k)
        log_w = np.log(weights)
        row = np.arange(k)
        for i in range(0, len(codes), BLOCK):
            h = mix(codes[i : i + BLOCK][None, :] ^ self.seeds)
            # The 16-bit parts of h, lowest first.
            parts = h.astype("<u8", copy=False).view("<u2").reshape(*h.shape, 4)
            r, c = self.gamma.take(parts[..., 0]), self.log_c.take(parts[..., 1])
            h >>= np.uint64(32)
            beta = h.astype(np.float64)
            beta *= 2.0**-32
            t = log_w[i : i + BLOCK][None, :] / r
            t += beta
            np.floor(t, out=t)
            np.subtract(t, beta, out=beta)
            beta += 1
            beta *= r
            a = np.subtract(c, beta, out=c)
            at = a.argmin(axis=1)
            better = a[row, at] < least
            least = np.where(better, a[row, at], least)
            chosen = np.where(better, codes[i + at], chosen)
            level = np.where(better, t[row, at], level)
        sample = mix(chosen ^ mix(level.astype(np.int64).astype(np.uint64) + self.seeds[:, 0])).reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            out = mix(out * ODD + sample[:, i])
        return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    """Whether the weighted or the plain Jaccard similarity is `similarity` or more: weights never part plain near copies."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    weighted = common / (a[1].sum() + b[1].sum() - common)
    return max(weighted, len(i) / (len(a[0]) + len(b[0]) - len(i))) >= similarity - EPS


def _vectors(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(k, codes, counts): the shingles of the wanted (k). Texts that surely are not wanted stay out of the shuffle."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(shingles_of(b["text"], size))
            yield pd.DataFrame({"k": b["k"], "codes": [c.view(np.int64) for c, _ in found], "counts": [n.astype(np.int32) for _, n in found]})

    wanted = materialize(wanted.distinct(), "near-wanted")
    some = texts.where(maybe_in("k", wanted)).join(wanted.hint("merge"), "k", "left_semi")
    return materialize(some.mapInPandas(vectors, "k long, codes array<long>, counts array<int>"), "near-vectors")


def _verified(pairs: DataFrame, vectors: DataFrame, weights, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted or plain Jaccard similarity is `similarity` or more."""
    one, two = (vectors.select(F.col("k").alias(k), F.col("codes").alias("codes_" + k), F.col("counts").alias("counts_" + k)) for k in ("a", "b"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def weighed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            codes = np.asarray(codes, np.int64).view(np.uint64)
            return codes, counts * weights.value[cell_of(codes, len(weights.value))]

        for f in batches:
            four = zip(f["codes_a"], f["counts_a"], f["codes_b"], f["counts_b"], strict=True)
            keep = [linked(weighed(c, n), weighed(d, m), similarity) for c, n, d, m in four]
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.join(two, "b").join(one, "a").mapInPandas(judge, "a long, b long")


def _reachable(placed: DataFrame, vectors: DataFrame, weights, similarity: float) -> DataFrame:
    """(k, foreign, total, foreign_n, total_n) of the nodes (k, label) that can have a link into another component.

    `total` is a node's weight, `foreign` its weight in shingles that occur in another component; `total_n` and
    `foreign_n` are the numbers of these shingles. A link needs `similarity` of a node's weight, or of its
    shingles, in those that the other one holds too. So a node that has less of both in shingles that occur in
    other components has none: the many heavily edited copies of one text are told apart here, without a pair
    among them.

    `own` and `own_n` are what a node has in shingles that no other component holds, `mark0`, `mark1` and so on the
    parities of the hashes of its other shingles; see `_may_link`. Ids that stand on several texts have none of these.
    """

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for k, label, codes, counts in zip(f["k"], f["label"], f["codes"], f["counts"], strict=True):
                codes = np.asarray(codes, np.int64)
                w = counts * weights.value[cell_of(codes.view(np.uint64), len(weights.value))]
                yield pd.DataFrame({"k": np.full(len(codes), k), "label": np.full(len(codes), label), "code": codes, "part": w, "total": np.full(len(codes), w.sum()), "total_n": np.full(len(codes), len(codes))})

    rows = vectors.join(placed, "k").select("k", "label", "codes", "counts").mapInPandas(share, "k long, label long, code long, part double, total double, total_n int")
    rows = rows.repartition("code")  # once: the aggregate and the join read the same exchange
    shared = rows.groupBy("code").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("code")
    place = lambda i: F.when(F.col("code").bitwiseAND(MARKS - 1) == i, bit(F.shiftright("code", 8)))
    marks = [F.coalesce(F.bit_xor(place(i)), F.lit(0).cast("long")).alias(f"mark{i}") for i in range(MARKS)]
    sums = [F.sum("part").alias("foreign"), F.max("total").alias("total"), F.count("*").alias("foreign_n"), F.max("total_n").alias("total_n")]
    foreign = rows.join(shared, "code", "left_semi").groupBy("k").agg(*sums, *marks)
    able = foreign.where((F.col("foreign") >= similarity * F.col("total") - SLACK) | (F.col("foreign_n") >= similarity * F.col("total_n") - SLACK))
    one = F.col("texts") == 1
    known = [F.when(one, F.col(c)).alias(c) for c in MARKED]
    own = [F.when(one, F.col("total") - F.col("foreign")).alias("own"), F.when(one, F.col("total_n") - F.col("foreign_n")).alias("own_n")]
    return able.join(vectors.groupBy("k").agg(F.count("*").alias("texts")), "k").select("k", "foreign", "total", "foreign_n", "total_n", *own, *known)


def _may_link(similarity: float) -> Column:
    """Whether two nodes of different components can be linked, by what `_reachable` says of them (the second one's columns end in 2).

    They have no more in common than the lesser of their foreign weights, or of their foreign shingles. And they
    differ in the own shingles of both and in at least as many others as parities differ, each of weight 1 or more;
    a link needs a difference of at most (1 - similarity) / (1 + similarity) of both sums.
    """
    common, common_n = F.least("foreign", "foreign2"), F.least("foreign_n", "foreign_n2")
    weight, number = F.col("total") + F.col("total2"), F.col("total_n") + F.col("total_n2")
    parities = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in MARKED[1:]), F.bit_count(F.col(MARKED[0]).bitwiseXOR(F.col(MARKED[0] + "2"))))
    most = (1 - similarity) / (1 + similarity)
    differ, differ_n = (F.coalesce(F.col(c) + F.col(c + "2") + parities, F.lit(0)) for c in ("own", "own_n"))
    weighted = (common >= similarity * (weight - common) - SLACK) & (differ <= most * weight + SLACK)
    return weighted | (common_n >= similarity * (number - common_n) - SLACK) & (differ_n <= most * number + SLACK)


def _apart(placed: DataFrame) -> DataFrame:
    """Of (band, k, label) the buckets that hold more than one component."""
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    return placed.join(mixed, "band", "left_semi")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    bands: int = 12,
    rows: int = 3,
    cells: int = CELLS,
) -> DataFrame:
    """One row per input row: the id, class_id (the smallest id of its class), kept (whether it is that id).

    Classes are the connected components of documents with equal texts or with a weighted or a plain Jaccard
    similarity of `similarity` or more, as far as they share a band: 12 bands of 3 samples miss a pair of weighted
    similarity 0.7 with a probability of 6 in 1,000, one at 0.8 with 2 in 10,000, and one at 0.9 with 1 in 10 million. Null, empty and blank texts have no
    shingles and are alike only to texts equal to them, null being empty. Rows that repeat an id are one
    document and share its verdict. A row without an id is compared with nothing: class_id null, kept. Only
    id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(id_col).cast("long").alias("k"), text_or_empty(text_col).alias("text"))
    weights = spark.sparkContext.broadcast(cell_weights(*cell_frequencies(read, size, cells)))  # `cells` numbers

    texts = read.where("k IS NOT NULL")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s = weights.value, Sampler(bands, rows)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "h": b["h"], "bands": [s.bands_of(codes, n * w[cell_of(codes, len(w))]) for codes, n in shingles_of(b["text"], size)]})

    signed = materialize(texts.select("k", F.unhex(F.md5("text")).alias("h"), "text").mapInPandas(sign, "k long, h binary, bands array<long>"), "near-signatures")
    same = materialize(signed.groupBy("h").agg(F.min("k").alias("node")), "near-texts")
    firsts = signed.join(same.select("h", F.col("node").alias("k")), ["h", "k"], "left_semi")
    buckets = materialize(firsts.select("k", F.explode("bands").alias("band")).distinct(), "near-buckets")

    # First round: every bucket against its smallest member.
    heads = buckets.groupBy("band").agg(F.min("k").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = materialize(buckets.join(heads, "band").where("k <> a").select("a", F.col("k").alias("b")).distinct(), "near-stars")
    ends = stars.select(F.col("a").alias("k")).union(stars.select("b"))
    links = materialize(_verified(stars, _vectors(texts, ends, size), weights, similarity), "near-links")

    # Second round: members of a bucket that are still apart and can have a link, in pairs.
    labels = components(links)
    apart = materialize(_apart(buckets.join(labels, "k", "left").select("band", "k", F.coalesce("label", "k").alias("label"))), "near-apart")
    vectors = _vectors(texts, apart.select("k"), size)
    for _ in range(2):
        able = materialize(_reachable(apart.select("k", "label").distinct(), vectors, weights, similarity), "near-able")
        apart = materialize(_apart(apart.select("band", "k", "label").join(able, "k")), "near-apart")
    other = apart.select(F.col("k").alias("b"), *[F.col(c).alias(c + "2") for c in apart.columns if c != "k"])
    near = (F.col("k") < F.col("b")) & (F.col("label") != F.col("label2")) & _may_link(similarity)
    pairs = apart.join(other, (F.col("band") == F.col("band2")) & near).select(F.col("k").alias("a"), "b").distinct()
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"), "near-pairs")
    more = _verified(pairs, vectors, weights, similarity)

    classes = components(links.unionByName(more))
    nodes = signed.join(same, "h").select("k", "node").join(classes.withColumnRenamed("k", "node"), "node", "left")
    found = nodes.groupBy("k").agg(F.min(F.coalesce("label", "node")).alias("label"))
    return (
        docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("k"))
        .join(found, "k", "left")
        .select(F.col("id").alias(id_col), F.col("label").alias("class_id"), F.coalesce(F.col("label") == F.col("k"), F.lit(True)).alias("kept"))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents, all columns, of which `near_groups` keeps one in each class; rows that repeat its id stay."""
    out = near_groups(docs, id_col, text_col, **settings).where("NOT kept").select(F.col(id_col).cast("long").alias("k")).distinct()
    out = materialize(out, "near-out")
    some, others = join_touched(docs, F.col(id_col).cast("long"), out)
    row = [F.col(f"_row.`{c}`") for c in docs.columns]
    return some.join(out, F.col("_k") == F.col("k"), "left_anti").select(*row).union(others.select(*row))
