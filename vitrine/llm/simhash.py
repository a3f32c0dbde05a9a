"""SimHash near-dedup: fingerprints of 64 bits, linked where at most `distance` bits differ.

Candidates are pruned by pigeonring filtering. The fingerprint is a ring of distance + 1 segments. If two of them differ in at
most `distance` bits, then from some segment on every chain of l consecutive segments differs in no more than its share of the
budget, the floor of l * distance / (distance + 1): nothing in the first segment, one bit in the first two, two in the first
three, and so on. The first two steps are met by equality: the first segment and a half of the second one agree,
which makes 2 * (distance + 1) keys for a fingerprint. The members of a key's bucket go through the other steps
of the chain and then through the full count of bits.

A bucket's members are dealt to blocks of bounded size and every two blocks meet in one group. Inside a group a
spanning forest of the links is found, never all pairs, and the forests of all groups hold the same components
as all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.components import components
from vitrine.llm.words import text_or_empty
from vitrine.session import materialize

BITS = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14
#: Most members of a group: two blocks.
GROUP = 4096


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """A bit is 1 where more than half of the shingles' hashes have it; zero without words."""
    words = text.encode().lower().split()  # bytes: A-Z alone, and the six blanks
    if not words:
        return 0
    size, line = min(size, len(words)), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones, digest = len(words) - size + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        spans = zip(starts[i : min(i + CHUNK, n)].tolist(), ends[i + size - 1 : min(i + CHUNK, n) + size - 1].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], seed) for a, b in spans], np.dtype(">u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments, which cover all bits; none is narrower than two."""
    count = distance + 1
    if not 0 <= distance <= BITS // 2 - 1:
        raise ValueError("from 0 to 31 bits may differ")
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def mask(shift: int, width: int) -> int:
    return ((1 << width) - 1) << shift


def signed(n: int) -> int:
    return n - (1 << BITS) if n >> (BITS - 1) else n


def chains(distance: int) -> list[tuple[int, list[int]]]:
    """For every kind of key its bits, and the masks of the chain's first two, three, ... segments."""
    ring, out = segments(distance), []
    for i in range(len(ring)):
        order = [ring[(i + j) % len(ring)] for j in range(len(ring))]
        steps = [sum(mask(*s) for s in order[: j + 1]) for j in range(1, len(order))]
        if len(order) == 1:
            out.append((mask(*order[0]), steps))
            continue
        shift, width = order[1]
        for half in (mask(shift, width // 2), mask(shift + width // 2, width - width // 2)):
            out.append((mask(*order[0]) | half, steps))
    return out


def keys(column: str, distance: int) -> Column:
    """The pieces of a fingerprint that a linked one shares at least once, each with its kind."""
    kinds = chains(distance)
    return F.array(*[F.struct(F.lit(n).cast("tinyint").alias("kind"), F.col(column).bitwiseAND(F.lit(signed(bits)).cast("long")).alias("piece")) for n, (bits, _) in enumerate(kinds)])


def forest(members: np.ndarray, steps: list[int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (one, two) between members, which agree in a key, that connect all that are linked, fewer than members."""
    parts = len(steps) + 1
    rest, one, two = members, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            differ, alive = rest ^ x, np.arange(len(rest))
            for j, bits in enumerate(steps, 2):
                alive = alive[np.bitwise_count(differ[alive] & np.uint64(bits)) <= j * distance // parts]
            alive = alive[np.bitwise_count(differ[alive]) <= distance]
            if len(alive):
                found = rest[alive]
                one.append(np.full(len(found), x))
                two.append(found)
                front.extend(found)
                rest = np.delete(rest, alive)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(none + one), np.concatenate(none + two)


def links(prints: DataFrame, distance: int, group: int = GROUP) -> DataFrame:
    """(a, b): fingerprints that connect all linked ones of the distinct `prints` (fp)."""
    kinds = chains(distance)
    pieces = materialize(prints.select("fp", F.explode(keys("fp", distance)).alias("key")).select("key.*", "fp"), "simhash-keys")
    sizes = pieces.groupBy("kind", "piece").agg(F.count("*").alias("n")).where("n > 1")
    half = group // 2
    blocks = F.when(F.col("n") <= half, 1).otherwise(F.ceil(F.col("n") / (half * 0.8))).cast("int")  # hashing deals unevenly
    dealt = pieces.join(sizes, ["kind", "piece"]).select("kind", "piece", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    met = dealt.select("kind", "piece", "fp", "block", F.explode(others).alias("other")).select("kind", "piece", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
    groups = met.groupBy("kind", "piece", "low", "high").agg(F.collect_list("fp").alias("members")).select("kind", "members")

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [forest(np.asarray(m, np.int64).view(np.uint64), kinds[k][1], distance) for k, m in zip(b["kind"], b["members"], strict=True)]
            one, two = (np.concatenate([np.zeros(0, np.uint64), *[f[i] for f in found]]).view(np.int64) for i in (0, 1))
            yield pd.DataFrame({"a": one, "b": two})

    return groups.mapInPandas(span, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, seed: int = 42, group: int = GROUP) -> DataFrame:
    """One row per input row: the id, fingerprint (long), component_id (the smallest id that links lead to).

    A fingerprint bit is 1 if more than half of the hashes (XXH64 of `size` words, lower-cased over A-Z, repeats
    included) have it; a shorter text is one shingle. Null, empty and blank texts have fingerprint zero and are linked like any
    other. Every link of at most `distance` bits counts, without a cap on buckets or partners. Repeated rows and ids are rows of their own,
    each with its text's fingerprint. A row without an id has the component of its fingerprint, null if no row of it has an id.
    Only id and text are read, so other columns may have any name; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [signed(fingerprint(t, size, seed)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["k", "fp"])

    read = docs.select(F.col(id_col).cast("long").alias("k"), text_or_empty(text_col).alias("text"))
    rows = materialize(read.mapInArrow(sign, "k long, fp long"), "simhash-prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("k").alias("least")), "simhash-distinct")
    found = components(materialize(links(prints.select("fp"), distance, group).distinct(), "simhash-links"))
    labelled = prints.join(found.withColumnRenamed("k", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(labelled.join(least, "label").select("fp", "component_id"), "simhash-components")
    return rows.join(named, "fp").select(F.col("k").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
