"""Line dedup: an exact set-similarity join of lines, from which later matches are removed.

Equal lines meet first, by hash, so a line that a third of all documents hold is one row afterwards. Of each
remaining line the different words are put in one order, long words first, and neighbours in that order are its
keys. Two sets of n and m words with c of them in common differ by a = n - c and b = m - c words. Among the first
a + b + 2 common words (the order ends in words that every line has) some two have none of the a + b others between
them, so they are neighbours in both sets, and come after at most 2a + b words of the first set and a + 2b of the
second. Lines of the similarity therefore share a key among the first `_reach` of each, and pairs of long words
are rare enough that few other lines share one.

The length filter, the positional filter and a filter on word signatures, all of them lossless, are conditions of
semi joins: an entry stays if any partner passes, and no row is made for each partner. What is left, a small part of
the lines, is verified by the words, in semi joins again: with one key a line first, then with all.

Everything is DataFrame work. Words are told apart by a hash of 56 bits and their lengths.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.llm.filters import bit, join_touched, maybe_in
from vitrine.llm.words import BLANKS, id_key, split_blanks, text_or_empty
from vitrine.session import materialize

#: The bitmaps that spare rows a shuffle have at least `CELLS` bits for each value they hold, up to `MOST` bits. The result does not depend on it.
CELLS, MOST = 12, 1 << 25
EPS = 1e-9
HASH = (1 << 56) - 1
#: Shares of the keys that the whole join takes one after the other; a power of two. The result does not depend on it.
SHARES = 4
#: A line's place: its document's id, a hash that tells different texts of one id apart (see `_apart`), and its number.
PLACE = ["k", "d", "no"]
FINE = ["sig0", "sig1"]
LOCAL_MAP = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def _numbered(line: Column) -> Column:
    """The different words of a line as numbers in order: of words of up to 127 bytes, whose numbers are negative, the longer first, words of one length by hash."""

    def number(word: Column) -> Column:
        length = F.octet_length(word)
        return F.xxhash64(word).bitwiseAND(HASH).bitwiseOR(F.shiftleft(F.bitwise_not(length).cast("long"), 56))

    # The empty pieces between blanks have no length.
    return F.sort_array(F.array_distinct(F.array_remove(F.transform(split_blanks(line), number), number(F.lit("")))))


def _reach(n: Column, t: float) -> Column:
    """How many of its first keys a line of n words shares one of with any line of the similarity: the most that 2a + b can be, and 1.

    It is linear in the other line's size, so the most lies at the least or the greatest size, t * n or n / t.
    """
    return (F.floor(F.greatest(n * (2 * (1 - t)), n * (1 / t - 1)) + 1e-6) + 1).cast("int")


def _least_overlap(n: Column, m: Column, t: float) -> Column:
    """The least number of common words of two sets of n and m words with Jaccard similarity t."""
    return F.ceil((n + m) * F.lit(t / (1 + t)) - EPS)


def _pieces(docs_text: DataFrame) -> DataFrame:
    """(k, d, no, line) of all lines."""
    return docs_text.select("k", "d", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit("".join(BLANKS))) != ""


def _repeats(places: DataFrame, cells: int | None) -> DataFrame:
    """The places of lines that an earlier line equals byte for byte, of (k, d, no, h)."""
    several = materialize(places.groupBy("h").agg(F.min("k").alias("low"), F.count("*").alias("c")).where("c > 1").select("h", "low"), "line-several")
    some = materialize(places.where(_maybe("h", several.select("h"), cells)).join(several, "h"), "line-some")
    # Most of them are in other documents than the first.
    near, inside = some.where("k = low"), F.struct("d", "no")
    first = near.groupBy("h").agg(F.min(inside).alias("at"), F.max(inside).alias("last")).where("at < last").select("h", "at")
    later = some.where("k > low").select(*PLACE).unionByName(near.join(first, "h").where(F.col("at") != inside).select(*PLACE))
    return materialize(later.distinct(), "line-repeats")


def _maybe(column: str | Column, known: DataFrame, cells: int | None) -> Column:
    """False only where `column` is not in `known`, whose rows say how large the bitmap is if `cells` does not."""
    cells = min(1 << max(14, (CELLS * known.count() - 1).bit_length()), MOST) if cells is None else max(cells, 64)
    return F.coalesce(maybe_in(column, known, cells), F.lit(False))


def _firsts(docs_text: DataFrame, places: DataFrame, repeats: DataFrame, t: float, cells: int | None) -> DataFrame:
    """`_sets` of the lines at those of `places` that `repeats` does not hold.

    What a bitmap of the repeats holds back is told from them by places alone. Where such a line may be, its set is
    made with the others and held against these places afterwards: no line's text is shuffled, and texts are cut once.
    """
    here = F.xxhash64(*PLACE)
    maybe = _maybe(here, repeats.select(here), cells)
    spared = materialize(places.where(maybe).select(*PLACE).join(repeats, PLACE, "left_anti"), "line-spared")
    lines = _pieces(docs_text).withColumn("maybe", maybe).where(~F.col("maybe") | _maybe(here, spared.select(here), cells))
    sets = materialize(_sets(lines, t), "line-sets")
    kept = materialize(sets.where("maybe").join(spared, PLACE, "left_semi").select(*sets.columns), "line-spared-sets")
    return sets.where("not maybe").unionByName(kept).drop("maybe")


def _sets(lines: DataFrame, t: float) -> DataFrame:
    """(id, k, d, no, maybe, n, sig, prefix) of lines with a word: an id, the number of different words, a signature, and of the words of the first keys 31 bits."""
    sets = lines.where(_has_word(F.col("line"))).select(*PLACE, "maybe", _numbered(F.col("line")).alias("words"))
    prefix = F.transform(F.slice("words", F.lit(1), _reach(F.size("words"), t) + 1), lambda word: word.bitwiseAND((1 << 31) - 1).cast("int"))
    return sets.select(F.monotonically_increasing_id().alias("id"), *PLACE, "maybe", F.size("words").alias("n"), _signature(F.col("words")).alias("sig"), prefix.alias("prefix"))


def _signature(words: Column, own: Callable[[Column], Column] | None = None) -> Column:
    """Each word, or each for which `own` is true, turns over one of 64 bits, so two lines differ by as many words as bits, at least."""
    none = F.lit(0).cast("long")
    turn = (lambda word: F.when(own(word), bit(word)).otherwise(none)) if own else bit
    return F.aggregate(words, none, lambda all_, word: all_.bitwiseXOR(turn(word)))


def _fine(words: Column) -> list[Column]:
    """The words dealt to two signatures, which tell more of them apart than one."""
    return [_signature(words, lambda word: F.shiftright(word, 6).bitwiseAND(1) == part).alias(c) for part, c in enumerate(FINE)]  # noqa: B023


def _entries(lines: DataFrame, begin: Column, end: Column) -> DataFrame:
    """A row for each of the lines' keys from number `begin` to before `end`; behind a line's last word stand 0, 1, ..., as in every line.

    `span` is the line's number of words and the key's number in one, since rows of these columns are most of what is shuffled.
    """
    word = lambda pos: F.coalesce(F.get("prefix", pos), pos - F.col("n"))
    pos = F.col("pos")
    placed = lines.where(begin < end).select("id", "n", "sig", "prefix", F.explode(F.sequence(begin, end - 1)).alias("pos"))
    span = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(pos.cast("long"))
    return placed.select("id", "sig", span.alias("span"), F.xxhash64(word(pos), word(pos + 1)).alias("key"))


def _place(side: str) -> Column:
    return F.struct(*[F.col(f"{side}.{c}") for c in PLACE])


def _size(span: str) -> Column:
    return F.shiftright(span, 32).cast("int")


def _number(span: str) -> Column:
    return F.col(span).bitwiseAND((1 << 32) - 1).cast("int")


def _passes(t: float, signatures: list[str]) -> Column:
    """Entries `one` and `two` of different lines share a key and pass the filters on sizes, positions and signatures."""
    n, m = _size("one.span"), _size("two.span")
    need = _least_overlap(n, m, t)
    return (
        (F.col("one.key") == F.col("two.key"))
        & (F.col("one.id") != F.col("two.id"))
        & (F.least(n, m) >= F.greatest(n, m) * t - EPS)
        & (functools.reduce(Column.__add__, [F.bit_count(F.col(f"one.{c}").bitwiseXOR(F.col(f"two.{c}"))) for c in signatures]) <= n + m - 2 * need)
        & (_number("one.span") <= 2 * n + m - 3 * need)
        & (_number("two.span") <= n + 2 * m - 3 * need)
    )


def _similar(words: Column, other: Column, t: float) -> Column:
    return F.size(F.array_intersect(words, other)) >= _least_overlap(F.size(words), F.size(other), t)


def _met(index: DataFrame, later: DataFrame, t: float) -> DataFrame:
    """The entries of `later` that an entry of another line in `index` meets, which passes every filter.

    Columns keep their names: where both are one table, their plans are alike and Spark writes one exchange for both.
    """
    return later.alias("two").join(index.alias("one"), _passes(t, ["sig"]), "left_semi")


def _met_before(index: DataFrame, later: DataFrame, t: float) -> DataFrame:
    """The entries of `later` that an entry of an earlier line in `index` meets, by words too where both sides have them."""
    met = _passes(t, FINE) & (_place("one") < _place("two"))
    if "words" in later.columns:
        met &= _similar(F.col("one.words"), F.col("two.words"), t)
    return later.alias("two").join(index.alias("one"), met, "left_semi")


def _leads(index: DataFrame, later: DataFrame, t: float, cells: int | None) -> DataFrame:
    """The entries of `index` that meet an entry of a later line in `later`."""
    some = index.where(_maybe("key", later.select("key"), cells))
    return some.alias("one").join(later.alias("two"), _passes(t, FINE) & (_place("one") < _place("two")), "left_semi")


def _fetch(docs_text: DataFrame, wanted: DataFrame, cells: int | None) -> DataFrame:
    """(id, k, d, no, words, fine signatures) of the wanted (id, k, d, no): texts are cut where they lie, and only lines that may be wanted are shuffled."""
    here = F.xxhash64(*PLACE)
    lines = _pieces(docs_text).where(_maybe(here, wanted.select(here), cells))
    # Rows that repeat an id and its text repeat their lines.
    words = lines.join(wanted, PLACE).select("id", *PLACE, "line").distinct().select("id", *PLACE, _numbered(F.col("line")).alias("words"))
    return materialize(words.select("*", *_fine(F.col("words"))), "line-words")


@contextlib.contextmanager
def _hashed(spark: SparkSession) -> Iterator[None]:
    """A shuffled join whose partitions have all turned out small is a hash join, without a sort of both sides; AQE measures them first."""
    before = spark.conf.get(LOCAL_MAP)
    spark.conf.set(LOCAL_MAP, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    try:
        yield
    finally:
        spark.conf.set(LOCAL_MAP, before)


def _apart(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of the text for rows whose id may stand on different texts, 0 for all others, whose lines are then narrower rows."""
    twice = materialize(docs.select(id_key(id_col).alias("k")).groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"), "line-ids")
    if twice.isEmpty():
        return F.lit(0).cast("long")
    text = F.xxhash64(text_or_empty(text_col))
    some = docs.where(maybe_in(id_key(id_col), twice)).select(id_key(id_col).alias("k"), text.alias("d"))
    several = some.groupBy("k").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high")
    return F.when(maybe_in(id_key(id_col), several.select("k")), text).otherwise(F.lit(0).cast("long"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, cells: int | None = None) -> DataFrame:
    """One row per id and text that have a line with a word: k (the id, null as the largest), d (a hash that tells the texts
    of one id apart), n_lines, n_removed, removed (line numbers from 0).

    Lines end at line feeds; their sets are of the words between blanks, unchanged. A line is removed if an
    earlier line of the input has a Jaccard similarity of `similarity` or more with it, whether or not that line is
    removed itself. Earlier is the smaller id, then the smaller hash of the text, then the smaller number. Lines without words
    are no lines here: they match nothing and stay. Rows that repeat an id and its text are one document; rows of
    one id with other texts are documents of their own, in the order of their hashes; null ids come after all others.
    `cells` is the size of the bitmaps that spare rows a shuffle; by default it follows the number of lines.
    """
    with _hashed(docs.sparkSession):
        return _removed(docs.select(id_key(id_col).alias("k"), _apart(docs, id_col, text_col).alias("d"), text_or_empty(text_col).alias("text")), similarity, cells)


def _removed(docs_text: DataFrame, t: float, cells: int | None) -> DataFrame:
    """`removed_lines` of documents (k, d, text)."""
    counted = docs_text.withColumn("n_lines", F.size(F.filter(F.split("text", "\n"), _has_word)).cast("long"))
    lines = counted.select("k", "d", "n_lines", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(_has_word(F.col("line")))
    places = materialize(lines.select(*PLACE, "n_lines", F.unhex(F.md5("line")).alias("h")), "line-places")
    repeats = _repeats(places.drop("n_lines"), cells)
    first = _firsts(docs_text, places, repeats, t, cells)

    # Keys that reach behind a line's last word, which at 0.8 only lines of one word have, then the others,
    # a share at a time: what the join shuffles is most of this step's disk, and it goes with each write.
    reach, last = _reach(F.col("n"), t), F.col("n") - 1
    short = _entries(first, last, reach)
    index = _entries(first, F.lit(0), F.least(reach, last))
    shares = [index.where(F.col("key").bitwiseAND(SHARES - 1) == share) for share in range(SHARES)]
    met = functools.reduce(DataFrame.unionByName, [materialize(_met(some, some, t), "line-met") for some in [short, *shares]])

    wanted = materialize(first.select("id", *PLACE).join(met.select("id").distinct(), "id", "left_semi"), "line-wanted")

    # From here on only lines that may be alike, with their words.
    words = _fetch(docs_text, wanted, cells)
    near = materialize(met.drop("sig").join(words.drop("words"), "id"), "line-near")
    words = words.select("id", "words")
    alike = materialize(_met_before(near, near, t), "line-alike")
    one = alike.groupBy(*[c for c in near.columns if c not in ("key", "span")])
    one = materialize(one.agg(F.min("span").alias("span"), F.min_by("key", "span").alias("key")).select(*near.columns), "line-one")
    later = words.where(_maybe("id", one.select("id"), cells))

    def verified(left: DataFrame) -> DataFrame:
        """The lines of the entries `left` that an earlier line matches."""
        left = materialize(left.join(later, "id"), "line-left")
        ahead = materialize(_leads(near, left, t, cells), "line-ahead")
        found = _met_before(ahead.join(words.where(_maybe("id", ahead.select("id"), cells)), "id"), left, t)
        return materialize(found.select("id", *PLACE).distinct(), "line-found")

    # One key for each line matches most of them, and spares their others. The rest is held against all by every key.
    led = verified(one)
    still = materialize(alike.join(led, "id", "left_anti"), "line-still")
    found = [repeats, led] if still.isEmpty() else [repeats, led, verified(still)]
    matched = functools.reduce(DataFrame.unionByName, [f.select(*PLACE) for f in found])

    out = materialize(matched.groupBy("k", "d").agg(F.sort_array(F.collect_set("no")).alias("removed")), "line-out")
    totals = places.groupBy("k", "d").agg(F.max("n_lines").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return totals.join(out, ["k", "d"], "left").select("k", "d", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, cells: int | None = None) -> DataFrame:
    """The documents, all columns and rows, their texts without the removed lines; a text of which nothing is left is empty.

    A null text stays null. See `removed_lines` for what is removed.
    """
    apart = _apart(docs, id_col, text_col)
    docs_text = docs.select(id_key(id_col).alias("k"), apart.alias("d"), text_or_empty(text_col).alias("text"))
    place = F.struct(id_key(id_col).alias("k"), apart.alias("d"))
    out = materialize(_removed(docs_text, similarity, cells).where("n_removed > 0").select(F.struct("k", "d").alias("k"), "removed"), "line-removed")
    some, others = join_touched(docs, place, out)
    joined = some.join(out.select(F.struct("k", "removed").alias("_out")), F.col("_k") == F.col("_out.k"), "left")
    gone = lambda no: F.coalesce(F.array_contains("_out.removed", no), F.lit(False))
    kept = F.array_join(F.filter(F.split(F.col(f"_row.`{text_col}`"), "\n"), lambda line, no: ~gone(no)), "\n")
    row = [F.col(f"_row.`{c}`") for c in docs.columns]
    changed = joined.select(*[kept.alias(c) if c == text_col else r for c, r in zip(docs.columns, row, strict=True)])
    return changed.union(others.select(*row))
