"""Exact, line and substring dedup against brute force, over corpora with every hard case."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vitrine.llm import exact_dedup, line_dedup, substring_dedup
from vitrine.llm.words import LAST_ID


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda c: F.substring(F.unhex(F.md5(c)), 1, 0), lambda c: F.unhex(F.substring(F.md5(c), 1, 2))], ids=["md5", "one value", "a byte"])
def test_exact_groups_whatever_the_hash_does(documents, digest):
    rows = brute.corpus(1)
    got = [tuple(r) for r in exact_dedup.exact_groups(documents(rows), digest=digest).collect()]
    assert sorted(got, key=str) == sorted(brute.exact(rows), key=str)


def test_exact_prefers_the_longest_text(documents):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(documents([(1, "a b"), (2, "a  b"), (3, "ab"), (4, "é"), (5, " é")])).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (2, 3, False), 4: (5, 2, False), 5: (5, 2, True)}


def text_ranks(spark, rows):
    """The hash that orders different texts of one id."""
    texts = spark.createDataFrame([(t or "",) for _, t in rows], "text string").distinct()
    return {r.text: r.d for r in texts.select("text", F.xxhash64("text").alias("d")).collect()}


@pytest.mark.parametrize("cells", [1, 1 << 10])
def test_lines_equal_brute_force(documents, shared, cells):
    rows = brute.corpus(2)
    rows += [(7, "keep me please now\n" + (rows[20][1] or "x y")), (7, "another text of id 7\nkeep me please"), (None, "a b c d\nuniq one two three"), (None, "other words here now\na b c d"), (1, "a b c d")]
    ranks = text_ranks(shared, rows)
    several = {k for k, t in rows if any(k == i and (t or "") != (x or "") for i, x in rows)}
    want = {(LAST_ID if k is None else k, ranks[t or ""] if k in several else 0): v for (k, t), v in brute.later_lines(rows, lambda t: ranks[t or ""]).items()}
    got = {(r.k, r.d): (r.n_lines, r.removed) for r in line_dedup.removed_lines(documents(rows), cells=cells).collect()}
    assert got == want


def test_rows_without_an_id_and_rows_of_one_id_lose_only_repeated_lines(documents):
    rows = [(None, "a b c d\nuniq one two three"), (None, "other words here now\na b c d"), (1, "a b c d"), (7, "keep me please now\nx"), (7, "a b c d\nlast words stay here")]
    got = sorted(r.text for r in line_dedup.line_dedup(documents(rows)).collect())
    assert got == sorted(["uniq one two three", "other words here now", "a b c d", "keep me please now\nx", "last words stay here"])


def test_line_filters_lose_no_match_at_the_border(documents):
    base = [f"t{i}" for i in range(9)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:8], "x"])), (3, " ".join([*base[:7], "y", "z"])), (4, " ".join(base[:8])), (5, "a b c d"), (6, "a b c d e"), (7, "a b c"), (8, "e d c b a")]
    got = {r.k: r.n_removed for r in line_dedup.removed_lines(documents(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 1}


def test_line_dedup_returns_whole_rows(documents):
    rows = [(1, "a b c d\n\nkeep this"), (2, "x\na b c d\n"), (3, None), (4, "a b c d")]
    got = {r.doc_id: (r.text, r.k, r.keep_id) for r in line_dedup.line_dedup(documents(rows)).collect()}
    assert got == {1: ("a b c d\n\nkeep this", "x", 1), 2: ("x\n", "x", 1), 3: (None, "x", 1), 4: ("", "x", 1)}


@pytest.mark.parametrize(("seed", "window"), [(3, 20), (4, 20), (5, 12)])
def test_substrings_equal_brute_force(documents, seed, window):
    rows = brute.corpus(seed)
    want = []
    for k, w, covered in brute.repeats(rows, window):
        kept = " ".join(x for x, out in zip(w, covered, strict=True) if not out)
        want.append((k, len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.repeated_spans(documents(rows), window=window)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha.hex()) for r in got.collect()], key=str) == sorted(want, key=str)


def test_substring_dedup_cuts_texts(documents):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"one {passage} two"), (2, f"three\n{passage}\nfour"), (3, passage), (4, None), (5, "")]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: "three\nfour", 3: "", 4: None, 5: ""}


def test_overlapping_and_periodic_passages():
    w = [b"a", b"b"] * 30
    covered = substring_dedup.repeated_in(w, 20)
    assert covered.tolist() == [False] * 2 + [True] * 58
    machine = substring_dedup.Automaton([(1, " ".join(f"q{i}" for i in range(50)))], 20)
    text = [b"x", *[f"q{i}".encode() for i in range(15, 40)], b"y"]
    assert machine.cover(2, text).tolist() == [False, *[True] * 25, False]
    assert not machine.cover(1, text).any()


def test_empty_tables(documents):
    none = documents([(1, "x")]).where("doc_id = 2")
    assert exact_dedup.exact_groups(none).count() == 0
    assert line_dedup.removed_lines(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.repeated_spans(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0


def test_the_whole_join_of_lines_takes_every_key_once(documents, monkeypatch):
    taken, made, real, entries = [], [], line_dedup._met, line_dedup._entries
    monkeypatch.setattr(line_dedup, "_entries", lambda *a: made.append(entries(*a)) or made[-1])
    monkeypatch.setattr(line_dedup, "_met", lambda index, later, t: taken.append(index) or real(index, later, t))
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(rng.sample("abcdefghijkl", 6)) for _ in range(2))) for i in range(12)]
    line_dedup.removed_lines(documents(rows))
    keys = lambda table: {r.key for r in table.select("key").distinct().collect()}
    shares, whole = [keys(x) for x in taken[1 : 1 + line_dedup.SHARES]], keys(made[1])
    assert len(shares) == line_dedup.SHARES > 1 and max(map(len, shares)) < len(whole)
    assert set().union(*shares) == whole and sum(map(len, shares)) == len(whole)


def test_line_dedup_runs_no_python_on_the_executors(documents, monkeypatch):
    written, real = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    out = line_dedup.line_dedup(documents([(1, "a b c d\nkeep this"), (2, "x y z\na b c d"), (3, "a b c d e")]))
    plans = "\n".join([*written, out._jdf.queryExecution().executedPlan().toString()])
    assert written and not any(word in plans for word in ("Python", "Pandas", "MapInArrow"))



def test_line_texts_are_cut_once_into_sets_and_words_go_only_to_lines_to_verify(documents, monkeypatch):
    plans, made, real = {}, {}, line_dedup.materialize

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(line_dedup, "materialize", seen)
    rows = [(i, f"a b c d e f g h i{i % 3}\nown{i} words{i} of{i} this{i} line{i}") for i in range(30)]
    got = {r.k: r.removed for r in line_dedup.removed_lines(documents(rows), cells=1 << 10).collect()}
    assert got == {k: v[1] for (k, _), v in brute.later_lines(rows, lambda t: 0).items()}
    assert "hashpartitioning" not in plans["line-sets"] and plans["line-sets"].count("Scan ExistingRDD") == 1
    one = made["line-one"].collect()
    assert len({r.id for r in one}) == len(one) == made["line-left"].count() == 2


def test_refused_lines_of_a_family_make_no_row_for_each_pair(documents, monkeypatch):
    rng = random.Random(9)
    base = [f"word{i}" for i in range(20)]
    rows = [(i, " ".join([w for w in base if rng.random() > 0.1] + [f"own{i}x{j}" for j in range(rng.randint(0, 2))])) for i in range(120)]
    made, real = {}, line_dedup.materialize

    def counted(df, name):
        table = real(df, name)
        made[name] = max(made.get(name, 0), table.count())
        return table

    monkeypatch.setattr(line_dedup, "materialize", counted)
    got = {r.k: r.removed for r in line_dedup.removed_lines(documents(rows)).collect()}
    assert got == {k: v[1] for (k, _), v in brute.later_lines(rows, lambda t: 0).items()}
    keys = max(len(t.split()) for _, t in rows)
    assert max(made.values()) <= keys * len(rows)


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.65, 0.8, 0.95, 1.0])
def test_lines_of_any_similarity_share_a_key(documents, similarity):
    rng = random.Random(10)
    letters = "abcdefghijklmnop"
    rows = [(i, "\n".join(" ".join(rng.sample(letters[: rng.randint(2, 16)] + "xyz", rng.randint(1, 5))) for _ in range(4))) for i in range(30)]
    rows += [(i, " ".join(rng.sample(letters, rng.randint(12, 16)))) for i in range(30, 60)]
    got = {r.k: r.removed for r in line_dedup.removed_lines(documents(rows), similarity=similarity).collect()}
    assert got == {k: v[1] for (k, _), v in brute.later_lines(rows, lambda t: 0, similarity).items()}
