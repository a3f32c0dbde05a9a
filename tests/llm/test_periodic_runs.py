"""Periodic runs against the comparison of every word with the one a period later."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tests.llm import brute
from vitrine.llm import periodic_runs as pr, queries


def plain_runs(w, min_length=24, exponent=3):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, exponent * q):
                part = w[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_with_periods(rng):
    w = []
    for _ in range(rng.randint(1, 5)):
        p = [f"w{rng.randrange(rng.choice([2, 4, 40]))}" for _ in range(rng.randint(1, 20))]
        w += (p * rng.randint(1, 8))[: rng.randint(1, 120)]
    return w


@pytest.mark.parametrize(("min_length", "exponent"), [(24, 3), (6, 3), (4, 2)])
def test_runs_equal_brute_force(min_length, exponent):
    rng = random.Random(min_length)
    for _ in range(400):
        w = words_with_periods(rng)
        assert [tuple(r) for r in pr.runs_of([x.encode() for x in w], min_length, exponent).tolist()] == plain_runs(w, min_length, exponent)


def test_trees_give_suffix_order_and_common_extensions():
    rng = random.Random(3)
    for _ in range(100):
        w = [rng.randint(1, 3) for _ in range(rng.randint(1, 70))]
        tree = pr.SuffixTree(w)
        n = len(w)
        assert sorted(range(n), key=lambda i: w[i:]) == sorted(range(n), key=tree.ranks(False).__getitem__)
        assert sorted(range(n), key=lambda i: [-x for x in w[i:]]) == sorted(range(n), key=tree.ranks(True).__getitem__)
        one, two = zip(*[(i, j) for i in range(n + 1) for j in range(n + 1) if i != j], strict=True)
        common = [next((d for d in range(n) if max(i, j) + d >= n or w[i + d] != w[j + d]), 0) for i, j in zip(one, two, strict=True)]
        assert pr.Extensions(tree).of(pr.np.array(one), pr.np.array(two)).tolist() == common


def test_rows_of_every_kind(documents):
    rng = random.Random(8)
    rows = brute.corpus(8) + [(2000 + i, " \n".join(words_with_periods(rng))) for i in range(40)]
    rows += [(5, "tick tock " * 20), (5, "tick tock " * 20), (None, "a " * 24), (3000, "a " * 23), (3001, "É é " * 12)]
    want = []
    for k, text in rows:
        w = brute.words(text)
        runs = plain_runs(w)
        want.append((k, len(w), runs, plain_collapse(w, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_very_long_texts_and_empty_tables(documents):
    rows = [(1, "ab " * 200_000 + "cd"), (2, " ".join(f"w{i}" for i in range(500_000))), (3, "y" * 3_000_000), (4, " ".join(f"w{i % 30_000}" for i in range(100_000)))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in pr.periodic_runs(documents(rows)).collect()}
    assert got == {1: [(0, 200_000, 1)], 2: [], 3: [], 4: [(0, 100_000, 30_000)]}
    assert pr.periodic_runs(documents(rows).where("doc_id = 9")).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        pr.periodic_runs(documents(rows), exponent=1)


def test_registered_query_equals_brute_force(shared):
    sf = "/root/testdata/sf0.001"
    want = []
    for k, text in shared.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w, h = brute.words(text), zlib.crc32(str(k).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        exponent = 1000 * best[1] // best[2] if runs else None
        want.append((k, len(runs), *best, exponent, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(plain_collapse(w, runs))))
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](shared, sf).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[1] for r in got)
