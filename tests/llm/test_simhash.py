"""SimHash near-dedup against every pair of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from tests.llm import brute
from vitrine.llm import queries, simhash


def plain_print(text, size=3):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in brute.words(text)]
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=3):
    """(id, fingerprint, component) of every row, by all pairs."""
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), brute.order(k))
    return [(k, prints[i], None if least[root(i)][0] else least[root(i)][1]) for i, (k, _) in enumerate(rows)]


def rows_of(df):
    return sorted([(r[0], r[1] & (1 << 64) - 1, r[2]) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed", [11, 12])
def test_groups_equal_all_pairs(documents, seed):
    rows = brute.corpus(seed, 120)
    rng = random.Random(seed)
    long = brute.prose(rng, 300, 5000).split()
    for k in range(200, 260):
        edited = list(long)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = f"E{k}"
        rows.append((k, " ".join(edited)))
    rows += [(7, "another text under an id that exists"), (300, None), (301, "one"), (302, "ONE"), (303, "é É"), (304, "É é")]
    assert rows_of(simhash.simhash_groups(documents(rows))) == sorted(plain_components(rows), key=str)


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_every_linked_pair_shares_a_key_and_passes_its_chain(distance):
    rng = random.Random(distance)
    kinds = simhash.chains(distance)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, distance)):
            y ^= 1 << b
        met = [len(simhash.forest(np.array([x, y], np.uint64), steps, distance)[0]) for bits, steps in kinds if x & bits == y & bits]
        assert x == y or any(met)


def test_small_groups_split_a_dense_bucket(shared):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = list({b ^ sum(1 << rng.randrange(12) for _ in range(rng.randint(0, 6))) for b in base for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    df = shared.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    label = {p: p for p in prints}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    def parts(links):
        for p in prints:
            label[p] = p
        for a, b in links:
            label[root(a)] = root(b)
        return sorted(sorted(x for x in prints if root(x) == r) for r in {root(p) for p in prints})

    want = parts([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    top = (1 << 64) - 1
    got = [(r.a & top, r.b & top) for r in simhash.links(df, 3, group=40).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert parts(got) == want


def test_very_long_texts_and_empty_tables(documents):
    text = " ".join(f"w{i % 1000} Z{i}" for i in range(300_000))  # 4 MB
    rows = [(1, text), (2, text + " end"), (3, "x" * 2_000_000)]
    assert rows_of(simhash.simhash_groups(documents(rows))) == sorted(plain_components(rows), key=str)
    assert simhash.simhash_groups(documents(rows).where("doc_id = 9")).count() == 0


def test_registered_query_equals_all_pairs(shared):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in shared.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((k, f"{p:016x}", c) for k, p, c in plain_components(rows))
    assert sorted(tuple(r) for r in queries.QUERIES["op11_simhash_pigeonring"](shared, sf).collect()) == want
