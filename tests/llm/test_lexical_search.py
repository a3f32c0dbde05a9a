"""Ranked search against the formula, item by item and document by document."""

import math
import random
import re

import pytest

from tests.llm import brute
from vitrine.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain_search(rows, items, k=10):
    texts = [(d, plain_terms(t)) for d, t in rows]
    texts = [(d, ts) for d, ts in texts if ts]
    n, total, df = len(texts), sum(len(ts) for _, ts in texts), {}
    for _, ts in texts:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(plain_terms(text))
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, ts in texts:
            m = 10 + 90 * len(ts) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in terms if t in ts)
            if score > 0:
                scores.append((-score, brute.order(d), d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return out


def searched(docs, items, **settings):
    return sorted([tuple(r) for r in ls.ranked_search(docs, items, **settings).collect()], key=str)


@pytest.mark.parametrize("settings", [{}, {"k": 3, "shard_docs": 7, "owners": (0.05, 0.3), "items_per_block": 4}, {"k": 1, "shard_docs": 1, "owners": ()}], ids=["usual", "many shards and blocks", "a document a shard"])
def test_search_equals_the_formula(documents, shared, settings):
    rng = random.Random(12)
    rows = [*brute.corpus(12), (400, "Ünï-code_x 7½ a.b"), (400, "another row of id 400"), (401, "w1 " * 500), (402, "only. here!")]
    items = [(i, brute.prose(rng, rng.randint(1, 25), 300)) for i in range(12)]
    items += [(3, "w1 w2 again and"), (3, "w1 w2 again and"), (50, None), (51, " .,- "), (52, "nowhereatall"), (53, "ünï Ünï 7½ A"), (54, "ONLY here"), (None, "w5 w7")]
    table = shared.createDataFrame([(i, t, "x", "y", None) for i, t in items], "item_id long, text string, shard string, term string, doc_id long")
    got = searched(documents(rows), table, **settings)
    assert got == sorted(plain_search(rows, items, settings.get("k", 10)), key=str)


def test_equal_scores_come_by_id(documents, shared):
    rows = [(k, "same words here") for k in (30, 4, 17, 9)] + [(None, "same words here")] + [(k, f"other {k}") for k in range(100, 112)]
    table = shared.createDataFrame([(1, "words")], "item_id int, text string")
    got = ls.ranked_search(documents(rows), table, k=3, shard_docs=2).orderBy("rank")
    assert [(r.item_id, r.rank, r.doc_id) for r in got.collect()] == [(1, 1, 4), (1, 2, 9), (1, 3, 17)]
    assert got.schema["item_id"].dataType.simpleString() == "int"
    got = ls.ranked_search(documents(rows), table, k=9, shard_docs=2)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [4, 9, 17, 30, None]


def test_very_long_texts_and_empty_tables(documents, shared):
    rows = [(1, "needle " + "hay " * 700_000), (2, "needle in a " + "z" * 2_000_000), (3, " ".join(f"t{i}" for i in range(200_000)))] + [(k, "nothing") for k in range(10, 20)]
    items = [(1, "needle hay"), (2, "t199999 " * 100_000), (3, "z" * 2_000_000)]
    docs, table = documents(rows), shared.createDataFrame(items, "item_id long, text string")
    assert searched(docs, table) == sorted(plain_search(rows[:1] + rows[1:], items), key=str)
    assert searched(docs.where("doc_id = 99"), table) == []
    assert searched(docs, table.where("item_id = 99")) == []


def test_remembered_terms_are_bounded_in_bytes(documents, shared, monkeypatch):
    monkeypatch.setattr(ls, "MEMO_BYTES", 2000)
    monkeypatch.setattr(ls, "SHARD_POSTINGS", 50)
    rows, items = brute.corpus(13, 40), [(1, "w1 w2 w3 again"), (2, "changed and")]
    table = shared.createDataFrame(items, "item_id long, text string")
    texts = documents(rows).select("doc_id", "text").na.fill("")
    _, roster = ls.index(texts, table.selectExpr("explode(split(text, ' ')) AS term"))
    assert roster.count() > 3
    assert searched(documents(rows), table) == sorted(plain_search(rows, items), key=str)
