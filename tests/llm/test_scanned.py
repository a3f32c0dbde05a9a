"""Hashes of the words of a buffer."""

import random

import numpy as np
from hypothesis import given, strategies as st

from vitrine.llm import scanned


@given(st.binary(max_size=300))
def test_words_are_those_of_split(text):
    starts, h = scanned.scan(text)
    words = text.split()
    assert [text[s : s + len(w)] for s, w in zip(starts, words, strict=True)] == words
    assert h.tolist() == [scanned.scan(w)[1][0] for w in words]
    assert len(set(h.tolist())) == len(set(words))


def test_hashes_do_not_depend_on_the_place():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdefgh\xc3\xa9", k=rng.choice([1, 2, 5, 9, 63, 64, 65, 400]))) for _ in range(30_000)] + [b"x" * (scanned.CHUNK + 5), b"y", b"x" * (scanned.CHUNK + 6), b"z" * scanned.CHUNK]
    rng.shuffle(words)
    text = b" \n".join(words)
    assert len(text) > 2 * scanned.CHUNK
    starts, h = scanned.scan(text)
    assert len(h) == len(words)
    alone = {w: scanned.scan(w)[1][0] for w in set(words)}
    assert np.array_equal(h, np.array([alone[w] for w in words], np.uint64))
    assert len(set(alone.values())) == len(alone)


def test_nothing_and_blanks():
    for text in (b"", b" \t\n\x0b\x0c\r "):
        starts, h = scanned.scan(text)
        assert len(starts) == len(h) == 0


def test_buffers_hold_all_texts():
    texts = ["a" * 10, "é" * scanned.BUFFER, "", "b"]
    assert [x.decode() for held in scanned.buffers(texts) for x in held] == texts
    assert list(scanned.buffers([])) == []


def test_shingles_of_a_buffer_are_those_of_its_texts():
    from vitrine.llm import near_dedup

    rng = random.Random(4)
    texts = ["", " ", "one", "a b c d", "a b c d e"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for text, (codes, counts) in zip(texts, near_dedup.shingles_of(texts, 5), strict=True):
        words = text.split()
        runs = [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0))]
        alone = near_dedup.shingles(text, 5)
        assert codes.tolist() == alone[0].tolist() and counts.tolist() == alone[1].tolist()
        assert len(codes) == len(set(runs)) and sorted(counts.tolist()) == sorted(runs.count(r) for r in set(runs))


def test_words_of_a_buffer_are_those_of_its_texts(monkeypatch):
    from vitrine.llm import substring_dedup
    from vitrine.llm.grams import minimizers, run_hashes

    calls = []
    monkeypatch.setattr(substring_dedup, "scan", lambda text: calls.append(text) or scanned.scan(text))
    rng = random.Random(5)
    texts = ["", " ", "é", " a  b\r\nc ", "a b\xa0c\x1cd"] + ["".join(rng.choice(["a", "bé", " ", "\n", "\t "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    found = list(substring_dedup.worded(texts, lambda h: substring_dedup._anchors(h, 6, 3)))
    assert len(calls) == 1
    for text, (joined, begins, first, last, runs, at) in zip(texts, found, strict=True):
        words = text.encode().split()
        assert joined == b" ".join(words)
        assert [joined[i:].split(b" ", 1)[0] for i in begins] == words and last - first == len(words)
        alone = run_hashes(scanned.scan(joined)[1], 3)
        assert runs[first : max(first, last - 2)].tolist() == alone.tolist()
        assert (at[first : max(first, last - 5)] - first).tolist() == minimizers(alone, 4).tolist()
