"""A memo's size in bytes, whatever it is asked for."""

import random
import sys

import public_tokenizers
import xxhash

from vitrine.llm import grams, memo, packing


def held(m):
    return sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (m.young, m.old))


def test_words_of_a_megabyte_are_not_kept():
    m = memo.Memo(xxhash.xxh64_digest, 1 << 20)
    rng = random.Random(1)
    for i in range(50):
        words = [bytes([97 + i % 26]) * (1 << 20), *[str(rng.random()).encode() for _ in range(200)]]
        assert m.many(words) == [xxhash.xxh64_digest(w) for w in words]
        assert m.one(b"x" * (1 << 20)) == xxhash.xxh64_digest(b"x" * (1 << 20))
    assert held(m) < 3 << 20
    assert max(len(k) for d in (m.young, m.old) for k in d) <= 64


def test_a_memo_turns_over_and_keeps_what_is_asked_for(monkeypatch):
    made = []
    m = memo.Memo(lambda k: made.append(k) or k[::-1], 20_000)
    for i in range(3000):
        key = str(i).encode()
        assert m.many([b"often", key]) == [b"netfo", key[::-1]]
    assert held(m) < 60_000
    assert made.count(b"often") == 1


def test_the_packing_tokenizer_stays_in_its_bound(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 1 << 20)
    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for _ in range(30):
        w.encode(" ".join(f"w{rng.random()}" for _ in range(300)) + " " + "z" * 100_000)
    assert held(w.words) < 3 << 20


def test_hashes_are_those_of_the_words():
    words = [b"a", b"", b"b" * 5000, b"a"]
    assert grams.word_hashes(words).tolist() == [xxhash.xxh64_intdigest(x) for x in words]


def test_known_words_are_looked_up_once():
    class Counted(str):
        looked = 0

        def __hash__(self):
            Counted.looked += 1
            return super().__hash__()

    m = memo.Memo(str.upper)
    words = [Counted(w) for w in ("a", "b", "a", "c")]
    assert m.many(words) == ["A", "B", "A", "C"] and len(m.young) == 3
    Counted.looked = 0
    assert m.many(words) == ["A", "B", "A", "C"]
    assert Counted.looked == len(words)


def test_a_word_and_the_sign_behind_it_are_cut_without_a_pattern(monkeypatch):
    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words = ["Then,", "then", "THEN.", "a1", "A~", "x'", "-", "7", "don't", "we'll,", "né,", "a\x01", "\x7f", "a\x7f", "(so)", "'s", "s'", "Re's"]
    want = [w.tokenizer.encode(x, add_special_tokens=False).ids for x in words]
    assert [w.encode(x).tolist() for x in words] == want
    cut = []
    monkeypatch.setattr(packing, "SHOWN_SPLIT", type("Pattern", (), {"findall": staticmethod(lambda word: cut.append(word) or [word])}))
    again = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert [again.encode(x).tolist() for x in words[:6]] == want[:6] and not [x for x in cut if len(x) > 1]
