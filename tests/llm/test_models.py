"""Tokenizers, packing, classifiers, near copies, preferences and licences against plain versions."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from vitrine.llm import byte_bpe, license_scan, near_dedup, packing, preference, quality_rules, weak_labels
from vitrine.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "  a", "a  b\n\n c\t", "\x85\xa0　x", "\x1c\x1dy", "don't I'LL we've", "x" * 5000, "日本語テキスト", "é́ é ﬁ", "12½ 3²", "a\x0bb\x0cc \r\n", "<|endoftext|>", "\U0001f600\U0001f600 ok", "Σίσυφος ΣΑΣ", " line "]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(documents, reference):
    rows = [*brute.corpus(7), *[(5000 + i, t) for i, t in enumerate(HARD)]]
    args = RANKS, public_tokenizers.PATTERN
    both = byte_bpe.decode(byte_bpe.encode(documents(rows), *args), *args).collect()
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in both), key=str)
    want = sorted(((k, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in rows), key=str)
    assert got == want


def test_perfect_hash_is_minimal():
    keys = byte_bpe.read_ranks(RANKS)
    p = byte_bpe.PerfectHash(keys)
    assert None not in p.slot_key and len(p.slot_key) == len(keys)
    assert all(p.get(k) == v for k, v in keys.items())
    assert p.get(b"surely not in there") is None


def test_memo_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    c = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for t in ("one two three four five", "six one two", "seven"):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == reference.encode_ordinary(t)


def test_word_tokenizer_equals_the_library(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 5000)
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    w = packing.WordTokenizer(WORDS)
    for text in [*HARD, *[x or "" for _, x in brute.corpus(8)]]:
        assert w.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packing_reads_added_tokens_as_the_library_does(documents):
    t = Tokenizer.from_file(WORDS)
    texts = ["a <|endoftext|> b", "<|startoftext|>a", "x<|endoftext|>y  é", "日本<|endoftext|> ok", "A <|ENDOFTEXT|> b", "<|endoftext", *HARD]
    w = packing.tokenizer(WORDS)
    for text in texts:
        assert w.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text
    got = packing.pack(documents([(1, texts[0])]), WORDS).orderBy("start").collect()
    assert [i for p in got for i in p.ids][:3] == [320, 49407, 321]


@pytest.mark.parametrize(("window", "space", "merge"), [(64, 2, 3), (4096, 32, 2048)])
def test_packing_places_every_id_once(documents, monkeypatch, window, space, merge):
    monkeypatch.setattr(packing, "MERGE", merge)
    rows = [r for r in brute.corpus(9) if r[0] is not None]
    pieces = packing.pack(documents(rows), WORDS, window=window, space=space).collect()
    t = Tokenizer.from_file(WORDS)
    want = {}
    for k, text in rows:
        want.setdefault(k, []).append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for k, found in by_doc.items():
        found.sort(key=lambda p: p.start)
        assert sum(p.length for p in found) == sum(map(len, want[k]))
        if len(want[k]) == 1:
            assert [i for p in found for i in p.ids] == want[k][0]
            assert [p.start for p in found] == [sum(q.length for q in found[:i]) for i in range(len(found))]
    for found in by_sequence.values():
        found.sort(key=lambda p: p.offset)
        assert [p.offset for p in found] == [sum(q.length for q in found[:i]) for i in range(len(found))]
        total = sum(p.length for p in found)
        assert total == window or total & (total - 1) == 0 and total < window
    assert packing.pack(documents(rows).where("doc_id < -1"), WORDS).count() == 0


def test_figures_equal_plain_counts():
    for _, text in [*brute.corpus(11), *enumerate(HARD)]:
        text = text or ""
        w = brute.words(text)
        lines = [x for x in text.split("\n") if brute.words(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g in grams if grams.count(g) > 1}
        covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert quality_rules.figures(text) == want, text


def test_quality_rules_score_by_the_counts(documents):
    good = [(k, brute.prose(random.Random(k), 80)) for k in range(30)]
    bad = [(100 + k, brute.prose(random.Random(k), 80).replace(" ", "*** ")) for k in range(10)]
    rows = [*good, *bad, (200, None), (201, "a b"), (202, "a b c " * 40)]
    docs = documents(rows)
    trusted = docs.where("doc_id < 15").select("doc_id")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, trusted, cells=1 << 10).collect()}
    counts = {True: np.zeros(1 << 10, np.int64), False: np.zeros(1 << 10, np.int64)}
    for k, t in rows:
        counts[k < 15] += quality_rules.cells_of(t or "", 3, 1 << 10)
    ratios = quality_rules.log_ratios(counts)
    for k, t in rows:
        g = quality_rules.cells_of(t or "", 3, 1 << 10)
        assert got[k].score == pytest.approx(float(g @ ratios) / max(1, g.sum()), abs=1e-9)
        assert got[k].base_failed == (k >= 200) and got[k].kept == (k < 100)
    assert not any(r.score for r in quality_rules.quality_rules(docs, trusted.where("doc_id < 0"), cells=1 << 10).collect())


def test_label_model_finds_the_liar():
    rng = random.Random(5)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.7
        votes = "".join(("+" if good == (rng.random() < a) else "-") for a in (0.95, 0.9, 0.85, 0.5))
        counts[votes] = counts.get(votes, 0) + 1
    m = weak_labels.fit_labels(list(counts), list(counts.values()), 4)
    assert m.prior == pytest.approx(0.7, abs=0.05)
    assert m.accuracies() == pytest.approx([0.95, 0.9, 0.85, 0.5], abs=0.06)
    assert m.posterior(["++++", "---+"]) == pytest.approx([1, 0], abs=0.05)


def test_classifier_on_held_out_labels(shared):
    docs, labels = (shared.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_labels.classify(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.9


def test_classifier_without_evidence(documents):
    docs = documents([(1, None), (2, ""), (3, "a"), (3, "a")])
    assert {(r.doc_id, r.kept) for r in weak_labels.classify(docs).collect()} == {(1, True), (2, True), (3, True)}
    assert weak_labels.keep_good(docs).count() == 4 and weak_labels.keep_good(docs).columns == docs.columns
    assert weak_labels.classify(docs.where("doc_id > 9")).count() == 0


def test_near_groups_equal_brute_force(documents):
    rng = random.Random(3)
    rows = [(None, "lone words"), (900, None), (901, ""), (902, "  "), (903, "two words"), (904, "two words")]
    for base in range(12):
        words = [f"b{base}w{rng.randrange(90)}" for _ in range(120)]
        for copy in range(8):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 20])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((base * 10 + copy, " ".join(w)))
    found = {r.doc_id: r for r in near_dedup.near_groups(documents(rows), cells=1 << 12).collect()}
    df = np.zeros(1 << 12, np.int64)
    known = [(k, t or "") for k, t in rows if k is not None]
    for _, t in rows:
        df += np.bincount(near_dedup.cell_of(near_dedup.shingles(t or "", 5)[0], 1 << 12), minlength=1 << 12)
    weights = near_dedup.cell_weights(df, len(rows) - 1 + 1)
    label = {k: k for k, _ in known}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    vectors = {k: near_dedup.weigh(t, 5, weights) for k, t in known}
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if s == t or len(vectors[a][0]) and len(vectors[b][0]) and near_dedup.weighted_jaccard(vectors[a], vectors[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    assert {k: found[k].class_id for k, _ in known} == {k: root(k) for k, _ in known}
    assert found[None].class_id is None and found[None].kept
    kept = near_dedup.near_dedup(documents(rows), cells=1 << 12)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _ in rows if k is None or root(k) == k), key=str)
    assert near_dedup.near_groups(documents(rows).where("doc_id < -1")).count() == 0


def test_copies_in_a_hot_group_find_each_other(documents):
    rng = random.Random(5)
    base = [f"h{i}" for i in range(200)]
    rows = [(1000 + k, " ".join(f"o{k}w{i}" for i in range(60))) for k in range(200)]
    for copy in range(100):
        w = list(base)
        w[rng.randrange(10, 90)] = f"e{copy}"
        w[rng.randrange(110, 190)] = f"f{copy}"
        rows.append((copy, " ".join(w)))
    # Any two of the copies have a plain Jaccard similarity of 0.8 or more.
    found = {r.doc_id: r.class_id for r in near_dedup.near_groups(documents(rows)).collect()}
    assert found == {k: 0 if k < 100 else k for k, _ in rows}


def test_marks_part_no_linked_pair(documents):
    """Light and heavy edits of one text, and an id on two of them: what is settled without a pair equals all pairs."""
    rng = random.Random(11)
    base = [f"m{i}" for i in range(64)]
    rows = [(5000, " ".join(f"z{i}" for i in range(30)))]
    for copy in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((copy, " ".join(w)))
    rows.append((5000, " ".join([*base[:40], "alone", *base[40:]])))
    found = {r.doc_id: r.class_id for r in near_dedup.near_groups(documents(rows), bands=40, rows=2, cells=1 << 12).collect()}
    df = sum(np.bincount(near_dedup.cell_of(near_dedup.shingles(t, 5)[0], 1 << 12), minlength=1 << 12) for _, t in rows)
    weights = near_dedup.cell_weights(df, len(rows))
    vectors = [near_dedup.weigh(t, 5, weights) for _, t in rows]
    label = {k: k for k, _ in rows}
    for _ in rows:
        for i, (a, _) in enumerate(rows):
            for j in range(i):
                b = rows[j][0]
                if label[a] != label[b] and near_dedup.linked(vectors[i], vectors[j], 0.8):
                    label[a] = label[b] = min(label[a], label[b])
    assert found == label and len(set(label.values())) > 3


def test_sampling_agrees_with_the_similarity():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = rng.random(len(codes)) + 0.1, rng.random(len(codes)) + 0.1
    s = near_dedup.Sampler(2000, 1)
    same = np.mean(s.bands_of(codes, a) == s.bands_of(codes, b))
    assert same == pytest.approx(near_dedup.weighted_jaccard((codes, a), (codes, b)), abs=0.05)


def test_components(shared):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.k: r.label for r in components(shared.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_preferences(shared):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "b"),
        (3, "chosen", 0, "user", "same"), (3, "rejected", 0, "user", "same"),
        (4, "chosen", None, None, None), (4, "chosen", 1, "assistant", "x"), (4, "chosen", 1, "assistant", "x"),
        (None, "chosen", 0, "user", "lost"), (5, "other", 0, "user", "lost"),
    ]
    df = shared.createDataFrame([(*t, "extra") for t in turns], "pair_id long, side string, turn int, role string, text string, prompt string")
    got = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert (one.n_prompt_turns, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert one.chosen == "<|assistant|>\nyes<|end|>\n" and [one.chosen[a:b] for a, b in zip(one.chosen_mask[::2], one.chosen_mask[1::2], strict=True)] == ["yes<|end|>\n"]
    assert one.rejected == "<|assistant|>\nno<|end|>\n"
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].chosen_mask, got[2].rejected) == (0, "", [], "<|user|>\nb<|end|>\n")
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected) == (1, "", "")
    assert got[4].prompt == "" and got[4].rejected == "" and got[4].chosen == "<|unknown|>\n<|end|>\n<|assistant|>\nx<|end|>\n"
    assert preference.format_preferences(df.where("pair_id > 9")).count() == 0


def test_licences(documents):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the\nrights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    rows = [(1, mit), (2, "x\nLicensed under CC BY-NC 4.0.\ny"), (3, "  # RELEASED under the   MIT license\nAll rights reserved. Bye"), (4, None), (5, ""), (6, "The MIT License"), (7, mit.replace("The above", "Stop. The above"))]
    got = {r.doc_id: (r.licence, r.licences, r.n_rules) for r in license_scan.license_scan(documents(rows)).collect()}
    assert got == {1: ("mit", "mit", 1), 2: ("cc-by-nc-4.0", "cc-by-nc-4.0", 1), 3: ("mit", "mit,all-rights-reserved", 2), 4: (None, "", 0), 5: (None, "", 0), 6: (None, "", 0), 7: (None, "", 0)}
    assert license_scan.license_scan(documents(rows).where("doc_id > 9")).count() == 0



def test_texts_without_a_word_of_a_known_sentence_are_not_cut(documents, monkeypatch):
    known = [license_scan.plain(s) for s in license_scan.SENTENCES]
    words = license_scan.anchors(known)
    assert all(any(w in s.split(" ") for w in words) for s in known) and len(words) < len(known) / 2
    hidden = ["ALL RIGHTS RESERVED.", "all rights re\rserved.", "all\nrights\nreserved.", "All rights re\u017ferved.", "Licen\u212aed", "Licensed under the MIT Licen\rse.", "(all)rights--reserved!\nbye", "a. b"]
    rows = [*enumerate(hidden), (98, None), (99, "plain words. " * 50)]
    scan = lambda: sorted(tuple(r) for r in license_scan.license_scan(documents(rows)).collect())
    got = scan()
    monkeypatch.setattr(license_scan, "_may_hold", lambda text, known: F.lit(True))
    assert got == scan() and {r[0] for r in got if r[1]} == {0, 1, 2, 5, 6}
    monkeypatch.undo()
    plan = documents(rows).select(license_scan._may_hold(F.col("text"), known).alias("may"), "doc_id")
    assert {r.doc_id for r in plan.where("may").collect()} <= set(range(len(hidden))) - {7}


GNU = "    This program is free software{0} you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation{1} either version {2} of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n\n    You should have received a copy of the GNU General Public License\n    along with this program.  If not, see <https://www.gnu.org/licenses/>.\n"
BSD = "Copyright (c) 2020, A. Nyone\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n{0}Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n{2}\n{1}Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
NOTICES = {
    "apache-2.0": "   Copyright 2020 A Nyone\n\n   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0\n\n   Unless required by applicable law or agreed to in writing, software\n   distributed under the License is distributed on an \"AS IS\" BASIS,\n   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n   See the License for the specific language governing permissions and\n   limitations under the License.\n",
    "gpl-3.0": GNU.format(":", ",", 3),
    "gpl-2.0": GNU.format(";", ";", 2),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    "isc": "Copyright (c) 2020 A. Nyone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.\n",
}


def test_published_licence_notices(documents):
    rows = [(n, t) for n, t in enumerate(NOTICES.values())]
    more = [BSD.format("1. ", "2. ", ""), BSD.format("1. ", "2. ", "\n"), BSD.format("* ", "* ", "\n"), NOTICES["mpl-2.0"].replace("v. 2.0", "v. 1.1")]
    found = {r.doc_id: r.licence for r in license_scan.license_scan(documents([*rows, *[(100 + n, t) for n, t in enumerate(more)]])).collect()}
    assert found == {**dict(enumerate(NOTICES)), 100: "bsd", 101: "bsd", 102: "bsd", 103: None}


def test_an_apache_header_by_its_first_sentence(documents):
    first = NOTICES["apache-2.0"].split("   You may")[0]
    assert [(r.licence, r.n_rules) for r in license_scan.license_scan(documents([(1, first)])).collect()] == [("apache-2.0", 1)]
