"""License scans: known licence sentences become identifiers, and identifier runs are held against ordered rules.

A text is read twice, once with every line as a sentence boundary and once with single line breaks joined, so
both one-line notices and hard-wrapped licence texts are found. Sentences are normalised to lower-case words
of letters and digits. The dictionary and the rules are constants of the plan: nothing is joined. Only texts that hold a
word of some known sentence are cut at all: a plain search for a few such words spares the others the regular expressions.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.words import text_or_empty

# Sentences of published licence notices, in the order of their licences.
NOTICES = [
    "Released under the MIT License.",
    "Licensed under the MIT License.",
    "This project is licensed under the MIT License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "See the License for the specific language governing permissions and limitations under the License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU General Public License for more details.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Licensed under CC BY 4.0.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "This is free and unencumbered software released into the public domain.",
    "All rights reserved.",
    "You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
]
#: Stands in a run for one unknown sentence.
ANY = None

# A licence and the run of notices (positions above) that declares it, strongest evidence first.
NOTICE_RULES = [
    ("mit", (3, 4, 5)),
    ("mit", (3, 4)),
    ("mit", (0,)),
    ("mit", (1,)),
    ("mit", (2,)),
    ("apache-2.0", (7, 8, 9, 10)),
    ("apache-2.0", (7, 27, 28, 9, 10)),
    ("apache-2.0", (7, 8)),
    ("apache-2.0", (7, 27, 28)),
    ("apache-2.0", (7,)),
    ("apache-2.0", (6,)),
    ("gpl-3.0", (12, 14, 15)),
    ("gpl-3.0", (12,)),
    ("gpl-3.0", (11,)),
    ("gpl-2.0", (13, 14, 15)),
    ("gpl-2.0", (13,)),
    ("bsd", (16, 17, 18)),
    ("bsd", (16, ANY, 17, ANY, 18)),  # a list number with a full stop is a sentence of its own
    ("isc", (19,)),
    ("mpl-2.0", (20,)),
    ("cc-by-4.0", (21,)),
    ("cc-by-4.0", (24,)),
    ("cc-by-sa-4.0", (22,)),
    ("cc-by-nc-4.0", (23,)),
    ("unlicense", (25,)),
    ("all-rights-reserved", (26,)),
]


#: Ends a sentence, besides a line feed.
MARK = r"[.!?:][ \t\r\f\x0B]"


def plain(sentence: str) -> str:
    """A sentence as the normalised texts hold it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def code(n: int | None) -> str:
    """One character for each known sentence; an unknown one is a dot."""
    return "." if n is ANY else chr(0x100 + n)


def split_notices(notices: list[str], rules: list[tuple[str, tuple[int | None, ...]]]) -> tuple[list[str], list[tuple[str, tuple[int | None, ...]]]]:
    """The notices cut into sentences as texts are, each once, and the rules over them."""
    place: dict[str, int] = {}
    kept, runs = [], []
    for notice in notices:
        pieces = [x for x in re.split(MARK, notice) if plain(x)]
        for x in pieces:
            if plain(x) not in place:
                place[plain(x)] = len(kept)
                kept.append(x)
        runs.append(tuple(place[plain(x)] for x in pieces))
    return kept, [(name, tuple(m for n in run for m in ((ANY,) if n is ANY else runs[n]))) for name, run in rules]


SENTENCES, RULES = split_notices(NOTICES, NOTICE_RULES)


def _sentences(text: Column) -> Column:
    """Normalised sentences: a full stop, exclamation or question mark or colon before a blank ends one, and so does a line feed."""
    marked = F.regexp_replace(F.lower(text), MARK, "\n")
    return F.transform(F.split(F.regexp_replace(marked, "[^a-z0-9\n]+", " "), "\n"), lambda s: F.trim(s))


def _codes(sentences: Column, known: list[str]) -> Column:
    """The text as a string of sentence codes, empty sentences left out, or an empty string when none is known."""
    one = F.create_map(*[F.lit(x) for n, s in enumerate(known) for x in (s, code(n))])
    coded = F.transform(F.filter(sentences, lambda s: s != ""), lambda s: F.when(s.isin(known), one[s]).otherwise(F.lit(".")))
    return F.when(F.exists(sentences, lambda s: s.isin(known)), F.array_join(coded, "")).otherwise(F.lit(""))


def anchors(known: list[str]) -> list[str]:
    """A few words of which every known sentence has at least one: longer words, those of many sentences first."""
    left, out = [set(w for w in s.split(" ") if len(w) >= min(7, max(map(len, s.split(" "))))) for s in known], []
    while left:
        out.append(max(sorted(set().union(*left)), key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


def _may_hold(text: Column, known: list[str]) -> Column:
    """False only where neither reading of the text has a known sentence: a word stands in it unbroken once carriage returns, which one reading drops, are gone."""
    low = F.lower(F.replace(text, F.lit("\r"), F.lit("")))
    return functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in anchors(known)], F.lit(False))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: list[str] | None = None,
    rules: list[tuple[str, tuple[int, ...]]] | None = None,
) -> DataFrame:
    """One row per input row: its id, licence (of the first rule that holds), licences, n_rules, n_sentences.

    A rule holds when its sentences follow each other directly, empty sentences aside, in either reading of
    the text. Sentences that hold a mark inside are cut there, as the text is, and count as that many. `licences` names each licence once, in rule order, joined by commas; n_rules counts the rules
    that hold and n_sentences the known sentences of the reading by lines. Without a match licence is null,
    licences empty. A null text has no sentences. Other columns are not read.
    """
    sentences, rules = split_notices(NOTICES if sentences is None else sentences, NOTICE_RULES if rules is None else rules)
    known = [plain(s) for s in sentences]
    whole = text_or_empty(text_col)
    docs = docs.select(F.col(id_col), F.when(_may_hold(whole, known), whole).otherwise(F.lit("")).alias("_text"))
    text = F.col("_text")
    # A lone line feed is joined, two or more stay a boundary.
    joined = F.regexp_replace(F.regexp_replace(text, r"\r", ""), r"([^\n])\n([^\n])", "$1 $2")
    read = docs.select(F.col(id_col), _codes(_sentences(text), known).alias("_lines"), _codes(_sentences(joined), known).alias("_joined"))
    runs = [(name, "".join(code(n) for n in run)) for name, run in rules]
    holds = F.array(*[F.when(F.col("_lines").contains(run) | F.col("_joined").contains(run), F.lit(name)) for name, run in runs])
    found = read.select(id_col, "_lines", F.when((F.col("_lines") != "") | (F.col("_joined") != ""), F.array_compact(holds)).otherwise(F.array().cast("array<string>")).alias("_found"))
    return found.select(
        id_col,
        F.get("_found", F.lit(0)).alias("licence"),
        F.array_join(F.array_distinct("_found"), ",").alias("licences"),
        F.size("_found").cast("long").alias("n_rules"),
        F.char_length(F.replace(F.col("_lines"), F.lit("."), F.lit(""))).cast("long").alias("n_sentences"),
    )
