"""Plain versions of the operators, one document after the other."""

from __future__ import annotations

import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def order(k):
    return (k is None, k or 0)


def exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append((k, t or ""))
    out = []
    for k, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (-len(x[1]), order(x[0])))[0]
        out.append((k, keep, len(g), keep == k, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def later_lines(rows, rank, t=0.8):
    """For each different row (id, text) with a line its number of lines and those that an earlier line matches; `rank` orders texts of one id."""
    lines = sorted({(order(k), rank(text), n, frozenset(words(line)), k, text) for k, text in rows for n, line in enumerate((text or "").split("\n")) if words(line)}, key=lambda x: x[:3])
    out = {}
    for i, (k, d, n, s, *row) in enumerate(lines):
        hit = any(x[:3] < (k, d, n) and len(s & x[3]) >= t * len(s | x[3]) - 1e-9 for x in lines[:i])
        out.setdefault(tuple(row), {})[n] = hit
    return {row: (len(v), [n for n, hit in sorted(v.items()) if hit]) for row, v in out.items()}


def repeats(rows, size=20):
    """For each row (id, text) its words and whether each is covered by a window that starts earlier."""
    windows = {}
    for k, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            windows[key] = min(windows.get(key, (order(k), i)), (order(k), i))
    out = []
    for k, text in rows:
        w = words(text)
        covered = [False] * len(w)
        for i in range(len(w) - size + 1):
            if windows[tuple(w[i : i + size])] < (order(k), i):
                covered[i : i + size] = [True] * size
        out.append((k, w, covered))
    return out


def prose(rng: random.Random, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def corpus(seed, docs=60):
    """Documents with exact and near copies, shared lines and passages, blanks of every kind, nulls and empties."""
    rng = random.Random(seed)
    passage, line = prose(rng, 45), prose(rng, 12)
    rows = [(None, None), (None, prose(rng, 30)), (1000, ""), (1001, " \t\n"), (1002, "Ünïcode ß x y 日本語 \U0001f600 don't 12½")]
    for k in range(docs):
        text = "\n".join(prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        kind = rng.random()
        if kind < 0.15 and k:
            text = rows[-1 - rng.randrange(min(k, 10))][1] or ""
            if kind < 0.08:
                w = text.split(" ")
                w[rng.randrange(len(w))] = "changed"
                text = " ".join(w)
        elif kind < 0.3:
            text = text + "\n" + line + "\n" + passage + "\t" + prose(rng, 5)
        elif kind < 0.4:
            text = passage[:80] + "\x0b" + passage + "  " + passage
        elif kind < 0.45:
            text = " ".join(["again and"] * 30)
        rows.append((k, text))
    rows.append(rows[10])
    rng.shuffle(rows)
    return rows
