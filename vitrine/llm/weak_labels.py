"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

Labellers vote good, bad or neither on every document, or give no answer where it is too short for them. Their votes are counted by pattern over all documents:
with k labellers there are at most 4^k patterns, whatever the corpus, so expectation-maximisation runs on that
table. It estimates how often each labeller is right on good and on bad documents. The posteriors of a bounded
sample, weighted, train a logistic regression over hashed byte n-grams, which then scores every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.batches import small_batches
from vitrine.llm.quality_rules import cells_of
from vitrine.llm.words import text_or_empty
from vitrine.session import materialize

#: Documents of each predicted class that the scorer is fitted on; the choice is by a hash of the text.
SAMPLE = 4000
CELLS = 1024
GRAM = 3
#: N-grams at which a text's features count half.
FEW = 100

# Function words of the corpus's languages, whose absence marks text that is no prose.
COMMON = ["the", "and", "of", "to", "in", "that", "de", "la", "et", "le", "que", "und", "der", "die", "den", "el", "los", "en", "y"]
KNOWN = {w.encode() for c in COMMON for w in (c, c.capitalize())}
# The symbols that count as noise.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Figures:
    """What the labellers look at."""

    words: int
    chars: int
    symbols: int
    exclamations: int
    capitals: int
    distinct_words: int
    lines: int
    distinct_lines: int
    common: int
    stops: int


def figures(text: str) -> Figures:
    """`chars` are those inside words, `capitals` the upper-case letters of ASCII and Latin-1, `lines` those with a word, `stops` the
    full stops at a word's end."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    b = np.frombuffer(raw, np.uint8)
    wide = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    return Figures(
        words=len(words),
        chars=len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")),
        symbols=sum(raw.count(bytes([c])) for c in SYMBOLS),
        exclamations=raw.count(b"!"),
        capitals=int(((b >= 65) & (b <= 90)).sum() + wide.sum()),
        distinct_words=len(set(words)),
        lines=len(lines),
        distinct_lines=len(set(lines)),
        common=sum(map(KNOWN.__contains__, words)),
        stops=raw.count(b". ") + raw.count(b".\n") + raw.endswith(b"."),
    )


@dataclass(frozen=True)
class Labeller:
    """A vote by two conditions: bad where the first holds, else good where the second does, else none.

    A text of fewer than `least` words is too short for the labeller: it gives no answer at all.
    """

    name: str
    bad: Callable[[Figures], bool]
    good: Callable[[Figures], bool] = lambda f: False
    least: int = 0

    def answer(self, f: Figures) -> str:
        return "?" if f.words < self.least else "-" if self.bad(f) else "+" if self.good(f) else "0"


# Each of them knows one kind of junk; what is no junk of that kind may still be junk, so they seldom vote good.
LABELLERS = [
    Labeller("symbols", lambda f: f.symbols > 0.1 * f.words),
    Labeller("capitals", lambda f: f.capitals > 0.3 * f.chars, least=20),
    Labeller("exclamations", lambda f: f.exclamations > 0.3 * f.words),
    Labeller("variety", lambda f: f.distinct_words < 0.3 * f.words, least=20),
    Labeller("lines", lambda f: f.lines >= 4 and f.distinct_lines < 0.5 * f.lines),
    Labeller("word_length", lambda f: f.chars > 8 * f.words or f.chars < 3 * f.words, least=20),
    Labeller("function_words", lambda f: f.common < 0.02 * f.words, lambda f: f.common > 0.06 * f.words, least=40),
    Labeller("sentences", lambda f: f.stops < 0.005 * f.words, lambda f: 0.02 * f.words < f.stops < 0.3 * f.words, least=40),
]


def pattern_of(text: str, labellers: list[Labeller]) -> str:
    """One character per labeller: - for bad, + for good, 0 for neither, ? for no answer."""
    f = figures(text)
    return "".join(v.answer(f) for v in labellers)


@dataclass
class LabelModel:
    """What expectation-maximisation found: the share of good documents, and each labeller's votes given the class."""

    prior: float
    rates: np.ndarray  # class (bad, good) x labeller x answer (-, 0, +)

    @staticmethod
    def _codes(patterns: list[str]) -> np.ndarray:
        return np.array([["-0+?".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(patterns[0]) if patterns else 0)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability that a document with these votes is good. To vote neither way is an answer too."""
        codes = self._codes(patterns)
        if not patterns:
            return np.zeros(0)
        each = np.arange(codes.shape[1])
        known = np.concatenate([np.log(self.rates), np.zeros((2, len(each), 1))], axis=2)  # no answer says nothing
        bad, good = (known[c, each, codes].sum(1) for c in range(2))
        odds = math.log(1 - self.prior) - math.log(self.prior) + bad - good
        return 1 / (1 + np.exp(np.clip(odds, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        bad, good = (1 - self.prior) * self.rates[0], self.prior * self.rates[1]
        return (bad[:, 0] + good[:, 2]) / np.maximum(bad[:, [0, 2]].sum(1) + good[:, [0, 2]].sum(1), 1e-12)


def fit_labels(patterns: list[str], counts: list[int], k: int, rounds: int = 100, prior: float = 0.8) -> LabelModel:
    """Expectation-maximisation over the table of vote patterns.

    It starts from labellers that catch a third of what is bad and accuse one good document in fifty. Votes
    count as independent given the class. Without any document the model is its starting point.
    """
    codes, n = LabelModel._codes(patterns), np.array(counts, float)
    model = LabelModel(prior, np.array([[[0.33, 0.57, 0.1]] * k, [[0.02, 0.58, 0.4]] * k]))
    for _ in range(rounds if len(patterns) else 0):
        good = model.posterior(patterns)
        weight = np.stack([n * (1 - good), n * good])
        rates = np.array([[[weight[c, codes[:, j] == v].sum() + 0.1 for v in range(3)] for j in range(k)] for c in range(2)])
        new = LabelModel(float(np.clip(weight[1].sum() / n.sum(), 0.01, 0.99)), rates / rates.sum(2, keepdims=True))
        settled = abs(new.prior - model.prior) < 1e-9 and np.abs(new.rates - model.rates).max() < 1e-9
        model = new
        if settled:
            break
    return model


def features_of(text: str, cells: int) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams and of runs of three words by whether each is new in the text.

    A text of few n-grams says little, so its features are shrunk and its score stays near the prior.
    """
    grams = cells_of(text, GRAM, cells)
    total = int(grams.sum())
    seen: dict[bytes, int] = {}
    words = text.encode().split()
    new = np.array([seen.setdefault(w, i) == i for i, w in enumerate(words)], np.int64)
    runs = np.bincount(new[:-2] * 4 + new[1:-1] * 2 + new[2:], minlength=8) if len(new) > 2 else np.zeros(8)
    shares = np.concatenate([grams / max(1, total), runs / max(1, runs.sum())])
    return np.sqrt(shares) * (total / (total + FEW))


Verdict = Callable[[Iterable[str]], tuple[list[str], np.ndarray, np.ndarray]]


def _judge(docs: DataFrame, text_col: str, labellers: list[Labeller], sample: int, cells: int) -> Verdict:
    """Fit both models; the result gives the patterns, posteriors and scores of texts."""
    small_batches(docs.sparkSession)
    read = docs.select(text_or_empty(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            seen.update(pattern_of(t, labellers) for t in b["text"])
        yield pd.DataFrame(list(seen.items()), columns=["pattern", "n"])

    counted = read.mapInPandas(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    table = {r["pattern"]: r["n"] for r in counted.orderBy("pattern").collect()}  # 4 to the power of the labellers at most
    model = fit_labels(list(table), list(table.values()), len(labellers))
    posterior = dict(zip(table, model.posterior(list(table)).tolist(), strict=True))
    sides = [sum(n for p, n in table.items() if (posterior[p] >= 0.5) == good) for good in (False, True)]
    share = [min(1.0, sample / max(1, n)) for n in sides]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                if (draw := xxhash.xxh64_intdigest(t.encode(), 11) / 2**64) < max(share):
                    p = posterior[pattern_of(t, labellers)]
                    if draw < share[p >= 0.5]:
                        rows.append((p, features_of(t, cells)))
            yield pd.DataFrame(rows, columns=["posterior", "x"])

    weights, intercept = None, 0.0
    if all(sides):
        chosen = materialize(read.mapInPandas(choose, "posterior double, x array<double>"), "weak-sample")
        # A posterior is a weighted example of each class.
        x = array_to_vector("x").alias("features")
        good = chosen.select(x, F.lit(1.0).alias("label"), F.col("posterior").alias("w"))
        bad = chosen.select(x, F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("w"))
        fitted = LogisticRegression(weightCol="w", maxIter=60, regParam=1e-4, standardization=False, tol=1e-8).fit(good.unionByName(bad).where("w > 0"))
        # The sample holds both sides alike; the corpus does not.
        weights = np.array(fitted.coefficients.toArray())
        intercept = float(fitted.intercept) + math.log(share[0] / share[1])

    def verdict(texts: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        texts = list(texts)
        patterns = [pattern_of(t, labellers) for t in texts]
        p = np.array([posterior[x] for x in patterns], float)
        s = p if weights is None else 1 / (1 + np.exp(-np.clip(np.array([features_of(t, cells) @ weights + intercept for t in texts], float), -500, 500)))
        return patterns, p, s

    return verdict


def classify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    labellers: list[Labeller] = LABELLERS,
    sample: int = SAMPLE,
    cells: int = CELLS,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: the id, votes (the pattern), posterior, score, kept.

    `posterior` is the label model's probability that the document is good, `score` the scorer's; a document
    is kept when its score reaches `threshold`. The label model is estimated over all documents, the scorer
    fitted on about `sample` documents of each side, or all if there are fewer, chosen by a hash of the text.
    When all posteriors fall on one side, or the table is empty, there is nothing to fit and the score is the
    posterior. A null text is an empty one; texts of fewer than three bytes have no features and score by the
    intercept. Rows that repeat get the same verdict. Only id and text are read.
    """
    verdict = _judge(docs, text_col, labellers, sample, cells)
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            patterns, p, s = verdict(b["text"])
            yield pd.DataFrame({"id": b["id"], "votes": patterns, "posterior": p, "score": s, "kept": s >= threshold})

    return read.mapInPandas(score, f"id {kind}, votes string, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", labellers: list[Labeller] = LABELLERS, sample: int = SAMPLE, cells: int = CELLS, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that `classify` keeps; every row is judged where it lies."""
    verdict = _judge(docs, text_col, labellers, sample, cells)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdict(t or "" for t in b.column(at).to_pylist())[2] >= threshold))

    return docs.mapInArrow(keep, docs.schema)
