"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into quantile bins.  Shallow trees, boosted by turns over the features
(one feature after the other, small steps, on the logistic loss), add up to one lookup table
per feature; then the pairs with the largest gain on what is left get two-dimensional tables
the same way.  A text's score is the logistic function of the sum of its table entries, so
scoring is a bin search and one addition per table, vectorised over Arrow batches.

The model is fitted on at most ``MAX_EXAMPLES`` labelled rows.  Every text is scored whole.
Empty and null texts have all statistics zero and are scored like any other.
"""

from __future__ import annotations

import itertools
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

MAX_EXAMPLES = 20_000
BINS = 32
COARSE = 8
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
SHRINK = 2.0

FEATURES = (
    "words", "word_chars", "symbols", "upper", "exclaimed", "piped", "digits", "punctuated",
    "unique", "top_word", "repeated", "duplicate_lines", "line_words", "stopped_lines", "letters",
)
UPPER = string.ascii_uppercase.encode()
SYMBOLS = b"#*$%&|<>"
OTHER = string.punctuation.encode() + string.digits.encode() + string.whitespace.encode()


def features(text: str) -> list[float]:
    """Statistics of one text, in the order of FEATURES; all zero without words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)

    def found(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeated = 0.0
    if n >= 3:
        pairs = at[:-2] * len(number) + at[1:-1]
        triples = np.unique(pairs, return_inverse=True)[1] * len(number) + at[2:]
        repeated = 1 - len(np.unique(triples)) / len(triples)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(n), sum(map(len, words)) / n, found(SYMBOLS) / n, found(UPPER) / len(data), data.count(b"!") / n, data.count(b"|") / n,
        found(string.digits.encode()) / len(data), found(string.punctuation.encode()) / n, len(number) / n, np.bincount(at).max() / n,
        repeated, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        1 - found(OTHER) / len(data),
    ]


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Bin edges, one table per feature and one per chosen pair."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]  # of each fine bin, its bin in pair tables
    start: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.start)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return logistic(total)


def leaf(gradient, weight):
    return gradient / (weight + SHRINK)


def gain(gradient, weight):
    return gradient * gradient / (weight + SHRINK)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The tree of at most ``leaves`` leaves over ordered bins, grown by the best cut, as a table."""
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in itertools.pairwise(cuts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            won = gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht)
            k = int(np.argmax(won))
            if won[k] > best[0]:
                best = (won[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    table = np.empty(len(g))
    for a, b in itertools.pairwise(cuts):
        table[a:b] = leaf(g[a:b].sum(), h[a:b].sum())
    return table


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's bins into four quadrants: its gain and its table."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = gs[:-1, :-1], hs[:-1, :-1]
    parts = [
        (a, b),
        (gs[:-1, -1:] - a, hs[:-1, -1:] - b),
        (gs[-1:, :-1] - a, hs[-1:, :-1] - b),
        (gs[-1, -1] - gs[:-1, -1:] - gs[-1:, :-1] + a, hs[-1, -1] - hs[:-1, -1:] - hs[-1:, :-1] + b),
    ]
    won = sum(gain(*p) for p in parts) - gain(gs[-1, -1], hs[-1, -1])
    if not won.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    table = np.empty_like(g)
    low, high = slice(None, i + 1), slice(i + 1, None)
    left, right = slice(None, j + 1), slice(j + 1, None)
    for (rows, cols), (pg, ph) in zip([(low, left), (low, right), (high, left), (high, right)], parts, strict=True):
        table[rows, cols] = leaf(pg[i, j], ph[i, j])
    return float(won[i, j]), table


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted tables for statistics ``x`` and labels ``y``.  Without both classes: the constant rate."""
    width = len(FEATURES)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    coarse = [np.minimum(np.arange(len(e) + 1) * COARSE // (len(e) + 1), COARSE - 1) for e in edges]
    model = Model(edges, coarse, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(x), model.start)
    for _ in range(ROUNDS):
        for j in range(width):
            p = logistic(total)
            size = len(edges[j]) + 1
            step = RATE * shallow(np.bincount(b[:, j], y - p, size), np.bincount(b[:, j], p * (1 - p), size))
            model.tables[j] += step
            total += step[b[:, j]]

    def squares(i, j):
        p = logistic(total)
        cell = coarse[i][b[:, i]] * COARSE + coarse[j][b[:, j]]
        return cell, [np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (y - p, p * (1 - p))]

    ranked = sorted(((quadrants(*squares(i, j)[1])[0], (i, j)) for i, j in itertools.combinations(range(width), 2)), reverse=True)
    model.pairs = [pair for won, pair in ranked[:PAIRS] if won > 0]
    model.pair_tables = [np.zeros((COARSE, COARSE)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            cell, (g, h) = squares(i, j)
            step = RATE * quadrants(g, h)[1]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def measured(text) -> np.ndarray:
    return np.array([features(t) for t in common.texts(text)], float).reshape(-1, len(FEATURES))


def fit(examples: DataFrame) -> Model:
    """Model of ``examples`` (doc_id, label, text), whose number the caller bounds."""
    rows = common.with_columns(examples, lambda text: [measured(text).tolist()], ["text"], "x array<double>", ["doc_id", "label"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    return train(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], float))


def score(df: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted to every row of ``df``; columns with these names are replaced.

    Repeated rows stay and get equal scores; an empty table stays empty.
    """

    def scored(text):
        s = model.score(measured(text))
        return s, (s >= threshold).astype(np.int32)

    return common.with_columns(df, scored, ["text"], "score double, predicted int", keep)


def accepted(df: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` whose score is at least ``threshold``, with all columns.

    Null and empty texts are scored like any other; repeated rows share their verdict; an empty
    table stays empty.
    """

    def enough(text):
        return [model.score(measured(text)) >= threshold]

    return common.with_columns(df, enough, ["text"], "__accepted boolean").where("__accepted").select(df.columns)


def fit_labels(documents: DataFrame, labels: DataFrame, held: int = 2, by: int = 4, limit: int = MAX_EXAMPLES) -> Model:
    """Model of the labelled documents outside the held-out fold, at most ``limit`` of them."""
    sample = common.label_sample(labels, "quality", common.remainder("doc_id", by) != held, limit)
    # at most ``limit`` pairs of numbers are broadcast
    return fit(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]))
