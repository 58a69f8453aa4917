"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-cased word tokens.  The vocabulary holds every term that two labelled examples
share.  A term's weight is its inverse document frequency, scaled up by how much its presence
differs between the two classes (likelihood-ratio statistic), so that the cosine follows wording
that bears on the label before length or topic.  Examples are indexed in an inverted index whose
postings are cut into blocks of examples.  Most terms have few postings, which are added up
directly.  The few very frequent terms keep, for every block, their largest weight there and all
weights of the block as a small matrix: what the rare terms gave plus the block maxima bounds every
example of a block, blocks are visited in the order of these bounds, and those whose bound lies
below the k-th cosine found are passed over: the neighbours are exact.  Texts are searched in
groups, so that a block is visited once for all texts that need it.

Votes are weighted by nearness and smoothed with the rate among all examples of the same kind
(with or without vocabulary terms), which keeps scores calibrated where neighbours are few.
A text without any known word (also an empty or null one) has no direction; its neighbours
are the examples without such terms, and its score is their rate.

The labelled examples are bounded by ``max_examples``; all their terms are used, and everything
that is scored is scored whole.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

MAX_EXAMPLES = 8_000
MIN_EXAMPLES = 2
NEIGHBOURS = 15
BLOCK = 64
#: So many of the most frequent terms have block maxima and block matrices.
FREQUENT = 384
#: Blocks that a text visits first, then next; then all whose bounds still reach.
VISITED = (2, 8)
#: Texts that are searched together.
GROUP = 32
TERM = re.compile(r"\w+")


def terms(text: str, vocabulary: dict[str, int] | None = None) -> Counter:
    """How often each term occurs, of ``vocabulary`` only if it is given."""
    found = TERM.findall(text.lower())
    return Counter(found if vocabulary is None else filter(vocabulary.__contains__, found))


@dataclass
class Index:
    """Examples as an inverted index with block maxima."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    frequent: np.ndarray  # of each term, its number among the frequent ones, or -1
    starts: np.ndarray  # of each term's postings, and those of the next
    posting: np.ndarray  # example numbers, ascending within a term
    weight: np.ndarray
    rate: float  # of label 1 among examples with vocabulary terms
    bare_rate: float  # and among those without
    bare_ids: list[int]
    blocks: np.ndarray | None = field(default=None, repr=False)  # [block, frequent term, example]

    def __getstate__(self):
        return self.__dict__ | {"blocks": None}

    def matrices(self) -> np.ndarray:
        """Weights of the frequent terms, a matrix for each block; made once where it is used."""
        if self.blocks is None:
            chosen = np.flatnonzero(self.frequent >= 0)
            own, term = spread(self.starts, chosen, self.frequent[chosen])
            self.blocks = np.zeros((-(-len(self.ids) // BLOCK), len(chosen), BLOCK))
            self.blocks[self.posting[own] // BLOCK, term, self.posting[own] % BLOCK] = self.weight[own]
        return self.blocks

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights of the vocabulary terms of a text."""
        found = sorted((self.vocabulary[t], n) for t, n in counts.items())
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.array([t for t, _ in found])
        w = np.array([1 + math.log(n) for _, n in found]) * self.idf[at]
        return at, w / math.sqrt(float(w @ w))

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term number, unit weight) of every vocabulary term of every text."""
        size, absent = len(self.vocabulary), itertools.repeat(-1)
        found = [np.array(list(map(self.vocabulary.get, TERM.findall(t.lower()), absent)), np.int64) for t in texts]
        term = np.concatenate([*found, np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        key, n = np.unique((row * size + term)[term >= 0], return_counts=True)
        row, term = key // max(1, size), key % max(1, size)
        w = (1 + np.log(n)) * self.idf[term]
        return row, term, w / np.sqrt(np.bincount(row, w * w, minlength=len(texts)))[row]

    def search(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, texts: int, k: int) -> list[list[tuple[float, int]]]:
        """For each of ``texts`` vectors the k examples of largest cosine as (cosine, example number); ties by number."""
        matrices = self.matrices()
        many, size = len(matrices), len(matrices) * BLOCK
        if not many:
            return [[] for _ in range(texts)]
        rare = self.frequent[term] < 0
        i, x = spread(self.starts, term[rare], w[rare])
        at = spread(self.starts, term[rare], row[rare])[1]
        near = np.bincount(at * size + self.posting[i], x * self.weight[i], minlength=texts * size).astype(float).reshape(texts, many, BLOCK)
        query = np.zeros((texts, matrices.shape[1]))
        query[row[~rare], self.frequent[term[~rare]]] = w[~rare]
        bounds = near.max(axis=2) + query @ matrices.max(axis=2).T
        order = np.argsort(-bounds, axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(many)[None, :], axis=1)
        visited = np.zeros(bounds.shape, bool)
        least = np.zeros(texts)
        for most in (*VISITED, many):
            # a bound that only ties with the k-th cosine may still hold a smaller number
            wanted = (rank < most) & ~visited & (bounds > 0) & (bounds >= least[:, None] - 1e-9)
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                near[rows, b] += query[rows] @ matrices[b]
            visited |= wanted
            first = np.take_along_axis(near, order[:, : min(most, VISITED[-1]), None], axis=1).reshape(texts, -1)
            seen = np.take_along_axis(visited, order[:, : min(most, VISITED[-1])], axis=1)
            first[np.repeat(~seen, BLOCK, axis=1)] = 0
            if most < many and first.shape[1] >= k:
                least = np.partition(first, -k, axis=1)[:, -k]
        near[~visited] = 0
        near = near.reshape(texts, size)
        q, number = np.nonzero((near > 0) & (near >= least[:, None] - 1e-9))
        cosine = np.round(near[q, number], 12)
        sort = np.lexsort((number, -cosine, q))
        q, number, cosine = q[sort], number[sort].tolist(), cosine[sort].tolist()
        begin = np.searchsorted(q, np.arange(texts + 1)).tolist()
        return [list(zip(cosine[a : min(a + k, b)], number[a : min(a + k, b)], strict=True)) for a, b in itertools.pairwise(begin)]

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of largest cosine with one vector."""
        return self.search(np.zeros(len(at), np.int64), at, w, 1, k)[0]

    def votes(self, texts: list[str], k: int) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids of the neighbours, their cosines) of every text; equal texts are searched once."""
        number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        unique = list(number)
        found: list[tuple[float, list[int], list[float]]] = []
        for low in range(0, len(unique), GROUP):
            group = unique[low : low + GROUP]
            row, term, w = self.vectors(group)
            known = np.bincount(row, minlength=len(group)) > 0
            for best, any_ in zip(self.search(row, term, w, len(group), k), known, strict=True):
                if not any_:
                    found.append((self.bare_rate, self.bare_ids[:k], [0.0] * len(self.bare_ids[:k])))
                    continue
                near = [1 / (0.1 + 1 - c) for c, _ in best]
                own = sum(v for v, (_, i) in zip(near, best, strict=True) if self.labels[i])
                found.append(((own + self.rate) / (sum(near) + 1), [int(self.ids[i]) for _, i in best], [c for c, _ in best]))
        return [found[number[t]] for t in texts]

    def vote(self, text: str, k: int) -> tuple[float, list[int], list[float]]:
        return self.votes([text], k)[0]


def spread(starts: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from starts[a] to starts[a + 1] for each a of ``at``, and the weight ``w`` of their a."""
    n = starts[at + 1] - starts[at]
    return np.repeat(starts[at] - n.cumsum() + n, n) + np.arange(n.sum()), np.repeat(w, n)


def build(
    vocabulary: list[str], found: list[tuple[int, int, list[str], list[int]]], k: int = NEIGHBOURS, scale: np.ndarray | None = None
) -> Index:
    """``found``: (doc_id, label, vocabulary terms, counts) of every example; ``scale``: factors of the terms' weights."""
    number = {t: i for i, t in enumerate(vocabulary)}
    n = max(1, len(found))
    df = np.zeros(len(vocabulary))
    for _, _, own, _ in found:
        df[[number[t] for t in own]] += 1
    idf = (np.log((1 + n) / (1 + df)) + 1) * (1.0 if scale is None else scale)
    bare = sorted(r for r in found if not r[2])
    # examples that share their weightiest terms lie together, which makes the block maxima tight
    heavy = lambda own: sorted((-idf[number[t]], number[t]) for t in own)[:8]
    rows = sorted((r for r in found if r[2]), key=lambda r: (heavy(r[2]), r[0]))
    at, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for _, _, own, counts in rows:
        at.append(np.array([number[t] for t in own], np.int64))
        w = (1 + np.log(np.array(counts, float))) * idf[at[-1]]
        weights.append(w / np.sqrt(w @ w))
    term, weight = np.concatenate(at), np.concatenate(weights)
    posting = np.repeat(np.arange(len(rows)), [len(x) for x in at[1:]])
    order = np.lexsort((posting, term))
    term, weight, posting = term[order], weight[order], posting[order].astype(np.int32)
    starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    frequent = np.full(len(vocabulary), -1)
    most = np.argsort(-np.diff(starts), kind="stable")[:FREQUENT]
    frequent[most] = np.argsort(np.argsort(most))
    labels = np.array([r[1] for r in rows], int)
    base = sum(r[1] for r in found) / n
    smooth = lambda own: (sum(own) + base) / (len(own) + 1)
    return Index(
        number, idf, np.array([r[0] for r in rows], np.int64), labels, frequent, starts, posting, weight,
        smooth(labels.tolist()), smooth([r[1] for r in bare]), [r[0] for r in bare][:k],
    )


def fit(examples: DataFrame, k: int = NEIGHBOURS) -> Index:
    """Index of ``examples`` (doc_id, label, text), whose number the caller bounds.

    Term statistics are counted by Spark; the driver receives the vocabulary and, of each
    example, the numbers of its vocabulary terms.
    """

    def counted(text):
        own = [sorted(terms(t).items()) for t in common.texts(text)]
        return [[t for t, _ in x] for x in own], [[n for _, n in x] for x in own]

    words = common.stage(
        common.with_columns(examples, counted, ["text"], "terms array<string>, counts array<int>", ["doc_id", "label"]), "terms"
    )
    rows = words.groupBy("label").count().collect()
    n1 = sum(r["count"] for r in rows if r["label"] == 1)
    n0 = sum(r["count"] for r in rows if r["label"] == 0)
    a, b = F.col("a"), F.col("b")
    n, df = float(n0 + n1), a + b

    def part(seen, of):  # seen * ln(seen / expected)
        return F.when(seen > 0, seen * F.log(seen * n / of)).otherwise(0.0)

    statistic = 2 * (part(a, df * n1) + part(b, df * n0) + part(n1 - a, (n - df) * n1) + part(n0 - b, (n - df) * n0))
    vocabulary = (
        words.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
        .where(df >= MIN_EXAMPLES)
        .select("term", statistic.alias("s"))
        .toArrow()
        .sort_by("term")
    )
    chosen = vocabulary["term"].to_pylist()
    number = {t: i for i, t in enumerate(chosen)}

    def only(own, counts):
        pairs = [[(number[t], n) for t, n in zip(*x, strict=True) if t in number] for x in zip(own.to_pylist(), counts.to_pylist(), strict=True)]
        return [[t for t, _ in x] for x in pairs], [[n for _, n in x] for x in pairs]

    found = common.with_columns(words, only, ["terms", "counts"], "own array<int>, n array<int>", ["doc_id", "label"]).toArrow()
    rows = [(i, label, [chosen[t] for t in own], n) for i, label, own, n in zip(*(c.to_pylist() for c in found.columns), strict=True)]
    return build(chosen, rows, k, 1 + vocabulary["s"].to_numpy())


def score(df: DataFrame, index: Index, keep: list[str] | None = None, k: int = NEIGHBOURS, threshold: float = 0.7) -> DataFrame:
    """Adds score, predicted, neighbours (example ids) and cosines to every row of ``df``.

    Null and empty texts get the rate of the examples without known words.  Columns of
    ``df`` with these names are replaced; repeated rows stay; an empty table stays empty.
    """

    def voted(text):
        got = index.votes(common.texts(text), k)
        scores = [g[0] for g in got]
        return scores, [int(s >= threshold) for s in scores], [g[1] for g in got], [g[2] for g in got]

    return common.with_columns(df, voted, ["text"], "score double, predicted int, neighbours array<long>, cosines array<double>", keep)


def harmless(df: DataFrame, index: Index, k: int = NEIGHBOURS, threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``, with all columns.

    Null and empty texts are judged by the rate of the examples without known words; repeated
    rows share their verdict and stay or go together; an empty table stays empty.
    """

    def below(text):
        return [[v[0] < threshold for v in index.votes(common.texts(text), k)]]

    return common.with_columns(df, below, ["text"], "__harmless boolean").where("__harmless").select(df.columns)


def fit_labels(documents: DataFrame, labels: DataFrame, held: int = 1, by: int = 3, limit: int = MAX_EXAMPLES) -> Index:
    """Index of the labelled documents outside the held-out fold, at most ``limit`` of them."""
    sample = common.label_sample(labels, "toxic", common.remainder("doc_id", by) != held, limit)
    # at most ``limit`` pairs of numbers are broadcast
    return fit(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]))
