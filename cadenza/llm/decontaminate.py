"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A passage of m characters that occurs with at most e edits keeps at least
m - q + 1 - q * e of its q-grams, and their places lie on neighbouring diagonals (place in the
document minus place in the passage).  Shared q-grams are therefore counted per passage in
bands of diagonals, each overlapping the next by half, so that one band holds the whole
occurrence.  Bands that reach the bound are kept and verified by an alignment restricted to the
band, in which the passage may begin and end anywhere.

Texts are compared in lower case with each run of white space as one space.  The edit budget is
a share of the passage, lowered where the bound would fall below one q-gram; passages shorter
than a q-gram are sought as they are.  The passages are a query set: they are taken in blocks
of bounded size, every block against all documents, one block at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

Q = 12
EDITS = 0.06
BLOCK_CHARS = 1_000_000
FILTER_BITS = 22
SPANS = "spans array<struct<item_id:long,begin:int,end:int,edits:int>>"
#: Odd multipliers that keep neighbouring parts of a q-gram apart.
MULTIPLIERS = {k: np.uint64(x) for k, x in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93), (8, 0xFF51AFD7ED558CCD))}
_table: list[np.ndarray] = []


def lowered() -> np.ndarray:
    """For every code point below 65536 its lower case, if that is one code point; white space as a space."""
    if not _table:
        low = [ord(c) if len(c) == 1 else i for i, c in ((i, chr(i).lower()) for i in range(65536))]
        _table.append(np.array([32 if chr(i).isspace() else c for i, c in enumerate(low)], np.uint32))
    return _table[0]


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of ``text`` and the place of each in it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = lowered()[codes] if codes.max(initial=0) < 65536 else np.where(codes < 65536, lowered()[np.minimum(codes, 65535)], codes)
    space = low == 32
    keep = np.flatnonzero(~(space & np.concatenate([[False], space[:-1]])))
    return low[keep], keep


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each q-gram; equal q-grams have equal numbers."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)

    def joined(left, right, k):  # numbers of k + len(right's grams) characters from two neighbours
        n = min(len(left), len(right) - k)
        return left[:n] * MULTIPLIERS[k] + right[k : k + n]

    two = joined(wide := codes.astype(np.uint64), wide, 1)
    four = joined(two, two, 2)
    out = joined(joined(four, four, 4), four, 8)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


@dataclass
class Index:
    """Q-grams of a block of passages."""

    ids: list[int]
    codes: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    known: np.ndarray  # by the leading bits of a q-gram's number
    gram: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: list[int]

    @staticmethod
    def of(passages: list[tuple[int, str]], edits: float = EDITS) -> Index:
        ids, codes = [], []
        for i, text in passages:
            c = fold(text)[0]
            c = c[np.flatnonzero(c != 32)[0] : np.flatnonzero(c != 32)[-1] + 1] if (c != 32).any() else c[:0]
            if len(c):
                ids.append(i)
                codes.append(c)
        m = np.array([len(c) for c in codes], np.int64)
        budget = np.maximum(0, np.minimum((m * edits).astype(np.int64), (m - Q) // Q))
        own = [grams(c) for c in codes]
        gram = np.concatenate([*own, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([*(np.arange(len(g)) for g in own), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        gram, item, place = gram[order], item[order], place[order]
        unique, starts = np.unique(gram, return_index=True)
        known = np.zeros(1 << FILTER_BITS, bool)
        known[(unique >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return Index(ids, codes, budget, m - Q + 1 - Q * budget, known, unique, np.append(starts, len(gram)), item, place, [i for i in range(len(ids)) if m[i] < Q])

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of every band that reaches the bound."""
        number = grams(codes)
        at = np.flatnonzero(self.known[(number >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return []
        found = np.minimum(np.searchsorted(self.gram, number[at]), len(self.gram) - 1)
        same = self.gram[found] == number[at]
        at, found = at[same], found[same]
        times = self.starts[found + 1] - self.starts[found]
        if not times.sum():
            return []
        post = np.repeat(self.starts[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item = self.item[post]
        # most passages share a few common q-grams with a text, and too few to matter
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least
        keep = enough[item]
        item, diagonal = item[keep], np.repeat(at, times)[keep] - self.place[post][keep]
        width = self.budget[item] + 1
        band = np.floor_divide(diagonal, width)
        key = np.concatenate([item * (1 << 34) + band + (1 << 33), item * (1 << 34) + band - 1 + (1 << 33)])
        bands, counts = np.unique(key, return_counts=True)
        item, band = bands >> 34, (bands & ((1 << 34) - 1)) - (1 << 33)
        good = counts >= self.least[item]
        width = self.budget[item] + 1
        return list(zip(item[good].tolist(), (band * width)[good].tolist(), ((band + 2) * width - 1)[good].tolist(), strict=True))

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, begin, end, edits) of every occurrence within the budget, by place."""
        codes, places = fold(text)
        hits = []
        for i, low, high in self.candidates(codes):
            hit = aligned(self.codes[i], codes, low, high, int(self.budget[i]))
            if hit:
                hits.append((i, *hit))
        for i in self.short:
            hits += [(i, b, b + len(self.codes[i]), 0) for b in occurrences(self.codes[i], codes)]
        best: list[tuple[int, int, int, int]] = []
        for i, begin, end, edits in sorted(hits, key=lambda h: (h[0], h[3], h[1])):
            if all(i != j or end <= b or begin >= e for j, b, e, _ in best):
                best.append((i, begin, end, edits))
        return sorted((self.ids[i], int(places[b]), int(places[e - 1]) + 1, n) for i, b, e, n in best)


def occurrences(passage: np.ndarray, codes: np.ndarray) -> list[int]:
    """Where a short passage stands between characters that are no letters or digits."""
    text, part = codes.tobytes().decode("utf-32-le", "replace"), passage.tobytes().decode("utf-32-le", "replace")
    found, at = [], text.find(part)
    while at >= 0:
        around = text[max(0, at - 1) : at] + text[at + len(part) : at + len(part) + 1]
        if not any(map(str.isalnum, around)):
            found.append(at)
        at = text.find(part, at + 1)
    return found


def aligned(passage: np.ndarray, codes: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(begin, end, edits) of the best alignment on diagonals low - budget to high + budget, if within budget.

    Cells hold edits and, in their lower bits, the diagonal on which the alignment began.
    """
    m, n = len(passage), len(codes)
    low, high = max(low - budget, -budget), min(high + budget, n - m + budget)
    if high < low:
        return None
    for d in range(max(low, 0), min(high, n - m) + 1):
        if codes[d] == passage[0] and np.array_equal(codes[d : d + m], passage):
            return d, d + m, 0
    width = high - low + 1
    one = 1 << 32
    step = np.arange(width, dtype=np.int64) * one
    far = np.int64(1) << 60
    padded = np.full(m + width + 1, -1, np.int64)
    begin, end = max(0, low), min(n, high + m)
    padded[begin - low : end - low] = codes[begin:end]
    cells = np.arange(width, dtype=np.int64)
    where = np.arange(low, high + 1)
    cells[(where < 0) | (where > n)] = far
    for i in range(m):
        place = where + i  # in the document, of the character matched with passage[i]
        matched = cells + np.where(padded[i : i + width] == passage[i], 0, one)
        matched[(place < 0) | (place >= n)] = far
        skipped = np.append(cells[1:], far) + one
        best = np.minimum(matched, skipped)
        best[place + 1 < 0] = far
        cells = np.minimum.accumulate(best - step) + step
        cells[(place + 1 < 0) | (place + 1 > n)] = far
    k = int(np.argmin(cells))
    edits, start = int(cells[k] >> 32), low + int(cells[k] & (one - 1))
    stop = low + k + m
    return (start, stop, edits) if edits <= budget and stop > start else None


class Blocks(Sequence):
    """The passages (item_id, text) in lists of about ``chars`` characters, each collected when it is asked for.

    Null and empty passages are left out.  More than one block lie in a table on disk, by block.
    """

    def __init__(self, benchmark: DataFrame, chars: int):
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
        total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        self.parts = -(-total // chars)
        numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, self.parts))))
        self.items = numbered if self.parts <= 1 else common.stage(numbered.repartition("block"), "passages")

    def __len__(self) -> int:
        return self.parts

    def __getitem__(self, k: int) -> list[tuple[int, str]]:
        if not 0 <= k < self.parts:
            raise IndexError(k)
        return sorted(((r.item_id, r.text) for r in self.items.where(F.col("block") == k).collect()), key=str)


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Blocks:
    return Blocks(benchmark, chars)


def marked(df: DataFrame, passages: list[tuple[int, str]], keep: list[str] | None = None, edits: float = EDITS) -> DataFrame:
    """Adds spans (item_id, begin, end, edits) to every row: places of the passages in its text."""
    held: list[Index] = []

    def found(text):
        if not held:
            held.append(Index.of(passages, edits))
        names = ("item_id", "begin", "end", "edits")
        return [[[dict(zip(names, s, strict=True)) for s in held[0].find(t)] if t else [] for t in common.texts(text)]]

    return common.with_columns(df, found, ["text"], SPANS, keep)


def matches(df: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, begin, end, edits): one row for every place where a passage stands in a text of ``df``.

    begin and end are code points of the whole text.  Null and empty texts match nothing; equal
    passages are all reported; repeated documents give repeated rows; without passages or
    documents the result is empty.
    """
    out = None
    given = blocks(benchmark)
    for passages in given:
        rows = marked(df, passages, ["doc_id"], edits).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
        if len(given) > 1:  # the plan of one block holds its passages; it is done with before the next is read
            rows = common.stage(rows, "matches")
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        out = marked(df.limit(0), [], ["doc_id"]).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    return out


def clean(df: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``df`` in whose text no passage stands, with all columns.

    Null and empty texts hold no passage and stay; repeated rows share their verdict; without
    passages every row stays; an empty table stays empty.
    """
    out = df
    given = blocks(benchmark)
    for passages in given:
        flagged = common.with_columns(out, counter(passages, edits), ["text"], "__places int")
        out = flagged.where("__places = 0").select(df.columns)
        if len(given) > 1:
            out = common.stage(out, "clean")
    return out


def counter(passages: list[tuple[int, str]], edits: float):
    held: list[Index] = []

    def counted(text):
        if not held:
            held.append(Index.of(passages, edits))
        return [[len(held[0].find(t)) if t else 0 for t in common.texts(text)]]

    return counted
